"""Pages that are hard to parse, headings of articles, and awkward tables of pages."""

from __future__ import annotations

import time
import tracemalloc

import pytest

from badgewright.llm import style_tree

LARGE = {
    "open quotes": '<a b="' * 170_000 + ">",
    "two kinds of quotes": "<a b='" + "<a c=\"" * 90_000 + ">",
    "quotes and ends": '<a ">' * 60_000,
    "nested spans": "<span>" * 100_000 + "deep",
    "ends of nothing": "<span>" * 50_000 + "</b>" * 50_000,
    "rules below a paragraph": "<p>" + "<span>" * 50_000 + "<hr>" * 50_000,
    "items above many spans": "<li><ul>" + "<span>" * 40_000 + "<li></li>" * 40_000,
    "open heads": "<head>" * 150_000,
    "only starts": "<" * 1_000_000,
    "one long tag": "<a" * 500_000 + ">",
    "open comments": "<!--" * 250_000,
}


@pytest.mark.parametrize("name", LARGE)
def test_time_and_memory_grow_with_the_page(name):
    def work(html: str) -> float:
        start = time.process_time()
        body = style_tree.parse(html)
        style_tree.styles(body)
        roots, gone = style_tree.main_parts(body)
        style_tree.blocks(roots, set(), gone)
        return time.process_time() - start

    page = LARGE[name]
    assert work(page) < 10
    tracemalloc.start()
    work(page[: len(page) // 4])
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def texts(body) -> list[str]:
    return style_tree.blocks(style_tree.content_root(body), set())


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<p title=don't>It's here</p>", ["It's here"]),
        ('<p title="a > b">one</p><p>two</p>', ["one", "two"]),
        ('<p title="open>one</p><p>two</p>', ["one", "two"]),
        ("a < b <p>c", ["a < b", "c"]),
        ("a <b", ["a <b"]),
        ("x<!-- <p>y</p> -->z", ["xz"]),
        ("x<!-- never <p>y</p>", ["x"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<p>a<div>b</div>c", ["a", "b", "c"]),
        ("<script>if (a < b) {}</script>t", ["t"]),
        ("</p></div>t", ["t"]),
        ("<p = 'x'>t</p>", ["t"]),
        ("", []),
    ],
)
def test_parse(page, expected):
    assert texts(style_tree.parse(page)) == expected


def rows(spark, pages, schema="page_id bigint, url string, html string"):
    return spark.createDataFrame(pages, schema)


@pytest.mark.parametrize("n", [2, 3, 300])
def test_headings_that_all_articles_have_stay(spark, n):
    page = "<nav>Menu</nav><article><h1>Soup {k}</h1><h2>Ingredients</h2><p>Water and {k} leeks.</p><h2>Steps</h2><p>Boil {k}.</p></article>"
    pages = [(k, "http://r.org/", page.format(k=k)) for k in range(n)]
    found = {r["page_id"]: r["text"] for r in style_tree.extract_text(rows(spark, pages)).collect()}
    assert found == {k: f"Soup {k}\nIngredients\nWater and {k} leeks.\nSteps\nBoil {k}." for k in range(n)}


def test_nulls_repeated_rows_and_clashing_columns(spark):
    page = "<div class='top'>Hello all</div><article><p>Text {k}.</p></article>"
    pages = [(k, "http://a.org/x", page.format(k=k), "x", 1, 2) for k in range(4)]
    pages += [pages[1], pages[1], (None, "http://a.org/", page.format(k=9), "x", 1, 2), (5, None, None, "x", 1, 2), (6, "", "", None, None, None)]
    df = rows(spark, pages, "page_id bigint, url string, html string, text string, page int, twin int")
    found = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in style_tree.extract_text(df).collect()), key=str)
    expected = [(p, u, f"Text {9 if p is None else p}.", 7) for p, u, *_ in pages[:7]] + [(5, None, "", 0), (6, "", "", 0)]
    assert found == sorted(expected, key=str)


def test_long_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph {k} of a page that is long.</p>" for k in range(150_000)) + "</article>"
    found = style_tree.extract_text(rows(spark, [(1, "http://l.org/", long), (2, "http://l.org/", "<p>x</p>")])).collect()
    text = next(r["text"] for r in found if r["page_id"] == 1)
    assert text.count("\n") == 149_999 and text.startswith("Paragraph 0 of") and len(long) > 5_000_000
