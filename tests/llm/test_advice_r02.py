"""What the second review found missing: each test failed before its finding was settled."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from badgewright.llm import divergence, style_tree, toxicity
from badgewright.llm.shared import raw

SMALL = "/root/testdata/sf0.01"
FINNISH = (
    "Vanha kalastaja istui rannalla ja katseli hiljaista merta, joka kimalteli auringon laskiessa. Hän oli elänyt koko "
    "elämänsä samassa kylässä, missä talot olivat pieniä mutta ihmiset ystävällisiä. Joka aamu hän heräsi ennen muita, keitti "
    "kahvia ja lähti veneellään kohti saaria. Verkot olivat usein tyhjiä, mutta se ei häntä haitannut. Tärkeintä oli tuuli, "
    "veden ääni sekä lintujen laulu. Illalla naapurit kokoontuivat nuotion ympärille kertomaan tarinoita menneistä ajoista, "
    "ja lapset kuuntelivat silmät suurina, kunnes yö viimein saapui ja tähdet syttyivät taivaalle heidän yläpuolelleen. "
)


def with_documents(docs, rows):
    """The documents and further ones of (doc_id, text, lang)."""
    more = docs.sparkSession.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return docs.select("doc_id", "text", "lang").union(more)


def test_divergence_rejects_long_texts_without_common_words(spark):
    docs = raw(spark, SMALL, "documents")
    rnd = random.Random(3)
    good = docs.join(raw(spark, SMALL, "labels").where("quality = 1"), "doc_id").where("lang = 'en' AND n_chars > 1500")
    texts = [r["text"] for r in good.orderBy("doc_id").limit(12).collect()]
    shuffled = [" ".join("".join(rnd.sample(w, len(w))) if len(w) > 2 else w[::-1] + "q" for w in t.split()) for t in texts]
    rows = [(-1 - k, t, "en") for k, t in enumerate([*shuffled, FINNISH])]
    found = divergence.judge_documents(with_documents(docs, rows))
    kept = {r["doc_id"]: r["kept"] for r in found.where("doc_id < 0 AND NOT base_failed").collect()}
    assert len(kept) == len(rows) and not any(kept.values())
    labelled = found.join(raw(spark, SMALL, "labels"), "doc_id").where("NOT base_failed")
    share = {r["quality"]: r["kept"] for r in labelled.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.99 and share[0] < 0.2


def texts_of(spark, pages):
    table = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")
    return [r["text"] for r in style_tree.extract_text(table).orderBy("page_id").collect()]


def test_style_tree_names_never_cost_the_article(spark):
    body = "<p>Some long text of the article that nobody else has.</p>"
    menu = '<div class="menu">Other pages</div>'
    pages = [
        f'<div class="layout has-sidebar">{menu}<article><h1 class="article-header">Title</h1>{body}</article></div>',
        f'<div class="layout sidebar">{menu}<article><h1 class="header">Title</h1>{body}</article></div>',
        f'<form id="page"><main><h1>Title</h1>{body}</main></form>',
        f'<div class="widget"><h1>Title</h1>{body}</div>{menu}',
        f'<article><h1>Title</h1>{body}<div class="comments"><p>Nice!</p></div></article><div class="sidebar"><article>Teaser</article></div>',
    ]
    found = texts_of(spark, [(f"http://h{k}.org/", p) for k, p in enumerate(pages)])
    assert found == ["Title\nSome long text of the article that nobody else has."] * len(pages)


def test_style_tree_entropy_decides_on_small_hosts(spark):
    pages = [f'<div class="top">Welcome to our site</div><div class="text"><p>Page {k} tells story {k}.</p></div>' for k in range(6)]
    assert texts_of(spark, [("http://small.org/", p) for p in pages]) == [f"Page {k} tells story {k}." for k in range(6)]


def test_style_tree_keeps_repeated_markup_of_articles_on_hot_hosts(spark):
    page = '<article><h2>{h}</h2><p>Text {k} is <em>{e}</em> and <a href="/x">here</a> it goes on.</p><p class="note">Read our terms.</p></article>'
    pages = [page.format(k=k, h=f"Head {k % 3}", e=f"word{k % 30}") for k in range(900)]
    found = texts_of(spark, [("http://hot.org/", p) for p in pages])
    assert found == [f"Head {k % 3}\nText {k} is word{k % 30} and here it goes on." for k in range(900)]


def test_toxicity_lexicon_is_the_same_for_any_partitions(spark):
    """A neutral word that each task sees once keeps all its clean documents."""
    rows = [(f"filler{k} words zebra stand here", 0) for k in range(40)]
    rows += [(f"other{k} words without it", 0) for k in range(960)]
    rows += [(f"toxic{k} text grumbler zebra", 1) for k in range(8)] + [(f"toxic{k} text grumbler", 1) for k in range(20)]
    sample = spark.createDataFrame(rows, "text string, y int")
    one, many = (toxicity.learn_lexicon(sample.repartition(n)) for n in (1, 400))
    assert one == many and one.kind(b"zebra") == toxicity.OTHER and one.kind(b"grumbler") == toxicity.INSULT
