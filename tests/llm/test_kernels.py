"""The parts of the operators on their own."""

from __future__ import annotations

import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from badgewright.llm import bagminhash, decontaminate, divergence, packing, quality, style_tree, substrings, toxicity
from badgewright.llm.lines import PerfectHash
from badgewright.llm.token_files import TokenFile, TokenWriter, bits_for, pack, unpack
from badgewright.llm.words import split_words, windows

from . import brute


@given(st.lists(st.text(alphabet="ab é\n\t\x0b x", max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_of_arrays(texts):
    words = split_words(pa.array(texts, pa.string()))
    hashes = words.hashes()
    for k, text in enumerate(texts):
        mine = range(words.first[k], words.first[k + 1])
        assert [words.text(i, i + 1).decode() for i in mine] == brute.WORD.findall(text)
    seen = {}
    for i in range(len(hashes)):
        assert seen.setdefault(int(hashes[i]), words.text(i, i + 1)) == words.text(i, i + 1)
    assert list(windows(words, 2)) == [i for i in range(len(hashes)) if i + 1 < len(hashes) and words.row[i] == words.row[i + 1]]


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(0, 2**63, (2, 20_000), dtype=np.uint64)
    h1[:50] = h1[0]  # equal first halves are told apart by the second
    index = PerfectHash.build(h1, h2)
    assert sorted(index.places(h1, h2)) == list(range(20_000))
    again = PerfectHash(index.sizes, index.bits(), index.rest)
    assert (again.places(h1, h2) == index.places(h1, h2)).all()
    assert len(PerfectHash.build(h1[:0], h2[:0]).places(h1[:3], h2[:3])) == 3


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 20, 31])
def test_packing_of_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 777).astype(np.uint32)
    data = pack(ids, bits)
    assert len(data) == -(-777 * bits // 8) and (unpack(data, bits, 777) == ids).all()
    assert bits_for(2**bits) == bits and bits_for(2**bits + 1) == bits + 1


def test_token_file_random_access():
    rng, stream = np.random.default_rng(3), io.BytesIO()
    docs = [rng.integers(0, 50_257, rng.integers(0, 300)).astype(np.uint32) for _ in range(40)]
    closing, stream.close = stream.close, lambda: None
    writer = TokenWriter(stream, bits_for(50_257), block_ids=64)
    for k, ids in enumerate(docs):
        writer.add(k if k else None, ids)
    writer.close()
    file = TokenFile.open(pa.BufferReader(stream.getvalue()))
    closing()
    every = np.concatenate(docs)
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(every) + 1, 2))
        assert (file.ids(a, b) == every[a:b]).all()
    found = [x for low, high in file.runs(500) for x in file.documents(low, high)]
    assert len(found) == 40 and all((a == b).all() for a, b in zip(found, docs, strict=True))


@given(st.lists(st.lists(st.integers(0, 2), max_size=25), min_size=1, max_size=6), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_suffix_automaton_finds_all_repeats(strings, least):
    automaton = substrings.SuffixAutomaton(strings, [1] * len(strings))
    places = [(tuple(s[i : i + least])) for s in strings for i in range(len(s) - least + 1)]
    for s in strings:
        gone = set()
        for i in range(len(s) - least + 1):
            if places.count(tuple(s[i : i + least])) > 1:
                gone |= set(range(i, i + least))
        spans = automaton.repeated(s, least)
        assert {x for a, b in zip(spans[::2], spans[1::2], strict=True) for x in range(a, b)} == gone
        assert spans == sorted(spans)


def test_smallest_takes_the_first_of_ties():
    values = np.random.default_rng(0).integers(0, 4, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 28, 200, 201):
        expected = [i + int(np.argmin(values[i : i + width])) for i in range(max(0, 201 - width))]
        assert list(substrings.smallest(values, width)) == expected


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), max_size=6), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_wu_manber_finds_every_occurrence(items, text, window):
    tables = decontaminate.pattern_tables(((k, " ".join(x)) for k, x in enumerate(items)), window)
    found = {(a, b, k) for a, b, owners in decontaminate.occurrences([x.encode() for x in text], tables) for k in owners}
    expected = set()
    for k, item in enumerate(items):
        size = min(window, len(item))
        for p in {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else ():
            expected |= {(i, i + size, k) for i in range(len(text) - size + 1) if tuple(text[i : i + size]) == p}
    assert found == expected


def test_bagminhash_estimates_weighted_similarity():
    rng, m = np.random.default_rng(5), 4096
    elements = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = rng.integers(1, 12, (2, 60))
    b[:20] = a[:20]
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    row = np.repeat([0, 1], 60)
    s = bagminhash.signatures(row, np.tile(elements, 2), np.concatenate([a, b]), 3, m)
    assert abs((s[0] == s[1]).mean() - truth) < 4 * np.sqrt(truth * (1 - truth) / m)
    assert (s[2] == 0).all()
    # A part of a multiset has no point earlier than the whole.
    less = bagminhash.signatures(row[:60], elements, np.maximum(a - 2, 1), 1, m)
    assert (less[0].view(np.float64) >= s[0].view(np.float64)).all()


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
@settings(max_examples=60, deadline=None)
def test_shortest_pack_first_places_every_piece_once(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    held = {}
    for p in patterns:
        assert 0 < sum(p.lengths) <= 64
        for length in p.lengths:
            held[length] = held.get(length, 0) + p.count
    assert held == histogram
    slots, seen = packing.Slots.of(patterns), set()
    for length, n in histogram.items():
        sequence, offset = slots.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            cells = {(s, x) for x in range(o, o + length)}
            assert not cells & seen
            seen |= cells


def test_composed_transducer_rewrites_step_by_step():
    made = toxicity.grammar()
    i, n, p, r, o, h = toxicity.INSULT, toxicity.NEGATION, toxicity.PERSON, toxicity.REPORT, toxicity.OTHER, toxicity.HURT
    match = toxicity.MATCH

    def kinds(*string):
        return [x - match for x in made.run(string)[0] if x >= match]

    assert kinds(o, i) == [1]
    assert kinds(p, o, i) == [1 | toxicity.TARGETED]
    assert kinds(n, i) == [1 | toxicity.NEGATED]
    assert kinds(n, o, o, o, i) == [1]
    assert kinds(r, o, i, i) == [1 | toxicity.QUOTED] * 2
    assert kinds(p, h) == [toxicity.THREAT | toxicity.TARGETED]
    assert toxicity.harmless(kinds(h)[0])
    weights = np.arange(32, dtype=float)
    assert toxicity.weighted(made, weights).run((p, i, o))[1] == weights[1 | toxicity.TARGETED]
    assert toxicity.reversed_persons([i, o, p]) == [p, i, o, p]


def test_style_tree_removes_what_a_page_is_not():
    page = """<!doctype html><html><head><title>no</title></head><body><!-- no --><header>no</header><div class="cookie-notice">no</div>
    <main><h1>A &amp;  b</h1><p>one<br>two<p>three <b>four</b><ul><li>x<li>y</ul><aside>no</aside><form>no<input></form>
    <script>if (a</b) "</p>"</script><div id="comments"><p>no</div></main><footer>no</footer>"""
    body = style_tree.parse(page)
    low = {p for p, _, prior, *_ in style_tree.styles(body) if prior == 0}
    assert style_tree.blocks(style_tree.content_root(body), low) == ["A & b", "one two", "three four", "x", "y"]
    assert style_tree.blocks(style_tree.content_root(style_tree.parse("")), set()) == []
    assert style_tree.blocks(style_tree.content_root(style_tree.parse("plain &lt;text")), set()) == ["plain <text"]
    assert style_tree.host_of("https://u@www.A.example:8080/x") == "www.a.example" and style_tree.host_of(None) == ""


def test_style_tree_learns_what_a_site_repeats(spark):
    """Plain divs: only the pages of the site tell what is common to all of them."""
    body = "<body><div class=x>All our shops</div><div class=y>Text number {k} of the site</div></body>"
    rows = [(k, "http://shop.example/a", body.format(k=k)) for k in range(300)] + [(999, None, None), (1000, "x", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in style_tree.extract_text(pages).collect()}
    assert found == {**{k: f"Text number {k} of the site" for k in range(300)}, 999: "", 1000: ""}


def test_distances():
    reference = np.array([0.5, 0.5, 0.0])
    found = divergence.distances(np.array([[5.0, 5.0, 0.0], [0.0, 0.0, 3.0], [0.0, 0.0, 0.0]]), reference)
    assert found[0] == 0 and abs(found[1] - 1) < 1e-9 and np.isfinite(found[2])


class HeldRows(quality.Unlabelled):
    """Unlabelled rows in memory."""

    def __init__(self, codes, bins):
        self.codes, self.fold, self.bins = codes, np.arange(len(codes)) % 2, bins

    def total(self, of_codes):
        halves = np.array_split(np.arange(len(self.codes)), 3)
        return np.sum([of_codes(self.codes[h], self.fold[h]) for h in halves], axis=0)


def test_prior_and_risk():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(2, 1, (6000, 2)), rng.normal(-2, 1, (1000, 2))
    x = np.vstack([good[3000:], bad])
    bins = quality.Bins.of([np.quantile(c, np.arange(1, 12) / 12) for c in x.T], good[:3000])
    positive, unlabelled = bins.indicators(bins.codes(good[:3000])), HeldRows(bins.codes(x), bins)
    prior = quality.estimate_prior(positive, unlabelled)
    assert abs(prior - 0.75) < 0.06
    weights, lowered = quality.fit(positive, unlabelled, prior)
    assert abs(lowered - 0.75) < 0.06
    score = bins.weigh(unlabelled.codes, weights)
    assert ((score > 0) == (np.arange(4000) < 3000)).mean() > 0.97


def test_sums_of_parts_add_up():
    rng = np.random.default_rng(3)
    x, w = rng.integers(0, 2, (20_000, 7)).astype(np.float32), rng.normal(0, 1, 7)
    whole = quality.Sums.of(x, w)
    parts = sum(quality.Sums.of(x[k::3], w).to_vector() for k in range(3))
    back = quality.Sums.of_vector(parts, 7)
    p = 1 / (1 + np.exp(-(x @ w)))
    assert back.n == 20_000 and np.allclose(back.gradient, p @ x) and np.allclose(back.loss, whole.loss)
    assert np.allclose(back.hessian, (x * (p * (1 - p))[:, None]).T @ x, rtol=1e-4) and np.allclose(back.hessian, back.hessian.T)


def test_quality_features_are_numbers_for_any_text():
    x = quality.features(pa.array(["", " ", "A", "a a a", "x" * 10_000, "é\n\n|!#", None]))
    assert x.shape == (7, quality.FEATURES) and np.isfinite(x).all()


def test_tokens_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from badgewright.llm.tokens import Encoder

    rnd = random.Random(7)
    letters = [*"ab AB.,'s !?\n\t éÉßİΣσς́ 　 123 don't “”日x\x1f\x85😀-_ª", ". ", ", ", "  ", "\n\n", " \n", "É."]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(1500)]
    texts += ["", " ", "<|endoftext|> a", "a <|startoftext|>"]
    for name, space in (("word_bpe_49k.json", "drop"), ("byte_bpe_50k.json", "keep")):
        whole, ours = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name), space, kept=2000)
        for first in range(0, len(texts), 300):
            some = texts[first : first + 300]
            found = ours.encode(pa.array(some))
            assert [found.of(k).tolist() for k in range(len(some))] == [
                e.ids for e in whole.encode_batch(some, add_special_tokens=False)
            ]


def equal_to_the_library(path, space, texts):
    from tokenizers import Tokenizer

    from badgewright.llm.tokens import Encoder

    ours, whole = Encoder(path, space, kept=3000), Tokenizer.from_file(path)
    for kind in (pa.string(), pa.large_string()):
        found = ours.encode(pa.array(texts, kind))
        expected = whole.encode_batch(texts, add_special_tokens=False)
        assert [found.of(k).tolist() for k in range(len(texts))] == [e.ids for e in expected]
    return ours


# Words as they stand in lines, with what may follow them.
WORDS = ["river", "Öl", "año", "don't", "x's", "'tis", "ªb", "5th", "a1", "日本", "σς", "×", "we'", "\u00b5m"]
AFTER = [*" .,;:!?$%&*()[]-_'\"\n\t\x00", ".\n", "...\n", "\n\n", "\n\n\n", "\t\n", "\xa0\n", "\r\n", "\n.", "'s ", "'s\n", "'ll.", "×.", "é\n"]


def test_tokens_of_lines_and_punctuation_equal_the_library():
    import public_tokenizers

    rnd = random.Random(11)
    texts = ["".join(rnd.choice(WORDS) + rnd.choice(AFTER) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    texts += [rnd.choice(AFTER) + w + a for w in WORDS for a in AFTER]
    for name, space in (("word_bpe_49k.json", "drop"), ("byte_bpe_50k.json", "keep")):
        equal_to_the_library(public_tokenizers.path(name), space, texts)


def test_a_word_is_one_piece_whatever_follows_it():
    import public_tokenizers

    words = [f"{a}{b}" for a in ("river", "Öl", "garten", "market") for b in ("", "s", "ed", "é", "ing")]
    ends = ["", *".,;:!?$%&*", "$$$", "!!", ".,", "?!", ".***", ",%%%"]
    # Each word before each end, at an end of a line and inside one.
    lines = ["a " + " ".join(w + e for w in words) for e in ends] + [f"a {w}{e}" for e in ends for w in words]
    ours = equal_to_the_library(public_tokenizers.path("byte_bpe_50k.json"), "keep", ["\n".join(lines)])
    assert sum(len(x.h1) for x in ours.segments) <= len(words) + len(ends) + 2


def test_texts_are_cut_at_spaces_alone_by_other_patterns(tmp_path):
    """A pattern that takes full stops and line breaks together with letters."""
    import public_tokenizers
    from tokenizers import Regex, Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pattern = Split(Regex(r" ?[\p{L}.]+\n*| ?[^\s\p{L}]+\n*|\s+(?!\S)|\s+"), "isolated")
    other.pre_tokenizer = Sequence([pattern, ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(str(tmp_path / "other.json"))
    rnd = random.Random(12)
    texts = ["".join(rnd.choice(["the", "in", "on", "s"]) + rnd.choice([". ", ".\n", "\n", "..", "!\n", " "]) for _ in range(20)) for _ in range(200)]
    equal_to_the_library(str(tmp_path / "other.json"), "keep", texts)


def test_no_module_outside_imports_this_one():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for path in (root / "badgewright").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"badgewright\.llm|from badgewright import llm", path.read_text())
