"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with those of its language (``lang``)
by the Jensen-Shannon distance. The references are counted over all documents:

1. A word is common if it makes at least ``COMMON`` of a language's words. Every slice of the
   input names the words that make half of that share of the slice; a word common overall
   is named by some slices with at least ``COMMON`` / 2 of all words together, so no common word is missed,
   and there are at most 2 / COMMON candidates per language.
2. The candidates and the character classes are counted exactly, and each language's common words and classes made its reference.
3. Every document gets the base counts and its two distances from its language's reference.
   Short documents are told by the base rules alone: their histograms say little. The limit of the word
   distance follows from the reference: squared, it lies between what n words drawn from the
   reference differ from it by chance, and what a text without any common word differs at every length. So a
   text that lacks a language's common words is rejected at any size.

Every language with ``LEAST_WORDS`` words of its own has a reference, however small its share of the table; documents of the others
are judged by the base rules alone. Nothing that grows with the number of languages is collected: candidates and references are
tables, joined to the documents by language, broadcast while they are small, else by shuffled and salted joins.

Defined results: a null or empty text has no words and fails the base rules; a null language is a
language of its own; each row of a repeated id is judged by itself; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from badgewright.llm.shared import prepare_workers, record_batch, salted_join, slices
from badgewright.llm.words import Words, mixed, pieces, run_hashes, split_words, text_bytes, windows
from badgewright.sources.files import materialised

COMMON = 1 / 400
# Words that a language must have for a reference of its own.
LEAST_WORDS = 10_000
MIN_WORDS = 60
MIN_CHARACTERS = 200
MAX_CHARACTER_DISTANCE = 0.25
# Where the squared word limit lies between a text of the language (0) and one without common words (1).
WORD_LIMIT = 0.4
# Where common words make less of a language than this, texts may well have none: then only a pile-up is told.
LEAST_COVER = 0.1
PILE_UP = 0.60
WINDOW = 8
KNOTS = 16
BROADCAST_BYTES = 32 << 20
BLOCK_ROWS = 2048

# Character classes: lower case, upper case, digits, white space, sentence marks, other ASCII, the rest.
CLASSES = 7
_CLASS = np.full(256, 5, dtype=np.int8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 4
_CLASS[128:192] = -1  # inside a character
_CLASS[192:] = 6
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_APART = np.array([b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])

SCORES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, judged boolean, character_distance double, word_distance double"
)


def plain_words(texts: pa.Array) -> Words:
    """Lower-case words of letters and digits."""
    data, rows = text_bytes(texts)
    starts, ends = pieces(data, rows, _APART)
    return Words(_LOWER[data], rows, starts, ends, np.searchsorted(starts, rows))


def per_row(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many of the flags lie between each two neighbours of ``rows``."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[rows[1:]] - sums[rows[:-1]]


def class_counts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    kinds = _CLASS[data]
    return np.stack([per_row(kinds == k, rows) for k in range(CLASSES)], axis=1)


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    starts = windows(words, window)
    row = np.searchsorted(words.first, starts, "right") - 1
    key = mixed(run_hashes(words.hashes(), starts, starts + window) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(words.starts) + 1, dtype=np.int32)
    edge[starts[again]] += 1
    edge[starts[again] + window] -= 1
    return per_row(np.cumsum(edge[:-1]) > 0, words.first)


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


@dataclass
class Reference:
    """``words``: sorted hashes of a language's common words; ``word_shares``: their shares, the last one that of all other
    words; ``class_shares`` of the characters; ``chance``: see ``chance_squares``."""

    words: np.ndarray
    word_shares: np.ndarray
    class_shares: np.ndarray
    chance: np.ndarray

    def to_bytes(self) -> bytes:
        return self.words.astype("<u8").tobytes() + np.concatenate([self.word_shares, self.class_shares, self.chance]).astype("<f8").tobytes()

    @classmethod
    def of_bytes(cls, data: bytes) -> Reference:
        # Words, one share more than words, classes and knots, eight bytes each.
        k = (len(data) // 8 - 1 - CLASSES - KNOTS) // 2
        shares = np.frombuffer(data, "<f8", offset=8 * k)
        return cls(np.frombuffer(data, "<u8", k), shares[: k + 1], shares[k + 1 : k + 1 + CLASSES], shares[k + 1 + CLASSES :])


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2) of each row of counts from one reference."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    middle = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / middle), 0.0).sum(axis=1)
        b = np.where(reference > 0, reference * np.log2(reference / middle), 0.0).sum(axis=1)
    return np.sqrt(np.maximum((a + b) / 2, 0.0))


def chance_squares(reference: np.ndarray) -> np.ndarray:
    """Expected squared distance of 1, 2, 4, ... words drawn from a reference."""
    shares = reference[reference > 0]
    knots = 2 ** np.arange(KNOTS)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, knots[-1] + 1)))])
    expected = np.zeros(len(knots))
    for k, n in enumerate(knots):
        for r in shares:
            if r == 1:
                continue
            spread = 8 * np.sqrt(n * r * (1 - r)) + 20
            x = np.arange(max(0, int(n * r - spread)), min(n, int(n * r + spread)) + 1)
            log_p = log_factorial[n] - log_factorial[x] - log_factorial[n - x] + x * np.log(r) + (n - x) * np.log1p(-r)
            p = x / n
            middle = (p + r) / 2
            part = p * np.log2(np.where(p > 0, p, 1.0) / middle) + r * np.log2(r / middle)
            expected[k] += np.exp(log_p) @ part / 2
    return expected


def word_limits(reference: np.ndarray, expected: np.ndarray, sizes: np.ndarray, limit: float = WORD_LIMIT) -> np.ndarray:
    """Largest squared distance allowed to texts of so many words, with ``chance_squares`` of the reference.

    Between powers of two chance is interpolated, beyond the last it falls as 1 / n.
    """
    none = np.zeros((1, len(reference)))
    none[0, -1] = 1
    if reference[:-1][reference[:-1] >= COMMON].sum() < LEAST_COVER:
        return np.full(len(sizes), PILE_UP**2)
    at, most = np.log2(np.maximum(sizes, 1)), distances(none, reference)[0] ** 2
    chance = np.interp(at, np.arange(KNOTS), expected) * np.minimum(1.0, 2.0 ** (KNOTS - 1 - at))
    return chance + limit * np.maximum(most - chance, 0.0)


def _languages(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    encoded = batch.column("language").dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary.to_pylist()


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Each language of a batch with its rows."""
    code, names = _languages(batch)
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(names) + 1))
    for k, name in enumerate(names):
        yield name, order[cuts[k] : cuts[k + 1]]


def _words_of(words: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of some texts, and for each the place of its text among ``rows``."""
    count = words.counts[rows]
    ends = np.cumsum(count)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(words.first[rows] - (ends - count), count)
    return at, np.repeat(np.arange(len(rows)), count)


def _name_candidates(common: float, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = plain_words(batch.column("text"))
            hashes = words.hashes()
            languages, named, counts, totals = [], [], [], []
            for name, rows in _by_language(batch):
                mine = hashes[_words_of(words, rows)[0]]
                found, n = np.unique(mine, return_counts=True)
                often = np.flatnonzero(n >= common / 2 * len(mine))
                languages += [name] * (len(often) + 1)
                named += [*found[often].view(np.int64).tolist(), 0]
                counts += [*n[often].tolist(), len(mine)]
                totals += [False] * len(often) + [True]
            yield record_batch([languages, totals, named, counts], schema)

    return run


def _sorted(hashes: list[int]) -> np.ndarray:
    """Hashes as they are looked up: unsigned and sorted."""
    return np.sort(np.array(hashes, dtype=np.int64).view(np.uint64))


def _count(schema: pa.Schema, held: int = 2000):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            words = plain_words(batch.column("text"))
            hashes, plain = words.hashes(), class_counts(*text_bytes(batch.column("text")))
            for name, rows in _by_language(batch):
                candidates = _sorted(batch.column("candidates")[int(rows[0])].as_py())
                bins = word_bins(hashes[_words_of(words, rows)[0]], candidates)
                counted = np.bincount(bins, minlength=len(candidates) + 1)
                both = np.concatenate([counted, plain[rows].sum(axis=0)])
                sums[name] = sums[name] + both if name in sums else both
            if len(sums) > held:
                yield record_batch([list(sums), [x.tolist() for x in sums.values()]], schema)
                sums = {}
        yield record_batch([list(sums), [x.tolist() for x in sums.values()]], schema)

    return run


def word_bins(hashes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Number of each word among the sorted candidates, or one past the last."""
    if not len(candidates):
        return np.zeros(len(hashes), dtype=np.int64)
    place = np.minimum(np.searchsorted(candidates, hashes), len(candidates) - 1)
    return np.where(candidates[place] == hashes, place, len(candidates))


def reference_of(candidates: np.ndarray, counts: np.ndarray, common: float = COMMON) -> Reference:
    """A language's reference from its candidates' counts, that of all other words, and those of the character classes."""
    words, plain = counts[: len(candidates) + 1].astype(np.float64), counts[len(candidates) + 1 :].astype(np.float64)
    shares = words / max(words.sum(), 1)
    kept = shares[:-1] >= common
    shares = np.append(shares[:-1][kept], shares[:-1][~kept].sum() + shares[-1])
    return Reference(candidates[kept], shares, plain / max(plain.sum(), 1), chance_squares(shares))


def _make_references(common: float, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for candidates, counts in zip(batch.column("candidates").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                made.append(reference_of(_sorted(candidates), np.array(counts, dtype=np.int64), common).to_bytes())
            yield record_batch([batch.column("language"), made], schema)

    return run


def with_language(docs: DataFrame, table: DataFrame, column: str, how: str) -> DataFrame:
    """Documents with ``column`` of their language's row in a written table.

    The table is broadcast while it is no larger than ``BROADCAST_BYTES``; beyond that it is shuffled, and languages with a
    large share of the documents are salted.
    """
    size = table.agg(F.coalesce(F.sum(F.octet_length(F.col(column).cast("string"))), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return docs.join(F.broadcast(table), "language", how)
    return salted_join(docs, table, "language", "text", how)


def build_references(docs: DataFrame, common: float = COMMON, least_words: int = LEAST_WORDS) -> DataFrame:
    """(language, reference) of all languages of (text, language) that have enough words, as a written table."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("language string, is_total boolean, hash bigint, n bigint")
    named = docs.mapInArrow(_name_candidates(common, to_arrow_schema(schema)), schema)
    named = materialised(named.groupBy("language", "is_total", "hash").agg(F.sum("n").alias("n")), "named-words")
    large = named.where("is_total").select("language", F.col("n").alias("total")).where(F.col("total") >= least_words)
    often = salted_join(named.where("NOT is_total"), large, "language", "hash").where(F.col("n") >= common / 2 * F.col("total"))
    # At most 2 / common words of each language.
    by_language = often.groupBy("language").agg(F.collect_list("hash").alias("found"))
    found = F.coalesce("found", F.array().cast("array<bigint>")).alias("candidates")
    candidates = materialised(large.join(by_language, "language", "left").select("language", found), "word-candidates")

    counted_schema = StructType.fromDDL("language string, counts array<bigint>")
    counted = with_language(docs, candidates, "candidates", "inner").mapInArrow(_count(to_arrow_schema(counted_schema)), counted_schema)
    sums = counted.select("language", F.posexplode("counts")).groupBy("language", "pos").agg(F.sum("col").alias("n"))
    whole = sums.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("sums"))
    made_of = candidates.join(whole, "language").select("language", "candidates", F.col("sums.n").alias("counts"))
    out = StructType.fromDDL("language string, reference binary")
    return materialised(made_of.mapInArrow(_make_references(common, to_arrow_schema(out)), out), "language-references")


def _judge(limits: tuple[float, float, int, int], schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most_class, word_limit, min_words, min_characters = limits
        for batch in slices(batches):
            texts = batch.column("text")
            words, n = split_words(texts), len(batch)
            n_words = words.counts
            inside = np.zeros(len(words.data) + 1, dtype=np.int32)
            np.add.at(inside, words.starts, 1)
            np.add.at(inside, words.ends, -1)
            in_word = np.cumsum(inside[:-1]) > 0
            characters = (words.data & 0xC0) != 0x80
            word_chars = per_row(in_word & characters, words.rows)
            symbols = per_row(_SYMBOL[words.data], words.rows)
            repeated = repeated_words(words)
            dup_lines = [repeated_lines(t) for t in texts.to_pylist()]
            failed = (n_words < 20) | (100 * repeated > 30 * n_words)
            classes = class_counts(words.data, words.rows).astype(np.float64)

            plain = plain_words(texts)
            hashes = plain.hashes()
            far_class, far_words, most = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.inf)
            known = batch.column("reference")
            for _, every in _by_language(batch):
                if not known[int(every[0])].is_valid:
                    continue
                reference = Reference.of_bytes(known[int(every[0])].as_py())
                k = len(reference.word_shares)
                for first in range(0, len(every), BLOCK_ROWS):
                    rows = every[first : first + BLOCK_ROWS]
                    at, place = _words_of(plain, rows)
                    bins = word_bins(hashes[at], reference.words)
                    counts = np.bincount(place * k + bins, minlength=len(rows) * k).reshape(len(rows), k).astype(np.float64)
                    far_words[rows] = distances(counts, reference.word_shares)
                    far_class[rows] = distances(classes[rows], reference.class_shares)
                    most[rows] = word_limits(reference.word_shares, reference.chance, plain.counts[rows], word_limit)
            judged = known.is_valid().to_numpy(zero_copy_only=False)
            enough = judged & (plain.counts >= min_words) & (classes.sum(axis=1) >= min_characters)
            with np.errstate(invalid="ignore"):
                apart = enough & ((far_class > most_class) | (far_words**2 > most))
            columns = [n_words, word_chars, symbols, dup_lines, repeated, failed, ~failed & ~apart, judged]
            given = [batch.column(name) for name in ("doc_id", "lang") if name in batch.schema.names]
            yield record_batch([*given, *columns, far_class, far_words], schema)

    return run


def judge_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_character_distance: float = MAX_CHARACTER_DISTANCE,
    word_limit: float = WORD_LIMIT,
    min_words: int = MIN_WORDS,
    min_characters: int = MIN_CHARACTERS,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, the language it was compared with (null: none) and distances."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    prepare_workers(docs.sparkSession)
    lang = F.col(lang_col).cast("string")
    state = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        lang.alias("lang"),
        F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("language"),
    )
    references = build_references(state.select("text", "language"), least_words=least_words)
    schema = StructType.fromDDL("doc_id bigint, lang string, " + SCORES)
    limits = (max_character_distance, word_limit, min_words, min_characters)
    compared = with_language(state, references, "reference", "left")
    scored = compared.mapInArrow(_judge(limits, to_arrow_schema(schema)), schema)
    names = [f.name for f in StructType.fromDDL(SCORES)]
    shown = [F.when(F.col("judged"), F.col("lang")).alias("language") if c == "judged" else F.col(c) for c in names]
    return scored.select("doc_id", *shown)
