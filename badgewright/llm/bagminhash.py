"""Near-duplicate documents by BagMinHash signatures of weighted word shingles.

A document is the multiset of its runs of five words (all its words, if they are fewer). The similarity of two
documents is the weighted Jaccard similarity of their multisets; 0.8 or more makes a link, and
the classes are the connected components of all links.

1. Documents of the same word sequence are one: the smallest id stands for them.
2. Signatures. Each shingle starts Poisson processes over its weight range, which is cut at powers
   of two: (0, 1], (1, 2], (2, 4], (4, 8] ... A range up to the weight lies in the multiset
   whole; in the one above, each point falls to the lower or upper half, bit by bit of a hash, until it lies
   at or below the weight or above it. Points come in order of time, in random registers; a register keeps the
   earliest. Two documents agree in a register with the probability of their similarity. A document's
   processes stop at a time by which its registers are full, or start again with a later one.
3. Bands of five registers make buckets. In every bucket the smallest document is the hub, and
   the others are compared with it: as many pairs as members. Shingle multisets decide.
4. Links give components. Where a bucket's members lie in several, those apart from the hub's
   component are compared with all other members, so that no link is lost between members that are both unlike the
   hub; one link per pair of components is kept. Large groups are compared in blocks of bounded size.

Defined results: a text without words is alone in its class; rows equal in id and text are
one document; rows of one id with different texts are different documents with one id; a null id
is the largest. ``class_id`` is the smallest id of the class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from badgewright.llm.components import components
from badgewright.llm.shared import LAST_ID, hot_share, packed, record_batch, salted_join, slices
from badgewright.llm.substrings import row_key
from badgewright.llm.words import Words, mixed, run_hashes, split_words, windows
from badgewright.sources.files import materialised

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
BLOCK_SHINGLES = 8_000_000
NODE = "struct<doc: bigint, twin: bigint>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of every different shingle, by text and hash."""
    hashes = words.hashes()
    starts = windows(words, size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    row = np.concatenate([np.searchsorted(words.first, starts, "right") - 1, short])
    found = np.concatenate(
        [
            run_hashes(hashes, starts, starts + size),
            run_hashes(hashes, words.first[short], words.first[short + 1]),
        ]
    )
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    first = np.flatnonzero(fresh)
    return row[first], found[first], np.diff(np.append(first, len(row)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers above 0 and up to 1."""
    return ((mixed(x) >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """BagMinHash signatures, one row of ``registers`` 64-bit values per text; zeros for an empty multiset."""
    total = np.bincount(row, weights=weight, minlength=texts)
    out = np.full((texts, registers), np.inf)
    # One process per element and range of weights: range 0 is (0, 1], range j is (2^(j-1), 2^j].
    ranges = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(row)), ranges)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    width = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    key = mixed(element[owner] + level.astype(np.uint64) * _STEP)
    home, inside = row[owner], weight[owner] >= low + width
    factor, open_rows = 3.0, total > 0
    while open_rows.any():
        until = np.where(open_rows, registers * (np.log(registers) + factor) / np.maximum(total, 1), 0.0)
        out[open_rows] = np.inf
        flat = out.reshape(-1)
        active = np.flatnonzero(open_rows[home])
        time = np.zeros(len(active))
        point = 0
        while len(active):
            point += 1
            draw = mixed(key[active] ^ np.uint64(point * 0xD1B54A32D192ED03 % 2**64))
            time = time - np.log(_uniform(draw)) / width[active]
            near = time <= until[home[active]]
            active, time, draw = active[near], time[near], draw[near]
            register = (mixed(draw ^ _STEP) % np.uint64(registers)).astype(np.int64)
            taken = inside[active]
            if not taken.all():
                # The bits of the hash lead to a unit cell of the range; it counts if it ends at or below the weight.
                cell = (_uniform(draw + _STEP) * width[active]).astype(np.int64)
                taken = taken | (low[active] + np.minimum(cell, width[active] - 1) + 1 <= weight[owner[active]])
            np.minimum.at(flat, home[active][taken] * registers + register[taken], time[taken])
        open_rows = open_rows & np.isinf(out).any(axis=1)
        factor *= 2
    return np.where(np.isinf(out), 0.0, out).view(np.uint64)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per text and band."""
    parts = mixed(signature[:, : bands * rows]).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, parts.shape[:2])
    for k in range(rows):
        key = mixed(key ^ parts[:, :, k])
    return key


def _sign(size: int, bands: int, rows: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column("text"))
            n = len(words.first) - 1
            row, element, weight = shingle_sets(words, size)
            keys = band_keys(signatures(row, element, weight, n, bands * rows), bands, rows).view(np.int64)
            doc, twin = (batch.column(c).to_numpy() for c in ("doc", "twin"))
            hashes = words.hashes()
            some = words.counts > 0
            h1, h2 = doc.copy(), twin.copy()
            for h, salt in ((h1, 1), (h2, 2)):
                salted = mixed(hashes + np.uint64(salt))
                h[some] = run_hashes(salted, words.first[:-1][some], words.first[1:][some]).view(np.int64)
            size_of = np.bincount(row, weights=weight, minlength=n).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
            yield record_batch([doc, twin, h1, h2, size_of, lists], schema)

    return run


def overlaps(one: tuple[np.ndarray, np.ndarray], row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Similarities of one multiset (sorted elements, counts) with ``n`` others."""
    place = np.minimum(np.searchsorted(one[0], element), len(one[0]) - 1)
    same = one[0][place] == element
    both = np.bincount(row[same], weights=np.minimum(weight[same], one[1][place[same]]), minlength=n)
    sizes = np.bincount(row, weights=weight, minlength=n)
    return both / np.maximum(sizes + one[1].sum() - both, 1)


def _nodes(nodes: list[dict]) -> pa.Array:
    return pa.array(nodes, pa.struct([("doc", pa.int64()), ("twin", pa.int64())]))


def _compare_with_hub(size: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        hub, members = table.column("hub")[0].as_py(), table.column("node").to_pylist()
        row, element, weight = shingle_sets(split_words(table.column("text").combine_chunks()), size)
        found: list[dict] = []
        if hub in members:
            mine = row == members.index(hub)
            like = overlaps((element[mine], weight[mine]), row, element, weight, len(members)) >= threshold
            found = [m for m, yes in zip(members, like, strict=True) if yes and m != hub]
        return pa.table({"a": _nodes([hub] * len(found)), "b": _nodes(found)})

    return run


def _compare_apart(size: int, threshold: float):
    """Links between components: members of role 1 with those of role 0."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_pylist()
        role = table.column("role").to_numpy()
        row, element, weight = shingle_sets(split_words(table.column("text").combine_chunks()), size)
        first = np.searchsorted(row, np.arange(len(parts) + 1))
        number = {p: k for k, p in enumerate({(p["doc"], p["twin"]): p for p in parts})}
        part = np.array([number[(p["doc"], p["twin"])] for p in parts])
        linked: set[tuple[int, int]] = set()
        asked = np.flatnonzero(role == 0)
        back = np.full(len(parts), -1)
        back[asked] = np.arange(len(asked))
        keep = back[row] >= 0 if len(row) else np.zeros(0, bool)
        row0, element0, weight0 = back[row[keep]], element[keep], weight[keep]
        for one in np.flatnonzero(role == 1):
            mine = slice(first[one], first[one + 1])
            if first[one] == first[one + 1] or not len(asked):
                continue
            like = overlaps((element[mine], weight[mine]), row0, element0, weight0, len(asked)) >= threshold
            linked |= {(int(part[one]), int(p)) for p in np.unique(part[asked[like]]) if p != part[one]}
        names = list({(p["doc"], p["twin"]): p for p in parts}.values())
        return pa.table({"a": _nodes([names[a] for a, _ in linked]), "b": _nodes([names[b] for _, b in linked])})

    return run


def _candidates(signed: DataFrame) -> DataFrame:
    """(hub, node, size): every member of a bucket with the bucket's smallest, hubs with themselves."""
    node = F.struct("doc", "twin").alias("node")
    rows = materialised(signed.select(node, "size", F.explode("bands").alias("band")), "bands")
    hubs = rows.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    met = salted_join(rows, hubs.select("band", "hub"), "band", "node")
    return materialised(met.groupBy("hub", "node").agg(F.first("size").alias("size")), "candidates")


def near_links(docs: DataFrame, signed: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, label): components of the documents in ``signed`` that have a link."""
    edge = f"a {NODE}, b {NODE}"
    met = _candidates(signed)
    hot = F.broadcast(hot_share(met, "hub", "size"))
    salts = F.coalesce("_salts", F.lit(1))
    every = F.sequence(F.lit(0), salts - 1)
    one = F.array(F.pmod(F.xxhash64("node"), salts).cast("int"))
    dealt = met.join(hot, "hub", "left").select(
        "hub", "node", F.explode(F.when(F.col("hub") == F.col("node"), every).otherwise(one)).alias("deal")
    )
    # Only the texts of candidates are kept for the comparisons; the corpus is shuffled once, by the same
    # kind of join at every size.
    wanted = met.select("node").distinct().select("node", "node.doc", "node.twin").hint("merge")
    texts = materialised(docs.join(wanted, ["doc", "twin"]).select("node", "text"), "candidate-texts")
    with_text = texts.join(dealt, "node").select("hub", "deal", "node", "text")
    links = materialised(with_text.groupBy("hub", "deal").applyInArrow(_compare_with_hub(size, threshold), edge), "links")
    labels = components(links)

    # Buckets' members that are not in one component yet.
    labelled = met.join(labels, "node", "left").select("hub", "node", "size", F.coalesce("label", "node").alias("part"))
    labelled = materialised(labelled, "candidates-labelled")
    mixed_hubs = labelled.groupBy("hub").agg(
        F.min("part").alias("low"),
        F.max("part").alias("high"),
        F.max(F.when(F.col("hub") == F.col("node"), F.col("part"))).alias("hub_part"),
    )
    open_hubs = mixed_hubs.where("low <> high").select("hub", "hub_part")
    rest = materialised(salted_join(labelled, open_hubs, "hub", "node"), "candidates-apart")
    # Members are dealt into blocks of both roles; a pair of blocks is one comparison. A group of a share of
    # all rows gets that share of the tasks, and no block more shingles than a task should hold.
    hot = F.broadcast(hot_share(rest, "hub", "size", per_task=1))
    cuts = F.greatest(F.ceil(F.sqrt("_salts")), F.ceil(F.col("_n") / BLOCK_SHINGLES))
    sized = rest.join(hot.select("hub", cuts.cast("int").alias("n")), "hub", "left")
    n = F.coalesce("n", F.lit(1))
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    every = F.explode(F.sequence(F.lit(0), n - 1))
    asked = sized.select("hub", "node", "part", F.lit(0).alias("role"), own.alias("b0"), every.alias("b1"))
    asking = sized.where("part <> hub_part").select(
        "hub", "node", "part", F.lit(1).alias("role"), every.alias("b0"), own.alias("b1")
    )
    pairs = texts.join(asked.unionByName(asking), "node").select("hub", "b0", "b1", "part", "role", "text")
    across = pairs.groupBy("hub", "b0", "b1").applyInArrow(_compare_apart(size, threshold), edge)
    merged = components(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    parts = merged.select(F.col("node").alias("label"), F.col("label").alias("merged"))
    alone = parts.join(labels, parts["label"] == labels["node"], "left_anti")
    moved = salted_join(labels, parts, "label", "node", "left").select("node", F.coalesce("merged", "label").alias("label"))
    return moved.unionByName(alone.select(F.col("label").alias("node"), F.col("merged").alias("label")))


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: doc_id, doc and twin (what identifies it), class_id, head (whether it is the class's first)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    state = packed(docs, id_col, text_col).select("doc_id", *row_key(), "text")
    schema = StructType.fromDDL("doc bigint, twin bigint, h1 bigint, h2 bigint, size bigint, bands array<bigint>")
    sign = _sign(size, bands, rows, to_arrow_schema(schema))
    signed = materialised(state.select("doc", "twin", "text").mapInArrow(sign, schema), "signatures")

    copy, node = F.struct("h1", "h2").alias("copy"), F.struct("doc", "twin")
    heads = materialised(signed.groupBy(copy).agg(F.min(node).alias("head")), "copies")
    first = heads.select("head.doc", "head.twin").distinct()
    labels = materialised(near_links(state, signed.where("size > 0").join(first, ["doc", "twin"]), size, threshold), "classes")
    classes = heads.join(labels.withColumnRenamed("node", "head"), "head", "left").select(
        "copy", F.coalesce("label", "head").alias("class")
    )
    members = salted_join(signed.select("doc", "twin", copy), materialised(classes, "copy-classes"), "copy", "doc")
    ids = F.when(F.col("doc") < LAST_ID, F.col("doc")).alias("doc_id")
    return members.select(
        ids, "doc", "twin", F.col("class.doc").alias("class_id"), (F.col("class") == node).alias("head")
    )


def near_report(docs: DataFrame, **options) -> DataFrame:
    return near_classes(docs, **options).select("doc_id", "class_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per class, its first document's, with the columns it came with.

    Of rows that are equal in id and text, which are one document, the one with the smallest hash of all its columns stays.
    """
    heads = near_classes(docs, id_col, text_col, **options).where("head").select("doc", "twin").distinct()
    rows = packed(docs, id_col, text_col).select("row", *row_key()).join(heads, ["doc", "twin"])
    # Partitioned by the same columns as the join: no further shuffle.
    kept = rows.groupBy("doc", "twin").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.select("row.*")
