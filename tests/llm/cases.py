"""Documents that try every operator: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = "the of and river stone garden market winter letter window travel music silver orange paper bridge".split()


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 400)) for _ in range(words))


def edited(text: str, seed: int, every: int) -> str:
    words = text.split()
    for k in range(seed % every, len(words), every):
        words[k] = f"edit{seed}x{k}"
    return " ".join(words)


BASE = prose(1, 120)
SHARED = prose(2, 60)
ROWS: list[tuple] = [
    (0, BASE),
    (1, BASE),
    (2, edited(BASE, 5, 60)),
    (3, edited(BASE, 9, 70)),
    (4, ""),
    (5, None),
    (6, "  \n\t \n"),
    (7, "one"),
    (8, "one two three"),
    (9, "one two three"),
    (10, f"{prose(3, 30)} {SHARED} {prose(4, 30)}\nA line that two documents share.\nshort"),
    (11, f"{prose(5, 10)} {SHARED}\n  a LINE that two documents share. \nshort"),
    (12, f"{SHARED} {SHARED}"),
    (13, "word " * 300),
    (14, "é" * 9 + "\n" + "é" * 10),
    (15, "É" * 9 + "\n" + "é" * 10 + "\nline\x0bwith\x0cother\rspace"),
    (16, prose(6, 4000)),
    (17, f"{prose(7, 20)} café 中文 \U0001f600 <|endoftext|> x  y\n\n z"),
    (18, prose(8, 34)),
    (19, prose(9, 35)),
    (20, prose(9, 35)),
]
BENCHMARK = [(1, SHARED), (2, "one two three"), (3, None), (4, "..."), (5, prose(6, 4000)[200:400]), (None, BASE)]


def table(spark: SparkSession, rows=ROWS) -> DataFrame:
    """Documents with further columns whose names the operators use themselves."""
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    clash = "row string, doc string, twin int, shard int, part int, score string, n_words string, kept string, `a.b` int"
    data = [(d, t, "en" if (d or 0) % 3 else None, "src", len(t or ""), *("x", "x", 1, 2, 3, "x", "x", "x", 4)) for d, t in rows]
    return spark.createDataFrame(data, f"{names}, {clash}")


def benchmark(spark: SparkSession, rows=BENCHMARK) -> DataFrame:
    return spark.createDataFrame(rows, "item_id bigint, text string")


def labels(spark: SparkSession, rows=()) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")
