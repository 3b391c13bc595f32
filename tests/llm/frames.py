"""Small inputs that every text operator must take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# names that operators use inside, as columns of the caller
CLASHING = ("keep_id", "kept", "group_size", "fp", "n", "vec", "score", "length", "offset", "_row", "_id", "_sha", "spans", "host", "path", "ids", "section")

TEXTS = [
    (5, "one  two\tthree\nfour five six seven"),
    (3, "one two three four five six seven"),
    (9, "one two three four five six seven"),
    (9, "one two three four five six seven"),
    (1, None),
    (2, ""),
    (4, " \n "),
    (7, "x"),
    (None, "one two three four five six seven"),
    (None, "a row without an id"),
    (8, "word " * 30_000),
    (6, "é日😀 token=abcdef12345 mail a.b@example.com on 2024-02-29\n\nsecond"),
]


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    rows = TEXTS if rows is None else rows
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    full = [(i, t, "en", None, None, *["extra"] * len(CLASHING)) for i, t in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def labels(spark: SparkSession, rows: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
