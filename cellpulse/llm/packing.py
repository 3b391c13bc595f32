"""Best-fit packing of token sequences through the configuration linear program.

All that packing depends on is how many pieces there are of each length, a histogram of at most ``capacity`` rows. A
configuration is a multiset of lengths that fits one sequence; the linear program asks for the fewest configurations that
cover the histogram. It is solved by multiplicative weights: a length costs less the more of it is covered, and a
knapsack dynamic program finds the configurations worth most at the present prices. The fractional solution is rounded
down, and what is left goes, still as counts, to the open sequence where it fits best, longest first. The plan is a short
list of rank ranges per length; Spark numbers the pieces of each length and looks the place of each number up, so no
task ever holds more than one batch of documents.

Only documents longer than the capacity are cut, into full pieces after a first one that may be shorter. Ids are those of the ``tokenizers`` library
without special tokens around the text; the string of an added token inside a text gets that token's id. Defined cases: a null text
is empty and becomes one piece with the end id alone; repeated rows are packed once each; a null id is carried along; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.llm.bpe import encoder
from cellpulse.llm.common import whole_text
from cellpulse.plans.storage import durable

CAPACITY = 1_024
END_ID = 2
ROUNDS = 120
RATE = 0.06
TOLERANCE = 0.003
CHUNK = 65_536

Group = tuple[tuple[int, ...], int]
"""The lengths in a sequence, and how many sequences hold just these."""


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of each piece."""
    first = length % capacity or capacity
    starts = [0, *range(first, length, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length], strict=True)]


def _best_values(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the worth of the best filling of each capacity, and the length it ends with (0: leave a token free)."""
    worth, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        k = fitting[room]
        options = worth[room - lengths[:k]] + prices[:k]
        top = int(options.argmax())
        if options[top] > worth[room - 1]:
            worth[room], last[room] = options[top], lengths[top]
        else:
            worth[room] = worth[room - 1]
    return worth, last


def _filling(room: int, last: np.ndarray) -> list[int]:
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
            room -= int(last[room])
        else:
            room -= 1
    return out


def fractional(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> Counter[tuple[int, ...]]:
    """Configurations and their fractional counts, from multiplicative weights with knapsack pricing.

    Every round prices the lengths, and for each length whose best sequence is worth about as much as any takes that
    sequence as often as the length needs. Then lengths covered more than the average get cheaper, the others dearer. The counts
    are averaged over the later rounds, when prices have settled.
    """
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], float)
    place = {int(x): k for k, x in enumerate(lengths)}
    log_prices, used, settled = np.log(lengths / capacity), Counter(), rounds // 3
    for r in range(rounds):
        prices = np.exp(log_prices)
        worth, last = _best_values(prices, lengths, capacity)
        covered, columns = np.zeros(len(lengths)), Counter()
        for k in np.flatnonzero(worth[capacity - lengths] + prices >= (1 - TOLERANCE) * worth[capacity]):
            column = Counter([int(lengths[k]), *_filling(int(capacity - lengths[k]), last)])
            at = np.array([place[x] for x in column])
            times = demand[k] / column[int(lengths[k])]
            covered[at] += times * np.array([column[x] for x in column]) / demand[at]
            columns[tuple(sorted(column.elements(), reverse=True))] += times
        mean = (covered * demand * lengths).sum() / (demand * lengths).sum()
        log_prices += RATE / np.sqrt(1 + r / 10) * np.clip(1 - covered / mean, -1, 1)
        if r >= settled:
            for column, times in columns.items():
                used[column] += times / mean / (rounds - settled)
    return used


def rounded(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[Group]:
    """Whole sequences: the fractional ones rounded down, then the rest by best fit, longest first, all as counts."""
    left = Counter({x: n for x, n in histogram.items() if n})
    open_: dict[int, list[Group]] = {}
    if not left:
        return []
    for column, x in sorted(fractional(dict(left), capacity, rounds).items(), key=lambda e: (sum(e[0]), e[1]), reverse=True):
        need = Counter(column)
        times = min(int(x), *(left[y] // n for y, n in need.items()))
        if times > 0:
            left.subtract({y: n * times for y, n in need.items()})
            open_.setdefault(capacity - sum(column), []).append((column, times))
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        count = left[length]
        while count:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                times, per = count, min(capacity // length, count)
                times = count // per
                open_.setdefault(capacity - per * length, []).append(((length,) * per, times))
                count -= times * per
                continue
            content, have = open_[room].pop()
            if not open_[room]:
                del open_[room]
            times = min(have, count)
            if have > times:
                open_.setdefault(room, []).append((content, have - times))
            open_.setdefault(room - length, []).append(((*content, length), times))
            count -= times
    return [g for r in sorted(open_) for g in open_[r]]


def rank_ranges(groups: list[Group]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first, until, sequence, each, offset)``: pieces of this length numbered first to until − 1 go to the sequences
    from ``sequence`` on, ``each`` to a sequence, side by side from ``offset``."""
    given, sequence, out = Counter(), 0, []
    for content, times in groups:
        offset = 0
        for length, each in sorted(Counter(content).items(), reverse=True):
            first = given[length]
            given[length] += each * times
            out.append((length, first, given[length], sequence, each, offset))
            offset += each * length
        sequence += times
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """One row per piece of every document, with the ids themselves if asked for."""
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, added=True)
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(enc.ids(text), np.uint32(end_id)).astype("<u4")
                for j, (a, n) in enumerate(cut(len(ids), capacity)):
                    row.append(k)
                    piece.append(j)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[a : a + n].tobytes()))
                    if with_ids:
                        kept.append(ids[a : a + n].astype(np.int32))
            columns = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32())}
            columns |= {"start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return source.mapInArrow(encode, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    cuts = pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)
    tagged = durable(cuts.withColumn("_tag", F.monotonically_increasing_id()), "pieces")
    # the number of a row within its writing task, cut into chunks, so that a frequent length is numbered in many groups
    chunked = tagged.withColumn("_chunk", F.expr(f"_tag div {CHUNK}"))
    counts = durable(chunked.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    ranges = rank_ranges(rounded(histogram, capacity))
    schema = "length long, _first long, _until long, _sequence long, _each long, _offset long"
    plan = spark.createDataFrame(ranges, schema)
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_chunk").orderBy("_tag")
    numbered = chunked.select("*", (F.row_number().over(inside) - 1).alias("_place")).join(bases, ["length", "_chunk"])
    numbered = numbered.withColumn("_rank", F.col("_base") + F.col("_place"))
    here = (numbered["length"] == plan["length"]) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_until"))
    placed = numbered.join(F.broadcast(plan), here).drop(plan["length"])
    nth = F.col("_rank") - F.col("_first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.expr("(_rank - _first) div _each")).alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences themselves, from pieces packed ``with_ids``; a group holds one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("input_ids"))
