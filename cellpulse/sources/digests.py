"""MD5 of whole files, large ones read range after range by tasks that hand the digest's state on."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

from pyspark import RDD
from pyspark.serializers import NoOpSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.operators.quality import PanelError

# Most bytes that one task reads of a large file; smaller files are read whole.
TASK_BYTES = 128 << 20
# Most bytes of large files in one go, so that the list of splits on the driver stays short; one file at least.
BATCH_BYTES = 64 << 30

# The size of OpenSSL's MD5_CTX (23 words of 32 bits), the slop of Hadoop's FileInputFormat, and the names whose
# files Hadoop would unpack or hide, so that they are read whole.
STATE_BYTES = 92
SLOP = 1.1
UNSPLIT = r"^[._]|\.(deflate|gz|bz2|lz4|snappy|zst)$"


def md5_library() -> ctypes.CDLL:
    """The OpenSSL that ``hashlib`` uses; its plain MD5 functions keep their state in the caller's memory."""
    import _hashlib  # not in every Python, and only large files need it

    library = ctypes.CDLL(_hashlib.__file__)
    if not hasattr(library, "MD5_Update"):
        raise RuntimeError("this OpenSSL has no MD5_Update: raise task_bytes so that files are read whole")
    return library


def md5_start() -> bytes:
    state = ctypes.create_string_buffer(STATE_BYTES)
    md5_library().MD5_Init(state)
    return state.raw


def md5_advance(state: bytes, blocks: Iterable[bytes]) -> tuple[bytes, int]:
    """The state after ``blocks``, and their bytes."""
    library, now, n = md5_library(), ctypes.create_string_buffer(state, STATE_BYTES), 0
    for block in blocks:
        library.MD5_Update(now, block, ctypes.c_size_t(len(block)))
        n += len(block)
    return now.raw, n


def md5_finish(state: bytes) -> str:
    now, out = ctypes.create_string_buffer(state, STATE_BYTES), ctypes.create_string_buffer(16)
    md5_library().MD5_Final(out, now)
    return out.raw.hex()


def splits_before_last(length: int, split: int) -> int:
    """Number of splits of exactly ``split`` bytes that ``FileInputFormat`` makes before the last one."""
    n = max(length // split - 1, 0)
    while (length - n * split) / split > SLOP:
        n += 1
    return n


def fixed_records(spark: SparkSession, path: str, record: int, split: int) -> RDD:
    """The file's records as bytes, one partition per split: ``binaryRecords`` with a given size of splits."""
    # the path is read as a glob, and as a list cut at commas outside braces
    plain = "".join("{\\,}" if c == "," else "\\" + c if c in "\\{}[]*?" else c for c in path)
    sc = spark.sparkContext
    conf = sc._jvm.org.apache.hadoop.conf.Configuration(sc._jsc.hadoopConfiguration())
    for bound in ("minsize", "maxsize"):
        conf.setLong(f"mapreduce.input.fileinputformat.split.{bound}", split)
    return RDD(sc._jsc.sc().binaryRecords(plain, record, conf).toJavaRDD(), sc, NoOpSerializer())


def step_of(starts: dict[int, bytes]) -> Callable[[int, Iterator[bytes]], Iterator[tuple[bytes, int]]]:
    """The work of one task: the state its file has come to, advanced over the split's records."""

    def step(number: int, records: Iterator[bytes]) -> Iterator[tuple[bytes, int]]:
        yield md5_advance(starts[number], records)

    return step


def chained_md5(spark: SparkSession, files: list[tuple[str, int]], task_bytes: int) -> list[str]:
    """MD5 of each ``(path, length)``: all files side by side, the splits of one file in tasks one after another.

    A reader of fixed records fails on the rest at the end of a file. So the last split is left to the next, finer cut, and
    the last split of the finest one, about one record, is read byte by byte. Only states of 92 bytes come to the driver.
    """
    record = max(task_bytes // 128, 1)
    paths, lengths = [path for path, _ in files], [length for _, length in files]
    states, done = [md5_start() for _ in files], [0 for _ in files]
    for split, unit, last in ((128 * record, record, 0), (8 * record, record, 0), (record, record, 0), (record, 1, 1)):
        before_last = [splits_before_last(length, split) for length in lengths]
        base = [0, *accumulate(n + 1 for n in before_last)]
        todo = [range(at // split, n + last) for at, n in zip(done, before_last)]
        if not any(todo):
            continue
        rdd = spark.sparkContext.union([fixed_records(spark, path, unit, split) for path in paths])
        if rdd.getNumPartitions() != base[-1]:
            raise PanelError("files changed while they were read")
        for turn in range(max(map(len, todo))):
            at_work = [k for k, splits in enumerate(todo) if turn < len(splits)]
            numbers = {base[k] + todo[k][turn]: states[k] for k in at_work}
            stepped = rdd.mapPartitionsWithIndex(step_of(numbers))
            for k, (state, n) in zip(at_work, spark.sparkContext.runJob(stepped, list, list(numbers))):
                states[k], done[k] = state, done[k] + n
    if done != lengths:
        raise PanelError("files changed while they were read")
    return [md5_finish(state) for state in states]


def batches(files: list[tuple[str, int]], limit: int = BATCH_BYTES) -> Iterator[list[tuple[str, int]]]:
    """Files by size, large ones first, in groups of at most ``limit`` bytes, or of one file."""
    group: list[tuple[str, int]] = []
    for path, length in sorted(files, key=lambda f: (-f[1], f[0])):
        if group and sum(n for _, n in group) + length > limit:
            yield group
            group = []
        group.append((path, length))
    if group:
        yield group


def file_digests(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``(name, length, md5)`` of each file.

    Files of at most ``task_bytes`` are digested in one piece. Larger ones are read at once, when this is called, in ranges of
    about that size; only those with a name that Hadoop would unpack or hide stay in one piece, of 2 GiB at most.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    # of the metadata, so that the files left out are not opened
    large = (F.col("_metadata.file_size") > task_bytes) & ~F.col("_metadata.file_name").rlike(UNSPLIT)
    whole = files.filter(~large).select(name.alias("name"), "length", F.md5("content").alias("md5"))
    listed = [(r["path"], r["length"]) for r in files.filter(large).select("path", "length").collect()]
    if not listed:
        return whole
    rows = []
    for group in batches(listed):
        rows += [(p.rsplit("/", 1)[-1], n, md5) for (p, n), md5 in zip(group, chained_md5(spark, group, task_bytes))]
    return whole.unionByName(spark.createDataFrame(rows, "name string, length long, md5 string"))
