"""Digests of whole files against hashlib, with cuts at every kind of place."""

import hashlib

import numpy as np
import pytest

from cellpulse.operators.quality import PanelError
from cellpulse.sources import digests as D
from cellpulse.sources import readers as R


def written(path, n, seed=0):
    data = np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()
    path.write_bytes(data)
    return hashlib.md5(data).hexdigest()


def test_ranges_give_the_digest_of_the_whole_file(spark, tmp_path):
    # records of 10 bytes, splits of 1280, 80 and 10; Hadoop lets a last split grow by a tenth
    lengths = [1281, 1290, 1407, 1408, 1409, 2560, 2561, 2689, 4001, 9_001]
    want = {f"f{n}.bin": (n, written(tmp_path / f"f{n}.bin", n, n)) for n in lengths}
    want["small.bin"] = (1280, written(tmp_path / "small.bin", 1280))
    got = {r["name"]: (r["length"], r["md5"]) for r in D.file_digests(spark, str(tmp_path), task_bytes=1280).collect()}
    assert got == want


def test_odd_names(spark, tmp_path):
    folder = tmp_path / "a,b {c"
    folder.mkdir()
    names = ["x[1],{2}*?.bin", "}y,{z.bin", "per%20cent +.bin", "packed.gz", "ünï.bin"]
    want = {n: written(folder / n, 3000 + i, i) for i, n in enumerate(names)}
    got = {r["name"]: r["md5"] for r in D.file_digests(spark, str(folder).replace("{", "\\{"), task_bytes=640).collect()}
    assert got == want


def test_large_files_are_never_one_row(spark, tmp_path):
    n = D.TASK_BYTES + (20 << 20) + 7
    data = np.arange(n // 4 + 1, dtype=np.uint32).tobytes()[:n]
    (tmp_path / "day.bin").write_bytes(data)
    (tmp_path / "other.bin").write_bytes(data[:-1] + b"x")
    md5 = hashlib.md5(data).hexdigest()
    manifest = spark.createDataFrame([("day.bin", n, md5), ("other.bin", n, md5)], "name string, length long, md5 string")
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, str(D.TASK_BYTES))
    try:
        got = {r["name"]: r["status"] for r in R.file_integrity_audit(spark, str(tmp_path), manifest).collect()}
    finally:
        spark.conf.unset(limit)
    assert got == {"day.bin": "match", "other.bin": "digest differs"}


def test_a_task_reads_no_more_than_its_range(spark, tmp_path):
    written(tmp_path / "f.bin", 100_003)
    for split, unit in ((12_800, 100), (800, 100), (100, 100)):
        rdd = D.fixed_records(spark, f"file:{tmp_path}/f.bin", unit, split)
        n = D.splits_before_last(100_003, split)
        assert rdd.getNumPartitions() == n + 1
        assert spark.sparkContext.runJob(rdd, lambda rows: [sum(map(len, rows))], range(n)) == [split] * n
        assert 0 < 100_003 - n * split <= 1.1 * split


def test_files_that_changed_fail(spark, tmp_path):
    written(tmp_path / "f.bin", 3000)
    with pytest.raises(PanelError, match="changed"):
        D.chained_md5(spark, [(f"file:{tmp_path}/f.bin", 5000)], 1280)


def test_batches_hold_every_file_once():
    files = [("a", 5), ("b", 90), ("c", 40), ("d", 40)]
    assert list(D.batches(files, 80)) == [[("b", 90)], [("c", 40), ("d", 40)], [("a", 5)]]
