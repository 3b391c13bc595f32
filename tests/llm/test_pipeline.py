"""The pipeline on a small corpus, each stage beside its brute-force version."""

import random
import re

import corpus_pipeline
import pyarrow as pa
import pytest
from __spark_entry__ import oracle_sql, queries
from pyspark.sql import functions as F

from cellpulse.llm import pii
from cellpulse.llm.queries import PII_KEY
from tests.llm.frames import TEXTS, documents, labels
from tests.llm.test_judges import junk, prose
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_text_units import check_packed


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, prose(rng) if i % 5 else junk(rng)) for i in range(300)]
    rows += [(300 + i, rows[i * 7 + 1][1]) for i in range(20)]
    rows += [(400 + i, f"{rows[i * 6 + 2][1]} mail me.{i}@mail.example.com or +1 (171) 555-20{i:02d} now") for i in range(20)]
    long = " ".join(prose(rng) for _ in range(60))
    rows += [(500, long), (501, long + " end"), *[(i, t) for i, t in TEXTS if i is not None and i != 9]]
    rows = [(i if i >= 10 or i not in {k for k, _ in TEXTS} or j < 300 else 600 + i, t) for j, (i, t) in enumerate(rows)]
    documents(spark, rows).drop("ids").write.parquet(f"{path}/documents.parquet")
    labels(spark, [(i, int(i % 5 > 0), 0) for i in range(0, 300, 2)]).write.parquet(f"{path}/labels.parquet")
    return path


def pairs(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    before = pairs(docs)

    good = corpus_pipeline.durable(stages["quality classifier"](spark, docs, corpus))
    kept = pairs(good)
    assert good.columns == columns and kept.items() <= before.items()
    assert all(i in kept for i in range(300) if i % 5) and sum(i in kept for i in range(0, 300, 5)) <= 3

    once = corpus_pipeline.durable(stages["exact dedup"](spark, good, corpus))
    first: dict[str, int] = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i] or ""), i)
    assert once.columns == columns and set(pairs(once)) == set(first.values())

    apart = corpus_pipeline.durable(stages["SimHash near-dedup"](spark, once, corpus))
    left = pairs(once)
    assert apart.columns == columns and set(pairs(apart)) == plain_kept(list(left.items()))
    assert 501 not in pairs(apart)

    hidden = corpus_pipeline.durable(stages["PII"](spark, apart, corpus))
    p = pii.Permutation(PII_KEY)
    want = {i: None if t is None else pii.pseudonymise(t, p)[0] for i, t in pairs(apart).items()}
    assert hidden.columns == columns and pairs(hidden) == want and want != pairs(apart)

    packed = stages["best-fit packing"](spark, hidden, corpus).collect()
    check_packed(packed, list(want.items()), 1024)
    whole = corpus_pipeline.run(spark, corpus).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(whole) == key(packed)


def test_stages_on_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        assert out.collect() == []


def test_every_operator_has_one_query():
    names = [n for n in queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in queries()
    assert {"op1_exact_dedup", "op9_url_filter", "op13_lexical"} <= set(oracle_sql())


def test_texts_go_to_python_in_small_batches(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").filter("doc_id < 20")
    corpus_pipeline.hide_personal_data(spark, docs, corpus)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [len(batch)], "bytes": [batch.nbytes]})

    wide = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 400_000).alias("text"))
    got = wide.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 64 and max(r.bytes for r in got) <= corpus_pipeline.BATCH_BYTES + 500_000
