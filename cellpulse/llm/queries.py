"""The text operators as named queries over the test tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.llm import alignment, ann, exact_dedup, fingerprints, lexical, packing, pii, quality, sampled_pieces, secret_scan, simhash, token_counts, url_filter

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

# a real corpus gets a secret key of its own
PII_KEY = b"key of the test tables"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, capacity=1024, end_id=2)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), PII_KEY)


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampled_pieces.sampled(table(spark, sf_dir, "conversations"), PIECES, ["conv_id", "turn"], k=4, theta=1.0)
    return drawn.withColumn("n_pieces", F.size("ids"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, rule="start")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


# The rules of the test
URL_RULES: tuple[url_filter.Rule, ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def _op9_sql() -> str:
    """The same propagation, one CTE for each round."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    lower = lambda x: f"translate({x}, '{url_filter.UPPER}', '{url_filter.LOWER}')"
    link = url_filter.LINK.replace("'", "''")
    d = url_filter.DAMPING
    rounds = "".join(
        f"""s{r} AS (SELECT kind, host, sum(mass) AS mass FROM (
            SELECT f.kind, f.target AS host, s.mass * f.share * {d} AS mass FROM s{r - 1} s JOIN flows f ON f.kind = s.kind AND f.source = s.host
            UNION ALL SELECT kind, host, mass * (1 - {d}) FROM s0) GROUP BY ALL),
        """
        for r in range(1, url_filter.ROUNDS + 1)
    )
    return f"""
    WITH rules(h, p, v) AS (VALUES {rules}),
    known AS MATERIALIZED (SELECT row_number() OVER () AS k, page_id, html, {lower(f"regexp_extract(coalesce(url, ''), '{url_filter.URL}', 1)")} AS host,
        regexp_extract(coalesce(url, ''), '{url_filter.URL}', 2) AS path FROM pages),
    fit AS (SELECT k, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM known JOIN rules
        ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
    ruled AS MATERIALIZED (SELECT known.*, rule, v FROM known LEFT JOIN fit USING (k)),
    seeds AS (SELECT host, avg((v IS NOT DISTINCT FROM 'allow')::INT) AS trust, avg((v IS NOT DISTINCT FROM 'block')::INT) AS distrust FROM ruled WHERE host <> '' GROUP BY host),
    linked AS (SELECT source, target, count(*) AS weight FROM (
        SELECT DISTINCT k, host AS source, {lower("x")} AS target FROM (SELECT k, host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS x FROM known)) GROUP BY ALL),
    hosts AS (SELECT host FROM known UNION SELECT target FROM linked),
    labels AS (SELECT string_split(host, '.') AS l FROM hosts),
    cuts AS (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labels WHERE len(l) > 2),
    bonds AS (SELECT DISTINCT array_to_string(l[i:], '.') AS child, array_to_string(l[i + 1:], '.') AS parent FROM cuts),
    edges AS MATERIALIZED (SELECT source, target, sum(weight) AS weight FROM (
        SELECT * FROM linked UNION ALL SELECT child, parent, 1 FROM bonds UNION ALL SELECT parent, child, 1 FROM bonds)
        WHERE source <> target AND source <> '' AND target <> '' GROUP BY ALL),
    nodes AS (SELECT source AS host FROM edges UNION SELECT target FROM edges UNION SELECT host FROM seeds),
    kinds AS (SELECT 'trust' AS kind, * FROM edges UNION ALL SELECT 'distrust', target, source, weight FROM edges),
    shares AS (SELECT kind, source, target, weight / sum(weight) OVER (PARTITION BY kind, source) AS share FROM kinds),
    flows AS MATERIALIZED (SELECT * FROM shares UNION ALL SELECT kind, host, host, 1.0 FROM nodes CROSS JOIN (VALUES ('trust'), ('distrust')) t(kind)
        WHERE NOT EXISTS (SELECT 1 FROM shares s WHERE s.kind = t.kind AND s.source = host)),
    s0 AS MATERIALIZED (SELECT 'trust' AS kind, host, trust / sum(trust) OVER () AS mass FROM seeds WHERE trust > 0
        UNION ALL SELECT 'distrust', host, distrust / sum(distrust) OVER () FROM seeds WHERE distrust > 0),
    {rounds}
    verdicts AS (SELECT host, round((coalesce(sum(mass) FILTER (kind = 'distrust'), 0) - coalesce(sum(mass) FILTER (kind = 'trust'), 0)) * (SELECT count(*) FROM nodes), 6) AS suspicion
        FROM nodes LEFT JOIN s{url_filter.ROUNDS} USING (host) GROUP BY host)
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN coalesce(suspicion, 0) > {url_filter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
        CASE WHEN rule IS NULL THEN suspicion END AS suspicion
    FROM ruled LEFT JOIN verdicts USING (host)
    """


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.measure(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = rf"""
WITH split AS (SELECT kind, row_number() OVER () AS r, id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark)),
tf AS MATERIALIZED (SELECT kind, r, id, term, count(*) AS tf FROM (SELECT kind, r, id, unnest(words) AS term FROM split) GROUP BY ALL),
n AS MATERIALIZED (SELECT r, sum(tf)::BIGINT AS n FROM tf WHERE kind = 'd' GROUP BY r),
size AS (SELECT count(*) AS N_docs, sum(n)::BIGINT AS L FROM n),
asked AS (SELECT term, floor(1000 * ln((2 * any_value(N_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, size WHERE kind = 'd' AND term IN (SELECT term FROM tf WHERE kind = 'q') GROUP BY term),
scored AS (SELECT q.r AS q, q.id AS item_id, d.r, d.id AS doc_id,
        sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (25 + (75 * n * N_docs) // L))))::BIGINT AS score
    FROM tf q JOIN asked USING (term) JOIN tf d ON d.term = q.term AND d.kind = 'd' JOIN n ON n.r = d.r, size WHERE q.kind = 'q' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_sampled_pieces": op5_sampled_pieces,
    "op6_neighbours": op6_neighbours,
    "op7_token_counts": op7_token_counts,
    "op8_secrets": op8_secrets,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_fingerprints": op11_fingerprints,
    "op12_alignment": op12_alignment,
    "op13_lexical": op13_lexical,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op9_url_filter": _op9_sql(),
    "op13_lexical": OP13_SQL,
}
