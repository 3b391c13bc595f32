"""URL filter: rules first, then trust and distrust spread over the link graph of hosts.

The longest rule that fits decides a url. Where none fits, its host does. The rules' own verdicts on a host's pages are the seeds:
personalised PageRank carries trust from allowed hosts along links, and distrust from blocked hosts against them, as whoever links to
a bad host is suspect. Edges are hyperlinks between different hosts, weighted by linking pages, and the two-way bond of a host with its parent
domain. A host without outgoing edges keeps what it gets. A host is blocked if its distrust exceeds its trust by more
than ``threshold`` times the average share of a host; one that nothing reaches is allowed.

Pages are reduced to one row per pair of hosts before the iteration; every few rounds the state, one row per host, is written.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; a null page links nowhere;
repeated rows each get their verdict and count as pages each; with no seeds nothing spreads.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.plans.storage import durable

Rule = tuple[str, str, str]
"""Host, path and verdict."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'\s>]*)"""
DAMPING = 0.7
ROUNDS = 12
WRITE_EVERY = 3
THRESHOLD = 1.0
MAX_RULES = 1_000


def _lower(host: Column) -> Column:
    return F.translate(host, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    known = F.coalesce(url.cast("string"), F.lit(""))
    return _lower(F.regexp_extract(known, URL, 1)), F.regexp_extract(known, URL, 2)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; they are tried one by one")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    listed = [{"host": h, "path": p, "rule": h + p, "verdict": v} for h, p, v in ordered]
    table = F.from_json(F.lit(json.dumps(listed)), "array<struct<host:string,path:string,rule:string,verdict:string>>")
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    return F.get(F.filter(table, fits), F.lit(0))


def host_edges(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """``(source, target, weight)``, without loops, from pages with their host."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1)), _lower))
    linked = pages.select(F.col(host_col).alias("source"), F.explode(targets).alias("target")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    hosts = pages.select(F.col(host_col).alias("host")).unionByName(linked.select(F.col("target").alias("host"))).distinct()
    labels = F.split("host", r"\.")
    tail = lambda i: F.array_join(F.slice("labels", i, F.size("labels")), ".")
    steps = F.when(F.size("labels") > 2, F.sequence(F.lit(1), F.size("labels") - 2)).otherwise(F.array().cast("array<int>"))
    bonds = hosts.select(labels.alias("labels")).select(F.explode(F.transform(steps, lambda i: F.struct(tail(i).alias("child"), tail(i + 1).alias("parent")))).alias("b"))
    bonds = bonds.select("b.child", "b.parent").distinct()
    both = bonds.select(F.col("child").alias("source"), F.col("parent").alias("target")).unionByName(bonds.select(F.col("parent").alias("source"), F.col("child").alias("target")))
    edges = linked.unionByName(both.withColumn("weight", F.lit(1).cast("long")))
    return edges.filter("source <> target and source <> '' and target <> ''").groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def _flows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(kind, source, target, share)``: trust along the edges, distrust against them; dead ends flow to themselves."""
    kinds = edges.select(F.lit("trust").alias("kind"), "source", "target", "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    )
    totals = kinds.groupBy("kind", "source").agg(F.sum("weight").alias("total"))
    shares = kinds.join(totals, ["kind", "source"]).select("kind", "source", "target", (F.col("weight") / F.col("total")).alias("share"))
    every = nodes.select("host", F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind"))
    ends = every.join(totals.withColumnRenamed("source", "host"), ["kind", "host"], "left_anti")
    return shares.unionByName(ends.select("kind", F.col("host").alias("source"), F.col("host").alias("target"), F.lit(1.0).alias("share")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``(host, trust, distrust)`` for every host of the edges and seeds; ``seeds`` has host, trust and distrust, not negative."""
    nodes = durable(edges.select(F.col("source").alias("host")).unionByName(edges.select(F.col("target").alias("host"))).unionByName(seeds.select("host")).distinct(), "hosts")
    flows = durable(_flows(edges, nodes), "flows")
    sums = seeds.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    start = None
    for kind in ("trust", "distrust"):
        one = seeds.filter(F.col(kind) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(kind) / F.lit(sums[kind] or 1.0)).alias("mass"))
        start = one if start is None else start.unionByName(one)
    start = durable(start, "seeds")
    state = start
    for r in range(1, rounds + 1):
        moved = state.withColumnRenamed("host", "source").join(flows, ["kind", "source"])
        moved = moved.select("kind", F.col("target").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
        fresh = start.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass"))
        state = moved.unionByName(fresh).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if r % WRITE_EVERY == 0 and r < rounds:
            state = durable(state, "spread")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
    return nodes.join(state, "host", "left").groupBy("host").agg(of("trust"), of("distrust"))


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, and the host's suspicion (null where a rule decided)."""
    host, path = parts(F.col(url_col))
    known = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    ruled = known.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("fit.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = durable(ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "seeds")
    hosts = durable(propagate(durable(host_edges(known), "host-edges"), seeds, damping, rounds), "hosts")
    verdicts = hosts.select("host", F.round((F.col("distrust") - F.col("trust")) * hosts.count(), 6).alias("suspicion"))
    # only pages that no rule decides need their host, and their htmls need not travel
    slim = ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"))
    decided = slim.filter("rule is not null").withColumn("suspicion", F.lit(None).cast("double"))
    open_ = slim.filter("rule is null").join(verdicts, "host", "left")
    blocked = F.coalesce(F.col("suspicion"), F.lit(0.0)) > threshold
    open_ = open_.withColumn("verdict", F.when(blocked, "block").otherwise("allow"))
    return decided.unionByName(open_.select(decided.columns))
