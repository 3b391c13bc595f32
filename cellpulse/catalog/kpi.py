"""Key figures and experiment-log queries over the score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.catalog.distribution import GINI, STATS
from cellpulse.catalog.forecast import COPY, SCORES, forecasts, scores
from cellpulse.catalog.panel import LOG_SQL, run_log
from cellpulse.catalog.registry import CUSTOMERS, OBS, query, rounded
from cellpulse.operators import diagnostics as DG
from cellpulse.operators import distribution as D
from cellpulse.operators import forecast as FC
from cellpulse.operators import kpi as K
from cellpulse.plans.storage import scratch_path
from cellpulse.sources import testdata as T
from cellpulse.sources import writers as WR


@query(
    "fact_dataset",
    f"WITH {OBS}, a AS (SELECT CAST(sum(n_rows) AS BIGINT) AS rows_, count(*) AS occ, max(n_rows) AS mx, count(DISTINCT t_index) AS seen, sum(value) AS total FROM obs), "
    "n AS (SELECT max(user_id) + 1 AS n, count(DISTINCT event_type) AS codes FROM events), "
    "w AS (SELECT * FROM a, n), u AS ("
    "SELECT 'n_days' AS key, 30.0::DOUBLE AS value, 'days' AS unit FROM w UNION ALL SELECT 'n_squares', n, '' FROM w UNION ALL SELECT 'n_timestamps', 720, '' FROM w UNION ALL "
    "SELECT 'total_raw_rows', rows_, '' FROM w UNION ALL SELECT 'mean_rows_per_day', rows_ / 30.0, '' FROM w UNION ALL SELECT 'absent_cells', seen * n - occ, '' FROM w UNION ALL "
    "SELECT 'absent_cells_pct', 100 * (seen * n - occ) / (seen * n), '%' FROM w UNION ALL SELECT 'mean_rows_per_cell', rows_ / occ, '' FROM w UNION ALL SELECT 'max_rows_per_cell', mx, '' FROM w UNION ALL "
    "SELECT 'missing_intervals', 720 - seen, '' FROM w UNION ALL SELECT 'country_codes', codes, '' FROM w UNION ALL SELECT 'total_activity', total, '' FROM w) "
    "SELECT 'Dataset' AS \"group\", key, round(value, 4) AS value, unit FROM u",
)
def fact_dataset(spark: SparkSession, sf: str) -> DataFrame:
    spec = T.hourly_spec(spark, sf)
    return rounded(K.fact_dataset(T.events_raw(spark, sf), T.events_rollup(spark, sf, spec), spec), 4)


@query(
    "fact_throughput",
    f"{LOG_SQL}, t AS (SELECT sum(download_s) AS s, sum(raw_rows * 65) AS b FROM log) SELECT 'Timing' AS \"group\", 'download_mib_per_s' AS key, round(b / 1048576.0 / s, 9) AS value, 'MiB/s' AS unit FROM t "
    "UNION ALL SELECT 'Timing', 'download_mbit_per_s', round(b * 8 / 1e6 / s, 9), 'Mbit/s' FROM t",
)
def fact_throughput(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.fact_throughput(run_log(spark, sf), F.col("raw_rows") * 65), 9)


@query(
    "fact_eda",
    f"WITH {CUSTOMERS}, {STATS}, v AS (SELECT round({GINI}, 8) AS gini, round(max(total) / quantile_cont(total, 0.5), 8) AS max_over_median, round(avg(power((total - m) / sd, 3)), 8) AS skewness FROM o, n) "
    "SELECT 'Distribution' AS \"group\", key, value, '' AS unit FROM (SELECT 'gini' AS key, gini AS value FROM v UNION ALL SELECT 'max_over_median', max_over_median FROM v UNION ALL SELECT 'skewness', skewness FROM v)",
)
def fact_eda(spark: SparkSession, sf: str) -> DataFrame:
    stats = D.distribution_stats(T.customer_totals(spark, sf))
    return rounded(K.as_facts(stats, "Distribution", keys=("gini", "max_over_median", "skewness")), 8)


def split_scores(spark: SparkSession, sf: str, split: str) -> DataFrame:
    return scores(spark, sf).filter(F.col("split") == split)


MEANS = f"{SCORES}, t AS (SELECT area, model, seed, mae / nullif(mase_scale, 0) AS mase FROM s WHERE split = 'test'), me AS (SELECT model, avg(mase) AS m FROM t GROUP BY model), ba AS (SELECT m AS base FROM me WHERE model = 'persistence')"


@query("fact_best_model", f"WITH {MEANS} SELECT model AS best_model, round(m, 8) AS best_mase FROM me ORDER BY round(m, 9), model LIMIT 1")
def fact_best_model(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.fact_best_model(split_scores(spark, sf, "test")), 8)


@query("fact_gain_over_persistence", f"WITH {MEANS} SELECT round(100 * (max(base) - min(m)) / max(base), 6) + 0.0 AS gain_over_persistence_pct FROM me, ba")
def fact_gain(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.fact_gain_over_persistence(split_scores(spark, sf, "test")), 6)


@query("fact_models_beating", f"WITH {MEANS} SELECT CAST(count(*) FILTER (WHERE model <> 'persistence' AND round(m, 9) < round(base, 9)) AS INTEGER) AS models_beating_persistence FROM me, ba")
def fact_beating(spark: SparkSession, sf: str) -> DataFrame:
    return K.fact_models_beating(split_scores(spark, sf, "test"))


STRESS = f"{SCORES}, t AS (SELECT area, model || '_' || seed AS model, mae / nullif(mase_scale, 0) AS mase FROM s WHERE split = 'stress' AND model = 'blend'), b AS (SELECT area, mae / nullif(mase_scale, 0) AS base FROM s WHERE split = 'stress' AND model = 'persistence')"


def stress_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_scores(spark, sf, "stress")
    named = F.when(F.col("model") == "blend", F.concat("model", F.lit("_"), F.col("seed"))).otherwise(F.col("model"))
    return rows.withColumn("model", named).select("area", "model", "mase")


@query("fact_stress_ratio", f"WITH {STRESS} SELECT model, round(max(mase / nullif(base, 0)), 8) AS worst_ratio FROM t JOIN b USING (area) GROUP BY model")
def fact_stress_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.fact_stress_ratio(stress_scores(spark, sf)), 8)


@query("fact_persistence_wins", f"WITH {STRESS} SELECT count(*) AS areas_persistence_wins FROM b WHERE base IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.area = b.area AND round(t.mase, 9) < round(b.base, 9))")
def fact_persistence_wins(spark: SparkSession, sf: str) -> DataFrame:
    return K.fact_persistence_wins(stress_scores(spark, sf))


@query("fact_copy_min", f"WITH {COPY} SELECT round(min(ratio), 8) AS copy_ratio_min FROM ra WHERE model = 'blend'")
def fact_copy_min(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.fact_copy_min(DG.copying_report(forecasts(spark, sf)[0])), 8)


@query("fact_collapsed", f"WITH {COPY} SELECT count(*) FILTER (WHERE ratio < 0.25) AS models_collapsed FROM ra WHERE model = 'blend'")
def fact_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return K.fact_collapsed(DG.copying_report(forecasts(spark, sf)[0]))


@query(
    "fact_cost_ratio",
    f"WITH {SCORES}, t AS (SELECT area, max(CASE WHEN model = 'seasonal_naive' THEN 1000 * rmse / n END) AS a, max(CASE WHEN model = 'persistence' THEN 1000 * rmse / n END) AS b FROM s WHERE split = 'test' GROUP BY area) "
    "SELECT area, round(a + 1e-9, 6) AS ms_numerator, round(b + 1e-9, 6) AS ms_denominator, round(a / nullif(b, 0), 8) AS cost_ratio FROM t",
)
def fact_cost_ratio(spark: SparkSession, sf: str) -> DataFrame:
    # a deterministic stand-in for the measured wall time
    timing = split_scores(spark, sf, "test").withColumn("inference_ms_per_step", 1000 * F.col("rmse") / F.col("n"))
    out = K.fact_cost_ratio(timing, "seasonal_naive", "persistence")
    for name in ("ms_numerator", "ms_denominator"):
        out = out.withColumn(name, F.col(name) + F.lit(1e-9))
    return rounded(out, 6, cost_ratio=8)


# --- experiment log ------------------------------------------------------------------------------

LOG = f"{SCORES}, log AS (SELECT model, area, split AS stage, CASE split WHEN 'test' THEN 1 ELSE 2 END AS stage_order, seed, mae AS valid_mae, mae / nullif(mase_scale, 0) AS valid_mase FROM s)"


def experiment_log(spark: SparkSession, sf: str) -> DataFrame:
    """Score rows in the shape of the experiment log: the split stands for the tuning stage."""
    return scores(spark, sf).select(
        "model", "area", F.col("split").alias("stage"), F.when(F.col("split") == "test", 1).otherwise(2).alias("stage_order"), "seed",
        F.col("mae").alias("valid_mae"), F.col("mase").alias("valid_mase"),
    )


@query("log_filter", f"WITH {LOG} SELECT model, area, stage, seed, round(valid_mae, 7) AS valid_mae FROM log WHERE model = 'blend' AND stage = 'test'")
def log_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.log_filter(experiment_log(spark, sf), model="blend", stage="test")
    return rounded(rows.select("model", "area", "stage", "seed", "valid_mae"), 7)


@query("log_best", f"WITH {LOG} SELECT model, area, stage, seed, round(valid_mae, 7) AS valid_mae FROM log QUALIFY row_number() OVER (PARTITION BY model, area ORDER BY round(valid_mae, 9), stage, seed) = 1")
def log_best(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.log_best(experiment_log(spark, sf)).select("model", "area", "stage", "seed", "valid_mae"), 7)


@query("log_summary", f"WITH {LOG} SELECT model, stage, count(*) AS n FROM log GROUP BY GROUPING SETS ((model), (stage), ())")
def log_summary(spark: SparkSession, sf: str) -> DataFrame:
    return K.log_summary(experiment_log(spark, sf))


@query(
    "sweep_spread",
    f"WITH {LOG}, sg AS (SELECT model, stage, min(stage_order) AS o, min(valid_mae) AS best, max(valid_mae) AS worst, count(valid_mae) AS n FROM log GROUP BY 1, 2), h AS (SELECT *, lag(best) OVER (PARTITION BY model ORDER BY o) AS p FROM sg) "
    "SELECT model, stage, n, round(best, 7) AS best, round(worst, 7) AS worst, round((worst - best) / nullif(best, 0), 7) AS spread, round(p - best, 7) + 0.0 AS gain, round((p - best) / nullif(p, 0), 7) + 0.0 AS gain_share FROM h",
)
def sweep_spread(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.sweep_spread(experiment_log(spark, sf)), 7)


@query(
    "ablation_delta",
    f"WITH {LOG}, m AS (SELECT model, avg(valid_mae) FILTER (WHERE stage = 'test') AS w, avg(valid_mae) FILTER (WHERE stage <> 'test') AS o FROM log GROUP BY 1) "
    "SELECT model, round(w + 1e-10, 7) AS with_it, round(o + 1e-10, 7) AS without_it, round(o - w, 7) + 0.0 AS delta, round((o - w) / w, 7) + 0.0 AS delta_share FROM m",
)
def ablation_delta(spark: SparkSession, sf: str) -> DataFrame:
    log = experiment_log(spark, sf).withColumn("flag", F.col("stage") == "test")
    out = K.ablation_delta(log, "flag")
    for name in ("with_it", "without_it"):
        out = out.withColumn(name, F.col(name) + F.lit(1e-10))  # off the exact halves between two roundings
    return rounded(out, 7)


@query("append_log", f"WITH {LOG} SELECT model, CAST(area AS BIGINT) AS area, stage, 2 * count(*) AS n, min(valid_mae IS NOT NULL) AS scored FROM log GROUP BY 1, 2, 3")
def append_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "experiments")
    rows = experiment_log(spark, sf).select(
        "model", "area", "stage", "seed", "valid_mae", F.struct(F.col("seed").alias("seed")).alias("hyperparams"),
        F.lit("compare the next seed").alias("rationale_for_next_change"),
    )
    WR.append_log(rows, path)
    WR.append_log(rows, path)
    back = spark.read.parquet(path)
    return back.groupBy("model", "area", "stage").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("valid_mae").isNotNull()).alias("scored")
    )


@query(
    "merge_selections",
    f"WITH {LOG}, k AS (SELECT model, round(avg(valid_mae), 7) AS score FROM log WHERE stage = 'test' GROUP BY model), f AS (SELECT model, round(avg(valid_mae), 7) AS score FROM log WHERE stage = 'stress' AND model = 'blend' GROUP BY model) "
    "SELECT model, score, 1 AS tuning_area FROM k WHERE model NOT IN (SELECT model FROM f) UNION ALL SELECT model, score, 1 FROM f",
)
def merge_selections(spark: SparkSession, sf: str) -> DataFrame:
    log = experiment_log(spark, sf)
    means = log.groupBy("stage", "model").agg(F.avg("valid_mae").alias("score")).withColumn("tuning_area", F.lit(1))
    kept = means.filter("stage = 'test'").drop("stage")
    fresh = means.filter("stage = 'stress' AND model = 'blend'").drop("stage")
    return rounded(FC.merge_selections(kept, fresh), 7)
