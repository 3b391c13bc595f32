import datetime as dt
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellpulse.functions import exprs as X
from cellpulse.operators import panel as P
from cellpulse.operators import quality as Q
from cellpulse.settings import PanelSpec, SplitRange
from cellpulse.sources import readers as R
from cellpulse.sources import writers as WR
from cellpulse.streaming import ingest as ING
from tests.fixtures import panel_frame, spec_hourly

T0 = 1383260400000  # 2013-11-01 00:00 in Rome

SPEC = PanelSpec(
    start=dt.date(2013, 11, 1), end=dt.date(2013, 11, 4), step_seconds=14_400, daily=6, weekly=42, n_areas=4, tz="Europe/Rome",
    splits=(
        SplitRange("train", dt.date(2013, 11, 1), dt.date(2013, 11, 1)),
        SplitRange("validation", dt.date(2013, 11, 2), dt.date(2013, 11, 2)),
        SplitRange("test", dt.date(2013, 11, 3), dt.date(2013, 11, 3)),
        SplitRange("stress", dt.date(2013, 11, 4), dt.date(2013, 11, 4)),
    ),
)


def write_day(folder, day: int, squares=(1, 2, 3, 4), omit=(), intervals=range(6)):
    """Each cell is split over two countries, and a third row has an empty activity field."""
    lines = []
    for i in intervals:
        for s in squares:
            if (s, i) in omit:
                continue
            ms = T0 + day * 86_400_000 + i * 14_400_000
            value = s * 100 + i
            lines += [f"{s}\t{ms}\t39\t\t\t\t\t{value * 0.25}", f"{s}\t{ms}\t33\t1.5\t\t\t\t{value * 0.75}", f"{s}\t{ms}\t0\t\t\t\t\t"]
    path = folder / f"sms-call-internet-mi-2013-11-{day + 1:02d}.txt"
    path.write_text("\n".join(lines) + "\n")
    return path


def test_scan_rollup_densify(spark, tmp_path):
    write_day(tmp_path, 0, omit={(3, 2)})
    raw = R.scan_cdr(spark, str(tmp_path), columns=("square_id", "time_ms", "country_code", "internet"))
    rollup = P.country_rollup(raw, SPEC)
    cells = {(r["area"], r["t_index"]): r for r in P.densify(rollup, SPEC).collect()}
    assert len(cells) == 24
    assert cells[(2, 5)]["value"] == pytest.approx(205)
    assert cells[(2, 5)]["n_rows"] == 3
    assert (cells[(3, 2)]["value"], cells[(3, 2)]["n_rows"]) == (0.0, 0)
    stats = Q.day_stats(raw, rollup, SPEC).first()
    assert stats["date"] == dt.date(2013, 11, 1)
    assert (stats["n_raw_rows"], stats["n_pairs"], stats["n_absent"], stats["n_timestamps"]) == (69, 23, 1, 6)


def test_null_only_cell_is_a_present_zero(spark):
    raw = spark.createDataFrame([(1, T0, 39, None), (2, T0, 39, 4.0)], "square_id int, time_ms long, country_code int, internet double")
    got = {r["area"]: r["value"] for r in P.country_rollup(raw, SPEC).collect()}
    assert got == {1: 0.0, 2: 4.0}


def test_only_needed_columns_are_converted(spark, tmp_path):
    write_day(tmp_path, 0)
    plan = R.scan_cdr(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<square_id:int,time_ms:bigint,internet:double>" in plan


def test_bad_days_are_reported(spark, tmp_path):
    write_day(tmp_path, 0, intervals=range(5))
    write_day(tmp_path, 1, squares=(1, 2, 9))
    raw = R.scan_cdr(spark, str(tmp_path))
    rollup = P.country_rollup(raw, SPEC)
    assert [(r["date"], r["n_timestamps"]) for r in Q.check_day_length(rollup, SPEC).collect()] == [(dt.date(2013, 11, 1), 5)]
    assert [(r["area"], r["n_rows"]) for r in Q.check_square_range(raw, SPEC).collect()] == [(9, 18)]
    with pytest.raises(Q.PanelError, match="ids"):
        Q.demand_empty(Q.check_square_range(raw, SPEC), "ids")
    present = rollup.select(F.lit(dt.date(2013, 11, 1)).alias("date"))
    assert Q.missing_days(present, SPEC).count() == 3


def test_file_dates(spark):
    names = ["/a/sms-call-internet-mi-2013-11-01.txt", "/a/date=2013-12-24/part-0.csv", "/a/readme.txt", "/a/x-2013-13-40.txt"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.select(R.file_date(F.col("p"))).collect()] == [dt.date(2013, 11, 1), dt.date(2013, 12, 24), None, None]


def test_stream_resumes_and_rerun_changes_nothing(spark, tmp_path):
    raw, out, progress = tmp_path / "raw", tmp_path / "out", tmp_path / "progress"
    raw.mkdir()
    write_day(raw, 1)
    write_day(raw, 0)
    run = lambda: ING.ingest_stream(spark, str(raw), str(out), str(progress), SPEC, files_per_trigger=1)
    assert run() == 2
    first = sorted(ING.stored_rollup(spark, str(out)).collect())
    assert run() == 0
    assert sorted(ING.stored_rollup(spark, str(out)).collect()) == first
    write_day(raw, 2)
    assert run() == 1
    assert spark.read.parquet(str(out)).select("date").distinct().count() == 3


def test_failing_file_keeps_earlier_days(spark, tmp_path):
    raw, out, progress = tmp_path / "raw", tmp_path / "out", tmp_path / "progress"
    raw.mkdir()
    write_day(raw, 0)
    ING.ingest_stream(spark, str(raw), str(out), str(progress), SPEC)
    write_day(raw, 1, squares=(1, 77))
    with pytest.raises(Exception, match="outside the grid"):
        ING.ingest_stream(spark, str(raw), str(out), str(progress), SPEC)
    assert ING.stored_rollup(spark, str(out)).count() == 24


def bad_days(raw):
    """Five days, of which one holds a foreign area, one a foreign day, one an unreadable line and one is short."""
    paths = [write_day(raw, 0), write_day(raw, 1, squares=(1, 2, 3, 4, 77)), write_day(raw, 2), write_day(raw, 3, intervals=range(5))]
    paths[2].write_text(paths[2].read_text() + "x\ty\n")
    paths.append(raw / "second-2013-11-01.txt")
    paths[4].write_text(f"1\t{T0 + 86_400_000}\t39\t\t\t\t\t1.0\n")
    return paths


REASONS = {
    "second-2013-11-01.txt": "record of another day: 2013-11-02",
    "sms-call-internet-mi-2013-11-02.txt": "area id outside the grid: 77",
    "sms-call-internet-mi-2013-11-03.txt": "1 cells of unreadable records",
    "sms-call-internet-mi-2013-11-04.txt": "day has 5 of 6 steps",
}


def reasons(spark, out):
    return {r["file"].rsplit("/", 1)[1]: r["reason"] for r in ING.refused_files(spark, str(out)).collect()}


def test_bad_files_of_a_micro_batch_hold_up_no_other(spark, tmp_path):
    raw, out, progress = tmp_path / "raw", tmp_path / "out", tmp_path / "progress"
    raw.mkdir()
    bad_days(raw)
    with pytest.raises(Q.PanelError, match="4 files refused"):
        ING.ingest_stream(spark, str(raw), str(out), str(progress), SPEC, whole_days=True)
    assert {r["date"] for r in spark.read.parquet(str(out)).collect()} == {dt.date(2013, 11, 1)} and ING.stored_rollup(spark, str(out)).count() == 24
    assert reasons(spark, out) == REASONS
    # the batch is done with; it is not offered again
    assert ING.ingest_stream(spark, str(raw), str(out), str(progress), SPEC, whole_days=True) == 0


def test_a_corrected_file_is_taken_by_the_batch_form(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    bad_days(raw)
    assert ING.ingest_pending(spark, str(raw), str(out), SPEC, days_per_batch=1, whole_days=True, allow_refused=True) == 4
    assert reasons(spark, out) == REASONS
    assert ING.ingest_pending(spark, str(raw), str(out), SPEC, whole_days=True) == 0
    time.sleep(1.1)
    write_day(raw, 3)
    assert ING.ingest_pending(spark, str(raw), str(out), SPEC, whole_days=True) == 1
    assert sorted(r["date"].day for r in spark.read.parquet(str(out)).select("date").distinct().collect()) == [1, 4]


def test_a_large_file_is_stored_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ING, "CELLS_PER_PART", 8)
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    write_day(raw, 0)
    ING.ingest_pending(spark, str(raw), str(out), SPEC)
    assert len(list(out.glob("*/*/part-*.parquet"))) > 1 and ING.stored_rollup(spark, str(out)).count() == 24


def test_plain_cutting_equals_the_csv_reader(spark, tmp_path):
    write_day(tmp_path, 0)
    (tmp_path / "odd-2013-11-02.txt").write_text("1\t2\t3\t\t\t\t\t\n1\t2\t3\t\t\t\t\t-1.5E2\n\t\t\t\t\t\t\t0\n")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(R.kept_fields(spark.read.text(str(tmp_path)))) == rows(R.scan_cdr(spark, str(tmp_path), with_file=True))


def test_batch_ingest_limit_order_and_force(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    for d in (2, 0, 1):
        write_day(raw, d)
    assert ING.ingest_pending(spark, str(raw), str(out), SPEC, limit=2) == 2
    days = {r[0] for r in spark.read.parquet(str(out)).select("date").distinct().collect()}
    assert days == {dt.date(2013, 11, 1), dt.date(2013, 11, 2)}
    assert ING.ingest_pending(spark, str(raw), str(out), SPEC) == 1
    assert ING.ingest_pending(spark, str(raw), str(out), SPEC) == 0
    before = sorted(ING.stored_rollup(spark, str(out)).collect())
    assert ING.ingest_pending(spark, str(raw), str(out), SPEC, force=True) == 3
    assert sorted(ING.stored_rollup(spark, str(out)).collect()) == before
    (raw / "notes.txt").write_text("x")
    with pytest.raises(Q.PanelError, match="date"):
        ING.ingest_pending(spark, str(raw), str(out), SPEC)


def test_integrity_audit(spark, tmp_path):
    import hashlib

    rows = []
    for i, text in enumerate(["alpha", "beta", "gamma"]):
        (tmp_path / f"f{i}.txt").write_text(text)
        rows.append((f"f{i}.txt", len(text), hashlib.md5(text.encode()).hexdigest()))
    rows[1] = (rows[1][0], rows[1][1], "0" * 32)
    rows[2] = (rows[2][0], 99, rows[2][2])
    rows.append(("gone.txt", 1, "0"))
    manifest = spark.createDataFrame(rows, "name string, length long, md5 string")
    got = {r["name"]: r["status"] for r in R.file_integrity_audit(spark, str(tmp_path), manifest).collect()}
    assert got == {"f0.txt": "match", "f1.txt": "digest differs", "f2.txt": "size differs", "gone.txt": "missing"}


def gap_panel(spark, missing, days=3):
    spec = spec_hourly(days, n_areas=2, splits=(("train", 1), ("test", 1), ("stress", 1)))
    series = {}
    for area in (1, 2):
        v = np.arange(days * 24, dtype=float) * area + 5
        v[list(missing)] = np.nan
        series[area] = v
    return panel_frame(spark, series, spec), spec


def test_short_gaps_are_filled_on_the_line_and_long_ones_stay(spark):
    missing = {0, 5, 10, 11, 12, 20, 21, 22, 23, 40, 41}
    panel, spec = gap_panel(spark, missing)
    runs = sorted((r["start"], r["length"]) for r in P.gap_runs(P.missing_steps(panel)).collect())
    assert runs == [(0, 1), (5, 1), (10, 3), (20, 4), (40, 2)]
    out = P.interpolate_gaps(panel, spec).toPandas().sort_values(["area", "t_index"])
    for area, part in out.groupby("area"):
        v = part["value"].to_numpy(dtype=float)
        for i in (5, 10, 11, 12, 40, 41):
            assert v[i] == pytest.approx(i * area + 5)
        assert np.isnan(v[[0, 20, 21, 22, 23]]).all()
        assert list(part["t_index"][part["filled"]]) == [5, 10, 11, 12, 40, 41]


def test_unfilled_gap_in_the_test_split_escalates(spark):
    panel, spec = gap_panel(spark, {2, 3, 4, 5, 30, 31, 32, 33})
    left = P.interpolate_gaps(panel, spec).filter("value is null")
    assert sorted({r["t_index"] for r in Q.gap_escalation(left, spec).collect()}) == [30, 31, 32, 33]
    assert Q.null_audit(P.interpolate_gaps(panel, spec)).first()["n_null"] == 16


def test_clock_change_is_reported(spark):
    spec = PanelSpec(start=dt.date(2013, 10, 26), end=dt.date(2013, 10, 28), step_seconds=3600, daily=24, weekly=168, n_areas=1, tz="Europe/Rome")
    times = P.time_index(spec.but(end=dt.date(2013, 10, 29)), spark)
    odd = {r["date"]: r["n_steps"] for r in Q.dst_check(times, spec).collect()}
    assert odd[dt.date(2013, 10, 27)] == 25
    assert dt.date(2013, 10, 26) not in odd


def test_stacked_panel_and_report(spark, tmp_path):
    write_day(tmp_path, 0)
    write_day(tmp_path, 2)
    rollup = P.country_rollup(R.scan_cdr(spark, str(tmp_path)), SPEC)
    panel = P.stack_days(P.densify(rollup, SPEC), SPEC)
    report = Q.panel_report(panel, rollup, SPEC).first()
    assert (report["n_timestamps"], report["n_areas"], report["n_missing_steps"]) == (24, 4, 12)
    assert report["first_utc"] == dt.datetime(2013, 10, 31, 23)
    assert report["first_local"] == dt.datetime(2013, 11, 1)
    assert len(report["missing_utc"]) == 12
    assert Q.grid_gaps(rollup).count() == 6  # the missing day in between; the last day lies outside


def test_geojson_document_and_lines(spark, tmp_path):
    ring = [[9.0, 45.0], [9.2, 45.0], [9.2, 45.4], [9.0, 45.4], [9.0, 45.0]]
    feature = {"type": "Feature", "properties": {"cellId": 7}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    doc, lines = tmp_path / "grid.geojson", tmp_path / "grid.jsonl"
    doc.write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}, indent=1))
    lines.write_text(json.dumps(feature) + "\n")
    from cellpulse.operators.spatial import cell_centroid

    for path, flag in ((doc, False), (lines, True)):
        row = cell_centroid(R.scan_grid_geojson(spark, str(path), lines=flag)).first()
        assert (row["cell_id"], row["latitude"], row["longitude"]) == (7, pytest.approx(45.2), pytest.approx(9.1))


def test_run_log_from_an_executed_notebook(spark, tmp_path):
    line = "[ 1/62] 2013-11-01  dl    5.7s  ingest   1.6s  4,842,625 rows  absent  18  peak   574 MiB\n"
    other = "[ 2/62] 2013-11-02  dl    6.0s  ingest   1.4s  5,000,000 rows  absent  20  peak   500 MiB\n"
    book = {"cells": [{"outputs": [{"text": ["start\n", line]}]}, {"outputs": [{"data": {"text/plain": [other]}}]}, {"outputs": []}]}
    path = tmp_path / "run.ipynb"
    path.write_text(json.dumps(book))
    log = R.scan_run_log(R.notebook_lines(spark, str(path)), 1_440_000)
    rows = sorted(log.collect(), key=lambda r: r["date"])
    assert [r["raw_rows"] for r in rows] == [4842625, 5000000]
    assert rows[0]["total_s"] == 7.3
    summary = Q.ingest_summary(log).first()
    assert (summary["n_days"], summary["total_raw_rows"], summary["absent_max_day"]) == (2, 9842625, dt.date(2013, 11, 2))
    assert summary["download_std_s"] == pytest.approx(np.std([5.7, 6.0], ddof=1))


def test_experiment_log_refuses_rows_without_reason(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("gbt", 5, "grid", "because", 1.0)]
    schema = "model string, area int, stage string, rationale_for_next_change string, valid_mae double"
    WR.append_log(spark.createDataFrame(rows, schema), path)
    WR.append_log(spark.createDataFrame(rows, schema), path)
    assert spark.read.parquet(path).count() == 2
    for bad in (("gbt", 5, "grid", "  ", 1.0), (None, 5, "grid", "x", 1.0)):
        with pytest.raises(Q.PanelError):
            WR.append_log(spark.createDataFrame([bad], schema), path)
    assert spark.read.parquet(path).count() == 2


def test_stored_panel_prunes_and_names_missing_areas(spark, tmp_path):
    spec = spec_hourly(2)
    panel = panel_frame(spark, {a: np.arange(48.0) for a in (1, 2, 3)}, spec)
    path = str(tmp_path / "panel")
    WR.sink_panel(panel, path)
    df = R.scan_panel(spark, path, [2], ["t_index", "value"])
    assert df.count() == 48
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(area, [2])]" in plan or "EqualTo(area,2)" in plan
    with pytest.raises(Q.PanelError, match="99"):
        R.scan_panel(spark, path, [2, 99])


def test_reconcile(spark):
    a = spark.createDataFrame([("2013-11-01", 1e6), ("2013-11-02", 5.0), ("2013-11-03", 1.0)], "date string, total double")
    b = spark.createDataFrame([("2013-11-01", 1e6 + 0.5), ("2013-11-02", 5.1)], "date string, total double")
    got = {r["date"]: r["agrees"] for r in Q.reconcile_totals(a, b).collect()}
    assert got == {"2013-11-01": True, "2013-11-02": False, "2013-11-03": False}


def test_to_local_does_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = P.time_index(SPEC, spark).filter("t_index = 0").select(F.col("utc").cast("string"), F.col("local").cast("string")).first()
        assert tuple(row) == ("2013-10-31 23:00:00", "2013-11-01 00:00:00")
        # 02:30 does not exist in this zone on that day, but it does in a zone-free timestamp
        spark.conf.set("spark.sql.session.timeZone", "Europe/Rome")
        gap = spark.range(1).select(X.epoch_seconds(X.ntz(dt.datetime(2024, 3, 31, 2, 30))))
        assert gap.first()[0] == 1711852200
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)




def test_a_record_of_another_day_fails_before_anything_is_stored(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    write_day(raw, 0)
    path = write_day(raw, 1)
    path.write_text(path.read_text() + f"1\t{T0}\t39\t\t\t\t\t1.0\n")
    with pytest.raises(Exception, match="another day"):
        ING.ingest_pending(spark, str(raw), str(out), SPEC, days_per_batch=1)
    assert {r[0] for r in spark.read.parquet(str(out)).select("date").distinct().collect()} == {dt.date(2013, 11, 1)}
