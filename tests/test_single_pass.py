"""Expensive steps happen once: snapshots are parsed once a row, deliveries are imported once, long sides are not broadcast."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from docket import config as C
from docket.operators import dataset as D
from docket.operators import interact as I
from docket.operators import modeling as ML
from docket.plans import q_ingest as QI
from docket.plans import q_model as QM
from docket.plans import views as V
from tests.conftest import SF_SMALL


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


SNAPSHOTS = [("1", '{"created_at":"2021-03-04T05:06:07","deadline":null,"external_id":"1","source":"a","subject":"b","reason":"c","type":"d","neighborhood":"e"}'),
             ("2", "{bad"), ("3", '{"created_at":"x"}'), ("4", None)]


def _snapshots(spark):
    rows = [(k, C.SNAPSHOT_TYPE, C.FEATURE_SCHEMA_VERSION, j) for k, j in SNAPSHOTS]
    return spark.createDataFrame(rows, "external_id string, snapshot_type string, feature_schema_version string, input_json string")


def test_snapshot_is_parsed_once_below_the_filters(spark):
    proc = spark.createDataFrame([("1", None, None, None)], "external_id string, created_at timestamp_ntz, deadline timestamp_ntz, completed_at timestamp_ntz")
    plan = _optimized(D.cohort(D.build_dataset(_snapshots(spark), proc), "is_delayed"))
    assert plan.count("from_json") == 1
    assert not any("Filter" in line and ("from_json" in line or "RLIKE" in line) for line in plan.splitlines())
    plan = _optimized(D.scoring_features(_snapshots(spark)).where("feature_error IS NULL"))
    assert plan.count("from_json") == 1


def test_snapshot_errors_stay(spark):
    got = {r["external_id"]: r["schema_error"] for r in D.parse_snapshot(_snapshots(spark)).collect()}
    assert got["1"] is None and got["2"] == got["4"] == "malformed input_json" and got["3"].startswith("missing keys: ")


def test_summary_reads_a_stored_dataset(spark):
    assert "from_json" not in _optimized(QM.train_summary(spark, SF_SMALL))


def test_case_codes_come_from_the_stored_table(spark):
    plan = _optimized(V.process_view(spark, SF_SMALL))
    assert "regexp_replace" not in plan
    raw = {r["external_id"]: r for r in V.process_raw(spark, SF_SMALL).select("external_id", *[V._code(V.F.col(c)).alias(c) for c in C.CATEGORICAL_FEATURES]).collect()}
    for r in V.process_view(spark, SF_SMALL).collect():
        assert all(r[c] == raw[r["external_id"]][c] for c in C.CATEGORICAL_FEATURES)


def test_each_delivery_is_imported_once(spark, monkeypatch):
    calls = []

    def fake(rows, state, catalog, mapping_version=C.CANONICAL_MAPPING_VERSION):
        calls.append(rows)
        issues = spark.createDataFrame([], ", ".join(f"{c} string" for c in QI._ISSUE_COLS))
        return {"state": V.empty_state(spark), "issues": issues}

    monkeypatch.setattr(QI.I, "run_import", fake)
    QI.ingest_issues(spark, SF_SMALL)
    assert len(calls) == 2


def test_plan_joins_do_not_broadcast_long_sides(spark):
    requests = spark.createDataFrame([(1,), (2,), (2,)], "process_id bigint")
    snaps = spark.createDataFrame([(1, 1, "x")], "process_id bigint, snapshot_id bigint, input_fingerprint string")
    prior = spark.createDataFrame([(7, 1, "x", 1, "opening", "success")], "id bigint, snapshot_id bigint, input_fingerprint string, "
                                  "model_bundle_id bigint, prediction_context string, status string")
    plan = I.reuse_plan(requests, snaps, prior, 1)
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().sparkPlan().toString()
    assert sorted(r["action"] for r in plan.collect()) == ["rejected", "rejected", "reuse"]


def test_score_is_computed_once(spark):
    scored = spark.createDataFrame([(1, 2.0, 0.25, 3.0), (2, None, 0.75, float("nan"))], "id int, sla_duration_hours double, z double, h double")
    got = ML.decide_scores(scored.selectExpr("id", "sla_duration_hours", "exp(z) / 4 AS p", "h AS y_raw"), ["id"])
    assert _optimized(got).count("EXP(") <= 1
    rows = {r["id"]: r for r in got.collect()}
    assert rows[1]["risk_score"] == 32 and rows[1]["ok"] == 1 and rows[2]["delay_probability"] is None and rows[2]["ok"] == 0


def test_texts_are_stripped_and_written_once(spark):
    """A snapshot's two dates are stripped once each; a fingerprint is one JSON text; an import keeps no source texts."""
    from docket.functions import exprs as X

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    snaps = spark.createDataFrame([("1", '{"created_at":" 2020-01-02T03:04:05Z ","deadline":null}')], "external_id string, input_json string")
    parsed = D.parse_snapshot(snaps.repartition(1), ["created_at"])
    assert plan(parsed).count("trim(") == 2
    row = parsed.first()
    assert str(row["snap_created"]) == "2020-01-02 03:04:05" and row["snap_deadline"] is None and row["schema_error"] is None
    texts = spark.createDataFrame([("a", 'q"', "c")], "x string, y string, z string").repartition(1)
    fp = texts.select(X.fingerprint({c: F.col(c) for c in "zyx"}).alias("fp"))
    assert plan(fp).count("to_json") + plan(fp).count("StructsToJson") == 1
    assert fp.first()["fp"] == hashlib.sha256(b'{"x":"a","y":"q\\"","z":"c"}').hexdigest()
    rows = spark.createDataFrame([("7", "2020-01-02", "f", 1, i) for i in (1, 2, 3)], "case_enquiry_id string, open_dt string, _file string, _file_seq int, _row long")
    catalog = spark.createDataFrame([], "column string, raw string, code string, version string")
    decided = QI.I.run_import(rows, V.empty_state(spark), catalog)["decided"]
    assert "open_dt" not in decided.columns
    assert [r["decision"] for r in decided.orderBy("_row").collect()] == ["insert", "skip", "skip"]


def test_all_columns_of_the_dataset_can_be_read(spark):
    """Nested columns of a parsed snapshot were lost between generators when the categories and the schema error were read together."""
    proc = spark.createDataFrame([(k, dt.datetime(2021, 3, 4), None, None) for k, _ in SNAPSHOTS],
                                 "external_id string, created_at timestamp_ntz, deadline timestamp_ntz, completed_at timestamp_ntz").repartition(1)
    snaps = _snapshots(spark).repartition(1)
    rows = {r["external_id"]: r for r in D.build_dataset(snaps, proc).withColumn("schema_error", F.col("schema_error").isNotNull()).collect()}
    assert [rows["1"][c] for c in C.CATEGORICAL_FEATURES] == list("abcde") and rows["1"]["open_hour"] == 5
    assert [rows[k]["schema_error"] for k in "1234"] == [False, True, True, True] and rows["3"]["source"] is None
    parsed = {r["external_id"]: r for r in D.snapshot_features(D.parse_snapshot(snaps)).collect()}
    assert parsed["1"]["snap"]["reason"] == "c" and parsed["1"]["reason"] == "c" and parsed["4"]["snap"] is None
    scored = {r["external_id"]: r for r in D.scoring_features(snaps).collect()}
    assert scored["1"]["type"] == "d" and scored["3"]["feature_error"].startswith("created_at") and scored["4"]["source"] is None


def test_live_cases_do_not_broadcast_the_case_table(spark):
    t = dt.datetime(2024, 1, 1)
    procs = spark.createDataFrame([("1", t, t), ("2", t, t), ("3", t, t)], "external_id string, completed_at timestamp_ntz, deadline timestamp_ntz")
    feats = spark.createDataFrame([("1", None), ("2", "bad")], "external_id string, feature_error string")
    scores = spark.createDataFrame([("1", 0.9), ("1", 0.8)], "external_id string, p double")
    live = I.live_cases(procs, feats, scores)
    assert "BroadcastHashJoin" not in live._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r["external_id"], r["outcome"], r["p"]) for r in live.collect()) == [("1", "ok", 0.8), ("1", "ok", 0.9), ("2", "failed", None), ("3", "skipped", None)]
    assert "BroadcastHashJoin" not in V.scored_view(spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
