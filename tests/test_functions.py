"""Rule tables for the scalar column functions."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from docket import config as C
from docket.functions import exprs as X

# P2 accept table: text -> expected (value or None, failed?)
PARSE_CASES = [
    ("2024-01-15 10:00:00", dt.datetime(2024, 1, 15, 10), False),
    ("2024-01-15", dt.datetime(2024, 1, 15), False),
    ("2024-01-15T10:00:00.5", dt.datetime(2024, 1, 15, 10, 0, 0, 500000), False),
    ("2024-01-15 10:00", dt.datetime(2024, 1, 15, 10), False),
    ("2024-1-5", dt.datetime(2024, 1, 5), False),
    ("2024-1-5 1:2:3", dt.datetime(2024, 1, 5, 1, 2, 3), False),
    ("20240115", dt.datetime(2024, 1, 15), False),
    ("2024-01-15T10:00:00Z", dt.datetime(2024, 1, 15, 10), False),
    ("2024-01-15T10:00:00+03:00", dt.datetime(2024, 1, 15, 10), False),
    ("  2024-01-15  ", dt.datetime(2024, 1, 15), False),
    ("2024", None, True),
    ("2024-01", None, True),
    ("2024-02-30", None, True),
    ("01/15/2024", None, True),
    ("10:00:00", None, True),
    ("garbage", None, True),
    ("", None, False),
    ("   ", None, False),
    (None, None, False),
]


def test_tolerant_timestamp_parse(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in PARSE_CASES], "t string")
    out = df.select("t", X.parse_ts("t").alias("v"), X.ts_parse_failed("t").alias("bad")).collect()
    for (text, want, bad), row in zip(PARSE_CASES, out):
        assert row["v"] == want, text
        assert bool(row["bad"]) == bad, text


def _ref_fingerprint(fields: dict) -> str:
    def norm(v):
        if v is None:
            return "<<null>>"
        if isinstance(v, dt.datetime):
            return v.isoformat()
        t = str(v).strip()
        return "<<empty>>" if t == "" else t

    payload = json.dumps({k: norm(v) for k, v in sorted(fields.items())}, sort_keys=True, ensure_ascii=False,
                         separators=(",", ":"))
    return hashlib.sha256(payload.encode()).hexdigest()


def test_fingerprint_matches_python_rule_and_is_key_order_free(spark):
    rows = [("A-1", dt.datetime(2024, 1, 15, 10), None, " x ", ""),
            ("B\"2", dt.datetime(2024, 1, 15, 10, 0, 0, 1234), dt.datetime(2024, 2, 1), "ç ü", "y")]
    df = spark.createDataFrame(rows, "id string, a timestamp_ntz, b timestamp_ntz, c string, d string")
    fields = {"external_id": X.norm_value("id"), "created_at": X.norm_value("a", True),
              "deadline": X.norm_value("b", True), "source": X.norm_value("c"), "subject": X.norm_value("d")}
    got = df.select(X.fingerprint(fields).alias("fp"),
                    X.fingerprint(dict(reversed(list(fields.items())))).alias("fp2")).collect()
    for (i, a, b, c, d), g in zip(rows, got):
        want = _ref_fingerprint({"external_id": i, "created_at": a, "deadline": b, "source": c, "subject": d})
        assert g["fp"] == want
        assert g["fp2"] == want


def test_targets_rule_table(spark):
    cut = dt.datetime(2025, 1, 13)
    d = dt.datetime(2024, 5, 1)
    rows = [
        (dt.datetime(2024, 4, 30), d, 0),            # before deadline
        (d, d, 0),                                    # tie = on time
        (dt.datetime(2024, 5, 2), d, 1),              # after
        (None, dt.datetime(2025, 1, 12), 1),          # open, deadline before cutoff
        (None, cut, None),                            # open, deadline == cutoff
        (None, dt.datetime(2025, 2, 1), None),        # open, after cutoff
        (dt.datetime(2024, 5, 2), None, None),        # no SLA
    ]
    df = spark.createDataFrame(rows, "done timestamp_ntz, dl timestamp_ntz, want int")
    for r in df.select(X.is_delayed("done", "dl", cut).alias("got"), "want").collect():
        assert r["got"] == r["want"]


def test_duration_split_calendar(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 8, 31, 23, 59), dt.datetime(2024, 8, 31, 23, 59)),
         (dt.datetime(2024, 9, 1), dt.datetime(2024, 8, 31)),
         (dt.datetime(2024, 12, 31, 23), None),
         (dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 2, 6))], "c timestamp_ntz, d timestamp_ntz")
    out = df.select(X.duration_hours("c", "d").alias("h"), X.split_label("c", C.REFERENCE_SPLITS).alias("s"),
                    *[v.alias(k) for k, v in X.calendar_features("c").items()]).collect()
    assert [r["h"] for r in out] == [0.0, None, None, 30.0]
    assert [r["s"] for r in out] == ["train", "validation", "audit", None]
    assert out[0]["open_weekday"] == dt.datetime(2024, 8, 31).weekday()
    assert out[0]["is_weekend"] == 1 and out[1]["is_weekend"] == 1
    assert out[3]["open_month"] == 1 and out[0]["open_hour"] == 23


def test_risk_bands_and_rounding(spark):
    ps = [0.0, 0.39, 0.394, 0.395, 0.40, 0.694, 0.695, 0.70, 1.0, 0.125, 0.005, None]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    out = df.select(X.risk_score("p").alias("s"), X.risk_level(X.risk_score("p")).alias("l")).collect()
    for p, r in zip(ps, out):
        if p is None:
            assert r["s"] is None and r["l"] is None
            continue
        want = max(0, min(100, round(p * 100)))  # Python rounds half to even
        assert r["s"] == want, p
        assert r["l"] == ("low" if want <= 39 else "medium" if want <= 69 else "high")


def test_clamp_interval_logit(spark):
    df = spark.createDataFrame([(-3.0,), (float("nan"),), (float("inf"),), (5.0,)], "x double")
    got = [r[0] for r in df.select(X.clamp_hours("x")).collect()]
    assert got == [0.0, None, None, 5.0]
    lo, hi = X.prob_interval(F.lit(0.9), F.lit(0.1))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi"), X.logit(F.lit(0.0)).alias("z")).first()
    assert abs(r["lo"] - 0.7) < 1e-12 and r["hi"] == 1.0
    assert r["z"] < -34  # clipped at 1e-15, finite


def test_threshold_cuts():
    cuts = X.threshold_cuts()
    assert len(cuts) == 17 and abs(cuts[0] - 0.1) < 1e-12 and abs(cuts[-1] - 0.9) < 1e-9


def test_canonical_code_rule(spark):
    raws = ["Mobile App", "Water & Sewer Board", "Curb Cover / Drain", "Clerk's 24 Hour Line",
            "Roads - Signal Unit", "  Padded  "]
    want = ["mobile_app", "water_and_sewer_board", "curb_cover_and_drain", "clerk_s_24_hour_line",
            "roads_signal_unit", "padded"]
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    assert [x[0] for x in df.select(X.canonical_code_rule("r")).collect()] == want
