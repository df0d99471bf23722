"""Ingest end-to-end on small CSV deliveries (cases of the reference import tests)."""

from __future__ import annotations

import csv
import os

from pyspark.sql import functions as F

from docket.operators import ingest as I
from docket.plans.views import empty_state
from docket.sources import files as SF

HEADER = ["case_enquiry_id", "open_dt", "closed_dt", "sla_target_dt", "case_status", "source", "subject", "reason",
          "type", "neighborhood", "closure_reason"]
BASE = {"case_enquiry_id": "10100-001", "open_dt": "2024-01-15 10:00:00", "closed_dt": "",
        "sla_target_dt": "2024-01-20 17:00:00", "case_status": "Open", "source": "Citizens Connect App",
        "subject": "Public Works Department", "reason": "Highway Maintenance", "type": "Request for Pothole Repair",
        "neighborhood": "Roxbury", "closure_reason": ""}
CATALOG = [("source", "Citizens Connect App", "citizens_connect_app"),
           ("subject", "Public Works Department", "public_works_department"),
           ("reason", "Highway Maintenance", "highway_maintenance"),
           ("type", "Request for Pothole Repair", "request_for_pothole_repair"),
           ("type", "Graffiti Removal", "graffiti_removal"),
           ("neighborhood", "Roxbury", "roxbury")]


def catalog(spark):
    return spark.createDataFrame([(c, r, k, "1.0.0") for c, r, k in CATALOG], "column string, raw string, code string, "
                                                                            "version string")


def write_csv(path, rows, header=HEADER):
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, fieldnames=header)
        w.writeheader()
        for r in rows:
            w.writerow({k: r.get(k, "") for k in header})
    return path


def run(spark, paths, state=None, version="1.0.0"):
    rows, headers = SF.read_csv_deliveries(spark, paths)
    st = state if state is not None else empty_state(spark)
    return I.run_import(rows, st, catalog(spark), version), headers


def counts(res):
    return {r["import_run"].rsplit("/", 1)[-1]: r.asDict() for r in res["counts"].collect()}


def test_new_row_inserted(spark, tmp_path):
    p = write_csv(os.path.join(tmp_path, "a.csv"), [BASE])
    res, _ = run(spark, [p])
    c = counts(res)["a.csv"]
    assert c["inserted_rows"] == 1 and c["status"] == "completed" and c["warning_count"] == 0
    snap = res["snapshots"].first()
    assert '"deadline":"2024-01-20T17:00:00"' in snap["input_json"] and '"type":"request_for_pothole_repair"' in \
        snap["input_json"]


def test_same_row_other_file_skipped_and_update(spark, tmp_path):
    a = write_csv(os.path.join(tmp_path, "a.csv"), [BASE])
    r1, _ = run(spark, [a])
    state = r1["state"].cache()
    b = write_csv(os.path.join(tmp_path, "b.csv"), [BASE, {**BASE, "case_enquiry_id": "10100-002"}])
    r2, _ = run(spark, [b], state)
    c = counts(r2)["b.csv"]
    assert (c["skipped_duplicate_rows"], c["inserted_rows"]) == (1, 1)
    closed = {**BASE, "closed_dt": "2024-01-18 09:00:00", "case_status": "Closed", "closure_reason": "Case Resolved"}
    d = write_csv(os.path.join(tmp_path, "d.csv"), [closed])
    r3, _ = run(spark, [d], state)
    assert counts(r3)["d.csv"]["updated_rows"] == 1
    s = r3["state"].where(F.col("external_id") == "10100-001").first()
    assert s["current_status"] == "Closed" and s["closure_reason"] == "Case Resolved"
    assert s["e_opening_fp"] == state.where(F.col("external_id") == "10100-001").first()["e_opening_fp"]
    assert r3["snapshots"].count() == 0  # opening snapshot is never rewritten


def test_opening_conflict_and_completed_with_issues(spark, tmp_path):
    a = write_csv(os.path.join(tmp_path, "a.csv"), [BASE])
    state = run(spark, [a])[0]["state"].cache()
    changed = {**BASE, "type": "Graffiti Removal"}
    b = write_csv(os.path.join(tmp_path, "b.csv"), [changed, {**BASE, "case_enquiry_id": "X-9"}])
    r, _ = run(spark, [b], state)
    c = counts(r)["b.csv"]
    assert c["quarantined_rows"] == 1 and c["error_rows"] == 1 and c["inserted_rows"] == 1
    assert c["status"] == "completed_with_issues"
    codes = [x["issue_code"] for x in r["issues"].collect()]
    assert codes == ["OPENING_DATA_CONFLICT"]


def test_unknown_source_warning_blank_id_and_counters(spark, tmp_path):
    rows = [{**BASE, "case_enquiry_id": "1", "source": "Carrier Pigeon"}, {**BASE, "case_enquiry_id": "2"},
            {**BASE, "case_enquiry_id": "3"}, {**BASE, "case_enquiry_id": "  "}]
    p = write_csv(os.path.join(tmp_path, "a.csv"), rows)
    r, _ = run(spark, [p])
    c = counts(r)["a.csv"]
    assert (c["total_rows"], c["inserted_rows"], c["warning_count"], c["quarantined_rows"]) == (4, 3, 1, 1)
    issues = sorted((x["row_number"], x["issue_code"], x["column_name"], x["severity"]) for x in r["issues"].collect())
    assert issues == [(1, "UNKNOWN_CANONICAL_MAPPING", "source", "warning"),
                      (4, "REQUIRED_FIELD_MISSING", "case_enquiry_id", "error")]
    assert all("Carrier" not in x["issue_message"] for x in r["issues"].collect())  # no raw values stored


def test_missing_required_column_fails_file(spark, tmp_path):
    hdr = [h for h in HEADER if h != "case_enquiry_id"]
    p = write_csv(os.path.join(tmp_path, "noid.csv"), [BASE], header=hdr)
    rows, headers = SF.read_csv_deliveries(spark, [p])
    assert rows.count() == 0
    miss = I.failed_file_issues(I.missing_required_columns(headers)).collect()
    assert [(m["issue_code"], m["column_name"]) for m in miss] == [("MISSING_REQUIRED_COLUMN", "case_enquiry_id")]


def test_mapping_version_mismatch(spark, tmp_path):
    a = write_csv(os.path.join(tmp_path, "a.csv"), [BASE])
    state = run(spark, [a])[0]["state"].cache()
    closed = {**BASE, "closed_dt": "2024-01-18 09:00:00", "case_status": "Closed"}
    b = write_csv(os.path.join(tmp_path, "b.csv"), [closed, {**BASE, "case_enquiry_id": "NEW"}])
    r, _ = run(spark, [b], state, version="2.0.0")
    dec = {x["external_id"]: x["decision"] for x in r["rows"].collect()}
    assert dec == {"10100-001": "CANONICAL_MAPPING_MISMATCH", "NEW": "insert"}


def test_repeated_key_in_one_file_follows_file_order(spark, tmp_path):
    closed = {**BASE, "closed_dt": "2024-01-18 09:00:00", "case_status": "Closed"}
    rows = [BASE, BASE, closed, {**BASE, "type": "Graffiti Removal"}, closed]
    p = write_csv(os.path.join(tmp_path, "a.csv"), rows)
    r, _ = run(spark, [p])
    dec = [x["decision"] for x in r["rows"].orderBy("_row").collect()]
    assert dec == ["insert", "skip", "update", "OPENING_DATA_CONFLICT", "skip"]


def test_duplicate_file_skip(spark, tmp_path):
    a = write_csv(os.path.join(tmp_path, "a.csv"), [BASE])
    man = SF.file_manifest(spark, [a])
    runs = man.select("file_hash", F.lit("completed").alias("status"))
    assert I.skip_known_files(man, runs).first()["duplicate"] == 1
    failed = man.select("file_hash", F.lit("failed").alias("status"))
    assert I.skip_known_files(man, failed).first()["duplicate"] == 0


def test_row_numbers_exact_across_splits(spark, tmp_path):
    # a file large enough to be split into several tasks
    rows = [{**BASE, "case_enquiry_id": f"id-{i}"} for i in range(30000)]
    p = write_csv(os.path.join(tmp_path, "big.csv"), rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256 * 1024)
    try:
        df, _ = SF.read_csv_deliveries(spark, [p])
        assert df.rdd.getNumPartitions() > 1
        got = df.select("case_enquiry_id", "_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["_row"] for r in got) == list(range(1, 30001))
    assert all(r["case_enquiry_id"] == f"id-{r['_row'] - 1}" for r in got)


def test_decisions_do_not_depend_on_partitioning(spark, tmp_path):
    closed = {**BASE, "closed_dt": "2024-01-18 09:00:00", "case_status": "Closed"}
    rows = [BASE, BASE, closed, closed] * 50
    p = write_csv(os.path.join(tmp_path, "a.csv"), rows)
    df, _ = SF.read_csv_deliveries(spark, [p])
    a = I.run_import(df, empty_state(spark), catalog(spark))["rows"].select("_row", "decision")
    b = I.run_import(df.repartition(7), empty_state(spark), catalog(spark))["rows"].select("_row", "decision")
    assert sorted(a.collect()) == sorted(b.collect())


def test_import_keeps_only_the_tables_that_its_outputs_read(spark, tmp_path):
    """Staged rows and key states go once the next table is written; fingerprints come back as they were."""
    from docket.session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(spark)
    folders = lambda: {x for x in os.listdir(root.removeprefix("file://")) if x.startswith("stored-")}
    closed = {**BASE, "closed_dt": "2024-01-18 09:00:00", "case_status": "Closed"}
    p = write_csv(os.path.join(tmp_path, "a.csv"), [BASE, closed, {**BASE, "case_enquiry_id": "2"}, {**BASE, "case_enquiry_id": ""}])
    before = folders()
    res, _ = run(spark, [p])
    assert {os.path.basename(t.scratch) for t in res["held"]} == folders() - before and len(res["held"]) == 3
    assert sorted(r["decision"] for r in res["rows"].collect()) == ["REQUIRED_FIELD_MISSING", "insert", "insert", "update"]
    for r in res["state"].collect():
        assert len(r["e_opening_fp"]) == len(r["e_row_fp"]) == 64 and r["e_row_fp"] == r["e_row_fp"].lower()


def test_fingerprints_of_any_text_are_packed_and_unpacked(spark):
    from docket.functions import exprs as X

    texts = ["0123456789abcdef" * 4, "0123456789ABCDEF" * 4, "", "x" * 32, "f" * 63, "f" * 64 + "\n", "\u00fc" * 20, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    got = df.select("i", X.pack_hex("t").alias("p")).select("i", F.length("p").alias("n"), X.unpack_hex("p").alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == texts
    assert [r["n"] == 32 for r in got[:-1]] == [True, *[False] * 6]


def test_stored_fingerprints_that_are_no_digests_are_compared(spark):
    rows = [("a", "o", "r", 1, 1), ("a", "o", "s", 1, 2), ("a", "o", "s", 1, 3), ("b", "x", "r", 1, 4), ("c", "o", "r", 1, 5)]
    valid = spark.createDataFrame(rows, "external_id string, opening_fp string, row_fp string, _file_seq int, _row int")
    state = spark.createDataFrame([("a", "o", "r", "1.0.0"), ("b", "o", "r", "1.0.0")], "external_id string, e_opening_fp string, e_row_fp string, e_mapping_version string")
    got = {r["_row"]: r for r in I.decide(valid, state, "1.0.0").collect()}
    assert [got[i]["decision"] for i in range(1, 6)] == ["skip", "update", "skip", "skip", "insert"]
    assert got[2]["row_fp"] == "s" and got[5]["opening_fp"] == "o"
