"""Sources, sinks, streaming and the driver contract."""

from __future__ import annotations

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from docket import config as C
from docket.operators import dataset as D
from docket.plans import views as V
from docket.sources import files as SF
from docket.sources import sinks as SK
from tests.conftest import SF_SMALL


def _xlsx_bytes(rows):
    """Minimal workbook (inline strings) built with the standard library."""
    def cell(ref, v):
        if isinstance(v, tuple):  # (number, style)
            return f'<c r="{ref}" s="{v[1]}"><v>{v[0]}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    body = ""
    for i, r in enumerate(rows, 1):
        if not r:
            continue
        body += f'<row r="{i}">' + "".join(cell(f"{chr(65 + j)}{i}", v) for j, v in enumerate(r) if v != "") + "</row>"
    sheet = ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/'
             f'spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet7.xml", sheet)
        z.writestr("xl/worksheets/sheet1.xml", sheet.replace(body, ""))  # not the first in the workbook
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{DOC}"><sheets><sheet name="a" r:id="r2"/>'
                                      '<sheet name="b" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet7.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts>'
                                    '<cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/></cellXfs></styleSheet>')
    return buf.getvalue()


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def test_xlsx_reader(spark, tmp_path):
    p = os.path.join(tmp_path, "a.xlsx")
    with open(p, "wb") as f:
        f.write(_xlsx_bytes([["case_enquiry_id", "open_dt", "source"], ["1", "2024-01-15", ""], [], ["2", "", "X"],
                             ["3", (45306.41667, 1), ""], ["4", (45306, 2), ""], ["5", (45306, 0), ""]]))
    long = SF.read_xlsx_deliveries(spark, p)
    rows = SF.xlsx_to_rows(long, ["case_enquiry_id", "open_dt", "source", "absent"]).orderBy("_row").collect()
    assert [(r["_row"], r["case_enquiry_id"], r["open_dt"], r["source"], r["absent"]) for r in rows] == [
        (1, "1", "2024-01-15", "", ""), (2, "", "", "", ""), (3, "2", "", "X", ""), (4, "3", "2024-01-15 10:00:00", "", ""),
        (5, "4", "2024-01-15 00:00:00", "", ""), (6, "5", "45306", "", "")]
    q = os.path.join(tmp_path, "b.xlsx")
    with open(q, "wb") as f:
        f.write(b"not a workbook")
    assert SF.read_xlsx_deliveries(spark, q).first()["error"] == "BadZipFile"


def test_manifest_hashes_large_files_in_chunks(spark, tmp_path):
    import hashlib

    want = {}
    for name, size in (("a.csv", 10), ("b c%20.csv", 1_000), ("d.csv", 5_003), ("e.xlsx", 0)):
        data = bytes(i * 7 % 251 for i in range(size))
        (tmp_path / name).write_bytes(data)
        want[name] = (size, hashlib.sha256(data).hexdigest())
    paths = [str(tmp_path / n) for n in ("a.csv", "d.csv", "e.xlsx")]
    whole = SF.file_manifest(spark, str(tmp_path))
    small = SF.file_manifest(spark, str(tmp_path), whole_bytes=100, chunk_bytes=64)
    rows = lambda df: {r["file_name"]: (r["size"], r["file_hash"]) for r in df.collect()}
    assert rows(small) == rows(whole) == {n: v for n, v in want.items() if v[0]}
    assert rows(SF.file_manifest(spark, paths, whole_bytes=100, chunk_bytes=64)) == {n: want[n] for n in ("a.csv", "d.csv", "e.xlsx")}
    # a file above the bound is never read as one value
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    try:
        assert rows(SF.file_manifest(spark, str(tmp_path), whole_bytes=1_500, chunk_bytes=64)) == rows(whole.sparkSession.createDataFrame(
            [(n, *v) for n, v in want.items() if v[0]], "file_name string, size long, file_hash string"))
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_manifest_hash_and_format_gate(spark, tmp_path):
    import hashlib

    a = os.path.join(tmp_path, "a.csv")
    b = os.path.join(tmp_path, "b.txt")
    for p, data in ((a, b"x,y\n1,2\n"), (b, b"hello")):
        with open(p, "wb") as f:
            f.write(data)
    m = {r["file_name"]: r for r in SF.file_manifest(spark, [a, b]).collect()}
    assert m["a.csv"]["file_hash"] == hashlib.sha256(b"x,y\n1,2\n").hexdigest()
    assert (m["a.csv"]["supported"], m["b.txt"]["supported"]) == (1, 0)


def test_versioned_table(spark, tmp_path):
    root = str(tmp_path)
    assert SK.current_version(spark, root, "t") == 0
    SK.write_version(spark.range(3), root, "t")
    SK.write_version(spark.range(5), root, "t")
    assert SK.current_version(spark, root, "t") == 2
    assert SK.read_current(spark, root, "t").count() == 5
    assert spark.read.parquet(f"{root}/t/v=1").count() == 3  # old version untouched


def test_bundle_roundtrip_and_version_check(spark, tmp_path):
    from docket.operators import modeling as ML

    ds = D.build_dataset(V.snapshot_view(spark, SF_SMALL), V.process_view(spark, SF_SMALL), C.TEST_SPLITS,
                         C.TEST_CUTOFF)
    coh = ML.with_label(D.cohort(ds, "is_delayed"), "is_delayed").where("split = 'train'")
    clf = ML.fit_classifier(coh, "logreg")
    rcoh = ML.with_label(D.cohort(ds, "total_duration_hours"), "total_duration_hours").where("split = 'train'")
    reg = ML.fit_regressor(rcoh, "enet", {"alpha": 0.5, "l1_ratio": 0.5}, log1p=True)
    path = os.path.join(tmp_path, "bundle")
    SK.save_bundle(spark, path, clf, reg)
    clf2, reg2, meta = SK.load_bundle(spark, path)
    feats = ds.where(F.col("schema_error").isNull()).select("external_id", *C.ALL_FEATURES)
    a = ML.score_cases(feats, clf, reg).select("external_id", "delay_probability", "predicted_hours")
    b = ML.score_cases(feats, clf2, reg2).select("external_id", "delay_probability", "predicted_hours")
    da = {r[0]: (r[1], r[2]) for r in a.collect()}
    for r in b.collect():
        pa, ha = da[r[0]]
        assert (pa is None and r[1] is None) or abs(pa - r[1]) < 1e-9
        assert abs(ha - r[2]) < 1e-6 and r[2] >= 0
    # version mismatch is refused
    import json

    meta["feature_schema_version"] = "opening-v0"
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/metadata")
    with pytest.raises(ValueError):
        SK.load_bundle(spark, path)


def test_bundle_of_trees_and_gram_models(spark, tmp_path):
    from docket.operators import metrics as M
    from docket.operators import modeling as ML

    ds = D.build_dataset(V.snapshot_view(spark, SF_SMALL), V.process_view(spark, SF_SMALL), C.TEST_SPLITS, C.TEST_CUTOFF)
    clf, met = ML.train_classifier(ds, "gbt", {"max_iter": 4, "max_leaf_nodes": 5}, n_splits=2)
    clf.calibration = "isotonic"
    rcoh = ML.with_label(D.cohort(ds, "total_duration_hours"), "total_duration_hours").where("split = 'train'")
    reg = ML.FittedRegressor("enet", None, ML.hour_models(M.time_folds(rcoh, 2), "enet", [{}], 2, True)[0, 2], True)
    path = os.path.join(tmp_path, "bundle")
    SK.save_bundle(spark, path, clf, reg)
    clf2, reg2, meta = SK.load_bundle(spark, path)
    assert (meta["classifier_form"], meta["regressor_form"], met.first()["model"]) == ("trees", "linear", "gbt")
    feats = ds.where(F.col("schema_error").isNull()).select("external_id", *C.ALL_FEATURES)
    a, b = ({r[0]: (r[1], r[2]) for r in ML.score_cases(feats, *m).select("external_id", "delay_probability", "predicted_hours").collect()} for m in ((clf, reg), (clf2, reg2)))
    assert len(a) > 100 and a == b


def test_dataset_fingerprint_properties(spark):
    ds = D.build_dataset(V.snapshot_view(spark, SF_SMALL), V.process_view(spark, SF_SMALL), C.TEST_SPLITS,
                         C.TEST_CUTOFF).cache()
    fp = D.dataset_fingerprint(ds, "is_delayed", C.TEST_CUTOFF).first()["fingerprint"]
    assert D.dataset_fingerprint(ds.repartition(5).orderBy(F.rand(1)), "is_delayed",
                                 C.TEST_CUTOFF).first()["fingerprint"] == fp
    import datetime as dt

    assert D.dataset_fingerprint(ds, "is_delayed", dt.datetime(2001, 2, 1)).first()["fingerprint"] != fp
    some_id = D.cohort(ds, "is_delayed").first()["external_id"]
    changed = ds.withColumn("open_hour", F.when(F.col("external_id") == some_id, 5).otherwise(F.col("open_hour")))
    assert D.dataset_fingerprint(changed, "is_delayed", C.TEST_CUTOFF).first()["fingerprint"] != fp


def test_stream_daily_volume_equals_batch(spark, tmp_path):
    from docket.operators import report as RP
    from docket.streaming.ingest_stream import daily_volume_stream

    preds = V.prediction_view(spark, SF_SMALL)
    src = os.path.join(tmp_path, "preds")
    preds.write.parquet(src)
    stream = spark.readStream.schema(preds.schema).parquet(src)
    q = (daily_volume_stream(stream).writeStream.outputMode("complete").format("memory").queryName("dv_test")
         .option("checkpointLocation", os.path.join(tmp_path, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r["day"]: r["count"] for r in spark.table("dv_test").collect()}
    want = {r["day"]: r["count"] for r in RP.daily_volume(preds, C.TEST_AS_OF, days=10_000).collect()}
    assert got == want


def test_stream_ingest_replay_is_noop(spark, tmp_path):
    from docket.streaming.ingest_stream import start_ingest_stream
    from tests.test_ingest import BASE, catalog, write_csv

    inbox = os.path.join(tmp_path, "inbox")
    os.makedirs(inbox)
    write_csv(os.path.join(inbox, "a.csv"), [BASE, {**BASE, "case_enquiry_id": "2"}])
    root = os.path.join(tmp_path, "tables")
    q = start_ingest_stream(spark, inbox, root, catalog(spark), os.path.join(tmp_path, "ck"))
    q.awaitTermination(300)
    assert SK.read_current(spark, root, "processes").count() == 2
    # the same bytes under a new name are a duplicate file: nothing changes
    write_csv(os.path.join(inbox, "a_copy.csv"), [BASE, {**BASE, "case_enquiry_id": "2"}])
    q = start_ingest_stream(spark, inbox, root, catalog(spark), os.path.join(tmp_path, "ck"))
    q.awaitTermination(300)
    assert SK.current_version(spark, root, "processes") == 1


def test_import_of_a_mixed_delivery(spark, tmp_path):
    from docket.streaming.ingest_stream import import_files
    from tests.test_ingest import BASE, catalog, write_csv

    at = lambda n: os.path.join(tmp_path, n)
    write_csv(at("good.csv"), [BASE, {**BASE, "case_enquiry_id": "2"}, {**BASE, "case_enquiry_id": "\t"}])
    write_csv(at("good_copy.csv"), [BASE, {**BASE, "case_enquiry_id": "2"}, {**BASE, "case_enquiry_id": "\t"}])
    for name, data in (("no_id.csv", b"open_dt,source\n2024-01-01,x\n"), ("notes.txt", b"hello"), ("empty.csv", b""), ("broken.xlsx", b"zip?"),
                       ("excess.csv", b"case_enquiry_id,open_dt\n9,2024-01-01\n10,2024-01-01,more,cells\n"),
                       ("quoted.csv", b'"case_enquiry_id","open_dt","a, ""b"""\n"7","2024-01-05",x\n')):
        with open(at(name), "wb") as f:
            f.write(data)
    with open(at("book.xlsx"), "wb") as f:
        f.write(_xlsx_bytes([["case_enquiry_id", "open_dt", "source"], ["5", (45306.5, 1), ""]]))
    names = ["good.csv", "good_copy.csv", "no_id.csv", "notes.txt", "empty.csv", "broken.xlsx", "excess.csv", "quoted.csv", "book.xlsx"]
    root = at("tables")
    import_files(spark, [at(n) for n in names], root, catalog(spark))
    runs = {r["import_run"].split("/")[-1]: r for r in SK.read_current(spark, root, "import_runs").collect()}
    assert {n: runs[n]["status"] for n in names} == {
        "good.csv": "completed_with_issues", "good_copy.csv": "duplicate_file", "no_id.csv": "failed", "notes.txt": "failed",
        "empty.csv": "failed", "broken.xlsx": "failed", "excess.csv": "failed", "quoted.csv": "completed", "book.xlsx": "completed"}
    assert (runs["good.csv"]["inserted_rows"], runs["good.csv"]["quarantined_rows"], runs["good_copy.csv"]["total_rows"]) == (2, 1, 0)
    issues = {(r["import_run"].split("/")[-1], r["issue_code"], r["column_name"]) for r in SK.read_current(spark, root, "issues").where("severity = 'error'").collect()}
    assert issues == {("good.csv", "REQUIRED_FIELD_MISSING", "case_enquiry_id"), ("no_id.csv", "MISSING_REQUIRED_COLUMN", "case_enquiry_id"),
                      ("notes.txt", "UNSUPPORTED_FILE_FORMAT", None), ("empty.csv", "INVALID_FILE_SCHEMA", None),
                      ("broken.xlsx", "INVALID_FILE_SCHEMA", None), ("excess.csv", "INVALID_FILE_SCHEMA", None)}
    assert sorted(r["external_id"] for r in SK.read_current(spark, root, "processes").collect()) == ["10100-001", "2", "5", "7"]
    snaps = SK.read_current(spark, root, "snapshots")
    assert sorted(r["external_id"] for r in snaps.collect()) == ["10100-001", "2", "5", "7"]
    # a later batch: the imported file is a duplicate, failed ones are tried again, snapshots only grow
    import_files(spark, [at("good.csv"), at("notes.txt")], root, catalog(spark), 1)
    later = SK.read_current(spark, root, "import_runs").where("batch_id = 1").collect()
    assert sorted((r["import_run"].split("/")[-1], r["status"]) for r in later) == [("good.csv", "duplicate_file"), ("notes.txt", "failed")]
    assert SK.read_current(spark, root, "snapshots").count() == 4


def test_unfinished_commit_is_not_read(spark, tmp_path):
    root = str(tmp_path)
    SK.write_version(spark.range(3), root, "t")
    os.makedirs(f"{root}/_commits/c=2")  # a writer died here
    assert SK.read_current(spark, root, "t").count() == 3
    SK.write_tables(spark, root, replace={"t": spark.range(4)}, append={"log": spark.range(1)})
    SK.write_tables(spark, root, append={"log": spark.range(2)})
    assert SK.read_current(spark, root, "t").count() == 4 and SK.read_current(spark, root, "log").count() == 3
    with pytest.raises(FileNotFoundError):
        SK.read_current(spark, root, "other")


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0 and "row_count" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_registry_and_single_active(spark):
    reg = spark.createDataFrame([], SK.REGISTRY_SCHEMA)
    m1 = spark.createDataFrame([(0.8, 0.9)], "pr_auc double, roc_auc double")
    reg = SK.register_bundle(reg, "v1", "rf", "/x/v1", "fp1", m1)
    reg = SK.register_bundle(reg, "v2", "logreg", "/x/v2", "fp2", m1)
    assert SK.check_single_active(reg) == 1
    assert SK.active_bundle(reg).first()["model_version"] == "v2"
    with pytest.raises(ValueError):
        SK.register_bundle(reg, "v2", "logreg", "/x/v2", "fp2", m1)
    with pytest.raises(ValueError):
        SK.enrich_metrics(reg, "v1", "other-fp", spark.createDataFrame([(0.1,)], "brier double"))
    reg = SK.enrich_metrics(reg, "v1", "fp1", spark.createDataFrame([(0.1,)], "brier double"))
    mon = {r["model_version"]: r for r in SK.monitoring_view(reg).collect()}
    assert mon["v1"]["validation_brier"] == pytest.approx(0.1) and mon["v1"]["validation_pr_auc"] == pytest.approx(0.8)
    # a metric that is stored already is replaced, sections are merged
    again = spark.sql("SELECT 0.2D AS brier, named_struct('cv_mae_mean', 3.0D) AS regression")
    reg = SK.enrich_metrics(SK.enrich_metrics(reg, "v1", "fp1", again), "v1", "fp1", spark.sql("SELECT named_struct('validation_mae', 2.0D) AS regression"))
    mon = {r["model_version"]: r for r in SK.monitoring_view(reg).collect()}
    assert [mon["v1"][k] for k in ("validation_brier", "cv_mae_mean", "validation_mae")] == [0.2, 3.0, 2.0]
    two = reg.withColumn("is_active", F.lit(1))
    with pytest.raises(ValueError):
        SK.check_single_active(two)
