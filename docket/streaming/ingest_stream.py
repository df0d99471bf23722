"""Structured Streaming wrappers around the batch operators (§2.11).

* :func:`start_ingest_stream` - new delivery files arriving in a folder are
  imported micro-batch by micro-batch with ``foreachBatch``: the batch's file
  list (one row per file) is read with the batch CSV reader (exact row
  numbers), files whose SHA-256 already has a successful run are skipped
  (S6, so a replayed micro-batch is a no-op), :func:`run_import` decides
  against the current state, and the new state / snapshots / runs / issues
  become live with one commit.
* :func:`daily_volume_stream` - A4 on an event-time stream: watermark plus
  a one-day tumbling window; equals the batch result once the watermark has
  passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket import config as C
from docket.operators import ingest as I
from docket.plans.views import STATE_SCHEMA
from docket.sources import files as SF
from docket.sources import sinks as SK

RUNS_SCHEMA = ("import_run string, status string, total_rows long, inserted_rows long, updated_rows long, "
               "skipped_duplicate_rows long, quarantined_rows long, error_rows long, warning_count long, "
               "imported_rows long, file_hash string, batch_id long")
SNAPSHOT_SCHEMA = ("external_id string, snapshot_type string, snapshot_at timestamp_ntz, feature_schema_version string, "
                   "input_json string, input_fingerprint string, source_import string")
COUNTERS = ["total_rows", "inserted_rows", "updated_rows", "skipped_duplicate_rows", "quarantined_rows", "error_rows",
            "warning_count", "imported_rows"]


def _table_or_empty(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    if SK.current_version(spark, root, name) == 0:
        return spark.createDataFrame([], schema)
    return SK.read_current(spark, root, name)


def _read_supported(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the readable files and the file-level issues (_file, issue_code, column_name) of the others."""
    csv = [p for p in paths if p.lower().endswith(".csv")]
    xlsx = [p for p in paths if p.lower().endswith(".xlsx")]
    problems = spark.createDataFrame([], "_file string, issue_code string, column_name string")
    parts = []

    def missing(headers: DataFrame) -> DataFrame:
        return I.missing_required_columns(headers).select("_file", F.explode("missing").alias("column_name")).select(
            "_file", F.lit("MISSING_REQUIRED_COLUMN").alias("issue_code"), "column_name")

    def unreadable(files: DataFrame) -> DataFrame:
        return files.select("_file", F.lit("INVALID_FILE_SCHEMA").alias("issue_code"), F.lit(None).cast("string").alias("column_name"))

    if csv:
        rows, headers = SF.read_csv_deliveries(spark, csv)
        rows = rows.checkpoint()  # parsed once: read for malformed lines, then for the import
        named = spark.createDataFrame([(p,) for p in csv], "_file string")
        same = SF._bare_col(headers["_file"]) == SF._bare_col(named["_file"])
        problems = problems.unionByName(missing(headers)).unionByName(unreadable(named.join(headers, same, "left_anti")))
        excess = rows.where("_excess").select("_file").distinct()
        problems = problems.unionByName(unreadable(excess))
        parts.append(rows.join(excess, "_file", "left_anti").drop("_excess", "_file_seq"))
    if xlsx:
        long = SF.read_xlsx_deliveries(spark, xlsx).checkpoint()  # parsed once
        readable = long.where("error IS NULL")
        miss = missing(readable.select("_file", "columns").distinct())
        problems = problems.unionByName(miss).unionByName(unreadable(long.where("error IS NOT NULL").select("_file")))
        wanted = [*C.COLUMN_MAP, *C.CATEGORICAL_COLUMNS]
        parts.append(SF.xlsx_to_rows(readable.where("_row > 0").join(miss.select("_file").distinct(), "_file", "left_anti"), wanted))
    rows = None
    for p in parts:
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    if rows is None:
        rows = spark.createDataFrame([], "_file string, _row long")
    return SF.with_file_seq(rows, paths), problems


_FILE_MESSAGES = {
    "UNSUPPORTED_FILE_FORMAT": "file format is not supported",
    "INVALID_FILE_SCHEMA": "file could not be read",
    "MISSING_REQUIRED_COLUMN": "required column missing",
}


def import_files(spark: SparkSession, paths: list[str], root: str, catalog: DataFrame, batch_id: int = 0,
                 mapping_version: str = C.CANONICAL_MAPPING_VERSION) -> dict:
    """One import of a batch of delivery files, in the order of ``paths``, into the tables under ``root``.

    Every file gets a run: ``duplicate_file`` (its content was imported before, or
    by an earlier file of the batch), ``failed`` (unsupported format, unreadable,
    required columns missing, or only bad rows), ``completed`` or
    ``completed_with_issues``.  Processes, opening snapshots, runs and issues
    become live with one commit.
    """
    from docket.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    runs = _table_or_empty(spark, root, "import_runs", RUNS_SCHEMA)
    manifest = SF.with_file_seq(SF.file_manifest(spark, paths).withColumnRenamed("path", "_file"), paths).checkpoint()
    known = I.skip_known_files(manifest, runs)
    # of equal files in one batch the first is read; the others follow its outcome below
    first = manifest.groupBy("file_hash").agg(F.min("_file_seq").alias("_first"))
    known = known.join(first, "file_hash").checkpoint()
    fresh = known.where((F.col("duplicate") == 0) & (F.col("_file_seq") == F.col("_first")))
    # the caller's own file list, one entry per file
    good = [r["_file"] for r in fresh.where("supported = 1").orderBy("_file_seq").collect()]
    rows, problems = _read_supported(spark, good)
    problems = problems.unionByName(fresh.where("supported = 0").select(
        "_file", F.lit("UNSUPPORTED_FILE_FORMAT").alias("issue_code"), F.lit(None).cast("string").alias("column_name"))).checkpoint()
    state = _table_or_empty(spark, root, "processes", STATE_SCHEMA)
    res = I.run_import(rows, state, catalog, mapping_version) if good else None

    messages = F.create_map(*[F.lit(x) for kv in _FILE_MESSAGES.items() for x in kv])
    file_issues = problems.select(F.col("_file").alias("import_run"), F.lit(None).cast("long").alias("row_number"), "column_name",
                                  "issue_code", F.lit("error").alias("severity"),
                                  F.concat_ws(": ", messages[F.col("issue_code")], "column_name").alias("issue_message"))
    failed = problems.groupBy(F.col("_file").alias("import_run")).agg(F.count(F.lit(1)).alias("n")).select(
        "import_run", F.lit("failed").alias("status"),
        *[(F.col("n") if c in ("quarantined_rows", "error_rows") else F.lit(0)).cast("bigint").alias(c) for c in COUNTERS])
    done = failed if res is None else res["counts"].select("import_run", "status", *COUNTERS).unionByName(failed)
    files = known.select("_file", "file_hash", "duplicate", "_file_seq", "_first")
    path = SF._bare_col(F.col("_file"))
    own = files.join(done, path == SF._bare_col(done["import_run"]), "left")
    # a readable file without data rows has no counted row: completed, all zero
    own = own.withColumns({"status": F.coalesce("status", F.when((F.col("duplicate") == 0) & (F.col("_file_seq") == F.col("_first")), F.lit("completed"))),
                           **{c: F.coalesce(c, F.lit(0)).cast("bigint") for c in COUNTERS}}).checkpoint()
    lead = own.where(F.col("_file_seq") == F.col("_first")).select(
        "file_hash", F.col("status").alias("_status"), *[F.col(c).alias(f"_n_{c}") for c in COUNTERS])
    own = own.join(lead, "file_hash", "left")
    again = (F.col("duplicate") == 0) & (F.col("_file_seq") != F.col("_first"))
    copied = (F.col("duplicate") == 1) | again & F.col("_status").isin(*C.SUCCESS_IMPORT_STATUSES)
    out = own.select(F.col("_file").alias("import_run"),
                     F.when(copied, F.lit("duplicate_file")).when(again, F.col("_status")).otherwise(F.col("status")).alias("status"),
                     *[F.when(copied, 0).when(again, F.col(f"_n_{c}")).otherwise(F.col(c)).cast("bigint").alias(c) for c in COUNTERS],
                     "file_hash", F.lit(batch_id).cast("long").alias("batch_id"))
    append = {"import_runs": out, "issues": file_issues if res is None else res["issues"].unionByName(file_issues)}
    if res is None:  # nothing to read: cases and snapshots stay as they are
        SK.write_tables(spark, root, append=append)
    else:
        SK.write_tables(spark, root, replace={"processes": res["state"]}, append={"snapshots": res["snapshots"], **append})
    return {"files": len(paths), "imported": len(good)}


def start_ingest_stream(spark: SparkSession, input_dir: str, root: str, catalog: DataFrame, checkpoint: str,
                        available_now: bool = True, max_files: int | None = None):
    """Watch ``input_dir`` for deliveries and import each micro-batch (of ``max_files`` files at most, if given)."""
    # binaryFile with only ``path`` selected lists new files without reading their bytes
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(input_dir).select("path")

    def handle(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().orderBy("path").collect()]  # file list of the micro-batch
        if paths:
            import_files(batch.sparkSession, paths, root, catalog, batch_id)

    w = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def daily_volume_stream(predictions: DataFrame, watermark: str = "1 day") -> DataFrame:
    """A4 on a stream of successful opening predictions (event time = predicted_at)."""
    ok = predictions.where((F.col("status") == "success") & (F.col("prediction_context") == "opening"))
    # watermarks need TIMESTAMP; with the UTC session zone the wall time is kept
    ok = ok.withColumn("_et", F.col("predicted_at").cast("timestamp"))
    return (ok.withWatermark("_et", watermark)
            .groupBy(F.window("_et", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "count"))
