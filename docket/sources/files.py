"""Delivery sources: CSV / XLSX scans, file manifest, hashes, row numbers.

* CSV (S1): every cell is text, blanks stay ``""``; quoted cells may hold line breaks and a
  file still splits into many tasks (:mod:`docket.sources.csv_records`).  Files with different headers are read per
  header group (headers are one short line per file, read as text).
* Row numbers (S4): records are numbered by a prefix over the splits of their file (one row per split), so that the
  1-based data-row number is exact without a single-partition window.
* Manifest (S3, S5): ``binaryFile`` gives path, size and bytes; the SHA-256
  of the bytes is computed in the JVM, that of a large file from a stream of chunks in its task (a row
  cannot hold more than 2 GB); unsupported extensions are flagged.
* XLSX (S2): one task per workbook (``mapInPandas`` over ``binaryFile``),
  parsed with the standard-library zip + XML modules, first sheet only.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import quote
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket import config as C
from docket.functions import exprs as X
from docket.sources.csv_records import csv_records

EMPTY_HASH = hashlib.sha256(b"").hexdigest()
WHOLE_BYTES = 256 << 20  # larger files are never held as one value
CHUNK_BYTES = 8 << 20


def _open_stream(path: str):
    """Input stream of a path as the binary reader names it."""
    if re.match(r"^(file:)?/", path):
        return pafs.LocalFileSystem().open_input_stream(_bare(path))
    store, name = pafs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_stream(name)


def _streamed_hash(chunk_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashes = []
            for path, size in zip(frame["path"], frame["size"], strict=True):
                digest, seen = hashlib.sha256(), 0
                with _open_stream(path) as stream:
                    while chunk := stream.read(chunk_bytes):
                        digest.update(chunk)
                        seen += len(chunk)
                if seen != size:
                    raise OSError(f"{path}: {seen} bytes read, {size} listed")
                hashes.append(digest.hexdigest())
            yield frame.assign(file_hash=hashes)

    return run


def file_manifest(spark: SparkSession, paths: str | Sequence[str], whole_bytes: int = WHOLE_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """S3 + S5: path, name, extension, size, sha256, supported (0/1).

    Files of more than ``whole_bytes`` are hashed ``chunk_bytes`` at a time, whatever their size; a file
    that changes while it is read fails the job.
    The binary reader leaves out files without a byte; of a list of files they
    are added back, so that every file has its row.
    """
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    held = files.where(F.col("length") <= whole_bytes).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("file_hash"))
    large = files.where(F.col("length") > whole_bytes).select("path", F.col("length").alias("size"))
    df = held.unionByName(large.mapInPandas(_streamed_hash(chunk_bytes), "path string, size bigint, file_hash string"))
    if not isinstance(paths, str):
        listed = spark.createDataFrame([(str(p), _bare(str(p))) for p in paths], "given string, bare string")
        df = listed.join(df.withColumn("bare", _bare_col(F.col("path"))), "bare", "left").select(
            F.coalesce("path", "given").alias("path"), F.coalesce("size", F.lit(0)).alias("size"),
            F.coalesce("file_hash", F.lit(EMPTY_HASH)).alias("file_hash"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return df.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), ext.alias("extension"), "size", "file_hash",
        ext.isin(*C.SUPPORTED_EXTENSIONS).cast("int").alias("supported"))


_CELL = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def split_csv_line(line) -> F.Column:
    """Cells of one CSV line: quoted cells may hold commas and doubled quotes."""
    cells = F.regexp_extract_all(line, F.lit(_CELL), 1)
    return F.transform(cells, lambda c: F.when(c.rlike('^".*"$'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')))
                       .otherwise(c))


def csv_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """First line of every file: (_file, columns array<string>), one row per file that has a line."""
    t = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"))
    first = t.where(F.col("_blk") == 0).groupBy("_file").agg(F.min_by("value", "_mid").alias("header"))
    cols = F.transform(split_csv_line(F.regexp_replace("header", "^\\ufeff|\r$", "")), lambda c: X.strip(c))
    return first.select("_file", cols.alias("columns"))


def _read_group(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of files with one header; ``_excess`` marks records with more cells than the header has, or with a quote that never ends."""
    cells = [T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))]
    schema = T.StructType([*cells, T.StructField("_corrupt", T.StringType())])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "multiLine": "true", "maxCharsPerColumn": "-1"}
    rows = csv_records(spark, paths).filter("_row > 0").withColumn("r", F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options))
    excess = F.coalesce(F.size(F.regexp_extract_all("r._corrupt", F.lit(_CELL), 1)) > len(columns), F.lit(False)) | F.col("_open")
    return rows.select(*[F.coalesce(F.col(f"r.c{i}"), F.lit("")).alias(c) for i, c in enumerate(columns) if c not in columns[:i]],
                       excess.alias("_excess"), "_file", "_row")


def read_csv_deliveries(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """S1 + S4 + F1: (rows, headers).

    ``rows`` has every column of its file as text plus ``_excess`` (the line
    has more cells than the header, or its quotes do not end: the file is malformed), ``_file``,
    ``_file_seq`` (position in ``paths``) and ``_row``; files missing a
    required column are left out of ``rows`` (see :func:`docket.operators.ingest.missing_required_columns`).
    """
    from docket.operators.ingest import missing_required_columns

    headers = csv_headers(spark, paths)
    miss = missing_required_columns(headers)
    # header groups: the caller's own file list, one row per file
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in headers.join(miss, "_file").collect():
        if r["missing"]:
            continue
        groups.setdefault(tuple(r["columns"]), []).append(r["_file"])
    out = None
    for cols, files in groups.items():
        part = _read_group(spark, files, cols)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "_file string, _excess boolean, _file_seq int, _row long"), headers
    return with_file_seq(out, paths), headers


def with_file_seq(rows: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Add ``_file_seq``: the 1-based position of the row's file in the caller's list."""
    seq = rows.sparkSession.createDataFrame([(_bare(str(p)), i + 1) for i, p in enumerate(paths)], "_path string, _file_seq int")
    return rows.withColumn("_path", _bare_col(F.col("_file"))).join(seq, "_path", "left").drop("_path")


def _bare(p: str) -> str:
    return re.sub(r"^file:(//)?", "", p)


def _bare_col(c):
    return F.regexp_replace(c, r"^file:(//)?", "")


# --- XLSX (S2) ---------------------------------------------------------------------------
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _col_index(ref: str) -> int:
    letters = re.match(r"([A-Z]+)", ref).group(1)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Fixed values of the workbook format: built-in number formats that show dates or times.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _first_sheet(z: zipfile.ZipFile) -> tuple[str, bool]:
    """Path of the workbook's first sheet, and whether dates count from 1904."""
    book = ET.fromstring(z.read("xl/workbook.xml"))
    props = book.find("m:workbookPr", _NS)
    from_1904 = props is not None and props.get("date1904") in ("1", "true")
    rid = book.find("m:sheets", _NS)[0].get(_REL)
    for rel in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == rid:
            target = rel.get("Target")
            return (target[1:] if target.startswith("/") else f"xl/{target}"), from_1904
    raise ValueError("the workbook's first sheet has no part")


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles that show a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {int(n.get("numFmtId")) for n in root.iter(f"{{{_NS['m']}}}numFmt")
              if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.get("formatCode", "")), re.I)}
    cells = root.find("m:cellXfs", _NS)
    return {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | custom}


def _serial_text(text: str, from_1904: bool) -> str:
    """A date serial as ``yyyy-MM-dd HH:mm:ss`` (whole seconds)."""
    start = _dt.datetime(1904, 1, 1) if from_1904 else _dt.datetime(1899, 12, 30)
    return (start + _dt.timedelta(seconds=round(float(text) * 86400))).strftime("%Y-%m-%d %H:%M:%S")


def parse_xlsx(data: bytes) -> list[list[str]]:
    """Rows of the workbook's first sheet as text, blank rows between others kept.

    Shared and inline strings as they are, date cells as ``yyyy-MM-dd HH:mm:ss``,
    booleans as True/False, other numbers as written.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheet, from_1904 = _first_sheet(z)
        dates = _date_styles(z)
        root = ET.fromstring(z.read(sheet))
        rows: list[list[str]] = []
        for row in root.iter(f"{{{_NS['m']}}}row"):
            number = int(row.get("r", len(rows) + 1))
            rows += [[] for _ in range(number - 1 - len(rows))]
            vals: dict[int, str] = {}
            for c in row.findall("m:c", _NS):
                t = c.get("t")
                v = c.find("m:v", _NS)
                text = v.text if v is not None and v.text is not None else ""
                if t == "s" and text:
                    text = shared[int(text)]
                elif t == "inlineStr":
                    text = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
                elif t == "b" and text:
                    text = "True" if text == "1" else "False"
                elif t in (None, "n") and text and int(c.get("s", 0)) in dates:
                    text = _serial_text(text, from_1904)
                vals[_col_index(c.get("r"))] = text
            rows.append([vals.get(i, "") for i in range(max(vals) + 1 if vals else 0)])
        while rows and not any(rows[-1]):
            rows.pop()
        return rows


def read_xlsx_deliveries(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Long form (_file, _row, columns, values, error).

    Row 1 is the row below the header; blank rows between others are rows.  A
    workbook without data rows gives one row with ``_row`` 0 and NULL values; one
    that cannot be read gives one row with its ``error``.
    """
    bins = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select(
        "path", "content")

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                names = ["_file", "_row", "columns", "values", "error"]
                try:
                    rows = parse_xlsx(bytes(content))
                    if not rows:
                        raise ValueError("no header")
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError) as e:
                    yield pd.DataFrame([(path, 0, None, None, type(e).__name__)], columns=names)
                    continue
                header = [h.strip() for h in rows[0]]
                data = [(path, i, header, (r + [""] * len(header))[: len(header)], None) for i, r in enumerate(rows[1:], 1)]
                yield pd.DataFrame(data or [(path, 0, header, None, None)], columns=names)

    return bins.mapInPandas(parse, "_file string, _row long, columns array<string>, values array<string>, error string")


def xlsx_to_rows(long: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide text columns from the XLSX long form (missing column -> '')."""
    def cell(c):
        pos = F.array_position("columns", F.lit(c)).cast("int")
        return F.coalesce(F.when(pos > 0, F.element_at("values", pos)), F.lit("")).alias(c)

    return long.select("_file", "_row", *[cell(c) for c in columns])
