"""Records of splittable CSV files whose quoted cells may hold line breaks.

A line break ends a record only outside quotes, and whether a place is inside quotes depends on all of the file before it.  Files
are still read split by split:

1. every split is scanned once under both assumptions (it begins outside or inside a quoted cell) and returns where each ends and how
   many records begin: one row per split;
2. these maps of two states are composed along each file, as a prefix over its splits, which gives every split its
   true beginning and the number of its first record;
3. every split is read again and cut into records.  A record that goes on in the next split is put together from its
   pieces; only such records are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of ``line`` lies inside a quoted cell if its beginning does (``inside``) or begins a cell.

    A cell is quoted if its first character is a quote; doubled quotes in it stand for one; quotes elsewhere mean nothing.
    """
    i = 0
    while True:
        if inside:
            j = line.find('"', i)
            if j < 0:
                return True
            if line.startswith('"', j + 1):
                i = j + 2
                continue
            i = j + 1
        elif line.startswith('"', i):
            inside, i = True, i + 1
            continue
        inside = False
        i = line.find(",", i) + 1
        if not i:
            return False


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_blk"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], list[dict]]]:
    """(file, block) with its lines, batch by batch in file order."""
    for b in batches:
        files, blocks, lines = b.column("_file").to_pylist(), b.column("_blk").to_pylist(), b.column("value").to_pylist()
        start = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or (files[i], blocks[i]) != (files[start], blocks[start]):
                yield (files[start], blocks[start]), lines[start:i], b.slice(start, 1).to_pylist()
                start = i


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: the state at its end and the records that begin in it, for both states at its beginning."""
    held, state, count = None, [False, True], [0, 0]

    def out():
        return pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]], pa.int64()), *[pa.array([s]) for s in state], *[pa.array([c], pa.int64()) for c in count]],
                                          ["_file", "_blk", "end0", "end1", "n0", "n1"])

    for key, lines, _ in _splits(batches):
        if key != held:
            if held is not None:
                yield out()
            held, state, count = key, [False, True], [0, 0]
        for line in lines:
            quoted, begins = '"' in line, bool(line.strip())
            for k in (0, 1):
                if not state[k]:
                    count[k] += begins
                if quoted:
                    state[k] = ends_inside(line, state[k])
    if held is not None:
        yield out()


def split_states(lines: DataFrame) -> DataFrame:
    """Per split: ``inside`` (it begins inside a quoted cell), ``before`` (records that begin earlier in the file), ``open`` (the file ends inside)."""
    splits = lines.mapInArrow(_scan, "_file string, _blk bigint, end0 boolean, end1 boolean, n0 bigint, n1 bigint")
    so_far = Window.partitionBy("_file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("_file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
    swaps = (F.col("end0") & ~F.col("end1")).cast("long")  # the other maps keep the state or end in the same state whatever it was
    splits = splits.withColumn("turns", F.sum(swaps).over(here))
    fixed = F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").alias("at"), F.col("turns").alias("turns")))
    splits = splits.withColumns({"last": F.last(fixed, ignorenulls=True).over(so_far), "earlier": F.coalesce(F.sum(swaps).over(so_far), F.lit(0))})
    turned = (F.col("earlier") - F.coalesce("last.turns", F.lit(0))) % 2 == 1
    splits = splits.withColumn("inside", F.coalesce("last.at", F.lit(False)) != turned)
    n = F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0"))
    end = F.when(F.col("inside"), F.col("end1")).otherwise(F.col("end0"))
    following = F.lead("_blk").over(Window.partitionBy("_file").orderBy("_blk"))
    return splits.withColumns({"before": F.coalesce(F.sum(n).over(so_far), F.lit(0)), "open": end & following.isNull()}).select("_file", "_blk", "inside", "before", "open")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (or pieces of them at the borders of splits); ``_row`` 0 is the first record of the file."""
    names = ["_file", "_blk", "_row", "record", "piece", "_open"]
    held, inside, row, parts, lead, ends_open = None, False, -1, [], False, False
    out: list[tuple] = []

    def close(piece: bool) -> None:
        nonlocal parts, lead
        if parts:
            out.append((held[0], held[1], row, "\n".join(parts), piece or lead, ends_open and piece))
        parts, lead = [], False

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * 6
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()))], names)

    for key, lines, first in _splits(batches):
        if key != held:
            close(inside)
            held, inside, row, ends_open = key, first[0]["inside"], first[0]["before"] - 1, first[0]["open"]
            lead = inside  # goes on with a record of an earlier split
        for line in lines:
            if not inside:
                close(False)
                if not line.strip():
                    continue
                row += 1
            parts.append(line)
            if '"' in line:
                inside = ends_inside(line, inside)
        yield flush()
    close(inside)
    yield flush()


def csv_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``_file, _row, record, _open``: the records of every file in order, ``_row`` counting from 0 (the header).

    Blank lines between records are not records; the carriage return before a record's end goes.  ``_open`` marks a
    file's last record if its quotes are not closed.
    """
    lines = _lines(spark, paths)
    states = split_states(lines)
    # one narrow row per split of a file (128 MB of text by default)
    known = lines.join(F.broadcast(states), ["_file", "_blk"])
    pieces = known.mapInArrow(_cut, "_file string, _blk bigint, _row bigint, record string, piece boolean, _open boolean")
    whole = pieces.filter(~F.col("piece")).select("_file", "_row", "record", "_open")
    parts = F.sort_array(F.collect_list(F.struct("_blk", "record")))
    joined = (pieces.filter("piece").groupBy("_file", "_row").agg(F.concat_ws("\n", F.transform(parts, lambda p: p["record"])).alias("record"), F.max("_open").alias("_open")))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))
