"""Exact deduplication by content sort.

Sampled splitters range-partition the rows on (first characters, content
digest, id); each task sorts its range externally, so equal texts stand next
to each other and neighbours are compared in full: a run of equal texts is a group.  The scan numbers the runs of its range
and reports size and best id of those with copies.  A group of copies may span several ranges (the id is part of the sort
key, so a huge group is split): the first and last run of every range come with their text, the last run of one range is compared
with the first of the next, and runs that continue one another are added up, a row or two per range.  Rows then take
their run's summary by (range, run); nothing is grouped or joined by content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docket.llm.common import id_and_text, materialise, sized, tidy

#: Characters of the text that lead the sort key; bounds what the splitter sample brings to the driver.
KEY_CHARS = 64


RUNS = "doc_id bigint, sha string, part int, run bigint, size bigint, best bigint, edge int, text string"


def _neighbours(keep: str):
    """Sorted texts -> their rows with range and run number, and a summary (``size`` not NULL) of every run that has copies or is the first (edge 1),
    last (2) or only one (3) of its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, best, text, sha = TaskContext.get().partitionId(), -1, 0, None, None, None

        def rows(b: pa.RecordBatch, numbers: np.ndarray) -> pa.RecordBatch:
            n = b.num_rows
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sha"), pa.array(np.full(n, part, np.int32)), pa.array(numbers),
                                               *[pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.string())]], _NAMES)

        def summaries(found: list[tuple]) -> pa.RecordBatch:
            run, size, best, edge, text = zip(*found)
            n = len(found)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(np.full(n, part, np.int32)), pa.array(run, pa.int64()),
                                               pa.array(size, pa.int64()), pa.array(best, pa.int64()), pa.array(edge, pa.int32()), pa.array(text, pa.string())], _NAMES)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            texts, ids = b.column("text"), b.column("doc_id")
            same = np.zeros(n, dtype=bool)
            same[1:] = pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            same[0] = number >= 0 and text == texts[0].as_py()
            numbers = number + np.cumsum(~same)
            yield rows(b, numbers)
            starts = np.flatnonzero(~same)
            found = []
            if len(starts) and number >= 0:  # the run held over ends in this batch
                total = size + int(starts[0])
                last = ids[int(starts[0]) - 1].as_py() if keep == "max" and starts[0] else best
                if total > 1 or number == 0:
                    found.append((number, total, last, 1 if number == 0 else 0, text if number == 0 else None))
            ends = starts[1:]
            for i in np.flatnonzero((np.diff(starts) > 1) | (numbers[starts[:-1]] == 0)) if len(ends) else []:
                x, y, k = int(starts[i]), int(ends[i]), int(numbers[starts[i]])
                found.append((k, y - x, ids[y - 1 if keep == "max" else x].as_py(), 1 if k == 0 else 0, texts[x].as_py() if k == 0 else None))
            if found:
                yield summaries(found)
            if len(starts):
                number, size, text = int(numbers[-1]), n - int(starts[-1]), texts[n - 1].as_py()
                best = ids[n - 1 if keep == "max" else int(starts[-1])].as_py()
            else:
                size += n
                best = ids[n - 1].as_py() if keep == "max" else best
        if number >= 0:
            yield summaries([(number, size, best, 3 if number == 0 else 2, text)])

    return run


_NAMES = [f.split()[0] for f in RUNS.split(", ")]


def _groups(found: DataFrame, keep: str) -> DataFrame:
    """``part, run, size, best`` of the groups with copies: runs at the borders of ranges count together if they continue one another."""
    edges = found.filter("edge > 0")
    first = edges.filter("edge <> 2").select("part", F.col("run").alias("first_run"), F.col("text").alias("first_text"))
    last = edges.filter("edge <> 1").select("part", F.col("run").alias("last_run"), F.col("text").alias("last_text"))
    order = Window.orderBy("part")  # a row per range that has rows
    place = first.select("part", F.row_number().over(order).alias("place"))
    ranges = first.join(last, "part").join(place, "part")
    before = ranges.select((F.col("place") + 1).alias("place"), F.col("last_text").alias("before"))
    ranges = ranges.join(before, "place", "left").select(
        "part", "place", "first_run", "last_run", (~F.coalesce(F.col("first_text") == F.col("before"), F.lit(False))).cast("long").alias("a"),
        (F.col("first_run") != F.col("last_run")).cast("long").alias("b"))
    so_far = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("chain", F.coalesce(F.sum(F.col("a") + F.col("b")).over(so_far), F.lit(0)) + F.col("a"))
    chains = ranges.select("part", F.col("first_run").alias("run"), "chain").unionByName(
        ranges.filter("b = 1").select("part", F.col("last_run").alias("run"), (F.col("chain") + 1).alias("chain")))
    sizes = chains.join(edges, ["part", "run"])
    best = F.max("best") if keep == "max" else F.min("best")
    whole = sizes.groupBy("chain").agg(F.sum("size").alias("size"), best.alias("best"))
    border = chains.join(whole, "chain").select("part", "run", "size", "best")
    return found.filter("edge = 0").select("part", "run", "size", "best").unionByName(border.filter("size > 1"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised forms are identical (``normalise``
    maps a string column to a string column; identity by default).  ``keep``
    tells whether the smallest (``min``) or largest (``max``) id of a group
    stays.  A NULL text counts as the empty text, so NULL and ``''`` form one
    group.  Ids are expected to be unique; of rows with the same id and text
    each counts and all carry the same ``kept`` flag.  A row with a NULL id counts
    in its group's size but never stays for the others: ``keep_id`` is the best id that is not NULL (NULL if the group has
    none) and its own ``kept`` is NULL.  Other columns are
    ignored; an empty table gives an empty result.  Very long texts only need
    to fit into one Arrow batch.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = id_and_text(docs, id_col, text_col).select("doc_id", (normalise(text) if normalise else text).alias("text"))
    rows = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    by_id = F.col("doc_id").asc_nulls_first() if keep == "max" else F.col("doc_id").asc_nulls_last()  # the best id ends or begins its run
    key = [F.substring("text", 1, KEY_CHARS), F.col("sha"), by_id]
    runs = (rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(tidy(_neighbours(keep)), RUNS))
    runs = materialise(runs, "runs")
    groups = materialise(_groups(runs.filter("size IS NOT NULL").drop("doc_id", "sha"), keep), "groups")
    out = runs.filter("size IS NULL").select("doc_id", "sha", "part", "run").join(sized(groups, groups.count()), ["part", "run"], "left")
    keep_id = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
                      (keep_id == F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))
