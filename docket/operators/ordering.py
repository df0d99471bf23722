"""Distributed ordering helpers: global row index, prefix sums, exact quantiles.

None of these uses an un-partitioned window over the data.  The data is
range-partitioned on the sort key (balanced by sampling, so a value range
holding a third of the rows is split across tasks), each partition counts
its rows, the per-partition counts (one row per partition, bounded by the
partition count) get offsets, and the offsets are broadcast back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n_parts(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


BROADCAST_ROWS = 500_000  # rows of a few numbers: about 16 MB


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its checked size is small; a plain join side otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _ranges(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column], num_partitions: int | None) -> DataFrame:
    """Sorted range partitions on (group, order), written once, with 0-based ``_r`` in the group and its size ``_n``.

    Rows of a group are contiguous inside a partition, so their rank is their
    position there plus the rows of the group in earlier partitions: one small
    table of (partition, group) counts, no exchange of the rows themselves.
    """
    from docket.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    group_cols = list(group_cols)
    n = _n_parts(df, num_partitions)
    # the range partitioner samples its input in a separate job: keep the input
    # cached only until the eager checkpoint has been written
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    srt = (src.repartitionByRange(n, *group_cols, *order_cols).sortWithinPartitions(*group_cols, *order_cols)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    srt = srt.checkpoint(eager=True)
    src.unpersist()
    counts = srt.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0")).checkpoint()
    w = Window.partitionBy(*group_cols).orderBy("_pid")  # at most one row per partition in each group
    whole = Window.partitionBy(*group_cols)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", *group_cols, (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_m0")).alias("_off"),
                         F.sum("_c").over(whole).alias("_n"))
    same = srt["_pid"] == offs["_pid"]
    for g in group_cols:
        same = same & srt[g].eqNullSafe(offs[g])
    joined = srt.join(sized(offs, counts.count()), same)
    return joined.select(*[srt[c] for c in df.columns], (srt["_mid"] + F.col("_off")).cast("long").alias("_r"), "_n")


def global_index(df: DataFrame, order_cols: Sequence[str | Column], index_col: str = "_idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based, gap-free row index following ``order_cols``.

    The sorted frame is checkpointed to the session's checkpoint folder
    (lineage cut, survives executor loss); ``order_cols`` should be a total
    order for a reproducible index.
    """
    return _ranges(df, [], order_cols, num_partitions).drop("_n").withColumnRenamed("_r", index_col)


def group_rank(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
               rank_col: str = "_rank") -> DataFrame:
    """0-based rank within each group without a per-group window (skew-safe)."""
    return _ranges(df, group_cols, order_cols, None).drop("_n").withColumnRenamed("_r", rank_col)


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles (NumPy's default) per group; NULL values are left out.

    For n values sorted ascending, q sits at h = (n-1) q: result =
    x[floor h] + (h - floor h) (x[ceil h] - x[floor h]).  Needs only the
    rows at those ranks, found with a distributed sort, never a per-group
    in-memory buffer.  Without group columns the result is one row.
    """
    group_cols = list(group_cols)
    vals = df.where(F.col(value_col).isNotNull()).select(*group_cols, F.col(value_col).alias("_v"))
    ranked = _ranges(vals, group_cols, ["_v"], None)
    aggs, wanted = [], None
    for name, q in qs.items():
        h = (F.col("_n") - 1) * F.lit(q)
        low, high = F.floor(h), F.ceil(h)
        at = (F.col("_r") == low) | (F.col("_r") == high)
        wanted = at if wanted is None else wanted | at
        lo, hi = F.max(F.when(F.col("_r") == low, F.col("_v"))), F.max(F.when(F.col("_r") == high, F.col("_v")))
        aggs.append((lo + F.max(h - low) * (hi - lo)).alias(name))
    return ranked.where(wanted).groupBy(*group_cols).agg(*aggs)


def bucketed_prefix_sums(df: DataFrame, part_cols: Sequence[str], score_col: str, value_cols: Sequence[str],
                         num_partitions: int | None = None) -> DataFrame:
    """Exclusive prefix sums ``<v>_below`` and totals ``<v>_total`` of ``value_cols`` in ``score_col`` order within ``part_cols``.

    Expects one row per (part, score) (aggregate first).  Rows are
    range-partitioned on (part, score) - boundaries come from sampling, so a
    narrow score range holding a third of the rows is still split over many
    tasks - summed locally in each range partition, and the per-partition
    totals (one row per partition and group, bounded) get offsets that are
    broadcast back.  No window spans more than one range partition.
    """
    from docket.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    part_cols = list(part_cols)
    n = _n_parts(df, num_partitions)
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    srt = (src.repartitionByRange(n, *part_cols, score_col).sortWithinPartitions(*part_cols, score_col)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id())).checkpoint(eager=True)
    src.unpersist()
    w_in = Window.partitionBy("_pid", *part_cols).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    local = srt.select("*", *[F.coalesce(F.sum(v).over(w_in), F.lit(0)).alias(f"_loc_{v}") for v in value_cols])
    tot = srt.groupBy("_pid", *part_cols).agg(*[F.sum(v).alias(f"_tot_{v}") for v in value_cols])
    w_p = Window.partitionBy(*part_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", *part_cols,
                      *[F.coalesce(F.sum(f"_tot_{v}").over(w_p), F.lit(0)).alias(f"_off_{v}") for v in value_cols],
                      *[F.sum(f"_tot_{v}").over(Window.partitionBy(*part_cols)).alias(f"{v}_total") for v in value_cols])
    out = local.join(sized(offs, tot.count()), ["_pid", *part_cols])
    for v in value_cols:
        out = out.withColumn(f"{v}_below", F.col(f"_loc_{v}") + F.col(f"_off_{v}"))
    return out.drop("_pid", "_mid", *[f"_loc_{v}" for v in value_cols], *[f"_off_{v}" for v in value_cols])
