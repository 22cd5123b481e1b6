"""Exact order-dependent building blocks that never put a whole group in one task.

Everything here starts from one range shuffle on (keys, order): a hot key is
split over as many partitions as its size asks for. What is left to combine
between partitions is one small row per (partition, key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.roles import c
from tidemark.plans.session import materialise

PART, POS = "_part", "_pos"
BLOCK, OWN = "_block", "_own"
HALO_BLOCK_ROWS = 65_536
PART_ROWS = 1_000_000  # rows of a partition that is sorted, where the caller knows how many there are
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def _columns(items: Sequence[str | Column]) -> list[Column]:
    return [c(i) if isinstance(i, str) else i for i in items]


def enough_parts(df: DataFrame, rows: int | None) -> int | None:
    """Partitions that keep a sorted one near ``PART_ROWS``, or None where the session's number already does."""
    wanted = -(-int(rows or 0) // PART_ROWS)
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, keys: Sequence[str], rows: int | None) -> DataFrame:
    """``df`` by keys over enough partitions for its rows; as it is where Spark's own exchange will do."""
    parts = enough_parts(df, rows)
    return df.repartition(parts, *_columns(keys)) if parts else df


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys of ``left`` stay, those of ``right`` go."""
    renamed = {key: f"_rk{i}" for i, key in enumerate(keys)}
    right = right.withColumnsRenamed(renamed)
    condition = F.lit(True)
    for key, other in renamed.items():
        condition = condition & c(key).eqNullSafe(c(other))
    return left.join(right, condition, how).drop(*renamed.values())


def range_sorted(
    df: DataFrame, order_by: Sequence[str | Column], partition_by: Sequence[str] = (), name: str = "sorted", rows: int | None = None
) -> DataFrame:
    """Rows sorted by (keys, order) with their partition and local position, fixed on disk.

    ``order_by`` must be unique within the keys; positions are then the same
    for every run and every number of partitions. With ``rows``, how many
    there are, partitions grow in number, not in size.
    """
    by = _columns([*partition_by, *order_by])
    parts = enough_parts(df, rows)
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    ordered = ranged.sortWithinPartitions(*by)
    tagged = ordered.withColumn("_mono", F.monotonically_increasing_id())
    fixed = materialise(tagged, name)
    return fixed.withColumns(
        {
            PART: F.shiftright("_mono", _LOCAL_BITS),
            POS: F.col("_mono").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)),
        }
    ).drop("_mono")


def _earlier(keys: Sequence[str]):
    """Frame over the earlier partitions of a key: at most one row per partition."""
    return Window.partitionBy(*_columns(keys)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def with_row_id(
    df: DataFrame,
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    name: str = "row_id",
    rows: int | None = None,
) -> DataFrame:
    """Add a dense 0-based row number, per key when ``partition_by`` is given."""
    keys = list(partition_by)
    held = range_sorted(df, order_by, keys, "rowid", rows)
    runs = (
        held.groupBy(PART, *_columns(keys))
        .agg(F.min(POS).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)) - F.col("_first"))
        .select(PART, *_columns(keys), "_shift")
    )
    if not keys:
        runs = F.broadcast(runs)  # one row per shuffle partition, whatever the data
    joined = join_on_keys(held, runs, [PART, *keys])
    return joined.select(*_columns(df.columns), (F.col(POS) + F.col("_shift")).cast("bigint").alias(name))


def running_totals(
    df: DataFrame,
    totals: Sequence[str],
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    prefix: str = "cum_",
    rows: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``totals`` in the given order, per key.

    The sum of all earlier partitions enters each partition as one seed row,
    so the window only ever covers rows of one range partition.
    """
    keys = list(partition_by)
    held = range_sorted(df, order_by, keys, "running", rows)
    seeds = held.groupBy(PART, *_columns(keys)).agg(*[F.sum(c(t)).alias(t) for t in totals])
    seeds = seeds.select(
        PART,
        *_columns(keys),
        F.lit(-1).cast("bigint").alias(POS),
        *[F.sum(c(t)).over(_earlier(keys)).alias(t) for t in totals],
    )
    inside = (
        Window.partitionBy(PART, *_columns(keys)).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    )
    merged = dealt(held.unionByName(seeds, allowMissingColumns=True), [PART, *keys], rows)
    return (
        merged.withColumns({prefix + t: F.sum(c(t)).over(inside) for t in totals})
        .filter(F.col(POS) >= 0)
        .drop(PART, POS)
    )


def with_halo(
    df: DataFrame, index: str, lookback: int = 0, lookahead: int = 0, block_rows: int | None = None
) -> DataFrame:
    """Cut an indexed series into blocks that also carry their neighbours' edge rows.

    A window partitioned by (keys, ``_block``) sees ``lookback`` earlier and
    ``lookahead`` later rows of every row with ``_own`` set; keep only those.
    """
    size = block_rows or max(HALO_BLOCK_ROWS, 8 * (lookback + lookahead))
    at = c(index)
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((at - lookahead) / size).cast("bigint"))
    last = F.floor((at + lookback) / size).cast("bigint")
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn(
        OWN, F.col(BLOCK) == F.floor(at / size).cast("bigint")
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    partition_by: Sequence[str] = (),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key from distinct values and running counts.

    The counts are combined on the map side and range-shuffled, so neither a
    hot key nor a hot value is ever held by one aggregation buffer.
    """
    if not partition_by:
        whole = exact_quantiles(df.withColumn("_all", F.lit(0)), value, probabilities, ["_all"], names)
        return whole.drop("_all")
    keys = list(partition_by)
    names = list(names or [f"q{p}" for p in probabilities])
    number = c(value).cast("double")
    counts = (
        df.select(*_columns(keys), number.alias("_v"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*_columns(keys), "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    run = running_totals(counts, ["_n"], ["_v"], keys, prefix="_upto_")
    sizes = run.groupBy(*_columns(keys)).agg(F.max("_upto__n").alias("_total"))
    run = join_on_keys(run, sizes, keys)
    picks = []
    for i, p in enumerate(probabilities):
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        low = F.floor(rank)
        high = F.least(low + 1, F.col("_total") - 1)
        for tag, at in (("lo", low), ("hi", high)):
            hit = (F.col("_upto__n") - F.col("_n") <= at) & (at < F.col("_upto__n"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}{i}"))
    picked = run.groupBy(*_columns(keys)).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for i, p in enumerate(probabilities):
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        share = rank - F.floor(rank)
        out.append((F.col(f"_lo{i}") + share * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(names[i]))
    return picked.select(*_columns(keys), *out)
