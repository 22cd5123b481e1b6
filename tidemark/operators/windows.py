"""Sliding and fixed sample windows over ordered signals, whole or per entity.

Overlapping windows share work through paired panes: the sample axis is cut at
every window start and every window end, each pane is aggregated once, and a
window merges at most about 2 * size / step panes. Whether a window is
complete is read off its own row count, so entity lengths are never joined in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stat_keys import (
    KEY_LABELS,
    MISSING_KEYS,
    VALUE_KEYS,
    from_moments,
    key_label,
    moment_aggregates,
    parts_needed,
    sign_bit,
)
from tidemark.plans.ordered import exact_quantiles, join_on_keys, with_halo, with_row_id
from tidemark.plans.roles import c, is_numeric, require_columns

SUB_PANE_ROWS = 65_536  # panes longer than this are aggregated in pieces
WINDOWS_PER_BLOCK = 10_000


@dataclass(frozen=True)
class WindowLayout:
    size: int
    step: int
    keep_partial: bool = False
    use_time: bool = False
    rate: float = 1.0

    def full_windows(self, length: Column) -> Column:
        return F.when(length >= self.size, F.floor((length - self.size) / self.step) + 1).otherwise(F.lit(0)).cast("bigint")

    def window_count(self, length: Column) -> Column:
        full = self.full_windows(length)
        if not self.keep_partial:
            return full
        return full + F.when(full * self.step < length, 1).otherwise(0)


def window_layout(
    window_size: float,
    unit: str = "samples",
    overlap_pct: float = 0,
    window_type: str = "Fixed Windows",
    keep_partial: bool = False,
    sample_rate_hz: float = 1.0,
) -> WindowLayout:
    """Validated window and step lengths in samples."""
    if window_size <= 0:
        raise ValueError("Window size must be greater than zero.")
    if not 0 <= float(overlap_pct) <= 90:
        raise ValueError("Overlap must be between 0 and 90 percent.")
    use_time = unit.strip().lower() == "seconds"
    if use_time and sample_rate_hz <= 0:
        raise ValueError("Sample rate must be greater than zero when window size uses seconds.")
    samples = float(window_size) * float(sample_rate_hz) if use_time else float(window_size)
    size = max(1, round(samples))
    sliding = window_type.strip().lower().startswith("sliding")
    # the step truncates the floating-point product: 100 samples at 90 % give 9
    step = max(1, int(size * (1 - float(overlap_pct) / 100.0))) if sliding else size
    return WindowLayout(size, step, bool(keep_partial), use_time, float(sample_rate_hz))


def window_table(lengths: DataFrame, length: str, layout: WindowLayout, partition_by: Sequence[str] = ()) -> DataFrame:
    """Index table of all windows of series with known lengths (inclusive end samples)."""
    count = layout.window_count(c(length))
    keys = [c(k) for k in partition_by]
    blocks = lengths.select(
        *keys, c(length).cast("bigint").alias("_len"), count.alias("_count")
    ).filter("_count > 0")
    blocks = blocks.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_count") - 1) / WINDOWS_PER_BLOCK))))
    # a long series has many blocks; spreading them keeps its windows off one task
    blocks = blocks.repartition(*keys, "_b")
    last = F.least((F.col("_b") + 1) * WINDOWS_PER_BLOCK, F.col("_count")) - 1
    rows = blocks.withColumn("_w", F.explode(F.sequence(F.col("_b") * WINDOWS_PER_BLOCK, last)))
    start = F.col("_w") * layout.step
    end = F.least(start + layout.size, F.col("_len"))
    out = [
        *keys,
        (F.col("_w") + 1).alias("Window Number"),
        start.alias("Start Sample"),
        (end - 1).alias("End Sample"),
        (end - start).alias("Window Samples"),
    ]
    if layout.use_time:
        out += [
            (start / layout.rate).alias("Start Time (s)"),
            ((end - 1) / layout.rate).alias("End Time (s)"),
        ]
    return rows.select(*out)


def _feature_name(key: str, column: str, snake: bool) -> str:
    name = f"{key_label(key)} {column}"
    return name.lower().replace("-", "_").replace(" ", "_") if snake else name


def _valid(layout: WindowLayout, w: Column, rows: Column) -> Column:
    """Complete windows, plus the first incomplete one if partial windows are kept.

    An incomplete window holds every row up to the end of its series, so the
    series length is its start plus its row count.
    """
    complete = rows == layout.size
    if not layout.keep_partial:
        return complete
    length = w * layout.step + rows
    first = (w == 0) | ((w - 1) * layout.step + layout.size <= length)
    return complete | ((rows < layout.size) & first)


def _pane_number(layout: WindowLayout) -> Column:
    """Pane of a sample: the axis is cut at every window start and every window end."""
    rest = layout.size % layout.step
    number = F.floor(F.col("_i") / layout.step).cast("bigint")
    return number * 2 + F.when(F.pmod(F.col("_i"), F.lit(layout.step)) >= rest, 1).otherwise(0) if rest else number


def _windows_of_pane(layout: WindowLayout) -> Column:
    """Numbers of the windows that hold a pane."""
    whole, rest = divmod(layout.size, layout.step)
    pane = F.col("_pane")
    step_no = F.floor(pane / 2) if rest else pane
    reach = F.lit(whole - 1)
    if rest:
        reach = reach + F.when(pane % 2 == 0, 1).otherwise(0)
    first = F.greatest(F.lit(0), step_no - reach).cast("bigint")
    return F.sequence(first, step_no.cast("bigint"))


def _pane_statistics(base: DataFrame, keys: list[str], names: list[str], parts: list[str], layout: WindowLayout) -> DataFrame:
    """One row per (entity, pane, piece) with mergeable statistics of every column."""
    panes = base.withColumns({"_pane": _pane_number(layout), "_piece": F.floor(F.col("_i") / SUB_PANE_ROWS).cast("bigint")})
    group = [*[c(k) for k in keys], F.col("_pane"), F.col("_piece")]
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    if "changes" in parts:
        before = Window.partitionBy(*group).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        signs = {f"_s{i}": sign_bit(F.col(n)) for i, n in enumerate(names)}
        panes = panes.withColumns(signs)
        panes = panes.withColumns({f"_b{i}": F.last(F.col(f"_s{i}"), ignorenulls=True).over(before) for i in range(len(names))})
        for i in range(len(names)):
            here = F.when(F.col(f"_s{i}").isNotNull(), F.col("_i"))
            aggregates += [
                F.count_if(F.col(f"_s{i}") != F.col(f"_b{i}")).alias(f"{names[i]}_changes"),
                F.min_by(F.col(f"_s{i}"), here).alias(f"{names[i]}_first"),
                F.max_by(F.col(f"_s{i}"), here).alias(f"{names[i]}_last"),
            ]
    for n in names:
        aggregates.append(F.count(F.col(n)).alias(f"{n}_n"))
        aggregates += moment_aggregates(F.col(n), parts, n)
    return panes.groupBy(*group).agg(*aggregates)


def _merge_panes(panes: DataFrame, keys: list[str], names: list[str], parts: list[str], layout: WindowLayout) -> DataFrame:
    """Merge the panes of each window; moments combine around the window mean."""
    spread = panes.withColumn("_w", F.explode(_windows_of_pane(layout)))
    group = [*[c(k) for k in keys], F.col("_w")]
    every = Window.partitionBy(*group)
    before = every.orderBy("_pane", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    extra = {}
    for n in names:
        if "mean" in parts:
            extra[f"{n}_center"] = F.sum(F.col(f"{n}_mean") * F.col(f"{n}_n")).over(every) / F.nullif(
                F.sum(f"{n}_n").over(every), F.lit(0)
            )
        if "changes" in parts:
            extra[f"{n}_carry"] = F.last(F.col(f"{n}_last"), ignorenulls=True).over(before)
    if extra:
        spread = spread.withColumns(extra)
    aggregates = [F.sum("_rows").alias("_rows")]
    for n in names:
        size = F.col(f"{n}_n")
        aggregates.append(F.sum(size).alias(f"{n}_n"))
        d = F.col(f"{n}_mean") - F.col(f"{n}_center") if "mean" in parts else None
        m2, m3, m4 = (F.col(f"{n}_{m}") for m in ("m2", "m3", "m4"))
        made = {
            "mean": lambda n=n: F.max(f"{n}_center"),
            "m2": lambda: F.sum(m2 + size * d * d),
            "m3": lambda: F.sum(m3 + 3.0 * d * m2 + size * d * d * d),
            "m4": lambda: F.sum(m4 + 4.0 * d * m3 + 6.0 * d * d * m2 + size * d * d * d * d),
            "min": lambda n=n: F.min(f"{n}_min"),
            "max": lambda n=n: F.max(f"{n}_max"),
            "sumsq": lambda n=n: F.sum(f"{n}_sumsq"),
            "changes": lambda n=n: F.sum(F.col(f"{n}_changes"))
            + F.count_if(F.col(f"{n}_first") != F.col(f"{n}_carry")),
        }
        aggregates += [made[p]().alias(f"{n}_{p}") for p in parts]
    return spread.groupBy(*group).agg(*aggregates)


def _value_statistics(base: DataFrame, keys: list[str], names: list[str], layout: WindowLayout) -> DataFrame:
    """Median, distinct count, smallest mode and its count per window, from value counts.

    A window of up to ``SUB_PANE_ROWS`` rows is one task's work. Longer ones
    are counted per pane first, their windows merge the counts, and medians
    come from range-sorted values, so no task holds a window.
    """
    stacked = ", ".join(f"{i}, {n}" for i, n in enumerate(names))
    own = [c(k) for k in keys]
    long = base.withColumn("_pane", _pane_number(layout)).select(*own, "_pane", F.expr(f"stack({len(names)}, {stacked}) AS (_c, _x)")).filter(F.col("_x").isNotNull())
    group = [*own, F.col("_w")]
    held = [F.count(F.lit(1)).alias("unique"), F.max("_f").alias("freq"), F.min_by("_x", F.struct(-F.col("_f"), F.col("_x"))).alias("top")]
    if layout.size <= SUB_PANE_ROWS:
        spread = long.withColumn("_w", F.explode(_windows_of_pane(layout)))
        counts = spread.repartition(*group).groupBy(*group, "_c", "_x").agg(F.count(F.lit(1)).alias("_f"))
        stats = counts.groupBy(*group, "_c").agg(*held, F.percentile("_x", F.lit(0.5), F.col("_f")).alias("median"))
    else:
        per_pane = long.groupBy(*own, "_pane", "_c", "_x").agg(F.count(F.lit(1)).alias("_f"))
        counts = per_pane.withColumn("_w", F.explode(_windows_of_pane(layout))).groupBy(*group, "_c", "_x").agg(F.sum("_f").alias("_f"))
        spread = long.withColumn("_w", F.explode(_windows_of_pane(layout)))
        middle = exact_quantiles(spread, "_x", [0.5], [*keys, "_w", "_c"], ["median"])
        stats = join_on_keys(counts.groupBy(*group, "_c").agg(*held), middle, [*keys, "_w", "_c"])
    return stats.groupBy(*group).agg(
        *[
            F.max(F.when(F.col("_c") == i, F.col(k))).alias(f"{n}_{k}")
            for i, n in enumerate(names)
            for k in VALUE_KEYS
        ]
    )


def windowed_features(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    window_size: float,
    order_by: Sequence[str | Column] = (),
    partition_by: Sequence[str] = (),
    unit: str = "samples",
    overlap_pct: float = 0,
    window_type: str = "Fixed Windows",
    keep_partial: bool = False,
    sample_rate_hz: float = 1.0,
    index: str | None = None,
    snake_names: bool = False,
) -> DataFrame:
    """Statistics of every column in every window, one row per (entity and) window.

    Give ``order_by`` (unique within an entity), or ``index`` when the table
    already carries a dense 0-based row number per entity.
    """
    layout = window_layout(window_size, unit, overlap_pct, window_type, keep_partial, sample_rate_hz)
    columns, keys, entity = list(columns), list(dict.fromkeys(keys)), list(partition_by)
    if not columns:
        raise ValueError("Select at least one numeric column for windowed extraction.")
    if not keys:
        raise ValueError("Select at least one feature.")
    if all(k in MISSING_KEYS for k in keys):
        raise ValueError("Select at least one statistical feature.")
    unknown = [k for k in keys if k not in KEY_LABELS and k != "count"]
    if unknown:
        raise ValueError(f"Unknown features: {unknown}")
    require_columns(df, columns, "Numeric columns")
    if not index and not order_by:
        raise ValueError("Give order_by or index: rows have no order of their own.")

    # text is read as numbers, what cannot be read counts as missing, and so does NaN
    names = [f"_x{i}" for i in range(len(columns))]
    numbers = []
    for n, name in zip(names, columns):
        x = c(name).cast("double") if is_numeric(df, name) else c(name).cast("string").try_cast("double")
        numbers.append(F.when(~F.isnan(x), x).alias(n))
    if index:
        base = df.select(*[c(k) for k in entity], c(index).cast("bigint").alias("_i"), *numbers)
    else:
        by = [c(o) if isinstance(o, str) else o for o in order_by]
        narrow = df.select(*[c(k) for k in entity], *[o.alias(f"_o{j}") for j, o in enumerate(by)], *numbers)
        base = with_row_id(narrow, [f"_o{j}" for j in range(len(by))], entity, "_i").select(
            *[c(k) for k in entity], "_i", *names
        )

    moment_keys = [k for k in keys if k not in VALUE_KEYS and k != "count"]
    parts = parts_needed(moment_keys)
    panes = _pane_statistics(base, entity, names, parts, layout)
    if layout.step == layout.size and layout.size <= SUB_PANE_ROWS and SUB_PANE_ROWS % layout.size == 0:
        stats = panes.withColumnRenamed("_pane", "_w").drop("_piece")
    else:
        stats = _merge_panes(panes, entity, names, parts, layout)
    stats = stats.filter(_valid(layout, F.col("_w"), F.col("_rows")))
    if any(k in VALUE_KEYS for k in keys):
        values = _value_statistics(base, entity, names, layout)
        stats = join_on_keys(stats, values, [*entity, "_w"], "left")

    start, rows = F.col("_w") * layout.step, F.col("_rows")
    out = [
        *[c(k) for k in entity],
        (F.col("_w") + 1).alias("Window Number"),
        start.alias("Start Sample"),
        (start + rows - 1).alias("End Sample"),
    ]
    if layout.use_time:
        out += [(start / layout.rate).alias("Start Time (s)"), ((start + rows - 1) / layout.rate).alias("End Time (s)")]
    for n, name in zip(names, columns):
        for k in keys:
            if k == "count":  # not a windowed statistic
                value = F.lit(None).cast("double")
            elif k in ("unique", "freq"):
                value = F.coalesce(F.col(f"{n}_{k}"), F.lit(0))
            elif k in VALUE_KEYS:
                value = F.col(f"{n}_{k}")
            else:
                value = from_moments(k, rows, F.col(f"{n}_n"), lambda p, n=n: F.col(f"{n}_{p}"))
            out.append(value.alias(_feature_name(k, name, snake_names)))
    if snake_names:
        out = [o.alias(s) for o, s in zip(out, [*entity, *_snake(layout, entity, columns, keys)])]
    return stats.select(*out)


def _snake(layout: WindowLayout, entity: list[str], columns: list[str], keys: list[str]) -> list[str]:
    base = ["window_number", "start_sample", "end_sample"]
    if layout.use_time:
        base += ["start_time_s", "end_time_s"]
    return base + [_feature_name(k, name, True) for name in columns for k in keys]


def window_metadata(
    features: DataFrame, layout: WindowLayout, window_size: float, overlap_pct: float, window_type: str
) -> DataFrame:
    """Settings of a windowed extraction with the number of windows it made."""
    return features.agg(F.count(F.lit(1)).alias("num_windows")).select(
        F.lit(True).alias("windowing_enabled"),
        F.lit(float(window_size)).alias("window_size"),
        F.lit("seconds" if layout.use_time else "samples").alias("window_unit"),
        F.lit(layout.size).alias("window_size_samples"),
        F.lit(layout.step).alias("step_samples"),
        F.lit(float(overlap_pct)).alias("overlap_pct"),
        F.lit(window_type).alias("window_type"),
        F.lit(layout.keep_partial).alias("keep_partial"),
        F.lit(layout.rate).alias("sample_rate_hz"),
        "num_windows",
    )


def trailing_window(
    df: DataFrame, columns: Sequence[str], rows_back: int, index: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Each row with the values of itself and up to ``rows_back`` rows before it."""
    blocks = with_halo(df, index, lookback=int(rows_back))
    over = Window.partitionBy(*[c(k) for k in partition_by], "_block").orderBy(c(index)).rowsBetween(-int(rows_back), 0)
    packed = F.transform(F.collect_list(F.struct(*[c(n) for n in columns])).over(over), lambda s: s)
    return blocks.withColumn("signal_window", packed).filter("_own").drop("_block", "_own")


def trailing_rows(df: DataFrame, index: str, current: int, rows_back: int = 100) -> DataFrame:
    """The current row and up to ``rows_back`` rows before it (a range filter on the row id)."""
    first = max(0, int(current) - int(rows_back))
    return df.filter(c(index).between(first, int(current)))
