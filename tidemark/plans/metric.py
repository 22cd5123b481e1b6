"""Exact neighbour work over point tables, cut into blocks of bounded size.

Points go to the cell of their nearest pivot. By the triangle inequality a
query only visits cells that can hold a neighbour, whatever the Minkowski
metric. Big cells are cut into chunks and their visitors into slices, so a task
holds one chunk and one slice; it emits a few numbers per query, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.roles import c
from tidemark.plans.sampling import hash_key
from tidemark.plans.session import materialise

ROWS_PER_PIVOT = 4_000
MOST_PIVOTS = 512
CHUNK_ROWS = 4_096
SLICE_ROWS = 4_096
WIDE = 16  # components beyond which pivots hardly rule out any cell
WIDE_ROWS = 32_768  # most rows of a wide table's chunk or slice; copies sent grow with the number of chunks
WIDE_CHUNKS = 8  # chunks that a smaller wide table is cut into
_TILE_ROWS, _TILE_COLUMNS = 16, 4_096
_STRIP = 512  # queries whose distances are held at once
SLACK = 1e-9  # guards pruning against rounding; the exact test decides


def distances(a: np.ndarray, b: np.ndarray, metric: str = "minkowski", p: float = 2.0) -> np.ndarray:
    """Distance matrix of two point sets, summed coordinate by coordinate."""
    if metric == "cosine":
        na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        return np.clip(1.0 - (a @ b.T) / np.maximum(np.outer(na, nb), 1e-300), 0.0, 2.0)
    if metric in ("euclidean", "l2"):
        p = 2.0
    elif metric in ("manhattan", "l1"):
        p = 1.0
    elif metric not in ("minkowski", "chebyshev"):
        raise ValueError(f"Unknown metric {metric!r}.")
    out = np.zeros((len(a), len(b)))
    turned = np.ascontiguousarray(b.T)
    for top in range(0, len(a), _TILE_ROWS):  # tiles that stay in the processor's cache
        for at in range(0, len(b), _TILE_COLUMNS):
            tile = out[top : top + _TILE_ROWS, at : at + _TILE_COLUMNS]
            total, d = np.zeros(tile.shape), np.empty(tile.shape)
            for j in range(a.shape[1]):
                np.subtract(a[top : top + _TILE_ROWS, j, None], turned[None, j, at : at + _TILE_COLUMNS], out=d)
                _gather(d, total, metric, p)
            tile[:] = total
    return _finished(out, metric, p)


def _gather(d: np.ndarray, total: np.ndarray, metric: str, p: float) -> None:
    """Add one coordinate's differences to the running total."""
    if metric != "chebyshev" and p == 2:
        np.multiply(d, d, out=d)
    else:
        np.abs(d, out=d)
    if metric == "chebyshev":
        np.maximum(total, d, out=total)
        return
    if p not in (1, 2):
        np.power(d, p, out=d)
    np.add(total, d, out=total)


def _finished(total: np.ndarray, metric: str, p: float) -> np.ndarray:
    if metric == "chebyshev" or p == 1:
        return total
    return np.sqrt(total) if p == 2 else total ** (1.0 / p)


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of ``a`` to the same row of ``b``, summed as in ``distances``."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        _gather(a[:, j] - b[:, j], total, "euclidean", 2.0)
    return np.sqrt(total)


def screened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Squared Euclidean distances from one product in single precision, and each row's bound of their error.

    None where single precision cannot hold them. Whatever lies within the
    bound of a decision has to be measured by ``pair_distances``.
    """
    centre = b.mean(0)
    a, b = a - centre, b - centre
    na, nb = (a * a).sum(1), (b * b).sum(1)
    error = 1.5 * (a.shape[1] + 8) * 2.0**-24 * (np.sqrt(na) + np.sqrt(nb.max())) ** 2
    if not error.max() < 1e30:
        return None
    one = np.ones(1, dtype="float32")
    left = np.concatenate([a, na[:, None], np.broadcast_to(one, (len(a), 1))], axis=1).astype("float32")
    right = np.concatenate([-2.0 * b, np.broadcast_to(one, (len(b), 1)), nb[:, None]], axis=1).astype("float32")
    return left @ right.T, error + 1e-37


def product_distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """``distances`` for sums of many: Euclidean ones from one product, those too short for it measured."""
    if metric not in ("euclidean", "l2") or a.shape[1] <= 2 or not len(a) or not len(b):
        return distances(a, b, metric)
    centre = b.mean(0)
    p, q = a - centre, b - centre
    np_, nq = (p * p).sum(1), (q * q).sum(1)
    scale = (np.sqrt(np_) + np.sqrt(nq.max())) ** 2
    if not np.isfinite(scale).all():
        return distances(a, b, metric)
    square = np.concatenate([p, np_[:, None], np.ones((len(p), 1))], axis=1) @ np.concatenate([-2.0 * q, np.ones((len(q), 1)), nq[:, None]], axis=1).T
    i, j = places(square <= 1e-7 * scale[:, None])
    np.maximum(square, 0.0, out=square)
    np.sqrt(square, out=square)
    for at in range(0, len(i), 1 << 18):
        s = slice(at, at + (1 << 18))
        square[i[s], j[s]] = pair_distances(a[i[s]], b[j[s]])
    return square


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every true cell of a mask that is mostly false."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view("uint64"))
    inside = np.flatnonzero(flat[:whole].reshape(-1, 8)[words])
    found = np.concatenate([words[inside // 8] * 8 + inside % 8, whole + np.flatnonzero(flat[whole:])])
    return np.divmod(found, mask.shape[1])


def tiles(rows: int, columns: int) -> Iterator[tuple[slice, slice]]:
    """Row and column ranges that cover a matrix, a few million cells at a time."""
    for s in strips(rows):
        for at in range(0, columns, CHUNK_ROWS):
            yield s, slice(at, min(columns, at + CHUNK_ROWS))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


@dataclass(frozen=True)
class Metric:
    """A metric and the one its pruning runs in (unit vectors for cosine)."""

    name: str = "minkowski"
    p: float = 2.0

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return distances(a, b, self.name, self.p)

    @property
    def euclidean(self) -> bool:
        return self.name in ("euclidean", "l2") or (self.name == "minkowski" and self.p == 2)

    def within(self, a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
        """Whether each distance is at most ``radius``; what a product cannot tell is measured."""
        rough = screened(a, b) if self.euclidean and len(a) and len(b) and a.shape[1] > 2 else None
        if rough is None:
            return self(a, b) <= radius
        square, error = rough
        error = error + 1e-9 * radius * radius
        sure = square <= (radius * radius - error).astype("float32")[:, None] * np.float32(1 - 2e-7)
        open_cells = square <= np.nextafter((radius * radius + error).astype("float32"), np.float32(np.inf))[:, None]
        np.logical_xor(open_cells, sure, out=open_cells)
        i, j = places(open_cells)
        for at in range(0, len(i), 1 << 18):
            s = slice(at, at + (1 << 18))
            sure[i[s], j[s]] = pair_distances(a[i[s]], b[j[s]]) <= radius
        return sure

    def prune_points(self, x: np.ndarray) -> np.ndarray:
        if self.name != "cosine":
            return x
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)

    def prune(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distance the triangle inequality holds for."""
        if self.name == "cosine":
            return distances(self.prune_points(a), self.prune_points(b), "euclidean")
        return self(a, b)

    def prune_radius(self, r: float | np.ndarray) -> float | np.ndarray:
        """A radius in the metric as a radius of the pruning distance."""
        wide = np.sqrt(2.0 * np.asarray(r)) if self.name == "cosine" else np.asarray(r)
        return wide * (1 + SLACK) + 1e-12


@dataclass
class Cells:
    """Pivots with the size and radii of their cells: at most 512 rows, kept on the driver."""

    pivots: np.ndarray
    counts: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    points: DataFrame  # id, x, cell (and payload)
    chunk_rows: int | None = None  # rows of a chunk or slice where that is not the usual number


def build_cells(points: DataFrame, metric: Metric, id_col: str = "id", vector: str = "x", rows: int | None = None) -> Cells:
    """Assign every point to its nearest pivot. Pivots are rows chosen by a hash of their id."""
    total = rows if rows is not None else points.count()
    wanted, block = int(min(MOST_PIVOTS, max(1, -(-total // ROWS_PER_PIVOT)))), None
    first = points.select(F.size(c(vector)).alias("k")).first()
    if first is not None and (first["k"] or 0) > WIDE:  # one cell, cut into few large chunks
        wanted, block = 1, int(min(WIDE_ROWS, max(CHUNK_ROWS, -(-total // WIDE_CHUNKS))))
    chosen = points.select(c(vector).alias("x"), hash_key(id_col, 7).alias("h")).orderBy("h").limit(wanted).collect()
    pivots = np.array([r["x"] for r in chosen], dtype=float)
    names = [n for n in points.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = metric.prune(matrix(pdf[vector]), pivots)
                yield pdf.assign(cell=d.argmin(1).astype("int32"), radius=d.min(1))

    placed = points.select(*[c(n) for n in names]).mapInPandas(assign, f"{schema}, cell int, radius double")
    if wanted > 1:
        placed = materialise(placed, "cells")  # every pass reads the assignment instead of repeating it
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi")).collect()
    size = len(pivots)
    counts, lo, hi = np.zeros(size, dtype=int), np.full(size, np.inf), np.full(size, -np.inf)
    for r in stats:
        counts[r["cell"]], lo[r["cell"]], hi[r["cell"]] = r["n"], r["lo"], r["hi"]
    return Cells(pivots, counts, lo, hi, placed.drop("radius"), block)


def visits(
    queries: DataFrame,
    cells: Cells,
    metric: Metric,
    radius: float | str,
    vector: str = "x",
    own: str = "all",
    home: str | None = None,
) -> DataFrame:
    """Each query once per cell that may hold a point within ``radius`` (a number or a column).

    ``own`` keeps all cells, only the nearest pivot's (``only``), all but that
    one (``skip``), or those not before the query's ``home`` cell (``upper``).
    """
    pivots, lo, hi, counts = cells.pivots, cells.inner, cells.outer, cells.counts
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            d = metric.prune(matrix(pdf[vector]), pivots)
            if own == "only":
                d = np.where(counts[None, :] > 0, d, np.inf)
                yield pdf.assign(visit=[[int(i)] for i in d.argmin(1)])
                continue
            r = pdf[radius].to_numpy(dtype=float) if isinstance(radius, str) else np.full(len(pdf), float(radius))
            wide = metric.prune_radius(r)[:, None]
            near = (counts[None, :] > 0) & (d <= hi[None, :] + wide) & (d >= lo[None, :] - wide)
            if own == "skip":
                near[np.arange(len(pdf)), np.where(counts[None, :] > 0, d, np.inf).argmin(1)] = False
            elif own == "upper":
                near &= np.arange(len(pivots))[None, :] >= pdf[home].to_numpy()[:, None]
            yield pdf.assign(visit=[np.flatnonzero(row).astype(int).tolist() for row in near])

    routed = queries.mapInPandas(route, f"{schema}, visit array<int>")
    return routed.withColumn("visit", F.explode("visit"))


def upper_bounds(queries: DataFrame, cells: Cells, metric: Metric, k: int, vector: str = "x", name: str = "bound") -> DataFrame:
    """A distance within which every query surely has ``k`` points (infinite if there are fewer)."""
    pivots, hi, counts = cells.pivots, cells.outer, cells.counts
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            reach = np.where(counts[None, :] > 0, metric.prune(matrix(pdf[vector]), pivots) + hi[None, :], np.inf)
            order = reach.argsort(1)
            enough = counts[order].cumsum(1) >= k
            at = np.where(enough.any(1), enough.argmax(1), -1)
            value = np.where(at >= 0, np.take_along_axis(reach, order, 1)[np.arange(len(pdf)), at], np.inf)
            if metric.name == "cosine":
                value = value**2 / 2.0
            yield pdf.assign(**{name: value * (1 + SLACK) + 1e-12})

    return queries.mapInPandas(bound, f"{schema}, {name} double")


def block_join(
    cells: Cells,
    visiting: DataFrame,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    query_id: str = "qid",
    point_id: str = "id",
) -> DataFrame:
    """Run ``kernel(points, queries)`` for every (cell chunk, query slice) that meets."""
    spark = visiting.sparkSession
    per_cell = {r["visit"]: r["n"] for r in visiting.groupBy("visit").agg(F.count(F.lit(1)).alias("n")).collect()}
    layout = [
        (int(i), int(max(1, -(-int(n) // (cells.chunk_rows or CHUNK_ROWS)))), int(max(1, -(-per_cell[i] // (cells.chunk_rows or SLICE_ROWS)))))
        for i, n in enumerate(cells.counts)
        if n and i in per_cell
    ]

    def blocks(side: DataFrame, cell: str, split_by: str, split: str, copies: str) -> DataFrame:
        """Hash the side's rows over its own pieces and copy them to the other side's."""
        table = F.broadcast(spark.createDataFrame(layout, "_cell int, _chunk int, _slice int"))  # one row per pivot
        joined = side.join(table, F.col(cell) == F.col("_cell"))
        joined = joined.withColumn(split, F.pmod(F.xxhash64(c(split_by)), F.col(split)).cast("int"))
        return joined.withColumn(copies, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))

    keys = ["_cell", "_chunk", "_slice"]
    left = blocks(cells.points, "cell", point_id, "_chunk", "_slice")
    right = blocks(visiting, "visit", query_id, "_slice", "_chunk")

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return kernel(p, q)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def strips(n: int) -> Iterator[slice]:
    for start in range(0, n, _STRIP):
        yield slice(start, min(n, start + _STRIP))


def empty(columns: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame({n: [] for n in columns})
