"""Ward, average and complete linkage of tables of any size.

Ward linkage goes by rounds of reciprocal nearest neighbours. A cluster is one
row (id, n, s): its size and the sum of its points, which is all Ward's
criterion needs. Ward's criterion is reducible: clusters that are
each other's nearest are merged by the sequential algorithm too, whatever it
merges before, and no merge elsewhere brings anything closer to a cluster. So
every such pair may be merged at once, in any order, with the same tree.

Each turn cuts the means into cells of about ``block / 2`` clusters (median cuts
of a sample, drawn anew each turn). A task merges inside its cell, again and
again, every pair whose cost lies below what any cluster outside can offer; the
boxes and least sizes of the other cells, by size class, bound that from below.
What is close to a border waits for the next turn's cells, which are larger
because fewer clusters are left. A turn is linear in the clusters left. Where
cells decide too little (vectors of many components), the turn compares blocks
pairwise instead, which is quadratic but bounded in memory.

Heights follow the Lance-Williams convention on Euclidean distances:
``sqrt(2 nA nB / (nA + nB)) * |mean A - mean B|``. Ties go to the smaller
cluster id, a cluster keeps the smaller id of the two it merges, and repeated
points are clusters at distance 0. Rows with a null id or a vector with nulls
take no part; an empty table has no merges.

Average and complete linkage (``linked_merges``) need the distances of points.
They measure all pairs of points in a few passes; after each, the nearest pairs
of clusters are enough to find every merge below the pass's limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.graph import connected_components
from tidemark.plans.metric import WIDE_CHUNKS, distances, matrix, pair_distances, places, product_distances, screened, strips
from tidemark.plans.ordered import with_row_id
from tidemark.plans.roles import c
from tidemark.plans.session import materialise

BLOCK = 2048  # clusters a task compares with another block of as many
CELL_SAMPLE = 24  # clusters a cell's cuts are taken from
CELL_DIMENSIONS = 16  # components beyond which boxes bound nothing
NEAR_BOXES = 64  # boxes a cell measures one by one; the others share one bound
LEAST_SHARE = 0.05  # share of clusters a turn of cells has to merge
LINK_BLOCK = 8192  # most points of a block of average or complete linkage
STRIP, TILE = 256, 1024  # points of either block whose distances are held at once
PAIRS, NEAR = 2_000_000, 32  # nearest pairs of clusters that one task merges: in all, and for each cluster
SAMPLE, SAMPLE_POINTS = 128, 64  # least clusters, and most points of each, that suggest which pairs are near
FEW = 16  # clusters measured first
LAST = 6144  # clusters whose distances one task may hold
TURN = 100_000  # round numbers set aside for a turn
_MERGED = "round int, kept long, absorbed long, height double, root long"
_OUT = "round int, kept long, absorbed long, height double, size long, id long, n long, s array<double>"


def _costs(n_a: np.ndarray, s_a: np.ndarray, n_b: np.ndarray, s_b: np.ndarray) -> np.ndarray:
    """Squared Ward heights between every cluster of one block and every one of another."""
    mu_a, mu_b = s_a / n_a[:, None], s_b / n_b[:, None]
    gap = (mu_a**2).sum(1)[:, None] + (mu_b**2).sum(1)[None, :] - 2.0 * mu_a @ mu_b.T
    return np.maximum(gap, 0.0) * (2.0 * n_a[:, None] * n_b[None, :] / (n_a[:, None] + n_b[None, :]))


def _nearest(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each cluster of a pair of blocks, its nearest cluster in the other block (in its own, for a block with itself)."""
    pdf = pdf.sort_values("id")
    ids, n = pdf["id"].to_numpy(), pdf["n"].to_numpy().astype(float)
    s = np.array(pdf["s"].tolist(), dtype=float).reshape(len(pdf), -1)
    side = (pdf["own"] == pdf["a"]).to_numpy() if pdf["a"].iloc[0] != pdf["b"].iloc[0] else None
    out = []
    if side is None:
        d = _costs(n, s, n, s)
        d = (d + d.T) / 2.0
        np.fill_diagonal(d, np.inf)
        if len(ids) > 1:
            j = d.argmin(1)
            out.append(pd.DataFrame({"id": ids, "d": d[np.arange(len(ids)), j], "nn": ids[j]}))
    else:
        la, lb = np.flatnonzero(side), np.flatnonzero(~side)
        if len(la) and len(lb):
            d = _costs(n[la], s[la], n[lb], s[lb])
            ja, jb = d.argmin(1), d.argmin(0)
            out.append(pd.DataFrame({"id": ids[la], "d": d[np.arange(len(la)), ja], "nn": ids[lb][ja]}))
            out.append(pd.DataFrame({"id": ids[lb], "d": d[jb, np.arange(len(lb))], "nn": ids[la][jb]}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "d": [], "nn": []}).astype({"id": "int64", "d": "float64", "nn": "int64"})


def ward_merges(points: DataFrame, id_col: str = "id", vector: str = "x", block: int = BLOCK) -> DataFrame:
    """(round, kept, absorbed, height, size) of every merge of Ward's tree over all rows."""
    x = c(vector).cast("array<double>")
    rows = points.select(c(id_col).cast("bigint").alias("id"), x.alias("s")).filter(F.col("id").isNotNull() & F.col("s").isNotNull())
    rows = rows.filter(~F.exists("s", lambda v: v.isNull() | F.isnan(v)))
    clusters = materialise(rows.select("id", F.lit(1).cast("bigint").alias("n"), "s"), "ward-clusters")
    dims = clusters.select(F.size("s").alias("k")).distinct().limit(2).collect()
    if len(dims) > 1:
        raise ValueError("Every vector must have the same number of components.")
    found, at, left = [], 0, clusters.count()
    width = dims[0]["k"] if dims else 0
    if left > block:
        found, clusters, left = _merge_copies(clusters, left)
        at = len(found)
    while left > 1:
        before = left
        if left <= block or width <= CELL_DIMENSIONS:
            merged, clusters = _cell_turn(clusters, left, width, at, block)
            found.append(merged)
            left, at = clusters.count(), at + 1
        if left > 1 and before - left < LEAST_SHARE * before:
            merged, clusters = _block_turn(clusters, left, at, block)
            found.append(merged)
            left, at = clusters.count(), at + 1
    if not found:
        return points.sparkSession.createDataFrame([], "round int, kept long, absorbed long, height double, size long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return materialise(out, "ward-tree")


def _merge_copies(clusters: DataFrame, rows: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Equal points merged at height 0 into the one with the smallest id."""
    unique = materialise(clusters.groupBy("s").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "ward-unique")
    left = unique.count()
    if left == rows:
        return [], clusters, rows
    copies = clusters.select("id", "s").join(unique.filter("n > 1").select("s", F.col("id").alias("kept")).hint("merge"), "s")
    ranked = with_row_id(copies, ["id"], ["s"], "place").filter("place > 0")
    merged = ranked.select(F.lit(0).alias("round"), "kept", F.col("id").alias("absorbed"), F.lit(0.0).alias("height"), (F.col("place") + 1).alias("size"))
    return [materialise(merged, "ward-merges")], materialise(unique.select("id", "n", F.transform("s", lambda v: v * F.col("n")).alias("s")), "ward-clusters"), left


def _median_cuts(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of every cut of a complete binary tree, near the medians of the sample."""
    dims, cuts = np.zeros(2**depth - 1, dtype=int), np.full(2**depth - 1, np.inf)
    parts = {0: sample}
    for node in range(2**depth - 1):
        part = parts.pop(node)
        if len(part):
            dims[node] = int((part.max(0) - part.min(0)).argmax())
            cuts[node] = np.quantile(part[:, dims[node]], rng.uniform(0.42, 0.58))  # other borders each turn
        low = part[:, dims[node]] <= cuts[node]
        parts[2 * node + 1], parts[2 * node + 2] = part[low], part[~low]
    return dims, cuts


def _cell_turn(clusters: DataFrame, left: int, width: int, at: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Merges made inside cells, and the clusters that are left."""
    alone = left <= block
    depth = 0 if alone else max(1, int(np.ceil(np.log2(left / block))) + 1)
    boxes = None
    if alone:
        placed = clusters.withColumn("cell", F.lit(0))
    else:
        mean = F.transform("s", lambda v: v / F.col("n"))
        every = max(1, left // (CELL_SAMPLE * 2**depth))
        sample = clusters.filter(F.pmod(F.xxhash64("id", F.lit(at)), F.lit(every)) == 0).select(mean.alias("m")).collect()
        dims, cuts = _median_cuts(np.array([r["m"] for r in sample], dtype=float).reshape(-1, width), depth, np.random.default_rng(at))

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["s"].to_numpy()).astype(float) / pdf["n"].to_numpy()[:, None]
                    node = np.zeros(len(x), dtype=int)
                    for _ in range(depth):
                        node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > cuts[node])
                    yield pdf.assign(cell=(node - 2**depth + 1).astype("int32"))

        placed = materialise(clusters.mapInPandas(assign, "id long, n long, s array<double>, cell int"), "ward-cells")
        sides = [f(F.col("s")[j] / F.col("n")).alias(f"{tag}{j}") for j in range(width) for tag, f in (("lo", F.min), ("hi", F.max))]
        rows = placed.groupBy("cell", F.floor(F.log2("n")).alias("class")).agg(F.min("n").alias("least"), *sides).collect()  # a few rows per cell
        boxes = (
            np.array([r["cell"] for r in rows]), np.array([r["least"] for r in rows], dtype=float),
            np.array([[r[f"lo{j}"] for j in range(width)] for r in rows]), np.array([[r[f"hi{j}"] for j in range(width)] for r in rows]),
        )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return _merge_cell(pdf, boxes, at * TURN)

    done = materialise(placed.groupBy("cell").applyInPandas(merge, _OUT), "ward-turn")
    return done.filter("kept IS NOT NULL").select("round", "kept", "absorbed", "height", "size"), done.filter("kept IS NULL").select("id", "n", "s")


def _outside(mu: np.ndarray, n: np.ndarray, boxes: tuple[np.ndarray, ...], rest: tuple[float, float]) -> np.ndarray:
    """Lower bound of each cluster's cost with any cluster of the boxes, and of the rest (size, squared gap)."""
    least, lo, hi = boxes
    gap = np.maximum(np.maximum(lo[None] - mu[:, None], mu[:, None] - hi[None]), 0.0)
    cost = (gap**2).sum(2) * (2.0 * n[:, None] * least[None] / (n[:, None] + least[None]))
    return np.minimum(cost.min(1), rest[1] * 2.0 * n * rest[0] / (n + rest[0])) * (1 - 1e-9)


def _merge_cell(pdf: pd.DataFrame, boxes: tuple[np.ndarray, ...] | None, first: int) -> pd.DataFrame:
    """The merges of a cell that no cluster outside can change, then the clusters left."""
    pdf = pdf.sort_values("id")
    ids, n = pdf["id"].to_numpy().copy(), pdf["n"].to_numpy().astype(float)
    s = np.array(pdf["s"].tolist(), dtype=float).reshape(len(pdf), -1)
    near = None
    if boxes is not None:
        cell, least, lo, hi = boxes
        mu, other = s / n[:, None], cell != pdf["cell"].iloc[0]
        least, lo, hi = least[other], lo[other], hi[other]
        gap = (np.maximum(np.maximum(lo - mu.max(0), mu.min(0) - hi), 0.0) ** 2).sum(1)
        order = gap.argsort()
        close, far = order[:NEAR_BOXES], order[NEAR_BOXES:]
        rest = (least[far].min(), gap[far[0]]) if len(far) else (1.0, np.inf)
        near = (least[close], lo[close], hi[close]) if len(close) else None
    bound = _outside(s / n[:, None], n, near, rest) if near else np.full(len(n), np.inf)
    merges, turn = [], 0
    while len(ids) > 1:
        d = _costs(n, s, n, s)
        d = (d + d.T) / 2.0
        np.fill_diagonal(d, np.inf)
        j = d.argmin(1)
        cost = d[np.arange(len(ids)), j]
        sure = cost < bound
        i = np.flatnonzero((j[j] == np.arange(len(ids))) & sure & sure[j] & (np.arange(len(ids)) < j))
        if not len(i) and near is None:  # only rounding can hide every reciprocal pair; the closest pair is one
            i = cost.argmin()[None]
            i = np.minimum(i, j[i])
            j[i] = d[i[0]].argmin()
        if not len(i):
            break
        k = j[i]
        size = n[i] + n[k]
        merges.append(pd.DataFrame({"round": first + turn, "kept": ids[i], "absorbed": ids[k], "height": np.sqrt(cost[i]), "size": size.astype("int64")}))
        n[i], s[i] = size, s[i] + s[k]
        if near:
            bound[i] = np.maximum(np.minimum(bound[i], bound[k]), _outside(s[i] / n[i][:, None], n[i], near, rest))
        stay = np.ones(len(ids), dtype=bool)
        stay[k] = False
        ids, n, s, bound, turn = ids[stay], n[stay], s[stay], bound[stay], turn + 1
    left = pd.DataFrame({"id": ids, "n": n.astype("int64"), "s": list(s)})
    out = pd.concat([*merges, left])
    out["s"] = [v if isinstance(v, np.ndarray) else None for v in out["s"]]
    return out.reindex(columns=["round", "kept", "absorbed", "height", "size", "id", "n", "s"]).astype({k: "Int64" for k in ("round", "kept", "absorbed", "size", "id", "n")})


def _block_turn(clusters: DataFrame, left: int, at: int, block: int) -> tuple[DataFrame, DataFrame]:
    """One round of reciprocal pairs found by comparing all blocks of clusters, and the clusters left."""
    chunks = max(1, -(-left // block))
    own = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")
    placed = clusters.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    meet = placed.select("id", "n", "s", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    near = meet.groupBy("a", "b").applyInPandas(_nearest, "id long, d double, nn long")
    best = materialise(near.groupBy("id").agg(F.min(F.struct("d", "nn")).alias("m")).select("id", "m.d", "m.nn"), "ward-nearest")
    back = best.select(F.col("id").alias("nn"), F.col("nn").alias("id"))
    pairs = best.join(back, ["id", "nn"]).filter(F.col("id") < F.col("nn"))
    if pairs.isEmpty():  # only rounding can hide every reciprocal pair; the closest pair is one
        pairs = best.orderBy("d", "id", "nn").limit(1).select(F.least("id", "nn").alias("id"), F.greatest("id", "nn").alias("nn"), "d")
    pairs = materialise(pairs.select(F.col("id").alias("kept"), F.col("nn").alias("absorbed"), "d"), "ward-pairs")
    one = clusters.select(F.col("id").alias("kept"), F.col("n").alias("na"), F.col("s").alias("sa"))
    two = clusters.select(F.col("id").alias("absorbed"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    joined = pairs.join(one, "kept").join(two, "absorbed")
    merged = joined.select(F.col("kept").alias("id"), (F.col("na") + F.col("nb")).alias("n"), F.zip_with("sa", "sb", lambda p, q: p + q).alias("s"))
    gone = pairs.select(F.col("kept").alias("id")).unionByName(pairs.select(F.col("absorbed").alias("id")))
    made = materialise(joined.select(F.lit(at * TURN).alias("round"), "kept", "absorbed", F.sqrt("d").alias("height"), (F.col("na") + F.col("nb")).alias("size")), "ward-merges")
    return made, materialise(clusters.join(gone, "id", "left_anti").unionByName(merged), "ward-clusters")


def ward_clusters(points: DataFrame, n_clusters: int, id_col: str = "id", vector: str = "x") -> DataFrame:
    """(id, cluster): the tree cut into ``n_clusters``, clusters numbered by their smallest id.

    The cut undoes the highest merges: the lowest n - k by (height, round)
    are kept, which Ward's monotone heights make a set closed under children.
    """
    ids = points.select(c(id_col).cast("bigint").alias("id")).filter(F.col("id").isNotNull())
    return _cut(ward_merges(points, id_col, vector), ids, n_clusters)


def _cut(merges: DataFrame, ids: DataFrame, n_clusters: int) -> DataFrame:
    total = merges.count() + 1
    kept = with_row_id(merges, ["height", "round", "kept", "absorbed"], name="step").filter(F.col("step") < F.lit(max(total - int(n_clusters), 0)))
    found = connected_components(kept.select(F.col("kept").alias("u"), F.col("absorbed").alias("v"))).select(F.col("node").alias("id"), F.col("component").alias("first"))
    placed = materialise(ids.join(found, "id", "left").select("id", F.coalesce("first", "id").alias("first")), "tree-cut")
    numbers = with_row_id(placed.select("first").distinct(), ["first"], name="cluster")
    return placed.join(numbers, "first").select("id", "cluster")


def heights_of(merges: DataFrame) -> DataFrame:
    """(step, distance): merge heights in increasing order."""
    steps = with_row_id(merges, ["height", "round", "kept", "absorbed"], name="step")
    return steps.select((F.col("step") + 1).alias("step"), F.col("height").alias("distance"))


def ward_heights(points: DataFrame, id_col: str = "id", vector: str = "x") -> DataFrame:
    """(step, distance): Ward's merge heights in increasing order."""
    return heights_of(ward_merges(points, id_col, vector))


class _Side:
    """Points of some clusters in order of their cluster; each stands for ``copies`` equal points."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("cluster", kind="stable")
        self.ids, self.starts = np.unique(pdf["cluster"].to_numpy(), return_index=True)
        self.x, self.copies = matrix(pdf["x"]), pdf["n"].to_numpy().astype(float)
        self.plain = bool((self.copies == 1).all())
        self.sizes = np.add.reduceat(self.copies, self.starts) if len(self.starts) else np.zeros(0)


def _pieces(starts: np.ndarray, end: int, most: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Runs of clusters of at most ``most`` points together, or one larger one: first, next, and ranges of at most as many points."""
    ends, at = np.append(starts[1:], end), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, side="right")))
        yield at, to, [(top, min(top + most, int(ends[to - 1]))) for top in range(int(starts[at]), int(ends[to - 1]), most)]
        at = to


def _folded(d: np.ndarray, cuts: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
    """Rows of ``d`` added up (or their maximum) from each cut to the next."""
    if len(cuts) == len(d):
        return d
    ends, out, step = np.append(cuts[1:], len(d)), d[cuts], 1
    while True:
        more = np.flatnonzero(cuts + step < ends)
        if len(more) <= 8:  # few long ones
            for k in more:
                out[k] = ufunc(out[k], ufunc.reduce(d[cuts[k] + step : ends[k]], axis=0))
            return out
        out[more] = ufunc(out[more], d[cuts[more] + step])
        step += 1


def _between(p: _Side, q: _Side, metric: str, average: bool, upper: bool = False) -> Iterator[tuple[int, int, np.ndarray]]:
    """Distances between clusters in tiles that stay in the processor's cache: first cluster of either side, and the distances.

    With ``upper``, tiles with no later cluster than their rows' are left out.
    """
    ufunc, columns = (np.add if average else np.maximum), list(_pieces(q.starts, len(q.x), TILE))
    for at, to, rows in _pieces(p.starts, len(p.x), STRIP):
        for at_q, to_q, across in columns:
            if upper and to_q <= at:
                continue
            out = None
            for top, below in rows:
                for left, right in across:
                    d = product_distances(p.x[top:below], q.x[left:right], metric)
                    if average and not p.plain:
                        d *= p.copies[top:below, None]
                    if average and not q.plain:
                        d *= q.copies[None, left:right]
                    d = _folded(d, p.starts[at:to] - top if to > at + 1 else np.zeros(1, dtype=int), ufunc)
                    if right - left > to_q - at_q or to_q == at_q + 1:
                        d = _folded(np.ascontiguousarray(d.T), q.starts[at_q:to_q] - left if to_q > at_q + 1 else np.zeros(1, dtype=int), ufunc).T
                    out = d if out is None else ufunc(out, d)
            if average:
                size, size_q = p.sizes[at:to], q.sizes[at_q:to_q]
                out = out / size[:, None] if size.max() > 1 else out
                out = out / size_q if size_q.max() > 1 else out
            yield at, at_q, out


def _all_between(p: _Side, q: _Side, metric: str, average: bool) -> np.ndarray:
    out = np.empty((len(p.ids), len(q.ids)))
    for i, j, d in _between(p, q, metric, average):
        out[i : i + d.shape[0], j : j + d.shape[1]] = d
    return out


def _near(p: _Side, q: _Side, limit: float, metric: str, average: bool, alone: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Clusters of both sides nearer than the limit, and their distances; each pair once where the sides are the same."""
    single = metric in ("euclidean", "l2") and len(p.x) == len(p.ids) and len(q.x) == len(q.ids) and p.x.shape[1] > 2
    for s in strips(len(p.x)) if single else ():
        for at in range(s.start // TILE * TILE if alone else 0, len(q.x), TILE):
            t = slice(at, at + TILE)
            rough = screened(p.x[s], q.x[t])
            if rough is None:
                i, j = np.nonzero(distances(p.x[s], q.x[t], metric) < limit)
            else:
                square, error = rough
                bound = np.minimum(limit * limit * (1 + 1e-9) + error, np.finfo("float32").max)
                i, j = places(square <= np.nextafter(bound.astype("float32"), np.float32(np.inf))[:, None])
            if alone:
                i, j = i[i + s.start < j + at], j[i + s.start < j + at]
            d = pair_distances(p.x[s][i], q.x[t][j])
            yield i[d < limit] + s.start, j[d < limit] + at, d[d < limit]
    for at, at_q, d in () if single else _between(p, q, metric, average, alone):
        i, j = places(d < limit)
        stay = i + at < j + at_q if alone else slice(None)
        i, j = i[stay], j[stay]
        yield i + at, j + at_q, d[i, j]


def _tree(d: np.ndarray, size: np.ndarray, average: bool) -> list[tuple[int, int, float]]:
    """Merges (kept, absorbed, height) of few clusters from all their distances, which are overwritten."""
    np.fill_diagonal(d, np.inf)
    who, gap, merges = d.argmin(1), d.min(1), []
    for _ in range(len(d) - 1):
        i = int(gap.argmin())
        i, j = sorted((i, int(who[i])))
        merges.append((i, j, float(d[i, j])))
        new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j]) if average else np.maximum(d[i], d[j])
        new[i] = new[j] = np.inf
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        size[i] += size[j]
        again = np.flatnonzero((who == i) | (who == j))
        closer = (new < gap) | ((new == gap) & (who > i))
        who[closer], gap[closer] = i, new[closer]
        for k in {i, *again.tolist()} - {j}:
            who[k] = d[k].argmin()
            gap[k] = d[k, who[k]]
        gap[j] = np.inf
    return merges


class _Forest:
    """Average or complete linkage below a limit, from all pairs of clusters nearer than it.

    Every pair that is not listed is at least ``limit`` apart. A merge below the
    limit joins clusters of which some parts are listed, so chains of nearest
    neighbours along the lists find every such merge and no other: under
    complete linkage a missing pair of parts rules the merge out, under average
    linkage it bounds the mean from below, and the pairs whose bound does not
    decide are measured. A cluster has the place of one of its parts.
    """

    def __init__(self, u: np.ndarray, v: np.ndarray, d: np.ndarray, side: _Side, limit: float, least: float, metric: str, average: bool):
        self.side, self.limit, self.metric, self.average = side, limit, metric, average
        self.norm, self.short, count = None, 0.0, len(side.ids)
        if metric in ("euclidean", "l2") and side.x.shape[1] > 2:
            side.x = side.x - side.x.mean(0)
            self.norm = (side.x * side.x).sum(1)
            self.short = 4e-7 * self.norm.max()  # squares of differences that have to be measured
        here, there, gap = np.concatenate([u, v]).astype("int32"), np.concatenate([v, u]).astype("int32"), np.concatenate([d, d])
        order = np.lexsort((there, gap, here))
        self.there, self.gap = there[order], gap[order]
        self.ends = np.searchsorted(here[order], np.arange(count + 1))
        self.size, self.label, self.parts = side.sizes.copy(), np.arange(count), [None] * count
        self.lists, self.name, self.floor = [None] * count, side.ids.copy(), np.full(count, least)
        has = self.ends[:-1] < self.ends[1:]
        first = np.minimum(self.ends[:-1], max(len(self.gap) - 1, 0))
        self.near = np.where(has, self.there[first], -1).tolist()  # nearest cluster below the limit, -1 for none
        self.far = np.where(has, self.gap[first], np.inf).tolist()
        self.alive, self.turn = [True] * count, [0] * count
        self.seen = [0] * count  # turn of the nearest cluster when it was found

    def _listed(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, sums (or maxima) of distances and the pairs of points they cover."""
        if self.lists[at] is None:
            s = slice(self.ends[at], self.ends[at + 1])
            there = self.there[s]
            cover = self.side.sizes[at] * self.side.sizes[there]
            return there, self.gap[s] * cover if self.average else self.gap[s], cover
        return self.lists[at]

    def _points(self, at: int) -> np.ndarray:
        rows = self.parts[at]
        if rows is None:
            ends = self.side.starts[at + 1] if at + 1 < len(self.side.starts) else len(self.side.x)
            rows = self.parts[at] = np.arange(self.side.starts[at], ends)
        return rows

    def _now(self, ids: np.ndarray) -> np.ndarray:
        """The places that the clusters of these places have now."""
        now = self.label[ids]
        while True:
            above = self.label[now]
            if (above == now).all():
                return now
            now = above

    def _gaps(self, here: np.ndarray, rows: np.ndarray) -> np.ndarray:
        x, y = self.side.x[here], self.side.x[rows]
        if self.norm is None:
            return distances(x, y, self.metric)
        square = self.norm[here, None] + self.norm[rows] - 2.0 * (x @ y.T)
        return np.sqrt(square) if square.min() > self.short else product_distances(x, y, self.metric)

    def _measure(self, at: int, others: list[int]) -> np.ndarray:
        """Sums of the distances between the points of a cluster and those of others."""
        here, rows = self._points(at), [self._points(o) for o in others]
        starts = np.zeros(len(rows), dtype="int64")
        np.cumsum([len(r) for r in rows[:-1]], out=starts[1:])
        rows, copies = np.concatenate(rows), self.side.copies
        total = sum(copies[here[top : top + STRIP]] @ self._gaps(here[top : top + STRIP], rows) for top in range(0, len(here), STRIP))
        return np.add.reduceat(total * copies[rows], starts)

    def _nearest(self, at: int) -> tuple[int, float]:
        ids, total, cover = self._listed(at)
        now = self._now(ids)
        if self.lists[at] is not None or (now != ids).any():
            stay = now != at
            now, total, cover = now[stay], total[stay], cover[stay]
            order = now.argsort(kind="stable")
            now, total, cover = now[order], total[order], cover[order]
            starts = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]])) if len(now) else np.zeros(0, dtype=int)
            if len(starts) < len(now):
                now, cover = now[starts], np.add.reduceat(cover, starts)
                total = (np.add if self.average else np.maximum).reduceat(total, starts)
        whole = self.size[at] * self.size[now]
        if self.average:
            known = cover >= whole
            bound = np.where(known, total, total + (whole - cover) * self.limit) / whole
            for most in (FEW, len(now)):  # the likeliest first
                best = min(bound[known].min(initial=np.inf), self.limit)
                wanted = np.flatnonzero(~known & (bound <= best))
                if len(wanted) > most:
                    wanted = wanted[bound[wanted].argpartition(most)[:most]]
                if len(wanted):
                    total[wanted], cover[wanted], known[wanted] = self._measure(at, now[wanted].tolist()), whole[wanted], True
                    bound[wanted] = total[wanted] / whole[wanted]
        else:
            stay = cover >= whole
            now, total, cover = now[stay], total[stay], cover[stay]
            bound = total
        self.lists[at] = now, total, cover
        best = bound.min(initial=np.inf)
        if best >= self.limit:
            return -1, np.inf
        ties = now[bound == best]
        return int(ties[0] if len(ties) == 1 else ties[self.name[ties].argmin()]), float(best)

    def merges(self) -> list[tuple[int, int, float]]:
        """(kept, absorbed, height), children before parents."""
        made, near, far, seen, turn, alive = [], self.near, self.far, self.seen, self.turn, self.alive
        for first in range(len(near)):
            chain = [first] if alive[first] else []
            held = set(chain)
            while chain:
                at = chain[-1]
                if near[at] >= 0 and (not alive[near[at]] or turn[near[at]] != seen[at]):
                    near[at], far[at] = self._nearest(at)
                    seen[at] = turn[near[at]]
                to = near[at]
                if len(chain) > 1 and (to < 0 or to in held or far[at] >= far[chain[-2]]):
                    to = chain[-2]  # what rounding or a tie hides is each other's nearest
                if to < 0:
                    chain.pop()
                    held.clear()
                elif len(chain) > 1 and to == chain[-2]:
                    held.difference_update(chain[-2:])
                    del chain[-2:]
                    made.append(self._merge(at, to, min(far[at], far[to])))
                    if not chain and alive[first]:
                        chain.append(first)
                        held.add(first)
                else:
                    chain.append(to)
                    held.add(to)
        return made

    def _merge(self, a: int, b: int, height: float) -> tuple[int, int, float]:
        rows, others = self._points(a), self._points(b)
        if len(rows) < len(others):
            a, b, rows, others = b, a, others, rows
        height = max(height, self.floor[a], self.floor[b])
        kept, absorbed = sorted((int(self.name[a]), int(self.name[b])))
        self.lists[a] = tuple(np.concatenate(both) for both in zip(self._listed(a), self._listed(b)))
        self.lists[b] = self.parts[b] = None
        self.parts[a] = np.concatenate([rows, others])
        self.label[b] = a
        self.size[a] += self.size[b]
        self.name[a], self.floor[a], self.alive[b] = kept, height, False
        self.turn[a] += 1
        self.near[a], self.far[a], self.seen[a] = a, np.inf, -1  # to be found
        return kept, absorbed, height


def linked_merges(
    points: DataFrame, linkage: str, metric: str = "euclidean", id_col: str = "id", vector: str = "x", block: int = LINK_BLOCK, last: int = LAST, pairs: int = PAIRS
) -> tuple[DataFrame, DataFrame]:
    """(row, id) and the merges (round, kept, absorbed, height) of average or complete linkage over all rows.

    Equal vectors are one cluster at height 0. Then turn by turn all pairs of
    blocks of points are measured, and the about ``pairs`` nearest pairs of
    clusters, those below a limit that a sample of clusters suggests, go to one
    task with the points they touch, which finds every merge below the limit.
    Where that leaves almost all clusters (ties), reciprocal nearest neighbours
    are merged instead. A cluster's points stay in one block. The last clusters'
    distances are summed once, and one task finishes their tree by the recurrence.
    """
    average = linkage == "average"
    rows = points.select(c(id_col).cast("bigint").alias("id"), c(vector).cast("array<double>").alias("x"))
    named = materialise(with_row_id(rows, ["id", "x"], name="row"), "linked-rows")
    found, state, left = _linked_copies(named, metric)
    at = sum(f.count() for f in found)
    blocks = max(1, -(-left // int(min(block, max(1024, -(-left // WIDE_CHUNKS))))))
    own = F.pmod(F.xxhash64("cluster"), F.lit(blocks)).cast("int")

    def blocks_met(state: DataFrame):
        met = state.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = met.select("cluster", "x", "n", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
        return met.repartition(min(blocks * (blocks + 1) // 2, 2000), "a", "b").groupBy("a", "b")

    def sides(pdf: pd.DataFrame) -> tuple[_Side, _Side, bool]:
        return _Side(pdf[pdf["own"] == pdf["a"]]), _Side(pdf[pdf["own"] == pdf["b"]]), pdf["a"].iloc[0] == pdf["b"].iloc[0]

    def suggest(state: DataFrame, left: int, at: int) -> float:
        """A limit below which about as many pairs of clusters are as a task should merge."""
        wanted = min(pairs, NEAR * left)
        every = max(1, left // max(SAMPLE, 4000 * left // wanted))
        held = state.filter(F.pmod(F.xxhash64("cluster", F.lit(at)), F.lit(every)) == 0).withColumn("_i", F.row_number().over(Window.partitionBy("cluster").orderBy("x")))
        held = held.filter(F.col("_i") <= SAMPLE_POINTS).select("cluster", "x", "n").toPandas()
        if not len(held):
            return 0.0
        some = _Side(held)
        most = -(-2 * wanted * len(some.ids) // left)

        def reach(pdf: pd.DataFrame) -> pd.DataFrame:
            side = _Side(pdf)
            d = _all_between(some, side, metric, average)
            d[some.ids[:, None] == side.ids[None, :]] = np.inf
            d = d[np.isfinite(d)]
            return pd.DataFrame({"d": np.partition(d, most)[:most] if len(d) > most else d})

        gaps = state.withColumn("own", own).repartition(blocks, "own").groupBy("own").applyInPandas(reach, "d double").orderBy("d").limit(most)
        top = gaps.agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n")).first()
        return float(top["d"]) if top["n"] == most else float(np.finfo(float).max)

    def below(state: DataFrame, limit: float, least: float, first: int) -> DataFrame:
        """The merges below the limit, and the cluster that each absorbed one ends in."""

        def near(pdf: pd.DataFrame) -> pd.DataFrame:
            p, q, alone = sides(pdf)
            parts = [(np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"), np.zeros(0))]
            for i, j, d in _near(p, q, limit, metric, average, alone) if len(p.ids) and len(q.ids) else ():
                parts.append((p.ids[i], q.ids[j], d))
            u, v, d = (np.concatenate(part) for part in zip(*parts))
            return pd.DataFrame({"u": u, "v": v, "d": d})

        def grow(pdf: pd.DataFrame, touched: pd.DataFrame) -> pd.DataFrame:
            side = _Side(touched)
            forest = _Forest(np.searchsorted(side.ids, pdf["u"].to_numpy()), np.searchsorted(side.ids, pdf["v"].to_numpy()), pdf["d"].to_numpy(), side, limit, least, metric, average)
            made, ends = forest.merges(), {}
            for kept, absorbed, _ in reversed(made):
                ends[absorbed] = ends.get(kept, kept)
            rows = [(first + k, kept, absorbed, height, ends[absorbed]) for k, (kept, absorbed, height) in enumerate(made)]
            return pd.DataFrame(rows, columns=["round", "kept", "absorbed", "height", "root"])

        listed = materialise(blocks_met(state).applyInPandas(near, "u long, v long, d double"), "linked-pairs")
        ends = listed.select(F.col("u").alias("cluster")).unionByName(listed.select(F.col("v").alias("cluster"))).distinct()
        touched = state.join(ends, "cluster", "left_semi")
        both = listed.withColumn("_all", F.lit(0)).groupBy("_all").cogroup(touched.withColumn("_all", F.lit(0)).groupBy("_all"))  # about ``pairs`` pairs
        return materialise(both.applyInPandas(grow, _MERGED), "linked-merges")

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, alone = sides(pdf)
        if not len(p.ids) or not len(q.ids):
            return pd.DataFrame({"id": [], "d": [], "nn": []}).astype({"id": "int64", "d": "float64", "nn": "int64"})
        best, who = [np.full(len(side.ids), np.inf) for side in (p, q)], [np.zeros(len(side.ids), dtype="int64") for side in (p, q)]
        for at, at_q, d in _between(p, q, metric, average):
            rows, columns = np.arange(at, at + d.shape[0]), np.arange(at_q, at_q + d.shape[1])
            if alone:
                d = np.where(rows[:, None] == columns, np.inf, d)
            for side, mine, others, gaps in ((0, rows, columns, d),) if alone else ((0, rows, columns, d), (1, columns, rows, d.T)):
                j = gaps.argmin(1)
                gap = gaps[np.arange(len(mine)), j]
                closer = gap < best[side][mine]
                best[side][mine[closer]], who[side][mine[closer]] = gap[closer], others[j[closer]]
        ends = [(p, q)] if alone else [(p, q), (q, p)]
        made = pd.concat([pd.DataFrame({"id": mine.ids, "d": best[k], "nn": others.ids[who[k]]}) for k, (mine, others) in enumerate(ends)])
        return made[np.isfinite(made["d"])]

    def reciprocal(state: DataFrame, first: int) -> DataFrame:
        best = blocks_met(state).applyInPandas(nearest, "id long, d double, nn long").groupBy("id").agg(F.min(F.struct("d", "nn")).alias("m"))
        best = materialise(best.select("id", "m.d", "m.nn"), "linked-nearest")
        back = best.select(F.col("id").alias("nn"), F.col("nn").alias("id"))
        two = best.join(back, ["id", "nn"]).filter(F.col("id") < F.col("nn"))
        if two.isEmpty():  # only rounding can hide every reciprocal pair; the closest pair is one
            two = best.orderBy("d", "id", "nn").limit(1).select(F.least("id", "nn").alias("id"), F.greatest("id", "nn").alias("nn"), "d")
        two = two.select(F.lit(first).alias("round"), F.col("id").alias("kept"), F.col("nn").alias("absorbed"), F.col("d").alias("height"), F.col("id").alias("root"))
        return materialise(two, "linked-merges")

    def merged(state: DataFrame, made: DataFrame) -> DataFrame:
        moved = made.select(F.col("absorbed").alias("cluster"), "root")
        return materialise(state.join(moved, "cluster", "left").select(F.coalesce("root", "cluster").alias("cluster"), "x", "n"), "linked-state")

    least = 0.0
    while left > last:
        before, limit = left, suggest(state, left, at)
        for kind in ("below", "reciprocal"):
            if kind == "reciprocal" and (left <= last or before - left >= LEAST_SHARE * before):
                break
            made = below(state, limit, least, at) if kind == "below" else reciprocal(state, at)
            gone = made.count()
            if gone:
                found.append(made.drop("root"))
                state, left, at = merged(state, made), left - gone, at + gone
        least = max(least, limit)
        if left == before:
            raise ValueError("No two of the clusters that are left have a distance.")

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, _ = sides(pdf)
        if not len(p.ids) or not len(q.ids):
            return pd.DataFrame({"ids": [], "others": [], "sizes": [], "d": []})
        d = _all_between(p, q, metric, average)
        return pd.DataFrame({"ids": [p.ids.tobytes()], "others": [q.ids.tobytes()], "sizes": [p.sizes.tobytes()], "d": [d.tobytes()]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [tuple(np.frombuffer(v, dtype=t) for v, t in zip(r, ("int64", "int64", "float64", "float64"))) for r in pdf[["ids", "others", "sizes", "d"]].itertuples(index=False)]
        ids = np.unique(np.concatenate([p[0] for p in parts]))
        d, size = np.full((len(ids), len(ids)), np.inf), np.ones(len(ids))
        for mine, others, sizes, cell in parts:
            i, j = np.searchsorted(ids, mine), np.searchsorted(ids, others)
            cell = cell.reshape(len(i), len(j))
            d[np.ix_(i, j)], d[np.ix_(j, i)] = cell, cell.T
            size[i] = sizes
        rows = [(at + step, ids[i], ids[j], max(height, least)) for step, (i, j, height) in enumerate(_tree(d, size, average))]
        return pd.DataFrame(rows, columns=["round", "kept", "absorbed", "height"])

    rest = blocks_met(state).applyInPandas(table, "ids binary, others binary, sizes binary, d binary").withColumn("_all", F.lit(0))  # at most ``last`` clusters
    found.append(materialise(rest.groupBy("_all").applyInPandas(finish, "round int, kept long, absorbed long, height double"), "linked-merges"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return named.select("row", "id"), out


def _linked_copies(named: DataFrame, metric: str) -> tuple[list[DataFrame], DataFrame, int]:
    """The merges of equal vectors, (cluster, x, n) of the vectors with their numbers of copies, and how many they are."""
    rows = named.count()
    keys = named
    if metric == "cosine":  # zero vectors are no copies there
        keys = named.withColumn("alone", F.when(~F.exists("x", lambda v: v != 0), F.col("row")))
    by = ["x"] if metric != "cosine" else ["x", "alone"]
    state = materialise(keys.groupBy(*by).agg(F.min("row").alias("cluster"), F.count(F.lit(1)).alias("n")).select("cluster", "x", "n"), "linked-state")
    left = state.count()
    if left == rows:
        return [], state, left
    copied = state.filter("n > 1").select("x", F.col("cluster").alias("kept"))
    if metric == "cosine":
        copied = copied.filter(F.exists("x", lambda v: v != 0))
    made = named.join(copied.hint("merge"), "x").filter("row > kept").select(F.lit(0).alias("round"), "kept", F.col("row").alias("absorbed"), F.lit(0.0).alias("height"))
    return [materialise(made, "linked-merges")], state, left


def linked_clusters(points: DataFrame, n_clusters: int, linkage: str, metric: str = "euclidean", id_col: str = "id", vector: str = "x") -> DataFrame:
    """(id, cluster): the average or complete linkage tree cut into ``n_clusters``, clusters numbered by their smallest row."""
    named, merges = linked_merges(points, linkage, metric, id_col, vector)
    cut = _cut(merges, named.select(F.col("row").alias("id")), n_clusters)
    return named.join(cut.select(F.col("id").alias("row"), "cluster"), "row").select("id", "cluster")
