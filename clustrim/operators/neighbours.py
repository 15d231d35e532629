"""Point by point operators: exact k nearest neighbours, band sums, ball counts.

Points are dealt into cells, each around a pivot (a hash-drawn point), and each cell into rings by distance to its
pivot.  For every ring a bound on how far its points' neighbours can be follows from counts of the rings alone;
by the triangle inequality only points whose distance to the pivot is within reach of the ring are sent to it.
Where the data has structure a ring meets the points about it; where it has none, as in many dimensions, it
meets them all, as any exact answer must.  Rings that meet many points are split into blocks, each pair of
blocks a group of its own, so memory is bounded and no point table is broadcast: only the pivots (PIVOTS at most)
and the rings' bounds are.  Ball counts in up to three dimensions use tiles of different points with their
weights instead: of two tiles whose boxes lie within reach throughout, or out of it, no points meet.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import uniform
from . import select

#: Points of a block; points a cell is meant to hold, and the most cells; rings of a cell.
BLOCK, CELL, PIVOTS, RINGS = 2048, 1024, 2048, 24
#: Points of a tile at most; pairs of tiles that a task compares; dimensions up to which points are dealt into tiles.
TILE, PAIRS, TILED = 512, 128, 3


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, coordinates added left to right."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        t = a[:, j : j + 1] - b[:, j]
        t *= t
        out += t
    return out


class Cells:
    """Pivots, rings and who meets whom; a few numbers a ring, on the driver and broadcast."""

    def __init__(self, points: DataFrame, others: DataFrame, n: int, reach: float | None = None, k: int = 0, probes: int | None = None):
        """Rings of `points`; each meets the `others` within `reach`, or within the bound of its k nearest others (k + 1 if itself is among them).

        With `probes` it meets the others of that many cells only, the nearest by pivot: the result is approximate.
        """
        few = min(PIVOTS, max(1, math.ceil(n / CELL)))
        pivots = others.select("x", uniform(42, "pivot").alias("u"), "id").orderBy("u", "id").limit(few).collect()
        self.p = np.array([r["x"] for r in pivots], float).reshape(len(pivots), -1)
        self.unit = 0.0
        if len(pivots) > 1:
            self.unit = self.celled(others).agg(F.percentile_approx("gap", 0.5, 1000)).first()[0] or 0.0
        rings = lambda df: np.array(sorted((r["cell"], r["ring"], r["lo"], r["hi"], r["n"]) for r in self.celled(df).groupBy("cell", "ring").agg(F.min("gap").alias("lo"), F.max("gap").alias("hi"), F.count("*").alias("n")).collect()), float).reshape(-1, 5)
        own = rings(points)
        all_ = own if points is others else rings(others)
        far = np.sqrt(exact(self.p, self.p))
        self.cell, self.ring = own[:, 0].astype(int), own[:, 1].astype(int)
        lo, hi = own[:, 2], own[:, 3]
        if reach is None:
            bound = np.zeros(len(self.p))
            for c in np.unique(self.cell).tolist():
                span = far[c, all_[:, 0].astype(int)] + all_[:, 3]
                order = np.argsort(span)
                at = np.searchsorted(np.cumsum(all_[order, 4]), k)
                bound[c] = span[order[min(at, len(order) - 1)]]
            reach_of = hi + bound[self.cell]
        else:
            reach_of = np.full(len(own), reach)
        self.allowed = None
        if probes is not None:
            rank = far.argsort(1).argsort(1)  # of each cell by distance, for each cell
            self.allowed = (rank[self.cell] < probes).T
        slack = 1e-9 * (1 + hi + reach_of)  # distances are rounded
        self.least, self.most = lo - reach_of - slack, hi + reach_of + slack
        met = np.zeros(len(own))
        for g in range(len(own)):
            span = far[self.cell[g], all_[:, 0].astype(int)]
            met[g] = all_[(span - all_[:, 3] <= self.most[g]) & (span + all_[:, 3] >= self.least[g]), 4].sum()
        self.own_blocks = np.maximum(1, np.ceil(own[:, 4] / BLOCK)).astype(np.int64)
        self.met_blocks = np.maximum(1, np.ceil(met / BLOCK)).astype(np.int64)
        self.number = {(c, r): g for g, (c, r) in enumerate(zip(self.cell.tolist(), self.ring.tolist(), strict=True))}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All distances to the pivots; cell and ring of each row."""
        d = np.sqrt(exact(x, self.p))
        cell = d.argmin(1)
        return d, cell, self.rings(d[np.arange(len(x)), cell])

    def rings(self, gap: np.ndarray) -> np.ndarray:
        if self.unit <= 0:
            return np.zeros(len(gap), np.int64)
        return np.clip(np.ceil(np.log2(np.maximum(gap / self.unit, 1.0))), 0, RINGS - 1).astype(np.int64)

    def celled(self, df: DataFrame) -> DataFrame:
        pivots, unit = self.p, self.unit
        me = Cells.__new__(Cells)
        me.p, me.unit = pivots, unit

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    d, cell, ring = me.nearest(np.stack(pdf["x"].to_numpy()))
                    yield pd.DataFrame({"cell": cell, "ring": ring, "gap": d[np.arange(len(d)), cell]})

        return df.select("x").mapInPandas(run, "cell int, ring int, gap double")

    def met(self, points: DataFrame, others: DataFrame) -> DataFrame:
        """(g, bi, bj, query, id, x): every ring's points and what they meet, by pairs of blocks."""
        held = points.sparkSession.sparkContext.broadcast(self)

        def deal(query: bool):
            def run(batches):
                me = held.value
                for pdf in batches:
                    if not len(pdf):
                        continue
                    ids, x = pdf["id"].to_numpy(), pdf["x"].to_numpy()
                    d, cell, ring = me.nearest(np.stack(x))
                    spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    if query:
                        g = np.array([me.number[c] for c in zip(cell.tolist(), ring.tolist(), strict=True)], np.int64)
                        row = np.arange(len(ids))
                    else:
                        meets = (d[:, me.cell] >= me.least) & (d[:, me.cell] <= me.most)
                        row, g = np.nonzero(meets if me.allowed is None else meets & me.allowed[cell])
                    mine, other = (me.own_blocks, me.met_blocks) if query else (me.met_blocks, me.own_blocks)
                    at, many = spread[row] % mine[g], other[g]
                    again = np.repeat(np.arange(len(row)), many)
                    every = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
                    bi, bj = (at[again], every) if query else (every, at[again])
                    for a in range(0, len(again), 20_000):
                        cut = slice(a, a + 20_000)
                        r = row[again[cut]]
                        yield pd.DataFrame({"g": g[again[cut]], "bi": bi[cut], "bj": bj[cut], "query": query, "id": ids[r], "x": x[r]})

            return run

        kind = "g long, bi long, bj long, query boolean, id long, x array<double>"
        return points.select("id", "x").mapInPandas(deal(True), kind).unionByName(others.select("id", "x").mapInPandas(deal(False), kind))


def _blocks(pdf: pd.DataFrame, rows: int = 512):
    """(ids of some queries, ids of the others, squared distances), a few queries at a time."""
    q, r = pdf[pdf["query"]], pdf[~pdf["query"]].sort_values("id")
    if q.empty or r.empty:
        return
    rid, m = r["id"].to_numpy(), np.stack(r["x"].to_numpy())
    for a in range(0, len(q), rows):
        part = q.iloc[a : a + rows]
        yield part["id"].to_numpy(), rid, exact(np.stack(part["x"].to_numpy()), m)


def knn(points: DataFrame, k: int, max_k: int | None = 500, others: DataFrame | None = None, n: int | None = None, probes: int | None = None) -> DataFrame:
    """(id, j, rank, d): the k nearest other points, ties by j; k is at most n - 1 and max_k.  n: number of `others`, if it is known.

    `probes` makes it approximate: only points of that many cells about each point's own are compared.
    """
    own = others is None
    others = points if own else others
    n = others.count() if n is None else n
    k = min(k, n - own, max_k or k)
    if k < 1:
        return points.sparkSession.createDataFrame([], "id long, j long, rank int, d double")

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for qid, rid, d in _blocks(pdf):
            if own:
                d[qid[:, None] == rid[None, :]] = np.inf
            t = min(k, len(rid))
            edge = np.partition(d, t - 1, axis=1)[:, t - 1]
            row, col = np.nonzero(d <= edge[:, None])  # ties at the edge included, by ascending j
            val = d[row, col]
            order = np.lexsort((val, row))
            row, col, val = row[order], col[order], val[order]
            keep = (np.arange(len(row)) - np.searchsorted(row, row) < t) & np.isfinite(val)
            out.append((qid[row[keep]], rid[col[keep]], val[keep]))
        return pd.DataFrame(dict(zip(("id", "j", "d2"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    best = Cells(points, others, n, k=k + own, probes=probes).met(points, others).groupBy("g", "bi", "bj").applyInPandas(nearest, "id long, j long, d2 double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "j"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "j", "rank", F.sqrt("d2").alias("d"))


def knn_landmarks(points: DataFrame, k: int, size: int = 10_000, seed: int = 42) -> DataFrame:
    """knn against `size` hash-drawn landmarks other than the point itself: an approximation with linear work."""
    marks = points.select("id", "x", uniform(seed, "landmarks").alias("u")).orderBy("u", "id").limit(size).select("id", "x")
    marks = select.Scratch(points.sparkSession).write(marks, "landmarks")
    near = knn(points, k + 1, None, others=marks).where("id != j")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def minmax(points: DataFrame, max_anchors: int = 10_000, seed: int = 42) -> DataFrame:
    """(min_d, max_d): least and largest non-zero distance of the points to min(n, max_anchors) hash-drawn anchors."""
    anchors = points.select("id", "x", uniform(seed, "minmax").alias("u")).orderBy("u", "id").limit(max_anchors)
    blocks = max(1, math.ceil(max_anchors / BLOCK))
    deal = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    many = max(1, math.ceil(points.count() / BLOCK))
    a = anchors.select(deal(blocks).alias("bi"), every(many).alias("bj"), F.lit(True).alias("query"), "id", "x")
    b = points.select(every(blocks).alias("bi"), deal(many).alias("bj"), F.lit(False).alias("query"), "id", "x")

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [d[d > 0] for _, _, d in _blocks(pdf)]
        return pd.DataFrame([(d.min(), d.max()) for d in found if d.size], columns=["lo", "hi"], dtype="float64")

    ranges = a.unionByName(b).groupBy("bi", "bj").applyInPandas(ends, "lo double, hi double")
    return ranges.agg(F.sqrt(F.min("lo")).alias("min_d"), F.sqrt(F.max("hi")).alias("max_d"))


def radius(points: DataFrame, k: int, max_k: int | None = 500, n: int | None = None) -> DataFrame:
    """(id, score): distance to the last of the k neighbours."""
    return knn(points, k, max_k, n=n).groupBy("id").agg(F.max_by("d", "rank").alias("score"))


def band_sum(points: DataFrame, z: int, c: float, max_k: int | None = 500, n: int | None = None) -> DataFrame:
    """(id, score): sum of the distances of ranks z+1 .. int(c z); of all ranks if that band is empty."""
    n = points.count() if n is None else n
    near = knn(points, int(c * z), max_k, n=n)
    cols = min(int(c * z), max_k or int(c * z), n - 1)
    lo, hi = min(z, cols - 1), min(int(c * z), cols)
    band = (F.col("rank") > lo) & (F.col("rank") <= hi) if lo < hi else F.lit(True)
    return near.groupBy("id").agg(F.sum(F.when(band, F.col("d")).otherwise(0.0)).alias("score"))


def top(scores: DataFrame, z: int, by: str = "score", n: int | None = None) -> DataFrame:
    """The z rows of largest `by`, ties by smaller id; none if z <= 0 or z >= n, the number of points.

    Up to select.DIRECT rows are kept by a partial top-z in each task; more by an exact threshold over the
    written scores, so that they are not computed again.
    """
    n = scores.count() if n is None else n
    if not 0 < z < n:
        return scores.limit(0)
    if z <= select.DIRECT:
        return scores.orderBy(F.desc(by), "id").limit(z)
    scores = select.Scratch(scores.sparkSession).write(scores, "scores")
    return scores.where(select.among_top(select.edge(scores, z, by), by))


def _spread(points: DataFrame, dims: int) -> DataFrame:
    return points.withColumns({f"_x{j}": F.col("x")[j] for j in range(dims)})


def _cut(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in parts of at most `size`, by halves along the widest side."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            done.append(at)
            continue
        own = x[at]
        order = at[np.argsort(own[:, np.ptp(own, axis=0).argmax()], kind="stable")]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return done


class Tree:
    """Binary splits drawn from a sample of points, that deal any points into 2^depth parts of near points."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros(2**depth, int), np.full(2**depth, np.inf)
        held = {1: sample}
        for node in range(1, 2**depth):
            own = held.pop(node)
            if len(own) > 1:
                self.axis[node] = axis = int(np.ptp(own, axis=0).argmax())
                self.at[node] = np.median(own[:, axis])
            up = own[:, self.axis[node]] > self.at[node]
            held[2 * node], held[2 * node + 1] = own[~up], own[up]

    def part(self, x: np.ndarray) -> np.ndarray:
        node, row = np.ones(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + (x[row, self.axis[node]] > self.at[node])
        return node


def _tiles(points: DataFrame, dims: int, scratch: select.Scratch) -> DataFrame:
    """(tile, x, w, lo, hi, total): the different points in tiles, row by row, how often each occurs, the tile's box and number of points."""
    names = [f"_x{j}" for j in range(dims)]
    each = scratch.write(_spread(points, dims).select(*names).dropna("any").groupBy(*names).agg(F.count("*").alias("w")), "different")
    n = each.count()
    depth = max(0, math.ceil(math.log2(max(1, min(n / TILE, PIVOTS)))))
    drawn = each.orderBy(F.xxhash64(*names), *names).limit(8 * 2**depth).select(*names).collect() if depth else []
    held = points.sparkSession.sparkContext.broadcast(Tree(np.array(drawn, float).reshape(-1, dims), depth))

    @F.pandas_udf("int")
    def part(*x: pd.Series) -> pd.Series:
        return pd.Series(held.value.part(np.stack([c.to_numpy() for c in x], 1)).astype(np.int32))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = pdf[names].to_numpy(), pdf["w"].to_numpy()
        rows = [((int(pdf["part"].iloc[0]) << 32) + k, x[at].ravel(), w[at], x[at].min(0), x[at].max(0), w[at].sum()) for k, at in enumerate(_cut(x, TILE))]
        return pd.DataFrame(rows, columns=["tile", "x", "w", "lo", "hi", "total"])

    kind = "tile long, x array<double>, w array<long>, lo array<double>, hi array<double>, total long"
    return scratch.write(each.withColumn("part", part(*names)).groupBy("part").applyInPandas(tile, kind), "tiles")


def _tally(points: DataFrame, others: DataFrame, r: float, dims: int) -> DataFrame:
    """(_x0 .., n): each different point of `points` and the number of `others` within r of it.

    A difference, its square and a sum of squares keep their order when they are rounded, so the ends of two
    boxes bound the distance that is computed for any two of their points, and the counts are those of all pairs.
    """
    spark, scratch = points.sparkSession, select.Scratch(points.sparkSession)
    names = [f"_x{j}" for j in range(dims)]
    own = _tiles(points, dims, scratch)
    met = own if points is others else _tiles(others, dims, scratch)
    boxes = met.select("tile", "lo", "hi", "total").toPandas()
    side = lambda c: np.array(boxes[c].tolist(), float).reshape(-1, dims)
    held = spark.sparkContext.broadcast((boxes["tile"].to_numpy(np.int64), side("lo"), side("hi"), boxes["total"].to_numpy(np.int64)))
    most = r * r

    def meet(batches):
        """A tile, the number of points in the tiles that it holds within r throughout, the tiles to compare with."""
        tiles, low, high, total = held.value
        for pdf in batches:
            for t, lo, hi in zip(pdf["tile"], pdf["lo"], pdf["hi"], strict=True):
                near, far = np.zeros(len(tiles)), np.zeros(len(tiles))
                for j in range(dims):
                    near += np.maximum(np.maximum(lo[j] - high[:, j], low[:, j] - hi[j]), 0.0) ** 2
                    far += np.maximum(hi[j] - low[:, j], high[:, j] - lo[j]) ** 2
                whole = far <= most
                rest = tiles[~whole & ~(near > most)]
                yield pd.DataFrame({"tile": t, "other": np.append(rest, -1), "whole": np.append(np.zeros(len(rest), np.int64), total[whole].sum())})

    pairs = scratch.write(own.select("tile", "lo", "hi").mapInPandas(meet, "tile long, other long, whole long"), "meet")
    other = met.select(F.col("tile").alias("other"), F.col("x").alias("y"), F.col("w").alias("v"))
    pairs = pairs.repartition(max(1, math.ceil(pairs.count() / PAIRS)), "tile", "other")
    pairs = pairs.join(other, "other", "left").join(own.select("tile", "x"), "tile")

    def count(batches):
        for pdf in batches:
            for t, x, whole, y, v in zip(pdf["tile"], pdf["x"], pdf["whole"], pdf["y"], pdf["v"], strict=True):
                x = x.reshape(-1, dims)
                n = np.full(len(x), whole)
                if y is not None:
                    n += (exact(x, y.reshape(-1, dims)) <= most) @ v
                yield pd.DataFrame({"tile": t, "at": np.arange(len(x)), "n": n} | {c: x[:, j] for j, c in enumerate(names)})

    got = pairs.select("tile", "x", "whole", "y", "v").mapInPandas(count, ", ".join(["tile long, at long, n long", *[f"{c} double" for c in names]]))
    return scratch.write(got.groupBy("tile", "at").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in names]).drop("tile", "at"), "tally")


def _dims(points: DataFrame) -> int:
    d = points.select(F.size("x")).first()
    return d[0] if d else 0


def ball_counts(points: DataFrame, r: float) -> DataFrame:
    """(id, n): points within r, the point itself included."""
    dims = _dims(points)
    if 0 < dims <= TILED:
        return _spread(points, dims).join(_tally(points, points, r, dims), [f"_x{j}" for j in range(dims)]).select("id", "n")
    if not dims:
        return points.select("id", F.lit(points.count()).cast("long").alias("n"))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *((qid, (d <= r * r).sum(1)) for qid, _, d in _blocks(pdf))]
        return pd.DataFrame(dict(zip(("id", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    met = Cells(points, points, points.count(), reach=r).met(points, points)
    return met.groupBy("g", "bi", "bj").applyInPandas(within, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def heavy(points: DataFrame, r: float, least: int) -> DataFrame:
    dims = _dims(points)
    if 0 < dims <= TILED:
        names = [f"_x{j}" for j in range(dims)]
        return _spread(points, dims).join(_tally(points, points, r, dims).where(F.col("n") >= least), names, "left_semi").drop(*names)
    return points.join(ball_counts(points, r).where(F.col("n") >= least).select("id"), "id", "left_semi")


def far_from(points: DataFrame, centres: DataFrame, r: float) -> DataFrame:
    """Points farther than r from every one of `centres`."""
    dims = _dims(points)
    if 0 < dims <= TILED:
        names = [f"_x{j}" for j in range(dims)]
        return _spread(points, dims).join(_tally(points, centres, r, dims).where("n > 0"), names, "left_anti").drop(*names)
    centres = select.Scratch(points.sparkSession).write(centres.select("id", "x"), "centres")
    n = centres.count()
    if not n:
        return points

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [qid[(d <= r * r).any(1)] for qid, _, d in _blocks(pdf)]
        return pd.DataFrame({"id": np.concatenate([np.zeros(0, np.int64), *got])})

    near = Cells(points, centres, n, reach=r).met(points, centres).groupBy("g", "bi", "bj").applyInPandas(close, "id long").distinct()
    return points.join(near, "id", "left_anti")
