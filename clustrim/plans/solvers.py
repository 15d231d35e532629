"""Solvers of k-means with outliers, as plans over a points table (id, x).

Each takes (points, k, z) and ends with the same step: all points to their centres, the z farthest aside.
Only k x d centres or a few hundred weighted candidates live on the driver.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import uniform_of
from ..operators import assign as A
from ..operators import neighbours as N
from ..operators import sampling as S
from ..operators.select import ranked
from ..sources import solution

Centres = list[list[float]]


def weighted_seeds(ids: list[int], x: np.ndarray, w: np.ndarray, k: int, seed: int, salt: str, cap: float = np.inf) -> np.ndarray:
    """k rows: the first by weight, the next by weight times capped squared distance, by races on hash uniforms.

    Where no such weight is left, the next are drawn by weight among the rows not taken.
    """
    taken: list[int] = []
    d = np.ones(len(x))
    while len(taken) < min(k, len(x)):
        free = np.ones(len(x))
        free[taken] = 0
        p = w * np.minimum(d, cap) * free if taken else w
        p = p if p.sum() > 0 else w * free
        u = np.array([uniform_of(seed, f"{salt}-{len(taken)}", i) for i in ids])
        with np.errstate(divide="ignore"):
            nxt = int(np.lexsort((ids, np.where(p > 0, -np.log(u) / p, np.inf)))[0])
        new = N.exact(x, x[nxt : nxt + 1])[:, 0]
        d = np.minimum(d, new) if taken else new
        taken.append(nxt)
    return x[taken]


def weighted_lloyd(x: np.ndarray, w: np.ndarray, c: np.ndarray, rounds: int = 30, tol: float = 1e-4) -> np.ndarray:
    """Lloyd on weighted candidates; an empty cluster goes to the origin."""
    last = None
    for _ in range(rounds):
        d = N.exact(x, c)
        near = d.argmin(1)
        cost = float((w * d[np.arange(len(x)), near]).sum())
        if last is not None and abs(last - cost) < tol * max(last, 1e-10):
            break
        last = cost
        sums = np.stack([np.bincount(near, w * x[:, j], len(c)) for j in range(x.shape[1])], 1)
        mass = np.bincount(near, w, len(c))
        c = np.where(mass[:, None] > 0, sums / np.where(mass > 0, mass, 1)[:, None], 0.0)
    return c


@dataclass
class Solver:
    """run() repeats `run_count` times with other salts and keeps the strictly lowest cost."""

    run_count: int = 1
    seed: int = 42
    metric: str = "L2"
    #: Code name, its part in brackets, long name; whether the run count is part of them.
    name = "Rnd"
    starts = ""
    long_name = "Random"
    counted = long_counted = True

    def params(self) -> dict:
        return {}

    def codename(self) -> str:
        own = [*self.params().values(), self.seed, *([self.run_count] if self.counted else [])]
        return f"{self.name}{self.starts}({','.join(map(str, own))})"

    def fullname(self) -> str:
        own = self.params() | {"seed": self.seed} | ({"run_count": self.run_count} if self.long_counted else {})
        return f"KMeans::{self.long_name}{self.starts}({','.join(f'{a}={b}' for a, b in own.items())})"

    def problem(self) -> str:
        return "kmeans"

    def with_seed(self, seed: int) -> Solver:
        self.seed = seed
        return self

    def with_run_count(self, run_count: int) -> Solver:
        self.run_count = run_count
        return self

    def runnable(self, z: int) -> bool:
        return True

    def centres(self, points: DataFrame, k: int, z: int, seed: int, extra: dict) -> Centres:
        return S.uniform_seeds(points, k, seed)

    def solve(self, points: DataFrame, k: int, z: int, seed: int | None = None) -> A.Solution:
        extra: dict = {}
        centres = self.centres(points, k, z, self.seed if seed is None else seed, extra)
        out = A.finish(points, centres, z)
        out.original_outliers = extra.pop("detected", None)
        out.extra, out.codename, out.fullname = {a: str(b) for a, b in extra.items()}, self.codename(), self.fullname()
        return out

    def run(self, points: DataFrame, k: int, z: int | None = None, z_share: float | None = None, save_path: str | None = None) -> A.Solution:
        if self.metric != "L2":
            raise ValueError(f"solvers minimise squared L2 distances, not {self.metric}")
        if z_share is not None:
            z = math.ceil(z_share * points.count())
        began, best = time.time(), None
        for r in range(self.run_count):
            got = self.solve(points, k, z or 0, self.seed + 7919 * r)
            if best is None or got.cost < best.cost:
                best = got
        best.elapsed_ms = (time.time() - began) * 1000
        if save_path:
            solution.write_solution(best, save_path)
        return best


class Random(Solver):
    pass


@dataclass
class KMeansPlusPlus(Solver):
    eps_break: float = -1
    name, starts, long_name = "kmeans++", "[D2]", "Kmeans++"

    def centres(self, points, k, z, seed, extra):
        return A.lloyd(points, S.d2_seeds(points, k, seed), tol=self.eps_break if self.eps_break > 0 else 1e-4)[0]


@dataclass
class KMeansMinusMinus(Solver):
    name, starts, long_name = "kmeans--", "[D2]", "Kmeans--"

    def centres(self, points, k, z, seed, extra):
        return A.trimmed_lloyd(points, S.d2_seeds(points, k, seed), z)[0]


@dataclass
class _Detect(Solver):
    """Outliers by a neighbour score, k-means++ on the rest.  max_k None lifts the cap on neighbours."""

    max_k: int | None = 500
    long_counted = False

    def codename(self):
        """The neighbour search without a cap has a name of its own."""
        return super().codename().replace("(", "-faiss(", 1) if self.max_k is None else super().codename()

    def fullname(self):
        return super().fullname().replace("(", "FAISS(", 1) if self.max_k is None else super().fullname()

    def score(self, points, z, n):
        raise NotImplementedError

    def centres(self, points, k, z, seed, extra):
        n = points.count()
        gone = N.top(self.score(points, z, n), z, n=n) if 0 < z < n else points.limit(0)
        gone = gone.select("id").persist()
        extra |= {"outlier_method": self.name, "num_outliers_detected": gone.count(), "detected": gone}
        return KMeansPlusPlus(seed=seed).centres(points.join(gone, "id", "left_anti"), k, 0, seed, {})


@dataclass
class OKMeans(_Detect):
    neighbor_mult: float = 2
    name, long_name = "okmeans", "OKMeans"

    def params(self):
        return {"neighbor_mult": self.neighbor_mult}

    def score(self, points, z, n):
        return N.radius(points, max(1, int(self.neighbor_mult * z)), self.max_k, n)


@dataclass
class OKMeansBand(_Detect):
    c: float = 2
    name, long_name = "okmeans2", "OKMeans2"

    def params(self):
        return {"c": self.c}

    def score(self, points, z, n):
        return N.band_sum(points, z, self.c, self.max_k, n)


@dataclass
class OKMeansFixed(_Detect):
    n_neighbors: int = 10
    name, long_name = "okmeans-bad", "OKMeansBad"

    def params(self):
        return {"n_neighbors": self.n_neighbors}

    def score(self, points, z, n):
        return N.radius(points, self.n_neighbors, self.max_k, n)


@dataclass
class NKMeans(Solver):
    """Heavy balls: guesses of the optimum until few enough points are far from every heavy one."""

    iters: int = 10
    guess_base: float = 2.0
    lo: int = 10
    hi: int = 30
    name, long_name = "nkmeans", "NKMeans"

    def params(self):
        return {"iters": self.iters, "guess_base": self.guess_base}

    def runnable(self, z):
        return z > 0

    def _best(self, points, k, seed):
        starts = S.d2_seeds_runs(points, k, [seed + 31 * r for r in range(self.iters)])
        return min(A.lloyd_runs(points, starts), key=lambda run: run[1])[0]

    def centres(self, points, k, z, seed, extra):
        n = points.count()
        guesses = S.opt_guesses(self.guess_base, self.lo, self.hi)
        extra["opt_guesses"] = len(guesses)
        for t, guess in enumerate(guesses if z > 0 else []):
            r = 2 * math.sqrt(guess / z)
            out = N.far_from(points, N.heavy(points, r, 2 * z), r).select("id").persist()
            m = out.count()
            if m < n and m <= (3 * k + 2) * z:
                extra |= {"iter": t, "detected": out}
                rest = points.join(out, "id", "left_anti").select("id", "x").persist()
                best = self._best(rest, k, seed)
                rest.unpersist()
                return best
            out.unpersist()
        extra["nkmeans_fallback"] = "kmeans++"
        return KMeansPlusPlus(seed=seed).centres(points, k, 0, seed, {})


def _from_candidates(points, cands, k, z, extra_share, seed, extra, capped=True) -> Centres:
    """Weights without the farthest points, weighted seeding and Lloyd on the candidates."""
    ids, x = [c[0] for c in cands], np.array([c[1] for c in cands], float)
    extra["num_candidates"] = len(x)
    if len(x) <= k:
        return x.tolist()
    far = math.ceil((1 + extra_share) * z)
    near = A.split_top(A.assign(points, x.tolist()), min(far, points.count() - 1) if capped else far)
    w = S.candidate_weights(near.where(~F.col("is_outlier")), len(x))
    return weighted_lloyd(x, w, weighted_seeds(ids, x, w, k, seed, "seeds")).tolist()


@dataclass
class RobustKMeansPlusPlus(Solver):
    beta: float = 0.1
    delta: float = 0.1
    t_mult: float = 1.0
    m_mult: float = 1.0
    name, long_name = "robust-kmeans++", "RobustKmeans++"

    def params(self):
        return {"beta": self.beta, "delta": self.delta}

    def centres(self, points, k, z, seed, extra):
        extra |= {"t": max(1, int(self.t_mult * k)), "m": max(1, int(self.m_mult / self.delta))}
        return _from_candidates(points, S.mixed_rounds(points, k, seed, self.delta, self.t_mult, self.m_mult), k, z, 0.0, seed, extra, capped=False)


@dataclass
class IKMeans(Solver):
    epsilon: float = 0.5
    eta: float = 0.5
    beta: float = 1.5
    samples_per_iter: int = 5
    name, long_name = "ikmeans", "IKmeans"
    counted = long_counted = False

    def params(self):
        return {"epsilon": self.epsilon, "eta": self.eta, "beta": self.beta}

    def centres(self, points, k, z, seed, extra):
        return _from_candidates(points, S.capped_rounds(points, z, k, seed, self.epsilon, self.beta, self.samples_per_iter), k, z, self.epsilon, seed, extra)


@dataclass
class TIKMeans(Solver):
    """Centre reduction: recall the nearest excluded points in rounds, reduce the candidates under each."""

    epsilon: float = 0.5
    eta: float = 0.5
    beta: float = 1.5
    name, long_name = "tikmeans", "TIKmeans"
    counted = long_counted = False

    def params(self):
        return {"epsilon": self.epsilon, "eta": self.eta, "beta": self.beta}

    def reduce(self, ids, x, w, k, z, seed, salt):
        """Of all guesses of the optimum, the seeds of least weighted cost; then one weighted Lloyd step."""
        best = None
        for g, guess in enumerate(S.opt_guesses()):
            c = weighted_seeds(ids, x, w, k, seed, f"{salt}-{g}", guess / max(z, 1))
            cost = float((w * N.exact(x, c).min(1)).sum())
            if best is None or cost < best[0]:
                best = cost, c
        return weighted_lloyd(x, w, best[1], rounds=1, tol=0.0)

    def plan(self, points, k, z, seed):
        """(ids, candidates, their weights without the excluded, recalled points by slice and candidate, sizes of the slices)."""
        cands = S.capped_rounds(points, z, k, seed, self.epsilon / 2, self.beta)
        ids, x = [c[0] for c in cands], np.array([c[1] for c in cands], float)
        n = points.count()
        far = min(math.ceil((1 + self.epsilon) * z), n - 1)
        near = S.Reach(points).scratch.write(A.assign(points, x.tolist()).select("id", "cluster", "d2"), "near")
        order = A.split_top(near, far)
        w = np.zeros(len(x))
        for r in order.where(~F.col("is_outlier")).groupBy("cluster").agg(F.count("*").alias("n")).collect():
            w[r["cluster"]] = r["n"]
        # the excluded points, nearest first, in slices; a count for each slice and candidate comes back
        step = max(1, math.ceil(self.epsilon / 2 * z / 2))
        back = ranked(order.where("is_outlier").select("d2", "id", "cluster"), ["d2", "id"]).groupBy(F.floor(F.col("rank") / step).alias("slice"), "cluster").agg(F.count("*").alias("n"))
        slices = {(r["slice"], r["cluster"]): r["n"] for r in back.collect()}
        return ids, x, w, slices, far, step

    def centres(self, points, k, z, seed, extra):
        extra["algorithm"] = self.name
        ids, x, w, slices, far, step = self.plan(points, k, z, seed)
        extra["num_candidates"] = len(x)
        if len(x) <= k:
            return x.tolist()
        if z <= 0:
            return self.reduce(ids, x, np.where(w > 0, w, 1.0), k, 0, seed, "reduce").tolist()
        best, left, n = None, far, points.count()
        for t in range(max(1, math.ceil(2 * (1 + self.epsilon) / (self.epsilon / 2)))):
            if not left:
                break
            left = max(0, left - step)
            for (j, c), m in slices.items():
                if j == t:
                    w[c] += m
            free = max(0, math.ceil((1 + self.epsilon) * z) - left)
            got = self.reduce(ids, x, np.where(w > 0, w, 1.0), k, free, seed, f"reduce-{t}")
            cost = A.trimmed_cost(points, got.tolist(), min(math.ceil((1 + self.epsilon) * z), n - 1))
            if best is None or cost < best[0]:
                best = cost, got
        return best[1].tolist()


@dataclass
class Coreset(Solver):
    """Any solver on a uniform (or Bernoulli) sample, its centres finished on all points.

    The size is `size`, or follows the name of the data set.
    """

    inner: Solver | None = None
    size: int | None = None
    bernoulli: bool = False
    dataset: str = ""

    def codename(self):
        self.inner.seed = self.seed
        own = ",".join(str(p) for p in (*self.inner.params().values(), self.seed))
        head = self.inner.codename().split("(")[0].split("[")[0].replace("kmeans++", "kmeanspp")
        return f"coreset-{head}({own})"

    def fullname(self):
        head = self.inner.fullname().removeprefix("KMeans::").split("(")[0].split("[")[0].replace("Kmeans++", "KMeanspp")
        return f"KMeans::Coreset{head}({','.join(f'{a}={b}' for a, b in (self.inner.params() | {'seed': self.seed}).items())})"

    def runnable(self, z):
        return self.inner.runnable(z)

    def centres(self, points, k, z, seed, extra):
        if self.bernoulli:
            core, kk, zz, p = S.bernoulli_coreset(points, k, z, seed)
        else:
            core, zz, p = S.uniform_coreset(points, z, self.size or S.size_for(self.dataset), seed)
            kk = k
        core = core.persist()
        extra |= {"coreset_size": core.count(), "sampling_prob": p, "algorithm": self.inner.name}
        own: dict = {}
        centres = self.inner.centres(core, kk, zz, seed, own)
        extra |= {a: b for a, b in own.items() if a != "detected"}
        core.unpersist()
        if len(centres) > k:
            few = points.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centres)], "id long, x array<double>")
            centres = S.d2_seeds(few, k, seed)
        return centres


#: Names of the public presets and their solvers.
SOLVERS = {
    "Random": Random,
    "KMeans++": KMeansPlusPlus,
    "KMeans--": KMeansMinusMinus,
    "OKMeans": OKMeans,
    "OKMeans2": OKMeansBand,
    "OKMeansBad": OKMeansFixed,
    "OKMeansFAISS": lambda **a: OKMeans(max_k=None, **a),
    "OKMeans2FAISS": lambda **a: OKMeansBand(max_k=None, **a),
    "OKMeansBadFAISS": lambda **a: OKMeansFixed(max_k=None, **a),
    "NKMeans": NKMeans,
    "NKMeansFAISS": lambda **a: NKMeans(**a),
    "RobustKMeans++": RobustKMeansPlusPlus,
    "IKMeans": IKMeans,
    "TIKMeans": TIKMeans,
    "CoresetKMeans++": lambda **a: Coreset(inner=KMeansPlusPlus(), **a),
    "CoresetOKMeans": lambda **a: Coreset(inner=OKMeans(), **a),
    "CoresetOKMeans2": lambda **a: Coreset(inner=OKMeansBand(), **a),
    "CoresetOKMeansFAISS": lambda **a: Coreset(inner=OKMeans(max_k=None), **a),
    "CoresetOKMeans2FAISS": lambda **a: Coreset(inner=OKMeansBand(max_k=None), **a),
    "CoresetOKMeansBadFAISS": lambda **a: Coreset(inner=OKMeansFixed(max_k=None), **a),
    "CoresetNKMeans": lambda **a: Coreset(inner=NKMeans(iters=3), **a),
    "CoresetNKMeansFAISS": lambda **a: Coreset(inner=NKMeans(iters=3), **a),
}
