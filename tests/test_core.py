import gzip
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clustrim.functions import columns as C
from clustrim.operators import assign as A
from clustrim.operators import metrics as M
from clustrim.operators import neighbours as N
from clustrim.operators import prep, sampling, select
from clustrim.plans import catalogue, grid, report
from clustrim.plans import solvers as V
from clustrim.sources import datasets, solution, tables
from clustrim.sources import points as src
from clustrim.streaming.assign import assign_stream

SF = "/root/testdata/sf0.001"


def points(spark, xs, label=None):
    rows = [(i, [float(v) for v in (x if isinstance(x, (list, tuple)) else [x])], label[i] if label else None) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "id long, x array<double>, label string")


@pytest.fixture(scope="module")
def line5(spark):
    return points(spark, [0, 1, 2, 10, 100])


def column(df, by, what):
    return [r[what] for r in df.orderBy(by).collect()]


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, same, name):
    same(spark, name, SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_radius_and_top(line5):
    r = N.radius(line5, 2)
    assert column(r, "id", "score") == [2, 1, 2, 9, 98]
    assert [x["id"] for x in N.top(r, 1).collect()] == [4]
    assert N.top(r, 5).count() == 0 and N.top(r, 0).count() == 0


def test_band(line5):
    assert column(N.band_sum(line5, 1, 2), "id", "score") == [2, 1, 2, 9, 98]


def test_duplicates_exclude_self(spark):
    k = N.knn(points(spark, [0, 0, 5, 5]), 1)
    assert column(k, "id", "d") == [0, 0, 0, 0] and column(k, "id", "j") == [1, 0, 3, 2]


def test_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    p = points(spark, rng.integers(0, 9, (60, 2)).tolist())
    one = sorted(map(tuple, N.knn(p, 7).collect()))
    monkeypatch.setattr(N, "BLOCK", 17)
    assert sorted(map(tuple, N.knn(p, 7).collect())) == one


def test_minmax_takes_all_points_as_anchors(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)
    xs = np.random.default_rng(8).normal(size=(150, 2)).round(4)
    xs[7] = xs[3]
    d = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(2))
    got = N.minmax(points(spark, xs.tolist())).first()
    assert math.isclose(got["min_d"], d[d > 0].min(), rel_tol=1e-9) and math.isclose(got["max_d"], d.max(), rel_tol=1e-9)


def test_tie_takes_smaller_id(spark):
    s = A.finish(points(spark, [-1, 0, 1]), [[0.0]], 1)
    assert [r["id"] for r in s.outliers().collect()] == [0]


def test_empty_cluster_rules(spark):
    p = points(spark, [10, 12])
    assert A.lloyd(p, [[11.0], [99.0]], 1)[0] == [[11.0], [0.0]]
    assert A.lloyd(p, [[11.0], [99.0]], 1, empty="keep")[0] == [[11.0], [99.0]]
    assert A.trimmed_lloyd(p, [[11.0], [99.0]], 0, 1)[0] == [[11.0], [99.0]]


def test_balls(spark):
    p = points(spark, [0, 1, 2, 50])
    assert column(N.ball_counts(p, 1.0), "id", "n") == [2, 3, 2, 1]
    h = N.heavy(p, 1.0, 2)
    assert column(h, "id", "id") == [0, 1, 2]
    assert column(N.far_from(p, h, 1.0), "id", "id") == [3]
    wide = points(spark, [[v, 0, 0, 0] for v in (0, 1, 2, 50)])
    assert column(N.ball_counts(wide, 1.0), "id", "n") == [2, 3, 2, 1]


def test_final_step(line5):
    s = A.finish(line5, [[1.0], [10.0]], 1)
    assert (s.cost, s.outliers_cost) == (2.0, 8100.0)
    assert column(s.cluster_sizes(), "cluster", "n") == [3, 1]
    full = A.finish(line5, [[1.0]], 5)
    assert full.cost == 0 and full.outliers().count() == 5


def test_coreset_budget(spark):
    assert sampling.uniform_coreset(points(spark, range(10)), 5, 5)[1] == 2  # half to even
    assert sampling.uniform_coreset(points(spark, range(10)), 0, 5)[1] == 1


def test_scores(spark):
    df = spark.createDataFrame([(i, i in (1, 2), i in (2, 3)) for i in range(5)], "id int, is_true boolean, is_outlier boolean")
    assert M.outlier_scores(df).first() == (0.5, 0.5, 0.5)
    ab = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 0)], "label string, cluster int")
    assert M.agreement(ab).first() == (1.0, pytest.approx(1.0))


def test_population_deviation_and_report(spark):
    rows = [(0, "SKIN-5", "IKMeans", 3, "completed", 1.0, 0.5, 2.0), (1, "SKIN-5", "IKMeans", 3, "completed", 3.0, 0.7, 4.0), (2, "SKIN-5", "KMeans--", 3, "timeout", None, None, None), (3, "odd", "IKMeans", 3, "completed", 9.0, 1.0, 1.0)]
    full = [(t, d, al, c, st, cost, rec, 0.5, 0.5, float("nan"), None, tm, 1.5) for t, d, al, c, st, cost, rec, tm in rows]
    kinds = "task_id int, dataset string, algorithm string, c int, status string, cost double, recall double, precision double, f1 double, ari double, nmi double, time_s double, param_value double"
    df = spark.createDataFrame(full, kinds)
    r = report.cube(df.where("dataset = 'SKIN-5'"), "dataset").first()
    assert (r["cost_mean"], r["cost_std"], r["ari_mean"]) == (2.0, 1.0, None)
    text = report.markdown(df, report.dense_pairs(spark), {"seeds": 10})
    assert "| SKIN-5 | IKMeans | **2.00 ± 1.00** |" in text and "- timeout: 1" in text and "odd" not in text and "- seeds: 10" in text
    table = report.table_text(report.statistics(df, report.dense_pairs(spark)))
    assert "TIMEOUT" in table and "n=2" in table and "NOT_RUN" in table
    assert grid.summary(df, 3.5).endswith("Effective parallelism: 2.0\n")
    csv = report.csv_rows(report.statistics(df, report.dense_pairs(spark)))
    assert csv.columns == report.CSV_COLUMNS and len(csv.columns) == 21 and csv.first()["algorithm"] == "TIKMeans" and csv.count() == 60
    assert report.sweep_rows(report.cube(df, "dataset", "algorithm", "c", param=True)).columns == report.SWEEP_COLUMNS and len(report.SWEEP_COLUMNS) == 19


def test_draw_follows_weights(spark):
    p = spark.range(4).selectExpr("id", "array(cast(id as double)) as x")
    from pyspark.sql import functions as F

    got = [i for i, _ in sampling.draw(p, F.col("id") + 1, 1, [f"s{k}" for k in range(400)])]
    share = np.bincount(got, minlength=4) / 400
    assert np.abs(share - np.array([0.1, 0.2, 0.3, 0.4])).max() < 0.08


def test_cost_never_rises(spark):
    rng = np.random.default_rng(2)
    p = points(spark, rng.normal(size=(200, 2)).tolist()).persist()
    seeds = sampling.d2_seeds(p, 4, 1)
    costs = [A.lloyd(p, seeds, t, tol=-1.0)[1] for t in (1, 2, 4)]
    assert costs == sorted(costs, reverse=True)


@pytest.mark.parametrize("name", ["KMeans++", "KMeans--", "OKMeans", "OKMeans2", "OKMeansBad", "NKMeans", "RobustKMeans++", "IKMeans", "TIKMeans", "CoresetOKMeans", "Random"])
def test_solvers_set_planted_outliers_aside(spark, name):
    rng = np.random.default_rng(4)
    good = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (8, 0), (0, 8))])
    bad = np.array([[60.0, 60.0], [-70.0, 40.0], [50.0, -60.0]])
    p = points(spark, np.concatenate([good, bad]).tolist()).persist()
    options = {"size": 100} if name.startswith("Coreset") else {"lo": 2, "iters": 1} if name == "NKMeans" else {}
    s = V.SOLVERS[name](**options).run(p.select("id", "x"), 3, 3)
    assert s.outliers().count() == 3 and s.assignments.count() == 183 and len(s.centres) <= 3
    if name in ("OKMeans", "OKMeansBad"):
        assert {r["id"] for r in s.outliers().collect()} == {180, 181, 182}


def test_guards(spark):
    p = points(spark, [0, 1, 2])
    assert len(sampling.d2_seeds(p, 9, 1)) == 3
    assert V.TIKMeans().run(p.select("id", "x"), 2, 0).assignments.count() == 3
    same_place = points(spark, [1, 1, 1])
    assert len(sampling.d2_seeds(same_place, 2, 1)) == 2
    assert A.assign(p, []).first()["cluster"] == -1


def test_wide_centres_take_the_kernel(spark):
    rng = np.random.default_rng(3)
    p, c = points(spark, rng.normal(size=(50, 20)).tolist()), rng.normal(size=(9, 20)).tolist()
    want = N.exact(np.array([r["x"] for r in p.orderBy("id").collect()]), np.array(c)).argmin(1).tolist()
    assert column(A.assign(p, c), "id", "cluster") == want


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3 7\n4.5  5 6 8\nx y z 1\n")
    assert [tuple(r) for r in src.read_spaced(spark, str(tmp_path / "a.txt")).orderBy("label").collect()] == [([1, 2, 3], "7"), ([4.5, 5, 6], "8")]
    (tmp_path / "b.csv").write_text("1.0,2,3\n0.0,4,5\n")
    assert [tuple(r) for r in src.read_csv(spark, str(tmp_path / "b.csv"), 3).orderBy("label").collect()] == [([4, 5], "0"), ([2, 3], "1")]
    (tmp_path / "c.csv").write_text(",".join(["0", "tcp", "http", "SF"] + ["1"] * 37 + ["normal."]) + "\n" + "1,2\n")
    r = src.read_connections(spark, str(tmp_path / "c.csv")).first()
    assert len(r["x"]) == 37 and r["label"] == "normal"
    p = prep.inject(points(spark, range(200)), 0.01)
    src.write_points(p, str(tmp_path / "p"))
    assert src.read_points(spark, str(tmp_path / "p")).where("is_outlier").count() == 2


@pytest.mark.parametrize("direct", [20_000, 7])
def test_thresholds(spark, monkeypatch, direct):
    """Exact places by histograms, with many equal values."""
    monkeypatch.setattr(select, "DIRECT", direct)
    monkeypatch.setattr(select, "BINS", 4)
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.exponential(1, 60), np.full(50, 2.5), np.zeros(40)]).tolist()
    df = spark.createDataFrame([(i * 3 - 50, v) for i, v in enumerate(values)], "id long, d2 double")
    order = sorted(((-v, i * 3 - 50) for i, v in enumerate(values)))
    for z in (1, 30, 61, 80, 150, 400):
        at = order[min(z, 150) - 1]
        assert select.edge(df, z) == (-at[0], at[1]) and select.threshold(df, z) == -at[0]
        assert A.split_top(df, z).where("is_outlier").count() == min(z, 150)
    assert select.edge(df.limit(0), 3) is None and N.top(df, 30, "d2").count() == 30
    assert [r["id"] for r in prep.first_rows(df, 30).orderBy("id").collect()] == sorted(i for _, i in order)[:30]


def test_ranks_over_partitions(spark):
    df = spark.createDataFrame([(f"w{(k * 37) % 101:03d}",) for k in range(101)], "label string")
    got = {r["label"]: r["rank"] for r in select.ranked(df, ["label"]).collect()}
    assert got == {f"w{k:03d}": k for k in range(101)}
    classes = points(spark, range(6), ["b", "a", "b", None, "c", "c"])
    assert [r["id"] for r in prep.classes_as_outliers(classes, smallest=1).where("is_outlier").collect()] == [3]
    assert sorted(r["id"] for r in prep.classes_as_outliers(classes, all_but_largest=1).where("not is_outlier").collect()) == [0, 2]


@pytest.mark.parametrize("dims, cell", [(2, 9), (2, 60), (6, 25), (12, 40)])
def test_cells_lose_no_neighbour(spark, monkeypatch, dims, cell):
    """Clusters, outliers far away and equal points, many cells and blocks: all as by brute force."""
    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "BLOCK", 23)
    rng = np.random.default_rng(dims + cell)
    xs = np.concatenate([rng.normal(c, 0.5, (90, dims)) for c in (0, 7)] + [rng.normal(0, 60, (9, dims)), np.ones((14, dims))]).round(3)
    p = points(spark, xs.tolist()).persist()
    d = np.sqrt(N.exact(xs, xs))
    ids = np.arange(len(xs))
    for k in (1, 6):
        want = {i: [(float(d[i, j]), int(j)) for j in sorted((j for j in ids if j != i), key=lambda j: (d[i, j], j))[:k]] for i in ids}
        got = {i: [] for i in ids}
        for r in N.knn(p, k).orderBy("id", "rank").collect():
            got[r["id"]].append((r["d"], r["j"]))
        assert got == want
    for reach in (0.0, 1.7):
        assert column(N.ball_counts(p, reach), "id", "n") == (d <= reach).sum(1).tolist() if dims > 3 or reach else True
    near = p.where("id % 5 = 0")
    far = {int(i) for i in ids if d[i, ids % 5 == 0].min() > 1.7}
    assert {r["id"] for r in N.far_from(p, near, 1.7).collect()} == far and 0 < len(far) < len(xs)
    assert N.far_from(p, near.limit(0), 1.7).count() == len(xs)


def test_probed_cells_find_most_neighbours(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 40)
    xs = np.random.default_rng(3).normal(size=(800, 2))
    p = points(spark, xs.tolist()).persist()
    exact, some, all_ = ({(r["id"], r["j"]) for r in N.knn(p, 5, probes=probes).collect()} for probes in (None, 5, 20))
    assert all_ == exact and 0.9 <= len(some & exact) / len(exact) < 1
    near = N.knn_landmarks(p, 2, 50).collect()
    assert len(near) == 1600 and all(r["id"] != r["j"] for r in near) and len({r["j"] for r in near}) <= 50


def test_distances_kept_from_round_to_round(spark, monkeypatch):
    monkeypatch.setattr(A.Reach, "CUT", 2)
    rng = np.random.default_rng(6)
    xs = rng.normal(size=(40, 2))
    p, cs = points(spark, xs.tolist()), rng.normal(size=(5, 2))
    reach = A.Reach(p)
    for m in range(5):
        now = reach.add([cs[m].tolist()])
        assert np.allclose(column(now, "id", "d2"), N.exact(xs, cs[: m + 1]).min(1))
    reach.close()
    assert column(A.nearest_distance(p, []), "id", "d") == [math.inf] * 40


def test_solution_on_disk(spark, tmp_path):
    p = points(spark, [0, 1, 2, 10, 100]).select("id", "x")
    s = V.OKMeansFixed(n_neighbors=2).run(p, 2, 1, save_path=str(tmp_path / "s"))
    back = solution.read_solution(spark, str(tmp_path / "s"), p)
    assert (back.codename, back.fullname, back.cost, back.centres) == (s.codename, s.fullname, s.cost, s.centres)
    assert {r["id"] for r in back.outliers().collect()} == {r["id"] for r in s.outliers().collect()} and back.original_outliers.count() == 1
    assert {r["cluster"]: r["ids"] for r in solution.member_lists(back).collect()} == {r["cluster"]: r["ids"] for r in solution.member_lists(s).collect()}
    meta = solution.instance_meta(p, 2, 1, "line", z_share=0.2)
    assert (meta["N"], meta["dataset"]["dim"], meta["Z_perc"]) == (5, 1, 0.2)


def test_names_and_metric(spark):
    assert V.SOLVERS["OKMeansFAISS"](seed=7).codename() == "okmeans-faiss(2,7,1)" and V.SOLVERS["KMeans--"]().codename() == "kmeans--[D2](42,1)"
    assert V.SOLVERS["CoresetOKMeans2FAISS"](seed=3).codename() == "coreset-okmeans2-faiss(2,3)" and V.SOLVERS["CoresetKMeans++"]().codename() == "coreset-kmeanspp(42)"
    assert V.SOLVERS["Random"]().with_seed(5).with_run_count(2).codename() == "Rnd(5,2)" and V.IKMeans().codename() == "ikmeans(0.5,0.5,1.5,42)"
    assert V.SOLVERS["KMeans++"]().fullname() == "KMeans::Kmeans++[D2](seed=42,run_count=1)" and V.NKMeans().problem() == "kmeans"
    assert sampling.size_for("SKIN-5") == 24_000 and sampling.size_for("benchmark") == 20_000
    with pytest.raises(ValueError):
        V.Random(metric="L1").run(points(spark, [1, 2]).select("id", "x"), 1, 0)
    assert not V.NKMeans().runnable(0) and V.OKMeans().runnable(0)


def test_small_coreset(spark):
    rng = np.random.default_rng(9)
    p = points(spark, rng.normal(size=(400, 2)).tolist()).select("id", "x").persist()
    for bernoulli in (False, True):
        s = V.Coreset(inner=V.KMeansPlusPlus(), size=80, bernoulli=bernoulli).run(p, 3, 5)
        assert len(s.centres) == 3 and s.outliers().count() == 5 and int(s.extra["coreset_size"]) <= 400


def test_preparation_of_raw_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "Skin_NonSkin.txt").write_text("".join(f"{a} {b} {c} {1 + k % 2}\n" for k, (a, b, c) in enumerate(rng.integers(0, 255, (300, 3)))))
    (tmp_path / "shuttle.trn").write_text("".join(f"{k} {k % 7} {1 if k < 80 else 2 + k % 3}\n" for k in range(90)))
    with gzip.open(tmp_path / "SUSY.csv.gz", "wt") as f:
        f.writelines(f"{k % 2}.0,{k / 3},{k % 11}\n" for k in range(200))
    with gzip.open(tmp_path / "kddcup.data.gz", "wt") as f:
        f.writelines(",".join(["0", "tcp", "http", "SF", *[str(k % 9)] * 37, ["a", "b", "c", "d"][k % 4 if k % 20 else 3] + "."]) + "\n" for k in range(100))
    meta = {r["name"]: r for r in datasets.prepare(spark, str(tmp_path), str(tmp_path / "out")).collect()}
    assert {n: (m["n"], m["dim"], m["k"]) for n, m in meta.items()} == {"SKIN-5": (303, 3, 10), "SKIN-10": (303, 3, 10), "SUSY-5": (202, 2, 10), "SUSY-10": (202, 2, 10), "SHUTTLE": (90, 2, 10), "KDDFULL": (100, 37, 3)}
    assert meta["SKIN-5"]["z"] == 3 and meta["SHUTTLE"]["z"] == 6 and meta["KDDFULL"]["label_names"] == ["a", "b", "c", "d"] and meta["SKIN-5"]["label_names"] is None
    held = datasets.Registry(spark, str(tmp_path / "out"))
    with pytest.warns(UserWarning):
        assert held.preload(["SHUTTLE", "none"]) == ["SHUTTLE"]
    p, k = held.get("SHUTTLE")
    assert k == 10 and p.count() == 90 and held.get("SHUTTLE")[0] is p
    raw = src.read_spaced(spark, str(tmp_path / "shuttle.trn"))
    assert column(datasets.with_positions(raw), "id", "x") == [[float(k), float(k % 7)] for k in range(90)]
    assert [tuple(r) for r in src.widths(p).collect()] == [(2, 90)]
    held.close()


def test_grid_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    p = prep.inject(points(spark, [[i % 5, i % 7] for i in range(120)], ["a"] * 120), 0.02, 90.0).persist()

    def load(name):
        if name == "gone":
            raise FileNotFoundError(name)
        return p, 2

    tasks = grid.task_grid(spark, ["SKIN-5", "gone"], ["KMeans--", "KMeans++"], 2)
    path = str(tmp_path / "results")
    first = grid.run_grid(spark, tasks, load, path, start=0, end=3)
    assert {r["task_id"]: r["status"] for r in first.collect()} == {0: "completed", 1: "completed", 2: "completed"}
    both = grid.run_grid(spark, tasks, load, path, workers=2)
    assert {r["task_id"]: r["status"] for r in both.collect()} == {k: "completed" if k < 4 else "error" for k in range(8)} and both.where("task_id = 0").first()["algo_codename"] == "kmeans--[D2](0,1)"
    grid.analyse(spark, str(tmp_path))
    assert "KMeans--" in (tmp_path / "report.md").joinpath(next(f for f in os.listdir(tmp_path / "report.md") if f.startswith("part"))).read_text()
    assert src.read_results(spark, envelope(spark, both, tmp_path)).count() == 8
    monkeypatch.setattr(V.KMeansMinusMinus, "centres", lambda *a: spark.range(10**13).selectExpr("sum(sqrt(id))").collect())
    late = grid.run_task(p, V.KMeansMinusMinus(), 2, {"task_id": 1}, timeout=0.5)
    assert late["status"] == "timeout"
    assert grid.distinct_names(tasks) == {"dataset": ["SKIN-5", "gone"], "algorithm": ["KMeans++", "KMeans--"], "seed": [0, 1]}


def envelope(spark, results, folder):
    """A result file with its header, as other runners write it."""
    rows = [json.loads(r) for r in results.toJSON().collect()]
    (folder / "all.json").write_text(json.dumps({"system_info": grid.system_info(spark), "experiment_config": {}, "results": rows}))
    return str(folder / "all.json")


def test_resources(spark):
    assert grid.ResourceConfig.of(32, 768, 4) == grid.ResourceConfig(8, 4, 96.0) and grid.ResourceConfig.of(2, 16, 4).workers == 1
    assert grid.ResourceConfig.from_batch({"SLURM_CPUS_PER_TASK": "32", "SLURM_MEM_PER_NODE": "131072M"}, 4) == grid.ResourceConfig(2, 4, 64.0)
    assert grid.system_info(spark)["timestamp"][4] == "-" and grid.ExperimentConfig().timeout == 300 and set(grid.WORKER_CONF.values()) == {"1"}


def test_streamed_assignment(spark, tmp_path):
    points(spark, [0, 4, 9]).write.parquet(str(tmp_path / "in"))
    stream = assign_stream(spark.readStream.schema("id long, x array<double>, label string").parquet(str(tmp_path / "in")), [[0.0], [8.0]])
    q = stream.writeStream.format("memory").queryName("assigned").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert {r["id"]: r["cluster"] for r in spark.table("assigned").collect()} == {0: 0, 1: 0, 2: 1}


def test_scratch(spark):
    s = tables.Scratch(spark)
    for k in range(3):
        df = s.write(spark.range(k + 1), "t")
    s.drop("t", keep=1)
    assert df.count() == 3 and len(s.paths["t"]) == 1
    s.drop("t")
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_task_runner(spark):
    p = prep.inject(points(spark, [[i % 5, i % 7] for i in range(200)], ["a"] * 200), 0.02, 90.0)
    row = grid.run_task(p, V.OKMeansFixed(), 2, {"task_id": 0, "dataset": "t", "algorithm": "OKMeansBad", "seed": 1})
    assert row["status"] == "completed" and row["recall"] >= 0.5 and row["num_centers"] == 2
    assert grid.preset("NKMeans").codename().startswith("coreset-nkmeans") and math.isclose(grid.swept("OKMeansFAISS", 5)[2], 3.0)
    assert set(C.METRICS) == {"L1", "L2"}


@pytest.fixture
def limited(spark):
    """limited(seconds, f): f(), whose jobs are cancelled after so many seconds."""
    import threading

    def run(seconds, f):
        timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
        timer.start()
        try:
            return f()
        finally:
            timer.cancel()

    return run


def _copies(spark, n):
    """n points on 40 places and one apart."""
    place = (F.col("id") % 40).cast("double") / 100
    return spark.range(n).select("id", F.array(place, F.when(F.col("id") == 7, 900.0).otherwise(place * place)).alias("x"))


def test_balls_of_many_copies(spark, limited):
    n = 400_000  # 1.6e11 pairs
    got = limited(60, lambda: N.ball_counts(_copies(spark, n), 1.0).groupBy("n").count().collect())
    assert sorted(map(tuple, got)) == [(1, 1), (n - 1, n - 1)]


@pytest.mark.parametrize(("dims", "r"), [(1, 0.05), (2, 0.3), (3, 0.5), (2, 50.0)])
def test_balls_by_tiles(spark, monkeypatch, dims, r):
    monkeypatch.setattr(N, "TILE", 64)
    x = np.random.default_rng(3).normal(size=(1500, dims)).round(2)
    x[:50] = x[50:100]
    p = points(spark, x.tolist())
    near = N.exact(x, x) <= r * r
    assert column(N.ball_counts(p, r), "id", "n") == near.sum(1).tolist()
    assert column(N.far_from(p, p.where("id % 40 = 0"), r), "id", "id") == np.flatnonzero(~near[:, ::40].any(1)).tolist()


def test_heavy_of_many_copies(spark, limited):
    n = 400_000
    h = limited(60, lambda: N.heavy(_copies(spark, n), 1.0, 2).agg(F.count("*"), F.sum("id")).first())
    assert tuple(h) == (n - 1, n * (n - 1) // 2 - 7)


def test_far_from_many_copies(spark, limited):
    p = _copies(spark, 400_000)
    far = limited(60, lambda: N.far_from(p, p.where("id != 7"), 1.0).collect())
    assert [(r["id"], r["x"]) for r in far] == [(7, [0.07, 900.0])]


def test_runs_share_passes(spark):
    p = points(spark, np.random.default_rng(4).normal(size=(300, 2)).round(3).tolist()).persist()
    seeds = [42, 73, 104]
    starts = sampling.d2_seeds_runs(p, 3, seeds)
    assert starts == [sampling.d2_seeds(p, 3, s) for s in seeds]
    for (c, cost), start in zip(A.lloyd_runs(p, starts), starts, strict=True):
        want = A.lloyd(p, start)
        assert np.allclose(c, want[0]) and math.isclose(cost, want[1])
    few = points(spark, [1, 1, 2, 2])
    assert sampling.d2_seeds_runs(few, 4, seeds) == [sampling.d2_seeds(few, 4, s) for s in seeds]
    jobs = []
    for name, f in (("runs", lambda: V.NKMeans(iters=3)._best(p, 3, 42)), ("alone", lambda: [A.lloyd(p, s) for s in starts])):
        spark.sparkContext.setJobGroup(name, "")
        f()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] < jobs[1]


def test_whole_coreset_beyond_default_size(spark, same, tmp_path):
    import duckdb

    part = "/root/testdata/sf0.01/part.parquet"
    duckdb.sql(f"copy (select * replace (p_partkey + 100000 * i as p_partkey) from '{part}', (select unnest(range(11)) as i)) to '{tmp_path}/part.parquet' (format parquet)")
    assert spark.read.parquet(f"{tmp_path}/part.parquet").count() > 20_000
    same(spark, "coreset_kmeanspp", str(tmp_path))
