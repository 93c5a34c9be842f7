"""Study operators against plain forms: quantiles, numbering, resampling, Shapley values, structure files, training."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhoscape import cli
from rhoscape.operators import compare, figures, metrics, models, tabular
from rhoscape.plans import predict
from rhoscape.sources import bundles, density, structures
from rhoscape.storage import discard, materialise, quantiles, shared_path

CELL = np.array([[4.0, 0, 0], [0.5, 4.1, 0], [0.3, 0.4, 4.3]])


def test_quantiles_are_exact(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if k % 9 else None, rng.choice([1.0, 2.5, 7.0, rng.random() * 9, None])) for k in range(400)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: (r.low, r.half, r.top) for r in quantiles(frame, ["g"], "x", {"low": 0.01, "half": 0.5, "top": 1.0}).collect()}
    for g in ("a", "b", None):
        held = [x for k, x in rows if k == g and x is not None]
        assert np.allclose(got[g], np.quantile(held, [0.01, 0.5, 1.0]))
    assert quantiles(frame, [], "x", {"half": 0.5}).first().half == pytest.approx(np.median([x for _, x in rows if x is not None]))
    assert quantiles(frame.limit(0), ["g"], "x", {"half": 0.5}).count() == 0


def test_stored_tables(spark):
    stored = materialise(spark.range(4), "t")
    assert stored.count() == 4
    discard(stored)

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        shared_path(Cluster, "x")


def test_numbers_within_groups(spark):
    rows = [(k % 3, (k * 37) % 101) for k in range(90)]
    frame = spark.createDataFrame(rows, "g int, v int").repartition(4)
    got = {(r.g, r.v): r.n for r in tabular.numbered(frame, "g", "v", "n").collect()}
    for g in range(3):
        assert [got[g, v] for v in sorted(v for k, v in rows if k == g)] == list(range(1, 31))
    ranked = metrics.importance_shares(frame.withColumn("v", F.col("v").cast("double")).withColumn("name", F.col("v").cast("string")), "g", "name", "v")
    for g in range(3):
        held = sorted(((r.rank, r.v, r.share) for r in ranked.where(F.col("g") == g).collect()))
        assert [v for _, v, _ in held] == sorted((float(v) for k, v in rows if k == g), reverse=True)
        assert [r for r, *_ in held] == list(range(1, 31)) and sum(s for *_, s in held) == pytest.approx(1.0)


def test_control_drops_as_many(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("abcdefgh"), "test" if k % 10 == 0 else "val" if k % 10 == 1 else "train") for k in range(300)]
    frame = spark.createDataFrame(rows, "k int, system string, split string")
    count = lambda f: {r.split: r["count"] for r in f.groupBy("split").count().collect()}
    tested = {s for _, s, split in rows if split == "test"}
    shared = {split: sum(1 for _, s, x in rows if x == split and s in tested and split != "test") for split in ("train", "val", "test")}
    got = tabular.size_matched_control(frame, "k")
    left = count(got)
    for split in ("train", "val", "test"):
        n = sum(x == split for *_, x in rows)
        assert left.get(split, 0) == max(n - shared[split], shared[split] if split != "test" else n)
    assert {r.k for r in got.collect()} == {r.k for r in tabular.size_matched_control(frame.repartition(7), "k").collect()}


def test_labels_and_searches(spark):
    frame = spark.createDataFrame([(1, "test"), (2, "test"), (3, "train"), (4, "val")], "k int, split string")
    made = tabular.relabelled(frame, frame.where("k IN (1, 3)").select("k"), "k")
    assert {r.k: r.split for r in made.collect()} == {1: "test", 2: "aside", 3: "test", 4: "val"}
    words = spark.createDataFrame([("Alpha", None), ("beta", "ALPhabet"), ("c.d", "x")], "a string, b string")
    found = lambda t: {r.a for r in tabular.containing(words, ["a", "b"], t).collect()}
    assert found("alpha") == {"Alpha", "beta"} and found(".") == {"c.d"} and len(found("")) == 3 and not found("zz")


def test_bootstrap_draws(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=300)
    rows = [(int(k), float(v), float(v + 0.3 * a), float(v + 0.6 * b)) for k, v, a, b in zip(rng.permutation(10_000)[:300], y, rng.normal(size=300), rng.normal(size=300))]
    got = metrics.bootstrap_difference(spark.createDataFrame(rows, "k bigint, y double, p double, q double").repartition(3), "k", "y", "p", "q", 400).first()
    w = metrics.draw_weights(np.array([r[0] for r in rows]), np.arange(400))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2
    v, p, q = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    gain = (w @ (v - p) ** 2 - w @ (v - q) ** 2) / (w @ v**2 - (w @ v) ** 2 / w.sum(1))
    assert (got.low, got.high) == pytest.approx(np.quantile(gain, [0.025, 0.975])) and got.low < got.high < 0


def test_shapley_values_of_trees(spark):
    rng = random.Random(7)

    def grown(depth, rows):
        if depth == 0 or rows < 4:
            return rng.random() * 4 - 2, rows
        left = rng.randint(1, rows - 1)
        return rng.randrange(3), rng.random(), grown(depth - 1, left), grown(depth - 1, rows - left), rows

    def text(tree):
        nodes, leaves = [], []

        def number(t):
            if len(t) == 2:
                leaves.append(t)
                return -len(leaves)
            nodes.append(t)
            at, children = len(nodes) - 1, {}
            order.append((at, children))
            children["l"], children["r"] = number(t[2]), number(t[3])
            return at

        order: list = []
        number(tree)
        of = dict(order)
        row = lambda k, v: k + "=" + " ".join(map(str, v))
        lines = [row("split_feature", [n[0] for n in nodes]), row("threshold", [n[1] for n in nodes]), row("decision_type", [2] * len(nodes)), row("left_child", [of[k]["l"] for k in range(len(nodes))]), row("right_child", [of[k]["r"] for k in range(len(nodes))]), row("leaf_value", [v for v, _ in leaves]), row("internal_count", [n[4] for n in nodes]), row("leaf_count", [n for _, n in leaves])]
        return "feature_names=a b c\nobjective=regression\n\nTree=0\n" + "\n".join(lines) + "\n\nend of trees\n"

    def value(t, x, known):
        if len(t) == 2:
            return t[0]
        if t[0] in known:
            return value(t[2] if x[t[0]] <= t[1] else t[3], x, known)
        size = lambda c: c[1] if len(c) == 2 else c[4]
        return (size(t[2]) * value(t[2], x, known) + size(t[3]) * value(t[3], x, known)) / t[4]

    for _ in range(5):
        tree = grown(4, 60)
        booster = bundles.Booster.parse(text(tree))
        x = np.random.default_rng(1).random((6, 3))
        want = np.zeros((6, 3))
        for r, row in enumerate(x):
            for order in itertools.permutations(range(3)):
                for k, f in enumerate(order):
                    want[r, f] += (value(tree, row, order[: k + 1]) - value(tree, row, order[:k])) / 6
        assert np.allclose(booster.contributions(x), want)
        assert np.allclose(booster.predict(x), [value(tree, row, (0, 1, 2)) for row in x])
    bundle = bundles.Bundle("b", ["a", "b", "c"], {}, {"y": bundles.Target("y", "regression", features=["a", "b", "c"], booster=text(tree))})
    frame = spark.createDataFrame([tuple(map(float, row)) for row in x], "a double, b double, c double").repartition(3)
    got = {r.feature: r for r in bundles.importances(frame, bundle, "y").collect()}
    assert np.allclose([got[f].mean_abs for f in "abc"], np.abs(want).mean(0)) and sum(r.share for r in got.values()) == pytest.approx(1.0)
    assert bundles.leading(bundles.importances(frame, bundle, "y"), 1).first().feature == "abc"[int(np.abs(want).mean(0).argmax())]
    with pytest.raises(Exception, match="rows"):
        bundles.Booster.parse(text(tree).replace("leaf_count", "other")).contributions(x)


def formats():
    frac = np.array([[0.1, 0.2, 0.3], [0.6, 0.7, 0.9]])
    row = lambda v: " ".join(repr(float(t)) for t in v)
    header = "\n".join(["c", "1.0", *map(row, CELL), "Fe O", "1 1", "Direct", *map(row, frac)])
    xyz = "\n".join(["2", f'Lattice="{row(CELL.ravel())}" pbc="T T T"', *(f"{s} {row(p)}" for s, p in zip(("Fe", "O"), frac @ CELL))])
    return frac, {"POSCAR": header, "x.xyz": xyz, "bare.xyz": "1\n\nH 0 0 0", "broken.cif": "data_x"}


def test_structure_files(spark, tmp_path):
    frac, texts = formats()
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[-1]: r for r in structures.read_structures(structures.structure_files(spark, str(tmp_path))).collect()}
    for name in ("POSCAR", "x.xyz"):
        assert got[name].species == ["Fe", "O"] and np.allclose(got[name].lattice, CELL.ravel()) and np.allclose(got[name].frac, frac.ravel()) and not got[name].error
    assert "lattice" in got["bare.xyz"].error and got["broken.cif"].error


def test_predicted_densities_become_files(spark, tmp_path, capsys):
    _, texts = formats()
    (tmp_path / "in").mkdir()
    for name in ("POSCAR", "x.xyz"):
        (tmp_path / "in" / name).write_text(texts[name])
    made = cli.main(["predict", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--encut", "30", "--precision", "normal"])
    assert made == 0 and len(list((tmp_path / "out").glob("*.vasp"))) == 2
    read = density.read_densities(density.density_files(spark, str(tmp_path / "out"), "*.vasp")).collect()
    for r in read:
        grid = np.frombuffer(r.grid, "<f8")
        assert not r.error and grid.mean() * abs(np.linalg.det(CELL)) == pytest.approx(14.0, rel=1e-6)  # valence electrons of Fe and O
    (tmp_path / "in" / "bare.xyz").write_text(texts["bare.xyz"])
    assert cli.main(["predict", str(tmp_path / "in"), "--out", str(tmp_path / "again"), "--encut", "30"]) == 1
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "bare.xyz").write_text(texts["bare.xyz"])
    assert cli.main(["predict", str(tmp_path / "none"), "--out", str(tmp_path / "x"), "--encut", "30"]) == 1
    with pytest.raises(SystemExit) as usage:
        cli.main(["predict", str(tmp_path / "in")])
    assert usage.value.code == 2
    assert predict.gaussians(np.zeros((2, 3)), ["Fe"], np.array([0]), np.array([0]), np.array([0.0]), None).tolist() == [1.0, 0.0]


def test_export_and_figures(spark):
    table = spark.createDataFrame([("x", 1.0, 2.0), ("y", 0.0, 0.0)], "name string, a double, b double")
    rows = {(r.kind, r.name): r.relative_difference for r in compare.exported(table, table.limit(1)).collect()}
    assert rows == {("descriptor", "x"): 0.5, ("descriptor", "y"): 0.0, ("property", "x"): 0.5}
    edges = figures.cell_edges(spark.createDataFrame([("s", CELL.ravel().tolist())], "structure_id string, lattice array<double>")).collect()
    sides = sorted(round(math.dist((e.x0, e.y0, e.z0), (e.x1, e.y1, e.z1)), 9) for e in edges)
    assert len(edges) == 12 and sides == sorted(round(float(np.linalg.norm(v)), 9) for v in CELL for _ in range(4))


def test_study_of_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 3))
    rows = [(k, *map(float, v), float(10 ** (0.5 * v[0] - 0.2 * v[1])), int(v[2] > 0)) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "k int, a double, b double, c double, y double, label int").cache()
    part = lambda low, high: frame.where(f"k % 10 BETWEEN {low} AND {high}")
    found = models.study(part(0, 5), part(6, 7), part(8, 9), "k", ["a", "b", "c"], "y", "log10", 0.0, seeds=(0, 1), trees=4, trials=2, rounds=4).cache()
    n = part(8, 9).count()
    assert {(r.model, r.seed): r["count"] for r in found.groupBy("model", "seed").count().collect()} == {(m, s): n for m, s in (("linear", 0), ("forest", 0), ("forest", 1), ("boosted", 0), ("boosted", 1), ("boosted", -1))}
    scored = {(r.model, r.seed): r.r2 for r in metrics.regression_scores(found.join(frame.select("k", "y"), "k"), "y", "prediction", ["model", "seed"]).collect()}
    assert scored["linear", 0] > 0.95 and scored["forest", 0] > 0.2
    settings = models.drawn(random.Random(1))
    assert 0.01 <= settings["stepSize"] <= 0.1 and 3 <= settings["maxDepth"] <= 7 and 5 <= settings["minInstancesPerNode"] <= 100
    chosen = models.tuned(part(0, 5), part(6, 7), ["a", "b", "c"], "label", None, True)
    assert models.loss(chosen, part(8, 9), "label", None, True) < 0.5


def test_small_operators(spark):
    from rhoscape.kernels import spectral
    from rhoscape.kernels.features import featurize_grid
    from rhoscape.operators import grid

    field = np.random.default_rng(4).random((4, 6, 8))
    assert spectral.resample(field, (4, 6, 8)) is field and spectral.resample(field, (8, 6, 8)).shape == (8, 6, 8)
    assert np.array_equal(spectral.resample(field, (2, 3, 4), "linear"), field[::2, ::2, ::2])
    values = spark.createDataFrame([("a", 0.2), ("b", 0.5), ("c", 0.1)], "name string, value double")
    kept = {r.cluster: (r.kept, r.members) for r in metrics.representatives({"a": 0, "b": 0, "c": 1, "d": 2}, values).collect()}
    assert kept == {0: ("b", 2), 1: ("c", 1), 2: ("d", 1)}
    angle = 0.7
    turn = [[math.cos(angle), -math.sin(angle), 0.0], [math.sin(angle), math.cos(angle), 0.0], [0.0, 0.0, 1.0]]
    turned = grid.rotated(spark.createDataFrame([(CELL.ravel().tolist(),)], "lattice array<double>"), turn).first().lattice
    assert np.allclose(np.array(turned).reshape(3, 3), CELL @ np.array(turn).T)
    frac = np.array([[0, 0, 0], [0.5, 0.4, 0.6]])
    before, after = (featurize_grid(field, cell, ["Fe", "O"], frac)[0] for cell in (CELL, np.array(turned).reshape(3, 3)))
    assert all(after[k] == pytest.approx(v, rel=1e-6, abs=1e-9, nan_ok=True) for k, v in before.items())
