"""Density prediction, convergence tables and the comparison of feature tables."""

from __future__ import annotations

import numpy as np
import pytest

from rhoscape.kernels.lattice import Cell, fractions, images
from rhoscape.plans.convergence import analytic_convergence, differing, recommended_spacing
from rhoscape.plans.predict import STRUCTURES, predict_density
from rhoscape.sources.runs import dimension_table


def gaussian(points, species, probe, atom, distance, direction):
    return np.bincount(probe, np.exp(-(distance**2)) * (1 + atom), len(points))


def structures(spark, species=("Fe", "O")):
    return spark.createDataFrame([("a", [4.0, 0.0, 0.0, 0.5, 4.1, 0.0, 0.3, 0.4, 4.3], list(species), [0.0, 0.0, 0.0, 0.5, 0.45, 0.5], [6, 7, 8])], STRUCTURES)


@pytest.mark.parametrize("pairs", [64, 16_384])
def test_predicted_density(spark, pairs):
    rows = predict_density(structures(spark), gaussian, 4.0, pairs).orderBy("vox").toPandas()
    cell = Cell([4.0, 0, 0, 0.5, 4.1, 0, 0.3, 0.4, 4.3])
    points = fractions((6, 7, 8)) @ cell.rows
    places, owners, _ = images(cell, [(0, 0, 0), (0.5, 0.45, 0.5)], cell.repeats(4.0))
    d = np.sqrt(((points[:, None] - places[None]) ** 2).sum(2))
    raw = (np.exp(-(d**2)) * (1 + owners) * (d <= 4.0)).sum(1)
    assert len(rows) == 336 and np.allclose(rows.rho / rows.rho.mean(), raw / raw.mean())
    assert rows.rho.mean() * cell.volume == pytest.approx(8 + 6)


def test_prediction_errors(spark):
    with pytest.raises(Exception, match="no valence"):
        predict_density(structures(spark, ("Fe", "Og")), gaussian).collect()
    with pytest.raises(Exception, match="no charge"):
        predict_density(structures(spark), lambda points, *_: np.zeros(len(points))).collect()


def test_convergence(spark):
    table = analytic_convergence(spark, (0.25, 0.12)).cache()
    rows = {round(r.spacing, 3): r for r in table.collect()}
    assert rows[0.121].m1_rel_error < 0.01 and len(rows) == 2
    assert recommended_spacing(table, 0.5).first().spacing == pytest.approx(0.25) and np.isnan(recommended_spacing(table, 1e-9).first().spacing)


def test_differing(spark):
    left = spark.createDataFrame([("a", 1.0, float("nan")), ("b", 2.0, 3.0)], "k string, x double, y double")
    right = spark.createDataFrame([("a", 1.0 + 1e-8, float("nan")), ("b", 2.1, None)], "k string, x double, y double")
    assert {(r.k, r["name"]) for r in differing(left, right, "k", ["x", "y"]).collect()} == {("b", "x"), ("b", "y")}


def test_dimension_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# note\nname,value\na,1\n# more\nb,2\n")
    assert [tuple(r) for r in dimension_table(spark, str(tmp_path / "t.csv"), "name string, value int").collect()] == [("a", 1), ("b", 2)]
