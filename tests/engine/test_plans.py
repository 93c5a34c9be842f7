"""Spark plans: sources, batch semantics, streaming, packed against relational, queries against SQL."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhoscape import queries as Q
from rhoscape.cli import main
from rhoscape.oracles import ORACLES
from rhoscape.options import Options
from rhoscape.plans.featurize import columns, featurize_batch, sweep
from rhoscape.plans.registry import catalogue
from rhoscape.sources import density
from rhoscape.streaming.incremental import feature_stream, latest, run_available

SF = "/root/testdata/sf0.001"
LATTICE = [(4, 0, 0), (0.3, 4.2, 0), (0.1, 0.2, 4.5)]
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def sample(shape=(3, 4, 5)):
    return np.random.default_rng(1).random(shape)


def text(grid=None, species=("Fe", "Fe", "O"), **more):
    return density.format_density(LATTICE, list(species), [(0, 0, 0), (0.5, 0.5, 0.5), (0.25, 0.25, 0.1)], [sample() if grid is None else grid], **more)


def test_round_trip():
    lattice, species, frac, (grid,) = density.parse_density(text())
    assert species == ["Fe", "Fe", "O"] and np.allclose(lattice, LATTICE) and np.allclose(grid, sample(), atol=1e-9) and np.allclose(frac[2], (0.25, 0.25, 0.1))


def test_first_index_runs_fastest():
    i, j, k = np.meshgrid(range(3), range(4), range(5), indexing="ij")
    lines = text(i + 10.0 * j + 100.0 * k, by_volume=False).splitlines()
    assert [float(v) for v in lines[-12].split()] == [0, 1, 2, 10, 11]


def test_headers():
    body = text().splitlines()
    frac = [line.split() for line in body[8:11]]
    cartesian = [" ".join(map(str, np.array(list(map(float, f))) @ np.array(LATTICE))) + " T T F" for f in frac]
    old = ["x", str(-abs(np.linalg.det(LATTICE)) * 8), *body[2:5], "2 1", "Selective dynamics", "Cartesian", *cartesian, *body[11:]]
    lattice, species, places, _ = density.parse_density("\n".join(old), ["Fe_pv", "O/abc"])
    assert species == ["Fe", "Fe", "O"] and np.allclose(lattice, np.array(LATTICE) * 2) and np.allclose(places[1], 0.5)
    with pytest.raises(ValueError):
        density.parse_density("\n".join(old))
    with pytest.raises(ValueError, match="before its"):
        density.parse_density("\n".join(body[:-2]))
    blocks = "\n".join([*body, "augmentation occupancies 1 8", "0.1 0.2", *body[11:]])
    assert len(density.parse_density(blocks, blocks=None)[3]) == 2


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress, bz2.compress, lzma.compress])
def test_codecs(pack):
    assert density.decompress(pack(b"text of a file")) == b"text of a file"


def test_archives():
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("run/CHGCAR", b"one")
        z.writestr("run/INCAR", b"other")
    assert density.decompress(made.getvalue()) == b"one"


@pytest.fixture(scope="module")
def runs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    for name, content in (("a/CHGCAR", text().encode()), ("b/CHGCAR.gz", gzip.compress(text(sample((4, 4, 4))).encode())), ("c/CHGCAR", b"not a density"), ("d/CHGCAR.bz2", bz2.compress(text().encode())), ("d/CHGCAR", text().encode())):
        path = folder / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    return str(folder)


def test_batch(spark, runs):
    rows = featurize_batch(spark, runs).collect()
    assert [r.path.split("/")[-2] for r in rows] == ["a", "b", "c", "d", "d"]
    bad = [r for r in rows if r.error]
    assert len(bad) == 1 and np.isnan(bad[0].m1) and "c/" in bad[0].path
    assert rows[0].site_counts == "Fe:2,O:1" and rows[0].grid_shape == "3x4x5"
    assert len(columns(Options())) == 116
    assert featurize_batch(spark, runs, on_error="skip").count() == 4
    assert featurize_batch(spark, runs, one_per_directory=True).count() == 4
    with pytest.raises(Exception, match="ValueError|IndexError|error"):
        featurize_batch(spark, runs, on_error="raise").collect()


def test_sweep(spark, runs):
    packed = density.read_densities(density.density_files(spark, runs + "/a"))
    rows = sweep(packed, [(0.5, 1.0), (0.79, 1.14), (1.5, 1.0)]).collect()
    assert len(rows) == 2 and all(r.f_core + r.f_bond + r.f_int == pytest.approx(1) for r in rows)


def test_writer(spark, runs, tmp_path):
    packed = density.read_densities(density.density_files(spark, runs + "/a"))
    written = density.write_densities(packed, str(tmp_path / "texts")).collect()
    assert len(list((tmp_path / "texts").glob("*.vasp"))) == len(written) == packed.where("grid IS NOT NULL").count()
    text = open(written[0].file).read()
    assert len(text) == written[0].bytes and np.allclose(density.parse_density(text)[3][0], sample(), atol=1e-8)


def test_stream(spark, runs, tmp_path):
    table, marks = str(tmp_path / "features"), str(tmp_path / "marks")
    run_available(feature_stream(spark, runs), table, marks)
    run_available(feature_stream(spark, runs), table, marks)  # nothing is new
    assert latest(spark, table).count() == 5


def test_command_line(spark, runs, tmp_path, capsys):
    out = str(tmp_path / "one.json")
    assert main(["featurize", runs + "/a/CHGCAR", "--backend", "fd", "--out", out]) == 0
    assert json.load(open(out))["n_atoms"] == 3
    assert main(["featurize", runs + "/c/CHGCAR", "--out", out]) == 1
    assert main(["batch", runs, "--pattern", "nothing*"]) == 1
    assert main(["catalogue", "--out", str(tmp_path / "catalogue")]) == 0
    with pytest.raises(SystemExit):
        main(["batch"])


def test_catalogue(spark):
    rows = catalogue(spark).collect()
    assert len(rows) == 54 and rows[0].name == "zeta" and sum(bool(r.sentinel_cases) for r in rows) == 45


@needs_tables
def test_packed_equals_relational(spark):
    packed = {r.path: r for r in Q.featurize_packed(spark, SF).collect()}
    for r in Q.featurize_relational(spark, SF).collect():
        for name, value in r.asDict().items():
            if name != "structure_id" and name in packed[r.structure_id].asDict():
                scale = 1e4 if name == "rho_min" else 1.0
                assert packed[r.structure_id][name] * scale == pytest.approx(value, abs=2e-5), name


def _key(rows):
    def cell(v):
        return "-" if v is None else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@needs_tables
@pytest.mark.parametrize("name", ["voxelize", "slab_profiles", "fd_hessian", "curvature", "hartree_potential", "nearest_atom", "sphere_regions", "becke_weights", "site_statistics", "sensitivity_sweep", "non_nuclear_maxima", "region_profile", "metrics_classification", "spearman_matrix", "held_out_systems", "tolerant_match", "grid_sizes", "compare_rows"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    made = Q.queries()[name](spark, SF)
    names = sorted(made.columns)
    want = con.execute(f'SELECT {", ".join(chr(34) + n + chr(34) for n in names)} FROM ({ORACLES[name]})').fetchall()
    assert _key(made.select(*names).collect()) == _key(want)


@needs_tables
def test_census_against_kernel(spark):
    from rhoscape.kernels import topology

    rows = {r.structure_id: r for r in Q.extremum_census(spark, SF).collect()}
    levels = {r.structure_id: r for r in Q.percolation(spark, SF).collect()}
    frame = Q.voxels(spark, SF).orderBy("structure_id", "vox").toPandas()
    for name, part in frame.groupby("structure_id"):
        grid = part.rho.to_numpy(float).reshape(8, 8, 8)
        found = topology.census(grid)
        assert [rows[name][k] for k in ("n_max", "n_min", "n_saddle1", "n_saddle2", "euler")] == [found[k] for k in ("n_max", "n_min", "n_saddle1", "n_saddle2", "euler")]
        assert [levels[name][f"rho_perc_{a}"] for a in "abc"] == topology.percolation(grid).tolist()


@needs_tables
def test_plans_push_down(spark):
    """Scans read only the columns that a query uses, and filters reach the files."""
    plan = Q.voxels(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_returnflag:string>" in plan
    narrow = spark.read.parquet(f"{SF}/lineitem.parquet").where(F.col("l_quantity") > 49).select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in narrow
