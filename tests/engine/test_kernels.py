"""Numerical kernels against closed forms, brute force and invariances."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from rhoscape.constants import COULOMB
from rhoscape.kernels import topology
from rhoscape.kernels.features import Density, featurize_grid, variance_parts
from rhoscape.kernels.lattice import Cell, Nearest, Spheres, becke, bonds, fractions, images, neighbours
from rhoscape.kernels.spectral import Derivatives, fourier_resample, hartree, interpolate, linear_resample
from rhoscape.options import Options
from rhoscape.plans.registry import descriptor_names, register

LATTICE = np.array([(3.9, 0, 0), (0.8, 4.1, 0), (0.6, 0.5, 4.3)])
FRAC = np.array([(0.05, 0.10, 0.12), (0.52, 0.43, 0.58), (0.27, 0.71, 0.36)])
SPECIES = ["Fe", "Fe", "O"]
SHEARED = Cell([(5, 0, 0), (4.1, 1.9, 0), (3.3, 1.2, 1.7)])
EXTREME = Cell([(6, 0, 0), (5.7, 0.8, 0), (5.5, 0.6, 0.7)])
SPOTS = np.array([(0.03, 0.11, 0.07), (0.52, 0.47, 0.61), (0.81, 0.23, 0.39)])


def gaussians(lattice, frac, widths, electrons, shape, reach=3):
    cell = Cell(lattice)
    points = fractions(shape) @ cell.rows
    out = np.zeros(len(points))
    for shift in itertools.product(range(-reach, reach + 1), repeat=3):
        for f, a, n in zip(frac, widths, electrons):
            out += n * (a / np.pi) ** 1.5 * np.exp(-a * ((points - (np.array(f) + shift) @ cell.rows) ** 2).sum(1))
    return out.reshape(shape)


@pytest.fixture(scope="module")
def crystal():
    return gaussians(LATTICE, FRAC, (1.6, 1.9, 2.4), (8, 8, 6), (20, 21, 22))


@pytest.fixture(scope="module")
def features(crystal):
    return featurize_grid(crystal, LATTICE, SPECIES, FRAC)[0]


def close(a, b, but=()):
    return [k for k in a if k not in but and abs(a[k] - b[k]) > 1e-6 * max(1e-3, abs(a[k]))]


def test_names(features):
    assert len(features) == 54 and list(features) == descriptor_names() and all(np.isfinite(v) for v in features.values())


def test_translation(crystal, features):
    moved, _ = featurize_grid(np.roll(crystal, (3, 7, 11), (0, 1, 2)), LATTICE, SPECIES, FRAC + np.array([3 / 20, 7 / 21, 11 / 22]))
    assert close(features, moved) == []


def test_rotation(crystal, features):
    c, s = np.cos(0.65), np.sin(0.65)
    turned, _ = featurize_grid(crystal, LATTICE @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T, SPECIES, FRAC)
    assert close(features, turned) == []


def test_supercell(crystal, features):
    frac = [(f + np.array(s)) / 2 for f in FRAC for s in itertools.product((0, 1), repeat=3)]
    wide, _ = featurize_grid(np.tile(crystal, (2, 2, 2)), LATTICE * 2, [s for s in SPECIES for _ in range(8)], frac)
    assert close(features, wide) == []


def test_float32(crystal, features):
    small, meta = featurize_grid(crystal, LATTICE, SPECIES, FRAC, Options(float32=True))
    assert meta["precision"] == "float32" and np.median([abs(small[k] - v) / max(abs(v), 1e-9) for k, v in features.items()]) < 1e-5


def test_slater_atom():
    zeta, box, n = 3.0, 4.0, 64
    points = fractions((n,) * 3) * box
    rho = sum(zeta**3 / np.pi * np.exp(-2 * zeta * np.linalg.norm(points - (np.array(s) + 0.5) * box, axis=1)) for s in itertools.product((-1, 0, 1), repeat=3)).reshape((n,) * 3)
    found, _ = featurize_grid(rho, np.eye(3) * box, ["H"], [(0.5, 0.5, 0.5)], Options(derivative_backend="fd"))
    assert found["m1"] == pytest.approx(1.5 / zeta, rel=3e-3) and found["m2"] == pytest.approx(3 / zeta**2, rel=3e-3)
    assert found["zeta"] < 0.02 and found["lnf"] == pytest.approx(4 / 3 * np.pi / zeta**3 / box**3, rel=0.08)


def test_uniform_density_has_fallbacks():
    found, meta = featurize_grid(np.full((6, 6, 6), 0.1), np.eye(3) * 4, ["H"], [(0.5, 0.5, 0.5)])
    assert all(np.isfinite(v) for v in found.values()) and meta["zeta__flag"] == 1 and "lnf:uniform_density" in meta["sentinels"]
    assert found["T_eigenvalues_t1"] == pytest.approx(1 / 3) and found["disequilibrium"] == pytest.approx(1) and found["shannon_entropy"] == pytest.approx(0, abs=1e-12)
    zero, flags = featurize_grid(np.zeros((4, 4, 4)), np.eye(3), ["H"], [(0, 0, 0)])
    assert all(np.isfinite(v) for k, v in zero.items() if "_site_" not in k and "element_var" not in k) and flags["m1__flag"] == 1


def test_options():
    for bad in ({"partition": "voronoi"}, {"shells": (1.2, 1.0)}, {"laplacian_method": "x"}, {"derivative_backend": "x"}, {"derivative_backend": "fd", "fd_order": 5}, {"domains": ("x",)}):
        with pytest.raises(ValueError):
            Options(**bad)
    with pytest.raises(ValueError):
        register("extensive", "bonding", intensive=False)
    with pytest.raises(ValueError):
        Cell(np.zeros((3, 3)))
    only, _ = featurize_grid(np.random.default_rng(0).random((4, 5, 6)), np.eye(3) * 3, ["O"], [(0, 0, 0)], Options(domains="bonding"))
    assert len(only) == 18


@pytest.mark.parametrize("cell", [SHEARED, EXTREME, Cell(LATTICE)])
def test_nearest_images(cell):
    shape = (5, 6, 7)
    found = Nearest(cell, shape, SPOTS)
    places, owners, _ = images(cell, SPOTS, (9, 9, 9))
    points = fractions(shape) @ cell.rows
    d = np.sqrt(((points[:, None] - places[None]) ** 2).sum(2))
    assert np.allclose(found.distance, d.min(1), atol=1e-9)
    assert (d[np.arange(len(d)), :].min(1) <= found.distance + 1e-9).all()
    own = np.where(owners[None] == found.atom[:, None], d, np.inf).min(1)
    assert np.allclose(own, found.distance, atol=1e-7) and np.allclose(np.linalg.norm(found.direction, axis=1)[found.distance > 1e-9], 1)


def test_sphere_regions():
    from rhoscape.elements import covalent_radius

    species = ["Cs", "O", "Ni"]
    found = Spheres(SHEARED, (6, 6, 6), species, SPOTS)
    places, owners, _ = images(SHEARED, SPOTS, (7, 7, 7))
    d = np.sqrt((((fractions((6, 6, 6)) @ SHEARED.rows)[:, None] - places[None]) ** 2).sum(2)) / np.array([covalent_radius(s) for s in species])[owners]
    assert np.allclose(found.distance / found.radius, d.min(1))
    core, bond, rest = found.regions(0.79, 1.14)
    assert ((core.astype(int) + bond + rest) == 1).all()


def test_becke_weights_sum_to_one():
    total = np.zeros(6 * 7 * 8)
    for voxel, _, weight, _, _ in becke(Cell(LATTICE), (6, 7, 8), FRAC):
        np.add.at(total, voxel, weight)
    assert np.allclose(total, 1, atol=1e-12)


def test_bonds_and_neighbours():
    found = bonds(Cell(np.eye(3) * 3), [(0, 0, 0)], 0.1)
    assert len(found) == 3 and all(length == pytest.approx(3) for *_, length in found)
    edges = neighbours(SHEARED, SPOTS, 4.0)
    places, owners, _ = images(SHEARED, SPOTS, (8, 8, 8))
    home = (SPOTS % 1) @ SHEARED.rows
    assert len(edges) == sum(int(((d := np.linalg.norm(places - p, axis=1)) <= 4.0).sum() - (d < 1e-9).sum()) for p in home)
    assert {(i, j) for i, j, _, _ in edges} == {(j, i) for i, j, _, _ in edges}


def test_derivatives(crystal):
    cell = Cell(LATTICE)
    fft = Derivatives(crystal, cell)
    errors = [np.abs(Derivatives(crystal, cell, "fd", o).gradient() - fft.gradient()).max() for o in (2, 4, 6, 8)]
    assert errors == sorted(errors, reverse=True)
    every = fft.eigenvalues(np.ones(crystal.size, bool))
    assert np.allclose(every.sum(1), fft.laplacian(), atol=1e-8) and (np.diff(every) >= 0).all()
    assert not np.allclose(fft.laplacian("diagonal"), fft.laplacian(), rtol=0.05)
    x = fractions((12, 10, 9))
    wave = np.sin(2 * np.pi * (x[:, 0] + 2 * x[:, 1])).reshape(12, 10, 9)
    assert np.allclose(Derivatives(wave, cell).first(1).ravel(), 4 * np.pi * np.cos(2 * np.pi * (x[:, 0] + 2 * x[:, 1])))


def test_hartree_of_a_gaussian():
    n, box, a = 48, 10.0, 3.0
    rho = gaussians(np.eye(3) * box, [(0.5, 0.5, 0.5)], [a], [2], (n,) * 3, 1)
    v = hartree(rho, Cell(np.eye(3) * box))
    r = np.linalg.norm(fractions((n,) * 3) * box - box / 2, axis=1).reshape((n,) * 3)
    from math import erf

    inside = np.vectorize(lambda d: 2 * COULOMB * (erf(np.sqrt(a) * d) / d if d > 1e-9 else 2 * np.sqrt(a / np.pi)))(r[n // 2, n // 2, n // 2 : n // 2 + 8])
    got = v[n // 2, n // 2, n // 2 : n // 2 + 8]
    assert np.allclose(np.diff(got), np.diff(inside), rtol=0.02) and abs(v.mean()) < 1e-9


def test_interpolation_and_resampling(crystal):
    points = fractions(crystal.shape)[[0, 17, 5000]]
    assert np.allclose(interpolate(crystal, points), crystal.ravel()[[0, 17, 5000]])
    up = fourier_resample(crystal, (24, 25, 28))
    assert up.mean() == pytest.approx(crystal.mean()) and np.allclose(fourier_resample(up, crystal.shape), crystal, atol=2e-3 * crystal.max())
    assert linear_resample(crystal, (10, 7, 11)).shape == (10, 7, 11) and linear_resample(crystal, (13, 9, 10)).max() <= crystal.max()


def test_census_of_waves():
    for n in (12, 24):
        x, y, z = np.meshgrid(*[2 * np.pi * np.arange(n) / n] * 3, indexing="ij")
        found = topology.census(np.cos(x) + np.cos(y) + np.cos(z) + 0.1 * np.sin(x + 2 * y + z) + 3.5)
        assert [found[k] for k in ("n_max", "n_min", "n_saddle1", "n_saddle2", "euler")] == [1, 1, 3, 3, 0]


def spans(mask):
    out, seen, n = [False] * 3, {}, mask.shape
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        seen[start], stack = (0, 0, 0), [start]
        while stack:
            v = stack.pop()
            for axis, step in itertools.product(range(3), (1, -1)):
                w, o = list(v), list(seen[v])
                w[axis] += step
                o[axis] += w[axis] // n[axis]
                w[axis] %= n[axis]
                w, o = tuple(w), tuple(o)
                if not mask[w]:
                    continue
                if w not in seen:
                    seen[w] = o
                    stack.append(w)
                else:
                    out = [b or a != c for b, a, c in zip(out, seen[w], o)]
    return out


def test_percolation_against_flood_fill():
    rng = np.random.default_rng(0)
    for k in range(40):
        shape = tuple(rng.integers(1, 6, 3))
        f = rng.integers(0, 12, shape).astype(float) if k % 2 else rng.random(shape)
        want = [max(v for v in np.unique(f) if spans(f >= v)[a]) for a in range(3)]
        assert topology.percolation(f).tolist() == want


def test_ghost_maximum():
    frac, cell = [(0.2, 0.5, 0.5), (0.8, 0.5, 0.5)], np.eye(3) * 6
    rho = gaussians(cell, [*frac, (0.5, 0.5, 0.5)], (2, 2, 3), (1, 1, 0.5), (36, 36, 36), 1)
    density = Density(rho, cell, ["H", "H"], frac)
    assert len(density.ghosts) == 1
    found, _ = featurize_grid(rho, cell, ["H", "H"], frac)
    assert 0.1 < found["Q_NNM"] < 0.3 and found["n_NNM"] == pytest.approx(1 / 216)


def test_site_sums_add_up(crystal):
    density = Density(crystal, LATTICE, SPECIES, FRAC, Options(partition="becke"))
    assert density.shared_sums["total"].sum() == pytest.approx(density.total)
    assert density.sphere_sums["bond"].sum() == pytest.approx(density.rho[density.regions[1]].sum())
    within, between = variance_parts(x := np.array([1.0, 2.0, 5.0, 7.0]), ["a", "a", "b", "c"])
    assert within + between == pytest.approx(x.var())
