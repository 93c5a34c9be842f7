"""One density on its grid, with every derived field made once and only when asked for."""

from __future__ import annotations

import time
import traceback
from functools import cached_property

import numpy as np

from rhoscape.constants import BOND_TOL, BOHR, DENSITY_TO_AU, GEOMETRY_EPS, GRADIENT_TO_AU, NCI_RHO_MAX_AU, NCI_S_MAX, RHO_FLOOR_AU, S_PREFACTOR, UNIFORM_TOL
from rhoscape.elements import covalent_radius
from rhoscape.kernels import topology
from rhoscape.kernels.lattice import Cell, Nearest, Spheres, becke, bonds
from rhoscape.kernels.spectral import Derivatives, hartree, interpolate
from rhoscape.options import Options
from rhoscape.plans.registry import METADATA, Fallback, selected

VERSION = "0.1.0"


class Density:
    """A periodic density (e/A^3, shape (n1, n2, n3)) with its lattice, species and fractional coordinates."""

    def __init__(self, values, lattice, species, frac, options: Options | None = None) -> None:
        self.options = options or Options()
        self.grid = np.ascontiguousarray(values, np.float32 if self.options.float32 else float)
        if self.grid.ndim != 3:
            raise ValueError(f"a grid has three axes, got {self.grid.ndim}")
        self.cell, self.species, self.frac = Cell(lattice), [str(s) for s in species], np.asarray(frac, float).reshape(-1, 3)
        if len(self.species) != len(self.frac):
            raise ValueError(f"{len(self.species)} species for {len(self.frac)} positions")
        self.rho, self.shape, self.volume = self.grid.ravel(), self.grid.shape, self.cell.volume
        self.total = float(self.rho.sum(dtype=float))

    @property
    def site_counts(self) -> dict[str, int]:
        return {e: self.species.count(e) for e in dict.fromkeys(self.species)}

    @cached_property
    def uniform(self) -> bool:
        top = float(np.abs(self.rho).max())
        return top == 0.0 or float(np.ptp(self.rho)) <= UNIFORM_TOL * top

    @cached_property
    def nearest(self) -> Nearest:
        return Nearest(self.cell, self.shape, self.frac)

    @cached_property
    def spheres(self) -> Spheres:
        return Spheres(self.cell, self.shape, self.species, self.frac)

    @cached_property
    def regions(self):
        return self.spheres.regions(*self.options.shells)

    @cached_property
    def derivatives(self) -> Derivatives:
        return Derivatives(self.grid, self.cell, self.options.derivative_backend, self.options.fd_order)

    @cached_property
    def gradient(self) -> np.ndarray:
        return self.derivatives.gradient()

    @cached_property
    def gradient_norm(self) -> np.ndarray:
        return np.sqrt(np.einsum("ij,ij->i", self.gradient, self.gradient))

    @cached_property
    def laplacian(self) -> np.ndarray:
        return self.derivatives.laplacian(self.options.laplacian_method)

    @cached_property
    def atomic(self) -> tuple[np.ndarray, np.ndarray]:
        """Density in e/bohr^3 clipped at 0 and reduced gradient, infinite in empty voxels."""
        rho = np.maximum(self.rho, 0.0) * DENSITY_TO_AU
        full = rho > RHO_FLOOR_AU
        s = np.full(len(rho), np.inf)
        s[full] = self.gradient_norm[full] * GRADIENT_TO_AU / (S_PREFACTOR * rho[full] ** (4.0 / 3.0))
        return rho, s

    @cached_property
    def weak(self) -> np.ndarray:
        """Voxels of non-covalent interaction."""
        rho, s = self.atomic
        return (s < NCI_S_MAX) & (rho < NCI_RHO_MAX_AU)

    @cached_property
    def eigenvalues(self) -> np.ndarray:
        """Hessian eigenvalues where a descriptor looks at them; NaN elsewhere."""
        where = self.regions[1].copy()
        if not self.uniform:
            where |= self.weak
        out = np.full((len(self.rho), 3), np.nan)
        out[where] = self.derivatives.eigenvalues(where)
        return out

    @cached_property
    def potential(self) -> np.ndarray:
        return hartree(self.grid, self.cell)

    @cached_property
    def site_potentials(self) -> np.ndarray:
        return interpolate(self.potential, self.frac)

    @cached_property
    def midpoints(self) -> np.ndarray:
        """Density at the midpoints of nearest-neighbour bonds."""
        at = [0.5 * (self.frac[i] + self.frac[j] + np.array(t)) for i, j, t, _ in bonds(self.cell, self.frac, BOND_TOL)]
        return interpolate(self.grid, at) if at else np.zeros(0)

    @cached_property
    def census(self) -> dict:
        return topology.census(self.grid)

    @cached_property
    def levels(self) -> np.ndarray:
        return topology.percolation(self.grid)

    @cached_property
    def basins(self) -> np.ndarray:
        return topology.basins(self.grid, self.cell)

    @cached_property
    def ghosts(self) -> np.ndarray:
        """Flat indices of maxima outside every core sphere."""
        peaks = np.flatnonzero(self.census["maxima"])
        return peaks[~self.regions[0][peaks]]

    @cached_property
    def tensor(self) -> np.ndarray | None:
        """Normalised gradient tensor, or None without a gradient."""
        if self.uniform:
            return None
        t = self.gradient.T.astype(float) @ self.gradient.astype(float)
        return t / np.trace(t) if np.trace(t) > 0 else None

    @cached_property
    def information(self) -> tuple[float, float] | None:
        """Entropy and disequilibrium of the normalised clipped density, both by cell volume."""
        dv = self.volume / BOHR**3 / len(self.rho)
        rho = np.maximum(self.rho.astype(float), 0.0) * DENSITY_TO_AU
        charge = float(rho.sum()) * dv
        if charge <= 0:
            return None
        p = rho / charge
        full = p[p > 0]
        return -float((full * np.log(full)).sum()) * dv - float(np.log(self.volume / BOHR**3)), float((p * p).sum()) * dv * self.volume / BOHR**3

    def _pairs(self, partition: str):
        if partition == "becke":
            yield from becke(self.cell, self.shape, self.frac)
        elif partition == "nearest":
            yield np.arange(len(self.rho)), self.nearest.atom, None, self.nearest.distance, self.nearest.direction
        else:
            yield np.arange(len(self.rho)), self.spheres.atom, None, self.spheres.distance, None

    def site_sums(self, partition: str) -> dict[str, np.ndarray]:
        """Weighted sums over every site's share of the voxels, in one pass."""
        n = len(self.species)
        out = {k: np.zeros(n) for k in ("total", "r1", "r2", "core", "bond", "radial", "norm")}
        radii = np.array([covalent_radius(e) for e in self.species])
        a, b = (f * radii + GEOMETRY_EPS for f in self.options.shells)
        for voxel, atom, weight, r, direction in self._pairs(partition):
            held = self.rho[voxel].astype(float) if weight is None else weight * self.rho[voxel]
            add = lambda key, w: np.add(out[key], np.bincount(atom, w, n), out=out[key])
            add("total", held), add("r1", held * r), add("r2", held * r * r)
            core = r <= a[atom]
            add("core", np.where(core, held, 0.0)), add("bond", np.where(~core & (r <= b[atom]), held, 0.0))
            if direction is not None:
                share = 1.0 if weight is None else weight
                add("radial", share * np.abs(np.einsum("ij,ij->i", self.gradient[voxel], direction))), add("norm", share * self.gradient_norm[voxel])
        return out

    @cached_property
    def shared_sums(self) -> dict[str, np.ndarray]:
        return self.site_sums(self.options.partition)

    @cached_property
    def sphere_sums(self) -> dict[str, np.ndarray]:
        return self.site_sums("spheres")


def ratio(a, b) -> np.ndarray:
    b = np.asarray(b, float)
    return np.where(b != 0, a / np.where(b != 0, b, 1.0), np.nan)


def variance_parts(x: np.ndarray, groups) -> tuple[float, float]:
    """Population variance within and between groups; the two add up to the whole."""
    groups = np.asarray(groups)
    within = between = 0.0
    for g in dict.fromkeys(groups.tolist()):
        own = x[groups == g]
        within += len(own) / len(x) * float(own.var())
        between += len(own) / len(x) * (float(own.mean()) - float(x.mean())) ** 2
    return within, between


def featurize_grid(values, lattice, species, frac, options: Options | None = None) -> tuple[dict, dict]:
    """Features by name, and metadata: sizes, settings, a flag for each descriptor with degenerate cases."""
    began = time.perf_counter()
    density = Density(values, lattice, species, frac, options)
    found, cases = {}, {}
    chosen = selected(density.options.domains)
    for spec in chosen:
        value = spec.function(density)
        if isinstance(value, Fallback):
            cases[spec.name] = value.case
            value = value.value
        found[spec.name] = float(value)
    meta = {
        "n_atoms": len(density.species),
        "volume": density.volume,
        "grid_shape": "x".join(map(str, density.shape)),
        "site_counts": ",".join(f"{e}:{n}" for e, n in density.site_counts.items()),
        **density.options.recorded(),
    }
    for hook in METADATA:
        meta |= hook(density)
    meta |= {f"{d.name}__flag": int(d.name in cases) for d in chosen if d.cases}
    meta |= {"sentinels": ";".join(f"{k}:{v}" for k, v in cases.items()), "wall_time_s": time.perf_counter() - began, "version": VERSION, "error": ""}
    return found, meta


def featurize_or_error(make, options: Options | None = None) -> dict:
    """Features and metadata of what make() returns; what it or they raise becomes the row's error."""
    began = time.perf_counter()
    try:
        found, meta = featurize_grid(*make(), options)
        return found | meta
    except Exception as problem:  # recorded in the row
        return {"error": f"{type(problem).__name__}: {problem}", "traceback": traceback.format_exc(limit=3), "wall_time_s": time.perf_counter() - began, "version": VERSION}
