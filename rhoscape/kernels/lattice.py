"""Lattice algebra, nearest images, neighbour shells and fuzzy cells on NumPy arrays."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np

from rhoscape.constants import BECKE_CELLS, BECKE_K, GEOMETRY_EPS, MIN_PAIR_WEIGHT
from rhoscape.elements import covalent_radius


class Cell:
    """Lattice rows a1, a2, a3 in Angstrom and what follows from them."""

    def __init__(self, rows) -> None:
        self.rows = np.asarray(rows, float).reshape(3, 3)
        self.volume = abs(float(np.linalg.det(self.rows)))
        if self.volume < 1e-12:
            raise ValueError("the lattice is singular")
        self.inverse = np.linalg.inv(self.rows)
        self.reciprocal = self.inverse.T
        self.metric = self.reciprocal @ self.reciprocal.T
        self.lengths = np.linalg.norm(self.rows, axis=1)
        self.heights = 1.0 / np.linalg.norm(self.reciprocal, axis=1)
        #: Some image of any atom lies this close to any point: each fractional difference rounds into [-1/2, 1/2].
        self.reach = 0.5 * float(self.lengths.sum())

    @property
    def angles(self) -> np.ndarray:
        unit = self.rows / self.lengths[:, None]
        return np.degrees(np.arccos(np.clip([unit[1] @ unit[2], unit[0] @ unit[2], unit[0] @ unit[1]], -1, 1)))

    def repeats(self, distance: float) -> np.ndarray:
        """Image shifts a axis that contain every image within a distance of the cell."""
        return np.ceil(distance / self.heights).astype(int) + 1


def fractions(shape) -> np.ndarray:
    """(N, 3) fractional voxel positions in C order."""
    return np.stack(np.unravel_index(np.arange(int(np.prod(shape))), shape), 1) / np.asarray(shape, float)


def images(cell: Cell, frac: np.ndarray, repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, owners and shifts of the images of wrapped atoms."""
    wrapped = np.asarray(frac, float) % 1.0
    shifts = np.array(list(itertools.product(*(range(-int(r), int(r) + 1) for r in repeats))))
    places = (wrapped[None] + shifts[:, None]).reshape(-1, 3) @ cell.rows
    return places, np.tile(np.arange(len(wrapped)), len(shifts)), np.repeat(shifts, len(wrapped), axis=0)


def _blocks(shape, edge: int = 8) -> Iterator[np.ndarray]:
    """Flat indices of the voxels of each block of a grid."""
    n1, n2, n3 = shape
    for i, j, k in itertools.product(range(0, n1, edge), range(0, n2, edge), range(0, n3, edge)):
        a, b, c = (np.arange(s, min(s + edge, n)) for s, n in ((i, n1), (j, n2), (k, n3)))
        yield ((a[:, None, None] * n2 + b[None, :, None]) * n3 + c[None, None, :]).ravel()


def _near(block: np.ndarray, places: np.ndarray, count: int) -> np.ndarray:
    """Indices of all images that can be among the count nearest of any point of a block."""
    centre = block.mean(0)
    radius = np.sqrt(((block - centre) ** 2).sum(1).max())
    d = np.sqrt(((places - centre) ** 2).sum(1))
    count = min(count, len(d))
    return np.flatnonzero(d <= np.partition(d, count - 1)[count - 1] + 2 * radius + 1e-6)


def _pick(d: np.ndarray, shown: np.ndarray) -> np.ndarray:
    """Column of the nearest image; ties go to the lexicographically largest fractional displacement."""
    tied = d <= d.min(1, keepdims=True) + GEOMETRY_EPS
    if (tied.sum(1) > 1).any():
        for c in range(3):
            v = np.where(tied, shown[..., c], -np.inf)
            tied &= v >= v.max(1, keepdims=True) - 1e-9
    return tied.argmax(1)


class Nearest:
    """Nearest-image pass: distance, unit direction and owner of every voxel."""

    def __init__(self, cell: Cell, shape, frac) -> None:
        places, owners, _ = images(cell, frac, cell.repeats(cell.reach))
        points = fractions(shape) @ cell.rows
        n = len(points)
        self.distance, self.atom, self.direction = np.empty(n), np.empty(n, np.int64), np.zeros((n, 3))
        for block in _blocks(shape, 14):
            x = points[block]
            near = _near(x, places, 1)
            # Distances by a product of matrices around the block's centre are good to choose by; the chosen are exact.
            centre = x.mean(0)
            own, held = x - centre, places[near] - centre
            d = np.sqrt(np.maximum((own**2).sum(1)[:, None] + (held**2).sum(1) - 2.0 * own @ held.T, 0.0))
            best = d.argmin(1)
            tied = np.flatnonzero((d <= d.min(1, keepdims=True) + GEOMETRY_EPS).sum(1) > 1)
            if len(tied):
                best[tied] = _pick(d[tied], (own[tied][:, None] - held[None]) @ cell.inverse)
            step = x - places[near[best]]
            exact = np.sqrt((step**2).sum(1))
            self.distance[block], self.atom[block] = exact, owners[near[best]]
            long = exact > 1e-12
            self.direction[block[long]] = step[long] / exact[long, None]


class Spheres:
    """Assignment to the atom with the least distance in units of its covalent radius."""

    def __init__(self, cell: Cell, shape, species: list[str], frac) -> None:
        n = int(np.prod(shape))
        best, self.atom, self.distance = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n)
        for element in sorted(set(species)):
            own = np.array([k for k, e in enumerate(species) if e == element])
            found = Nearest(cell, shape, np.asarray(frac, float)[own])
            ratio = found.distance / covalent_radius(element)
            better = ratio < best - GEOMETRY_EPS / 10
            best[better], self.atom[better], self.distance[better] = ratio[better], own[found.atom[better]], found.distance[better]
        self.radius = np.array([covalent_radius(e) for e in species])[self.atom]

    def regions(self, a: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Core, bond and interstitial masks for sphere factors a < b."""
        core = self.distance <= a * self.radius + GEOMETRY_EPS
        outer = self.distance <= b * self.radius + GEOMETRY_EPS
        return core, ~core & outer, ~outer


def becke(cell: Cell, shape, frac, k: int = BECKE_K, cells: int = BECKE_CELLS) -> Iterator[tuple[np.ndarray, ...]]:
    """Chunks of (voxel, atom, weight, distance, direction) of the fuzzy-cell partition."""
    if cells < 1 or k < cells:
        raise ValueError(f"weights for {cells} of {k} images asked for")
    points = fractions(shape) @ cell.rows
    reach = 0.0
    while True:  # grow the images until the k nearest of every voxel are surely among them
        reach = max(2.0 * reach, cell.reach)
        places, owners, _ = images(cell, frac, cell.repeats(reach))
        centre = cell.rows.sum(0) / 2
        d = np.sort(np.sqrt(((places - centre) ** 2).sum(1)))
        if len(d) >= k and d[k - 1] + cell.reach <= reach:
            break
    for block in _blocks(shape):
        x = points[block]
        near = _near(x, places, k)
        d = np.sqrt(((x[:, None] - places[near][None]) ** 2).sum(2))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        d, chosen = np.take_along_axis(d, order, 1), near[order]
        at = places[chosen]
        n = min(cells, d.shape[1])
        apart = np.sqrt(((at[:, :n, None] - at[:, None]) ** 2).sum(3))
        same = np.eye(n, d.shape[1], dtype=bool)[None]
        mu = (d[:, :n, None] - d[:, None]) / np.where(same, 1.0, apart)
        for _ in range(3):
            mu = mu * (1.5 - 0.5 * mu * mu)
        product = np.where(same, 1.0, 0.5 * (1.0 - mu)).prod(2)
        weight = product / product.sum(1, keepdims=True)
        weight[weight <= MIN_PAIR_WEIGHT] = 0.0
        weight /= weight.sum(1, keepdims=True)
        row, column = np.nonzero(weight)
        dist = d[row, column]
        step = (x[row] - at[row, column]) / np.where(dist > 1e-12, dist, 1.0)[:, None]
        step[dist <= 1e-12] = 0.0
        yield block[row], owners[chosen[row, column]], weight[row, column], dist, step


def bonds(cell: Cell, frac, tol: float) -> list[tuple[int, int, tuple[int, int, int], float]]:
    """First-shell pairs (i, j, shift of j for the given coordinates, length), each once.

    j is a neighbour of i within (1 + tol) times the distance to i's closest neighbour.
    """
    frac = np.asarray(frac, float)
    wrap = np.floor(frac).astype(int)
    centres = (frac - wrap) @ cell.rows
    places, owners, shifts = images(cell, frac, cell.repeats(float(cell.lengths.min())))
    closest = np.array([np.partition(np.sqrt(((places - c) ** 2).sum(1)), 1)[1] for c in centres])
    places, owners, shifts = images(cell, frac, cell.repeats((1.0 + tol) * float(closest.max())))
    found: dict[tuple, float] = {}
    for i, centre in enumerate(centres):
        d = np.sqrt(((places - centre) ** 2).sum(1))
        for m in np.flatnonzero((d <= (1.0 + tol) * closest[i] + 1e-9) & (d >= 1e-9)):
            j, t = int(owners[m]), tuple(int(v) for v in shifts[m])
            found[min((i, j, t), (j, i, tuple(-v for v in t)))] = float(d[m])
    return [(i, j, tuple(int(v) for v in np.array(t) - wrap[j] + wrap[i]), found[i, j, t]) for i, j, t in sorted(found)]


def neighbours(cell: Cell, frac, cutoff: float, probes=None) -> list[tuple[int, int, tuple[int, int, int], float]]:
    """Edges (target, source atom, shift, distance) within a cutoff; targets are the atoms (without themselves) or probes."""
    own = probes is None
    targets = np.asarray(frac if own else probes, float)
    wrap = np.floor(targets).astype(int)
    points = (targets - wrap) @ cell.rows
    places, owners, shifts = images(cell, frac, cell.repeats(cutoff))
    home = np.floor(np.asarray(frac, float)).astype(int)
    out = []
    for i, point in enumerate(points):
        d = np.sqrt(((places - point) ** 2).sum(1))
        for m in np.flatnonzero((d <= cutoff) & ((d > 1e-9) | (not own))):
            j = int(owners[m])
            out.append((i, j, tuple(int(v) for v in shifts[m] - home[j] + wrap[i]), float(d[m])))
    return out
