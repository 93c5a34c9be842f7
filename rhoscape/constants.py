"""Unit factors, cutoffs and thresholds (fixed values)."""

import math

BOHR = 0.529177210903
HARTREE_EV = 27.211386245988
COULOMB = HARTREE_EV * BOHR
DENSITY_TO_AU = BOHR**3
GRADIENT_TO_AU = BOHR**4
S_PREFACTOR = 2.0 * (3.0 * math.pi**2) ** (1.0 / 3.0)

SPHERE_A, SPHERE_B = 0.79, 1.14
RHO_FLOOR_AU = 1e-8
NCI_S_MAX, NCI_RHO_MAX_AU = 0.5, 0.05
BOND_TOL = 0.1
BECKE_K, BECKE_CELLS, MIN_PAIR_WEIGHT = 60, 8, 1e-10
GEOMETRY_EPS, UNIFORM_TOL = 1e-8, 1e-12

#: Central-difference coefficients of offsets 1.. (first) and 0.. (second derivative) by order.
FIRST = {2: (1 / 2,), 4: (2 / 3, -1 / 12), 6: (3 / 4, -3 / 20, 1 / 60), 8: (4 / 5, -1 / 5, 4 / 105, -1 / 280)}
SECOND = {
    2: (-2.0, 1.0),
    4: (-5 / 2, 4 / 3, -1 / 12),
    6: (-49 / 18, 3 / 2, -3 / 20, 1 / 90),
    8: (-205 / 72, 8 / 5, -1 / 5, 8 / 315, -1 / 560),
}

#: Grid-size constants of the plane-wave code whose grids are reproduced.
RYTOEV, AUTOA = 13.605826, 0.529177249
#: Bins of profiles and histograms, points of a sampled scatter, window of the interaction map.
RADIAL_BIN, RATIO_BIN, UNIT_BINS, VALUE_BINS, MAX_POINTS, MAP_RHO, MAP_S = 0.05, 0.025, 50, 120, 3000, 0.08, 2.0
#: Relative differences: below NOISE of the scale, close, far; grades of agreement by rank correlation.
NOISE, CLOSE, FAR, GRADES = 1e-3, 0.01, 0.05, (0.99, 0.95, 0.8)
