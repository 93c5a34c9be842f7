"""The 54 built-in descriptors, in their fixed order."""

from __future__ import annotations

import numpy as np

from rhoscape.kernels.features import Density, ratio, variance_parts
from rhoscape.plans.registry import Fallback, metadata_hook, register, register_field

ZERO, UNIFORM = {"zero_density": 0.0}, {"uniform_density": 0.0}
THIRD = 1.0 / 3.0

register_field("rho", lambda d: d.rho)
register_field("potential", lambda d: d.potential.ravel())


def _share(part: float, whole: float, value: float = 0.0, case: str = "zero_density"):
    found = part / whole if whole else np.nan
    return found if np.isfinite(found) else Fallback(value, case)


def _sum(values, where=None) -> float:
    return float(np.sum(values if where is None else values[where], dtype=float))


@register("zeta", "bonding", "gradient,geometry", low=0, high=1, cases=UNIFORM, formula="1 - sum|grad rho . u| / sum|grad rho|")
def zeta(d: Density):
    if d.uniform:
        return Fallback(0.0, "uniform_density")
    radial = _sum(np.abs(np.einsum("ij,ij->i", d.gradient, d.nearest.direction)))
    share = _share(radial, _sum(d.gradient_norm), 0.0, "uniform_density")
    return share if isinstance(share, Fallback) else 1.0 - share


def _moment(d: Density, n: int):
    return _share(_sum(d.rho * d.nearest.distance**n), d.total)


@register("m1", "bonding", "geometry", "Angstrom", 0, cases=ZERO, formula="sum rho r / sum rho")
def m1(d: Density):
    return _moment(d, 1)


@register("m2", "bonding", "geometry", "Angstrom^2", 0, cases=ZERO, formula="sum rho r^2 / sum rho")
def m2(d: Density):
    return _moment(d, 2)


@register("sigma_r2", "bonding", "geometry", "Angstrom^2", 0, cases=ZERO, formula="m2 - m1^2")
def sigma_r2(d: Density):
    first, second = _moment(d, 1), _moment(d, 2)
    return second - first**2 if not isinstance(first, Fallback) and not isinstance(second, Fallback) else Fallback(0.0, "zero_density")


for _k, _name in enumerate(("core", "bond", "int")):
    register(f"f_{_name}", "bonding", "geometry,shells", low=0, high=1, cases=ZERO, formula=f"charge share of the {_name} region")(lambda d, k=_k: _share(_sum(d.rho, d.regions[k]), d.total))


@register("lnf", "bonding", "laplacian", low=0, high=1, cases=UNIFORM, formula="volume share of lap rho < 0")
def lnf(d: Density):
    return Fallback(0.0, "uniform_density") if d.uniform else float(np.mean(d.laplacian < 0))


@register("lnf_charge_weighted", "bonding", "laplacian", low=0, high=1, cases=UNIFORM | ZERO, formula="charge share of lap rho < 0")
def lnf_charge_weighted(d: Density):
    return Fallback(0.0, "uniform_density") if d.uniform else _share(_sum(d.rho, d.laplacian < 0), d.total)


@register("lap_concentration_valence", "bonding", "laplacian,geometry,shells", low=0, high=1, cases={"uniform_density": 0.5, "empty_region": 0.5}, formula="share of |lap rho| with lap rho < 0 outside the cores")
def lap_concentration_valence(d: Density):
    if d.uniform:
        return Fallback(0.5, "uniform_density")
    outside = d.laplacian[~d.regions[0]]
    if not len(outside):
        return Fallback(0.5, "empty_region")
    return _share(_sum(-outside[outside < 0]), _sum(np.abs(outside)), 0.5, "uniform_density")


@register("ellip_bond_bounded_avg", "bonding", "hessian,shells", low=0, high=1, cases={"no_bond_voxels": 0.0}, formula="mean of 1 - lambda2/lambda1 over bond voxels with lambda2 < 0")
def ellip_bond_bounded_avg(d: Density):
    first, second = d.eigenvalues[d.regions[1]][:, :2].T
    curved = second < 0
    return float(np.mean(1.0 - second[curved] / first[curved])) if curved.any() else Fallback(0.0, "no_bond_voxels")


@register("f_NCI", "bonding", "gradient", low=0, high=1, cases=UNIFORM, formula="volume share of s < 0.5 and rho < 0.05 a.u.")
def f_nci(d: Density):
    return Fallback(0.0, "uniform_density") if d.uniform else float(np.mean(d.weak))


def _nci(d: Density, value):
    if d.uniform:
        return Fallback(0.0, "uniform_density")
    return float(np.mean(value(d.eigenvalues[d.weak, 1], d.atomic[0][d.weak]))) if d.weak.any() else Fallback(0.0, "no_nci_voxels")


@register("NCI_attractive", "bonding", "gradient,hessian", low=0, high=1, cases=UNIFORM | {"no_nci_voxels": 0.0}, formula="share of interaction voxels with lambda2 < 0")
def nci_attractive(d: Density):
    return _nci(d, lambda second, rho: second < 0)


@register("sign_lambda2_rho_mean", "bonding", "gradient,hessian", "e/bohr^3", cases=UNIFORM | {"no_nci_voxels": 0.0}, formula="mean of sign(lambda2) rho over interaction voxels")
def sign_lambda2_rho_mean(d: Density):
    return _nci(d, lambda second, rho: np.sign(second) * rho)


@register("V_spread", "bonding", "potential", "eV", 0, source="potential", formula="standard deviation over sites of V at the nucleus")
def v_spread(d: Density):
    return float(np.std(d.site_potentials))


@register("V_int_min", "bonding", "potential,shells", "eV", cases={"empty_region": 0.0}, source="potential", formula="least V over interstitial voxels")
def v_int_min(d: Density):
    inside = d.regions[2]
    return float(d.potential.ravel()[inside].min()) if inside.any() else Fallback(0.0, "empty_region")


@register("rho_mid_mean", "bonding", "bond_census", "e/Angstrom^3", cases={"no_bonds": 0.0}, formula="mean rho at bond midpoints")
def rho_mid_mean(d: Density):
    return float(np.mean(d.midpoints)) if len(d.midpoints) else Fallback(0.0, "no_bonds")


@register("rho_mid_std", "bonding", "bond_census", "e/Angstrom^3", 0, cases={"no_bonds": 0.0}, formula="standard deviation of rho at bond midpoints")
def rho_mid_std(d: Density):
    return float(np.std(d.midpoints)) if len(d.midpoints) else Fallback(0.0, "no_bonds")


for _k, _name in enumerate("abc"):
    register(f"rho_perc_{_name}", "structural", "percolation", "e/Angstrom^3", formula=f"highest level whose super-level set spans a{_k + 1}")(lambda d, k=_k: float(d.levels[k]))


@register("perc_anisotropy", "structural", "percolation", low=0, cases={"zero_levels": 0.0}, formula="(max - min) / mean of the spanning levels")
def perc_anisotropy(d: Density):
    mean = float(d.levels.mean())
    return float(np.ptp(d.levels)) / mean if mean else Fallback(0.0, "zero_levels")


for _name in ("n_max", "n_min"):
    register(_name, "structural", "census", "1/Angstrom^3", 0, formula=f"{_name} over 26 neighbours, by cell volume")(lambda d, n=_name: d.census[n] / d.volume)


@register("n_NNM", "structural", "census,shells", "1/Angstrom^3", 0, formula="maxima outside every core, by cell volume")
def n_nnm(d: Density):
    return len(d.ghosts) / d.volume


@register("Q_NNM", "structural", "census,shells", low=0, high=1, formula="charge share of the ascent basins of maxima outside every core")
def q_nnm(d: Density):
    return _sum(d.rho, np.isin(d.basins, d.ghosts)) / d.total if d.total else 0.0


@register("rho_min", "structural", "", "e/Angstrom^3", formula="least rho")
def rho_min(d: Density):
    return float(d.rho.min())


@register("rho_min_ratio", "structural", cases=ZERO, formula="least rho / mean rho")
def rho_min_ratio(d: Density):
    mean = float(np.mean(d.rho))
    return float(d.rho.min()) / mean if mean else Fallback(0.0, "zero_density")


@register("rho_int_mean", "structural", "shells", "e/Angstrom^3", cases={"empty_region": 0.0}, formula="mean rho of the interstitial region")
def rho_int_mean(d: Density):
    inside = d.regions[2]
    return float(np.mean(d.rho[inside])) if inside.any() else Fallback(0.0, "empty_region")


for _k in range(3):
    register(f"T_eigenvalues_t{_k + 1}", "structural", "gradient", low=0, high=1, cases={"uniform_density": THIRD}, formula=f"eigenvalue {_k + 1} of the normalised gradient tensor")(
        lambda d, k=_k: Fallback(THIRD, "uniform_density") if d.tensor is None else float(np.linalg.eigvalsh(d.tensor)[k])
    )


@register("charge_FA", "structural", "gradient", low=0, high=1, cases=UNIFORM, formula="sqrt(3/2) |T - I/3| / |T|")
def charge_fa(d: Density):
    return Fallback(0.0, "uniform_density") if d.tensor is None else float(np.sqrt(1.5) * np.linalg.norm(d.tensor - np.eye(3) / 3) / np.linalg.norm(d.tensor))


def _informed(d: Density, value):
    return Fallback(0.0, "zero_density") if d.information is None else value(*d.information)


register("shannon_entropy", "structural", high=0, cases=ZERO, formula="-int p ln p - ln V")(lambda d: _informed(d, lambda s, q: s))
register("disequilibrium", "structural", low=0, cases=ZERO, formula="V int p^2")(lambda d: _informed(d, lambda s, q: q))
register("LMC_complexity", "structural", low=0, cases=ZERO, formula="disequilibrium x exp(entropy)")(lambda d: _informed(d, lambda s, q: q * float(np.exp(s))))


def _per_site(d: Density, base: str):
    if base == "m1":
        return ratio(d.shared_sums["r1"], d.shared_sums["total"])
    if base == "f_bond":  # always over the sphere cells
        return ratio(d.sphere_sums["bond"], d.sphere_sums["total"])
    return None if d.uniform else 1.0 - ratio(d.shared_sums["radial"], d.shared_sums["norm"])


def _spread(d: Density, base: str, kind: str):
    x = _per_site(d, base)
    if x is None:
        return Fallback(0.0, "uniform_density")
    counts = d.site_counts
    if kind == "within" and max(counts.values()) < 2:
        return Fallback(0.0, "one_site_per_element")
    if kind == "between" and len(counts) == 1:
        return Fallback(0.0, "single_element")
    if kind in ("within", "between"):
        return variance_parts(x, d.species)[kind == "between"]
    return float({"std": np.std, "range": np.ptp, "max": np.max, "min": np.min}[kind](x))


for _base, _units, _requires in (("m1", "Angstrom", "geometry"), ("f_bond", "dimensionless", "geometry,shells"), ("zeta", "dimensionless", "gradient,geometry")):
    for _suffix, _kind in (("site_std", "std"), ("site_range", "range"), ("site_max", "max"), ("site_min", "min"), ("within_element_var", "within"), ("between_element_var", "between")):
        _unit = _units if _kind not in ("within", "between") or _units == "dimensionless" else f"({_units})^2"
        _cases = UNIFORM | ({"one_site_per_element": 0.0} if _kind == "within" else {"single_element": 0.0} if _kind == "between" else {})
        register(f"{_base}_{_suffix}", "heterogeneity", f"{_requires},partition", _unit, cases=_cases, formula=f"{_suffix} of the per-site {_base}")(lambda d, b=_base, k=_kind: _spread(d, b, k))


@metadata_hook
def _euler(d: Density) -> dict:
    return {"euler_consistency": d.census["euler"]}


@metadata_hook
def _sites(d: Density) -> dict:
    return {"n_elements": len(d.site_counts), "max_sites_per_element": max(d.site_counts.values())}
