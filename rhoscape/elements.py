"""Element data: symbols, covalent radii and valence electron counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Symbols in the order of the atomic number.
SYMBOLS = """
    H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar
    K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr
    Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe
    Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf
    Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th
    Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr
""".split()

# Covalent radii in Angstrom (Cordero et al., Dalton Trans. 2832, 2008), hydrogen to curium.
RADII = """
    0.31 0.28 1.28 0.96 0.84 0.76 0.71 0.66 0.57 0.58 1.66 1.41 1.21 1.11 1.07 1.05 1.02 1.06
    2.03 1.76 1.70 1.60 1.53 1.39 1.39 1.32 1.26 1.24 1.32 1.22 1.22 1.20 1.19 1.20 1.20 1.16
    2.20 1.95 1.90 1.75 1.64 1.54 1.47 1.46 1.42 1.39 1.45 1.44 1.42 1.39 1.39 1.38 1.39 1.40
    2.44 2.15 2.07 2.04 2.03 2.01 1.99 1.98 1.98 1.96 1.94 1.92 1.92 1.89 1.90 1.87 1.87 1.75
    1.70 1.62 1.51 1.44 1.41 1.36 1.36 1.32 1.45 1.46 1.48 1.40 1.50 1.50 2.60 2.21 2.15 2.06
    2.00 1.96 1.90 1.87 1.80 1.69
""".split()

# Valence electrons of the pseudopotentials used for densities, by symbol.
VALENCE = """
    Ac:11 Ag:11 Al:3 Ar:8 As:5 Au:11 B:3 Ba:10 Be:2 Bi:5 Br:7 C:4 Ca:8 Cd:12 Ce:12 Cl:7 Co:9 Cr:6
    Cs:9 Cu:11 Dy:20 Er:22 Eu:17 F:7 Fe:8 Ga:3 Gd:18 Ge:4 H:1 He:2 Hf:4 Hg:12 Ho:21 I:7 In:3 Ir:9
    K:7 La:11 Li:1 Lu:25 Mg:2 Mn:7 Mo:6 N:5 Na:1 Nb:11 Nd:14 Ne:8 Ni:10 Np:15 O:6 Os:8 P:5 Pa:13
    Pb:4 Pd:10 Pm:15 Pr:13 Pt:10 Pu:16 Rb:7 Re:7 Rh:9 Ru:8 S:6 Sb:5 Sc:3 Se:6 Si:4 Sm:16 Sn:4 Sr:10
    Ta:5 Tb:19 Tc:7 Te:6 Th:12 Ti:4 Tl:3 Tm:23 U:14 V:5 W:6 Y:11 Yb:24 Zn:12 Zr:12
""".split()

COVALENT_RADIUS = {symbol: float(radius) for symbol, radius in zip(SYMBOLS, RADII)}
ZVAL = {symbol: int(count) for symbol, count in (entry.split(":") for entry in VALENCE)}


def covalent_radius(symbol: str) -> float:
    if symbol not in COVALENT_RADIUS:
        raise KeyError(f"no covalent radius for element {symbol!r}")
    return COVALENT_RADIUS[symbol]


def elements(spark: SparkSession) -> DataFrame:
    """Dimension table of all elements; radius and valence are null where unknown."""
    rows = [(z, s, COVALENT_RADIUS.get(s), ZVAL.get(s)) for z, s in enumerate(SYMBOLS, start=1)]
    return spark.createDataFrame(rows, "z int, symbol string, covalent_radius double, zval int")
