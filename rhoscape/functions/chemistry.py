"""Chemical formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements with f electrons in the valence region (fixed values).
F_ELEMENTS = "La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Ac Th Pa U Np Pu Am Cm".split()


def elements_of(formula: Column) -> Column:
    """Distinct element symbols of a formula in alphabetical order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)"))))


def chemical_system(formula: Column) -> Column:
    return F.array_join(elements_of(formula), "-")


def has_f_element(formula: Column) -> Column:
    return F.arrays_overlap(elements_of(formula), F.array(*map(F.lit, F_ELEMENTS)))


def species(labels: Column, counts: Column) -> Column:
    """One clean symbol an atom from arrays of group labels ("Fe_pv", "O/abc") and counts."""
    groups = F.zip_with(labels, counts, lambda s, n: F.array_repeat(F.split_part(F.split_part(s, F.lit("_"), F.lit(1)), F.lit("/"), F.lit(1)), n.cast("int")))
    return F.flatten(groups)


def reduced_counts(counts: Column) -> Column:
    """Counts divided by their greatest common divisor (Euclid's steps as a fold)."""
    gcd = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), lambda s, _: F.struct(F.when(s.b == 0, s.a).otherwise(s.b).alias("a"), F.when(s.b == 0, s.b).otherwise(s.a % F.nullif(s.b, F.lit(0).cast("bigint"))).alias("b")), lambda s: s.a)
    whole = F.aggregate(counts, F.lit(0).cast("bigint"), lambda g, n: gcd(g, n))
    return F.transform(counts, lambda n: (n / whole).cast("bigint"))


def parent_directory(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)
