"""Closed forms for symmetric 3x3 matrices as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: nested formulas stay small when projections are merged."""
    return F.element_at(F.transform(F.array(value), body), 1)


def eigenvalues(frame: DataFrame, xx: str, yy: str, zz: str, xy: str, xz: str, yz: str, names: tuple[str, str, str]) -> DataFrame:
    """Ascending eigenvalue columns by the trigonometric form (Smith 1961)."""
    entries = F.struct(*(F.col(n).cast("double").alias(k) for n, k in ((xx, "a"), (yy, "b"), (zz, "c"), (xy, "d"), (xz, "e"), (yz, "f"))))

    def centred(m: Column) -> Column:
        q = (m.a + m.b + m.c) / 3
        return F.struct((m.a - q).alias("a"), (m.b - q).alias("b"), (m.c - q).alias("c"), m.d.alias("d"), m.e.alias("e"), m.f.alias("f"), q.alias("q"))

    def scaled(m: Column) -> Column:
        p = F.sqrt((m.a * m.a + m.b * m.b + m.c * m.c + 2 * (m.d * m.d + m.e * m.e + m.f * m.f)) / 6)
        determinant = m.a * (m.b * m.c - m.f * m.f) - m.d * (m.d * m.c - m.f * m.e) + m.e * (m.d * m.f - m.b * m.e)
        return F.struct(m.q.alias("q"), p.alias("p"), determinant.alias("t"))

    def angled(m: Column) -> Column:
        r = F.when(m.p > 0, F.try_divide(m.t, 2 * m.p * m.p * m.p)).otherwise(F.lit(0.0))
        return F.struct(m.q.alias("q"), m.p.alias("p"), (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3).alias("f"))

    def solved(m: Column) -> Column:
        high, low = m.q + 2 * m.p * F.cos(m.f), m.q + 2 * m.p * F.cos(m.f + F.lit(2 * math.pi / 3))
        return F.struct(low.alias("low"), (3 * m.q - low - high).alias("mid"), high.alias("high"))

    found = let(entries, lambda m: let(centred(m), lambda c: let(scaled(c), lambda s: let(angled(s), solved))))
    return frame.withColumn("__e", found).withColumns({n: F.col(f"__e.{k}") for n, k in zip(names, ("low", "mid", "high"))}).drop("__e")


def erf(x: Column) -> Column:
    """Error function by its Maclaurin series; good to 1e-7; beyond 4 it is the sign."""
    terms = [F.lit((-1) ** n / (math.factorial(n) * (2 * n + 1))) * F.pow(x, 2 * n + 1) for n in range(60)]
    series = F.lit(2 / math.sqrt(math.pi)) * sum(terms[1:], terms[0])
    return F.when(F.abs(x) > 4.0, F.signum(x)).otherwise(series)
