"""Upper-tail probability of the chi-square distribution as an Arrow-batched UDF.

Runs on already-aggregated rows (one per feature and group), never per raw row.
Regularised upper incomplete gamma Q(k/2, x/2): series for x < a + 1, Lentz
continued fraction otherwise (standard textbook method). From ``LARGE`` on, where
these need too many steps near x = a, the Wilson-Hilferty form (off by less than 1e-6 there).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


#: Shape from which the expansions could end unconverged.
LARGE = 500_000.0


def _gamma_q(a: float, x: float) -> float | None:
    """Null if the expansion does not converge."""
    if x <= 0:
        return 1.0
    if a >= LARGE:
        v = 1.0 / (9.0 * a)
        return 0.5 * math.erfc(((x / a) ** (1.0 / 3.0) - 1.0 + v) / math.sqrt(2.0 * v))
    gln = math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        ap = a
        for _ in range(10_000):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        else:
            return None
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - gln))
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    else:
        return None
    return math.exp(-x + a * math.log(x) - gln) * h


def chi2_sf_value(stat: float | None, dof: float | None) -> float | None:
    if stat is None or dof is None or math.isnan(stat) or dof < 1:
        return None
    return _gamma_q(dof / 2.0, stat / 2.0)


@F.pandas_udf(DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf_value(None if pd.isna(s) else float(s), None if pd.isna(d) else float(d))
                      for s, d in zip(stat, dof)], dtype="float64")
