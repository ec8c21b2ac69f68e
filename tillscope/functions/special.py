"""Tail probabilities. Spark has no error function, so these run on the few grouped rows as Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return pd.Series(0.5 * _erfc(z.to_numpy(float) / math.sqrt(2.0))).where(z.notna().to_numpy())

    return tail(z)


def chi_square_tail(x: Column, dof: Column, method: str = "exact") -> Column:
    """P(X > x) of the chi-square law.

    Both parities have a finite closed form, used by ``exact``. ``wilson_hilferty`` takes the cube-root normal
    approximation for odd degrees of freedom.
    """
    if method not in ("exact", "wilson_hilferty"):
        raise ValueError(f"unknown method {method!r}")

    def one(x: float, k: int) -> float:
        if not (x >= 0) or k < 1:
            return math.nan
        if math.isinf(x):
            return 0.0
        odd = k % 2
        if odd and method == "wilson_hilferty":
            spread = 2.0 / (9.0 * k)
            return 0.5 * math.erfc(((x / k) ** (1.0 / 3.0) - 1.0 + spread) / math.sqrt(2.0 * spread))
        if x == 0:
            return 1.0
        # Terms y^s e^-y / Gamma(s + 1), s stepping by one up to k/2 - 1, in logs to stay finite.
        y = x / 2.0
        steps = (0.5 * odd + j for j in range(k // 2))
        rest = sum(math.exp(s * math.log(y) - y - math.lgamma(s + 1.0)) for s in steps)
        return (math.erfc(math.sqrt(y)) if odd else 0.0) + rest

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        out = [one(a, int(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(x, k)]
        return pd.Series(out, dtype="float64")

    return tail(x, dof)
