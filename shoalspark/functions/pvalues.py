"""Arrow-batched wrappers around the distribution functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from shoalspark.functions import special as S


def _masked(fn, *series: pd.Series) -> pd.Series:
    arrays = [s.to_numpy(dtype=float, na_value=np.nan) for s in series]
    out = np.full(len(series[0]), np.nan)
    ok = np.logical_and.reduce([np.isfinite(a) for a in arrays])
    if ok.any():
        out[ok] = fn(*[a[ok] for a in arrays])
    return pd.Series(out)  # NaN crosses Arrow as null


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(lambda a, b: np.where(b > 0, S.t_two_sided(a, np.where(b > 0, b, 1.0)), np.nan), t, df)


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _masked(S.f_sf, f, df1, df2)


@F.pandas_udf(DoubleType())
def z_p_value(z: pd.Series) -> pd.Series:
    return _masked(lambda a: np.minimum(1.0, 2 * S.norm_sf(np.abs(a))), z)


@F.pandas_udf(DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    return _masked(S.norm_sf, z)


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile as a column expression; null outside (0, 1)."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    outer = F.when(r <= 5, S.rational(S.PPF_MIDDLE, r - 1.6)).otherwise(S.rational(S.PPF_TAIL, r - 5))
    inner = q * S.rational(S.PPF_CENTRE, 0.180625 - q * q)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, inner).otherwise(F.signum(q) * outer))


@F.pandas_udf(DoubleType())
def signed_rank_p(v: pd.Series, n: pd.Series) -> pd.Series:
    return _masked(lambda a, b: np.array([S.signed_rank_exact(x, int(m)) for x, m in zip(a, b)]), v, n)
