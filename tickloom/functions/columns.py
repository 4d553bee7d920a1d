"""Column helpers shared by the operators."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), c)


def safe_div(a: Column, b: Column) -> Column:
    """NULL where the divisor is zero."""
    return F.try_divide(a, b)


def half_life_decay(age_days: Column, half_life: float) -> Column:
    if half_life <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / F.lit(float(half_life)))


def age_days(later: Column, earlier: Column) -> Column:
    us = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return us / F.lit(86_400_000_000.0)


@F.pandas_udf(DoubleType())
def norm_cdf(z: pd.Series) -> pd.Series:
    """Standard normal distribution function, for report-level rows."""
    return pd.Series([None if pd.isna(v) else _NORMAL.cdf(v) for v in z], index=z.index, dtype="float64")


@F.pandas_udf(DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    """Standard normal quantile, NULL outside (0, 1)."""
    return pd.Series([_NORMAL.inv_cdf(v) if pd.notna(v) and 0 < v < 1 else None for v in p], index=p.index, dtype="float64")


def seeded_hash(*cols: Column | str, seed: int) -> Column:
    """Repeatable 60-bit number of a seed and columns: the first 15 hex digits of the MD5 of
    ``seed|value|value``, values as strings.  Any engine with that digest draws the same."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def uniform(h: Column) -> Column:
    """A seeded hash as a number in (0, 1), by its low 53 bits."""
    return (F.pmod(h, F.lit(2**53)).cast("double") + 0.5) / F.lit(float(2**53))


def json_safe(df: DataFrame) -> DataFrame:
    """Dates and timestamps as strings, non-finite doubles as NULL."""
    out = []
    for f in df.schema:
        t, c = f.dataType.typeName(), F.col(f.name)
        if t == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif t in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif t in ("double", "float"):
            c = finite(c)
        out.append(c.alias(f.name))
    return df.select(*out)
