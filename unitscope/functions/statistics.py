"""Scalar statistics as column expressions; tails without a built-in function are Arrow-vectorised."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


#: Draws are numbers below this prime.
DRAWS = 2147483647
#: Multipliers of the parts of a draw's key and of the rounds that mix it: fixed values, any large odd numbers.
DRAW_PARTS, _ROUND = (48271, 1101520787, 69621), (1103515245, 747796405, 1664525)


def hash_key(*parts: Column | str | int) -> Column:
    """A whole number below 2**28 fixed by its parts, the same in every engine with md5."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def draw_base(key: str, rep: str) -> Column:
    """What all draws of a key (below 2**28) and a replicate share."""
    return F.expr(f"({key} * {DRAW_PARTS[0]}L + {rep} * {DRAW_PARTS[1]}L % {DRAWS}L) % {DRAWS}L")


def draws(base: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers below DRAWS, evenly spread over bases and places: whole-number arithmetic that any engine has and that stays below 2**63."""
    x = (base + places * DRAW_PARTS[2]) % DRAWS
    for multiplier in _ROUND:
        x = ((x ^ (x >> 15)) * multiplier + 12345) % DRAWS
    return x


def drawn_sql(source: str, columns: str, key: str, rep: str, place: str, name: str = "drawn") -> str:
    """Table expressions for DuckDB that end in `name` (columns, x), the same numbers over the rows of source."""
    out = [f"{name}_0 AS (SELECT {columns}, ({key} * {DRAW_PARTS[0]} + {rep} * {DRAW_PARTS[1]} % {DRAWS} + ({place}) * {DRAW_PARTS[2]}) % {DRAWS} AS x FROM {source})"]
    for k, multiplier in enumerate(_ROUND):
        last = name if k == len(_ROUND) - 1 else f"{name}_{k + 1}"
        out.append(f"{last} AS (SELECT {columns}, (xor(x, x >> 15) * {multiplier} + 12345) % {DRAWS} AS x FROM {name}_{k})")
    return ", ".join(out)


def finite(column: Column) -> Column:
    """Null in place of NaN and infinities, so that comparisons never see them."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)


def number(text: Column) -> Column:
    """A finite number, or null where the text is none."""
    return finite(text.try_cast("double"))


def minus_log10(p: Column) -> Column:
    """-log10 of p clipped to [1e-300, 1]."""
    return -F.log10(F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0)))


def likelihood_ratio(l0: Column, l1: Column) -> Column:
    return F.greatest(F.lit(0.0), 2 * (l1 - l0))


def chi2_tail_df2(x: Column) -> Column:
    return F.exp(-F.greatest(x, F.lit(0.0)) / 2)


def log_factorial(k: Column) -> Column:
    """ln k! of whole numbers from 0: from a table below 16, by Stirling's series above, to about 1e-12."""
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(16)))
    x = F.greatest(k, F.lit(16)).cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(k < 16, F.get(small, F.least(k, F.lit(15)).cast("int"))).otherwise(series)


def clipped_interval(share: Column, n: Column) -> tuple[Column, Column]:
    """Normal 95 % interval of a share, clipped to [0, 1]."""
    half = 1.96 * F.sqrt(share * (1 - share) / F.greatest(n, F.lit(1)))
    return F.greatest(F.lit(0.0), share - half), F.least(F.lit(1.0), share + half)


def _erfc_series(degree: int = 30) -> list[float]:
    """Coefficients of the powers of 2t - 1, t = 2 / (2 + x), in ln(erfc(x) / t) + x * x for x from 0: interpolated between Chebyshev's points, from the continued fraction of erfc where the built-in one has no digits left."""
    points = np.cos(np.pi * (np.arange(degree + 1) + 0.5) / (degree + 1))
    values = []
    for y in points:
        t = (y + 1) / 2
        x = 2 / t - 2
        if x < 3:
            values.append(math.log(math.erfc(x) / t) + x * x)
        else:
            f = x
            for k in range(200, 0, -1):
                f = x + k / 2 / f
            values.append(-math.log(math.sqrt(math.pi) * f * t))
    return np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebfit(points, values, degree)).tolist()


_ERFC = _erfc_series()


def erfc(x: Column) -> Column:
    """The complementary error function, to about 13 digits, as generated code."""
    size = F.abs(x)
    t = F.lit(2.0) / (size + 2)
    y, power = 2 * t - 1, F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        power = power * y + F.lit(c)
    tail = t * F.exp(power - size * size)
    return F.when(x < 0, 2 - tail).otherwise(tail)


def chi2_tail_df1(x: Column) -> Column:
    return erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 200):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out *= c * d
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function for numpy arrays."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1) / (a + b + 2)
    value = np.where(low, front * _beta_fraction(a, b, np.where(low, inner, 0.5)) / a, 1 - front * _beta_fraction(b, a, np.where(low, 0.5, 1 - inner)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


@pandas_udf(DoubleType())
def beta_quantile(q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """The q quantile of Beta(a, b) by bisection; null where a parameter is null or not positive."""
    ok = (q.notna() & (a > 0) & (b > 0)).to_numpy()
    qa, aa, ba = (s.to_numpy(float)[ok] for s in (q, a, b))
    low, high = np.zeros(len(qa)), np.ones(len(qa))
    for _ in range(60):
        middle = (low + high) / 2
        above = incomplete_beta(aa, ba, middle) > qa
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    out = np.full(len(q), np.nan)
    out[ok] = (low + high) / 2
    return pd.Series(out).where(ok, None)


@pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t."""
    ok = (t.notna() & (df > 0)).to_numpy()
    tv, dv = t.to_numpy(float)[ok], df.to_numpy(float)[ok]
    out = np.full(len(t), np.nan)
    out[ok] = incomplete_beta(dv / 2, np.full(len(dv), 0.5), dv / (dv + tv * tv))
    return pd.Series(out).where(ok, None)


def kolmogorov_tail(d: Column | str, n: Column | str) -> Column:
    """Asymptotic tail of the Kolmogorov distance d over n points; null for none."""
    d, n = (F.col(c) if isinstance(c, str) else c for c in (d, n))
    square = 2 * d * d * n
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-(k * k) * square))
    return F.when(d.isNotNull() & (n > 0), F.when(d * F.sqrt(n) < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms))))


def canonical_number(x: Column) -> Column:
    """A text of a number that every engine with whole 64-bit numbers and exact powers of two writes alike: its mantissa as a whole number from 2**52 to 2**53 - 1, "e" and the exponent. Zeros are "0"; null stays null."""
    lift = F.when(F.abs(x) < 1e-290, 200).otherwise(0)
    size = F.abs(x) * F.pow(F.lit(2.0), lift)
    guess = F.floor(F.log2(size))
    scaled = size * F.pow(F.lit(2.0), 52 - guess)
    # The logarithm may be off by one beside powers of two.
    shift = F.when(scaled >= 2.0**53, 1).when(scaled < 2.0**52, -1).otherwise(0)
    whole = (scaled * F.pow(F.lit(2.0), -shift)).cast("long")
    text = F.concat(F.when(x < 0, "-").otherwise(""), whole.cast("string"), F.lit("e"), (guess + shift - 52 - lift).cast("string"))
    return F.when(x.isNull(), None).when(F.isnan(x), "nan").when(x == 0, "0").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(text)


def canonical_number_sql(x: str) -> str:
    """canonical_number for DuckDB."""
    lift = f"CASE WHEN abs({x}) < 1e-290 THEN 200 ELSE 0 END"
    size = f"(abs({x}) * pow(2.0, {lift}))"
    guess = f"CAST(floor(log2({size})) AS BIGINT)"
    scaled = f"({size} * pow(2.0, 52 - {guess}))"
    shift = f"CASE WHEN {scaled} >= pow(2.0, 53) THEN 1 WHEN {scaled} < pow(2.0, 52) THEN -1 ELSE 0 END"
    text = f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, CAST({scaled} * pow(2.0, -({shift})) AS BIGINT), 'e', {guess} + ({shift}) - 52 - ({lift}))"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 'nan' WHEN {x} = 0 THEN '0' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END ELSE {text} END"
