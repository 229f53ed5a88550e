"""Standard normal distribution in double precision.

Spark has no error function, so the CDF is Hart's rational approximation in the
form published by G. West, "Better approximations to cumulative normal
functions" (2005): absolute error below 1e-15.  The same constants feed the
Column form and the NumPy form used inside Arrow UDFs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's coefficients, highest power first.
NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
# Beyond this point a continued fraction takes over.
RATIONAL_LIMIT = 7.07106781186547
SQRT_2PI = 2.5066282746310002
INV_SQRT_2PI = 0.3989422804014327


def _horner(coefficients, x):
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * x + c
    return total


def norm_pdf(x: Column) -> Column:
    return F.exp(x * x * F.lit(-0.5)) * F.lit(INV_SQRT_2PI)


def norm_cdf(x: Column) -> Column:
    """CDF as a Column; pass a plain column reference, it is used many times."""
    a = F.abs(x)
    bell = F.exp(a * a * F.lit(-0.5))
    central = bell * _horner([F.lit(c) for c in NUMERATOR], a) / _horner(
        [F.lit(c) for c in DENOMINATOR], a
    )
    fraction = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    outer = bell / fraction / F.lit(SQRT_2PI)
    lower = F.when(a < F.lit(RATIONAL_LIMIT), central).otherwise(outer)
    return F.when(x > F.lit(0.0), F.lit(1.0) - lower).otherwise(lower)


def np_norm_cdf(x: np.ndarray) -> np.ndarray:
    """CDF of a NumPy array, in few passes over cache-sized blocks."""
    a = np.abs(x)
    bell = np.multiply(a, a)
    bell *= -0.5
    np.exp(bell, out=bell)
    top = a * NUMERATOR[0]
    top += NUMERATOR[1]
    for c in NUMERATOR[2:]:
        top *= a
        top += c
    low = a * DENOMINATOR[0]
    low += DENOMINATOR[1]
    for c in DENOMINATOR[2:]:
        low *= a
        low += c
    top /= low
    top *= bell
    far = a >= RATIONAL_LIMIT
    if far.any():
        z = a[far]
        fraction = z + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            fraction = z + k / fraction
        top[far] = bell[far] / fraction / SQRT_2PI
    return np.where(x > 0.0, 1.0 - top, top)
