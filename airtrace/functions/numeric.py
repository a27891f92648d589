"""Missing-value policy and small numeric expressions.

Missing is always NULL inside the engine. NaN and infinities are converted at
the source because Spark orders NaN above every number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str | float) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def finite(value: Column | str) -> Column:
    """The value when it is a finite number, else NULL."""
    c = as_col(value)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(value, as_col(low)), as_col(high))


def guard(condition: Column, value: Column, message: str) -> Column:
    """``value`` where ``condition`` holds; anything else fails the job."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def uniform(*parts: Column | str) -> Column:
    """Reproducible uniform draw in (0, 1) from the md5 of a dash-joined key."""
    digest = F.md5(F.concat_ws("-", *[as_col(p).cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def mix32(h: np.ndarray) -> np.ndarray:
    """Scramble 32-bit numbers by two rounds of multiply and shift, modulo 2**32."""
    low = np.uint64(0xFFFFFFFF)
    h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & low
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & low
    return h ^ (h >> np.uint64(16))


def step32(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The 32-bit key plus a counter times the golden ratio, modulo 2**32."""
    return (key + (count + np.uint64(1)) * np.uint64(0x9E3779B9)) & np.uint64(0xFFFFFFFF)


def uniform32(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Reproducible uniform draws in (0, 1) inside a task: number ``count`` of each 32-bit ``key``."""
    return (mix32(step32(key, count)) + 0.5) / 4294967296.0


def bits32(seed: int, stream: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Reproducible 32-bit numbers: number ``count`` of every ``stream``.

    A stream has two keys of its own, added before the first scramble and combined
    with its result before the second, so long streams do not run into each other.
    """
    first = mix32(step32(np.uint64(seed & 0xFFFFFFFF), stream))
    second = mix32(first ^ np.uint64(0x5BD1E995))
    return mix32(mix32(step32(first, count)) ^ second)


def pick(n: Column, *parts: Column | str) -> Column:
    """Reproducible integer in [0, n) from the md5 of a dash-joined key."""
    digest = F.md5(F.concat_ws("-", *[as_col(p).cast("string") for p in parts]))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n.cast("long"))


def gaussian(*parts: Column | str) -> Column:
    """Standard normal draw by the Box-Muller transform of two keyed uniforms."""
    u1 = uniform(*parts, F.lit("a"))
    u2 = uniform(*parts, F.lit("b"))
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * F.pi() * u2)


def fixed_text(x, digits: int) -> Column:
    """``x`` with ``digits`` decimals, ties to the even digit; infinities are ``inf`` and ``-inf``."""
    c = as_col(x).cast("double")
    text = F.bround(c.cast("decimal(38,12)"), digits).cast(f"decimal(38,{digits})").cast("string")
    return F.when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(text)
