"""Keyed draws: values that depend on the given keys only.

Never on partitioning, row order or process, so a lost task recomputes the very
same value, and any SQL engine with md5 can repeat it.
"""
from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, functions as F

HEX_DIGITS = 13                      # 52 bits: exact in a double
SPAN = float(2 ** 52)


def _text(key) -> Column:
    return (key if isinstance(key, Column) else F.lit(key)).cast("string")


def uniform(*keys) -> Column:
    """A double in [0, 1) from the keys; each is a Column or a literal."""
    digest = F.md5(F.concat_ws("|", *[_text(k) for k in keys]))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(SPAN)


def integer(n: Column | int, *keys) -> Column:
    """An integer in 0..n-1."""
    return F.floor(uniform(*keys) * n).cast("long")


def between(lo: float, hi: float, *keys) -> Column:
    return F.lit(float(lo)) + F.lit(float(hi) - float(lo)) * uniform(*keys)


def log_between(lo: float, hi: float, *keys) -> Column:
    a, b = math.log(lo), math.log(hi)
    return F.exp(F.lit(a) + F.lit(b - a) * uniform(*keys))


def bernoulli(p: float, *keys) -> Column:
    return (uniform(*keys) < F.lit(float(p))).cast("int")


def choice(options, *keys) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (integer(len(options), *keys) + 1).cast("int"))


def zero_or_between(p_zero: float, lo: float, hi: float, *keys) -> Column:
    """A point mass at 0 mixed with a uniform; the two draws use separate streams."""
    return F.when(uniform(*keys, 0) < F.lit(float(p_zero)), F.lit(0.0)).otherwise(between(lo, hi, *keys, 1))


def uniform_value(*keys) -> float:
    """``uniform`` of literal keys, on the driver."""
    digest = hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()
    return int(digest[:HEX_DIGITS], 16) / SPAN


def normal_draw(*keys) -> float:
    """A standard normal value from literal keys."""
    return math.sqrt(-2 * math.log(1 - uniform_value(*keys, 0))) * math.cos(2 * math.pi * uniform_value(*keys, 1))
