"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def hashtags(text: Column) -> Column:
    """The tags of a text: words of two or more characters that begin with #, without that sign."""
    words = F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) > 1) & w.startswith("#"))
    return F.transform(words, lambda w: F.substr(w, F.lit(2)))


def token_bits(line: Column) -> Column:
    """The white-space separated tokens 0 and 1 of a line as integers; others are dropped."""
    return F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda t: t.isin("0", "1")), lambda t: t.cast("int"))


def minhash(element: Column, a: int, b: int, p: int, m: Column) -> Column:
    """((a e + b) mod p) mod m."""
    return ((element * a + b) % p) % m
