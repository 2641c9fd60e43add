"""Numeric and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def log_amount(amount: Column) -> Column:
    """SCA1: log(1 + amount), negatives as 0."""
    return F.log1p(F.greatest(amount, F.lit(0.0)))


def is_round_amount(amount: Column) -> Column:
    """SCA2: a finite multiple of ten; zero counts."""
    finite = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) != float("inf"))
    return finite & (amount % 1 == 0) & (amount % 10 == 0)


def fee_ratio(fee: Column, amount: Column) -> Column:
    """SCA3: fee share of the amount, 0 when there is no fee or no amount."""
    return F.when(fee.isNotNull() & (amount != 0), fee / amount).otherwise(0.0)


def seconds_after(later, earlier) -> Column:
    """Signed seconds from ``earlier`` to ``later``."""
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / 1e6


def seconds_between(a, b) -> Column:
    """SCA12: absolute distance in seconds."""
    return F.abs(seconds_after(a, b))


def entropy_term(share: Column) -> Column:
    """SCA4: one summand of the Shannon entropy."""
    return -share * F.log(share + 1e-12)


def normalised_entropy(entropy: Column, n: Column) -> Column:
    """SCA5: entropy relative to its maximum for n values, 0 for one value or none."""
    return F.when(n > 1, entropy / (F.log(n.cast("double")) + 1e-12)).otherwise(0.0)


def psi_term(current: Column, reference: Column) -> Column:
    """SCA18: one bin's share of the population stability index."""
    return (current - reference) * F.log(current / reference)


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
