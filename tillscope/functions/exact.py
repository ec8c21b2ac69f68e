"""Exact money, percent and draw columns.

Money is summed as integer cents; percents and averages are rounded half away from zero on integers, so
a result does not depend on the order in which partitions are added up.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(20,0)"


def to_cents(money: Column) -> Column:
    """decimal(12,2) money as bigint cents."""
    return (money * 100).cast("bigint")


def to_money(cents: Column) -> Column:
    return (cents.cast(WIDE) * F.lit(Decimal("0.01"))).cast("decimal(20,2)")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def half_up(num: Column, den: Column, times: int = 1) -> Column:
    """``times * num / den`` as a bigint, rounded half away from zero; NULL where ``den`` is 0.

    The products are decimals of at most 28 digits, so sums near the end of the bigint range are safe.
    """
    top = F.abs(num.cast(WIDE)) * F.lit(Decimal(2 * times))
    bottom = F.nullif(den.cast(WIDE), F.lit(Decimal(0)))
    size = _div(top + bottom, bottom * F.lit(Decimal(2)))
    return F.when(num < 0, -size).otherwise(size)


def pct(part: Column, whole: Column) -> Column:
    """Percent with two decimals; NULL where ``whole`` is 0."""
    return to_money(half_up(part, whole, times=10_000))


def avg_money(cents: Column, rows: Column) -> Column:
    return to_money(half_up(cents, rows))


def avg_tenths(tenths: Column, rows: Column) -> Column:
    return (half_up(tenths, rows).cast(WIDE) * F.lit(Decimal("0.1"))).cast("decimal(20,1)")


def safe_div(a: Column, b: Column) -> Column:
    """Ratio as double; 0 where the divisor is 0 or either side is missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """Ratio as double; NULL where the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


NO_FRACTION = 9e15  # doubles of at least 2**53 are whole numbers


def on_grid(value: Column) -> Column:
    """A double rounded half up to a whole decimal; larger ones than a bigint holds are whole already."""
    return F.when(F.abs(value) < NO_FRACTION, F.floor(value + 0.5).cast("decimal(38,0)")).otherwise(value.cast("decimal(38,0)"))


def fixed_sum(value: Column, digits: int = 9) -> Column:
    """Sum of doubles on a decimal grid of ``digits`` places: the same total for any partition order."""
    scale = float(10**digits)
    return F.sum(on_grid(value * scale)).cast("double") / scale


def round4(value: Column) -> Column:
    """Double rounded to four decimals, half up; one too large for four decimals stays as it is."""
    return F.when(F.abs(value) < NO_FRACTION / 1e4, F.floor(value * 10000.0 + 0.5).cast("double") / 10000.0).otherwise(value)


def significant(value: Column, digits: int = 6) -> Column:
    """Double to so many significant digits, so that the smallest probabilities keep theirs."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits - 1}e", value).cast("double"))


DRAW_RANGE = 2**32


def key_digest(key: Column, salt: str) -> Column:
    """32 hex digits that depend on the key and the salt only; gives up to four draws."""
    return F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")).cast("binary"))


def draw(digest: Column, slot: int = 0) -> Column:
    """Repeatable draw in 0 .. 2^32-1 from the slot-th group of eight hex digits."""
    return F.conv(F.substring(digest, 1 + 8 * slot, 8), 16, 10).cast("bigint")


def cut_points(weights: Sequence[str]) -> list[int]:
    """Upper ends of the draw intervals for the running sums of ``weights``."""
    total, cuts = Decimal(0), []
    for w in weights:
        total += Decimal(w)
        cuts.append(int(total * DRAW_RANGE))
    return cuts


def weighted_choice(drawn: Column, choices: Sequence, weights: Sequence[str]) -> Column:
    """The choice whose cumulative weight interval holds the draw; the last choice takes the rest."""
    out = F.lit(choices[-1])
    for choice, cut in reversed(list(zip(choices[:-1], cut_points(weights)))):
        out = F.when(drawn < cut, F.lit(choice)).otherwise(out)
    return out
