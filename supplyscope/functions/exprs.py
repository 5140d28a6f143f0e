"""Column helpers.  All are built-in expressions, so they stay inside whole-stage codegen.

The null rules follow the pandas/numpy semantics of the original job:
a missing value never satisfies a comparison, and clipping a missing value keeps it missing
(``least(greatest(NULL, 0), 100)`` would otherwise give 0 in Spark).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(c: ColumnOrName) -> Column:
    """``CAST(x AS DATE)``."""
    return _c(c).cast("date")


def days_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole days from ``start`` to ``end`` (``end - start``)."""
    return F.datediff(as_date(end), as_date(start))


def year_month(d: ColumnOrName) -> Column:
    """``YYYY-MM`` key of a date."""
    return F.date_format(as_date(d), "yyyy-MM")


def month_of(d: ColumnOrName) -> Column:
    return F.month(as_date(d))


def weekday0(d: ColumnOrName) -> Column:
    """Day of week with Sunday = 0 … Saturday = 6."""
    return F.dayofweek(as_date(d)) - 1


def safe_ratio(num: ColumnOrName, den: ColumnOrName, scale: float = 1.0,
               default: float = 0.0) -> Column:
    """``num / den * scale`` where ``den > 0``, else ``default`` (missing ``den`` → default)."""
    n, d = _c(num), _c(den)
    q = n / d
    if scale != 1.0:
        q = q * F.lit(float(scale))
    return F.when(d > 0, q).otherwise(F.lit(float(default)))


def clip(c: ColumnOrName, lo: float, hi: float) -> Column:
    """numpy ``clip``: bounds the value, keeps a missing value missing."""
    x = _c(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def floor_at(c: ColumnOrName, lo: float) -> Column:
    """numpy ``maximum(c, lo)``: keeps a missing value missing."""
    x = _c(c)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(lo))))


def round1(c: ColumnOrName) -> Column:
    """Round to one decimal, ties to even on ``x * 10`` (pandas ``Series.round(1)``)."""
    return F.rint(_c(c) * 10.0) / 10.0


MICRO = 1_000_000
FEMTO = 1_000_000_000  # of a millionth: units of 1e-15
# A value within so many units (relative to its size) of a decimal of six places stands for that
# decimal: eight units in the last place, which products of three money factors stay within ...
_TIGHT = 2.0 ** -50
# ... and below this size the next such decimal is told apart.
_TELLABLE = 2.0 ** 28
_LIMB = 1 << 22
#: Parts of a money value, in order; all are longs, and sums of each add up to the total.
MONEY_PARTS = ("w", "m", "a", "b", "c")


def money_parts(c: ColumnOrName) -> list[Column]:
    """Split a double into whole units, millionths, and three limbs of 2^-22, 2^-44 and 2^-66, all ``long``.

    Each value is judged by itself, at every size: one that is a decimal of at most six places, to
    eight units in its last place, counts as that decimal (whole units and millionths); any other
    counts by its binary digits, down to 2^-66 (whole units and limbs).  So stored amounts and their
    products add up as decimals do, and no other digits are left out.  NaN is missing; a value beyond
    2^63 raises.  A limb stays below 2^22, so a sum holds 2e12 values that aren't such decimals."""
    x = F.nanvl(_c(c).cast("double"), F.lit(None).cast("double"))
    whole = x.cast("long")
    rest = x - whole  # exact, as both have the same sign
    scaled = rest * float(MICRO)
    micro = F.rint(scaled)
    size = F.abs(x)
    tight = (F.abs(scaled - micro) <= size * (_TIGHT * MICRO)) & ((size < _TELLABLE) | (rest == 0.0))
    loose = F.when(tight, F.lit(0.0)).otherwise(rest * float(_LIMB))
    a = loose.cast("long")
    second = (loose - a) * float(_LIMB)
    b = second.cast("long")
    return [whole, F.when(tight, micro).otherwise(F.lit(0.0)).cast("long"), a, b, F.rint((second - b) * float(_LIMB)).cast("long")]


def combine_money(sums: list[Column]) -> Column:
    """The total of summed ``money_parts`` to 15 decimals, as the nearest double (below 10^22; beyond, an error)."""
    big = "decimal(38,0)"
    whole, micro, a, b, c = (s.cast(big) for s in sums)
    limb, unit = F.lit(_LIMB).cast(big), F.lit(str(_LIMB ** 3)).cast(big)
    limbs = ((a * limb + b).cast(big) * limb + c).cast(big)
    # Whole units that limbs add up to, and their rest in units of 1e-15.
    over = F.floor(limbs / unit).cast(big)
    femto = F.round(((limbs - over * unit).cast(big) * F.lit(MICRO * FEMTO).cast(big)).cast(big) / unit).cast(big)
    total = (((whole + over).cast(big) * F.lit(MICRO).cast(big) + micro).cast(big) * F.lit(FEMTO).cast(big) + femto).cast(big)
    return F.concat(total.cast("string"), F.lit("e-15")).cast("double")


def exact_sum(c: ColumnOrName) -> Column:
    """Exact sum of a double (``money_parts`` says what each value counts as), to 15 decimals.

    The parts are summed as 64-bit integers (fixed-width buffers, so the aggregate stays a codegen
    hash aggregate with a map-side combine) and joined into one decimal per group.  The result
    does not depend on partitioning or task order, so a recomputed task gives the same bits."""
    return combine_money([F.sum(p) for p in money_parts(c)])


def exact_avg(c: ColumnOrName) -> Column:
    """Mean of a double: exact sum over the count of present values (NaN is missing)."""
    x = _c(c)
    n = F.count(F.nanvl(x.cast("double"), F.lit(None).cast("double")))
    return F.when(n > 0, exact_sum(x) / n)


def matches(c: ColumnOrName, text: str, literal: bool = False) -> Column:
    """Case-insensitive containment of ``text`` in ``c``; regex (``find``) unless ``literal``.

    ``text`` is expected lower-cased already; a missing value never matches."""
    s = F.lower(_c(c).cast("string"))
    m = s.contains(F.lit(text)) if literal else s.rlike(text)
    return F.coalesce(m, F.lit(False))


def format_currency(c: ColumnOrName) -> Column:
    """Compact money label: ``$1.23M``, ``$4.6K``, ``$7.89``; zero or missing → ``$0.00``.

    Formatting is half-up on the shortest decimal form of the value."""
    x = _c(c)
    return (F.when(x.isNull() | (x == 0) | F.isnan(x), F.lit("$0.00"))
            .when(x >= 1e6, F.format_string("$%.2fM", x / 1e6))
            .when(x >= 1e3, F.format_string("$%.1fK", x / 1e3))
            .otherwise(F.format_string("$%.2f", x)))


def fixed(c: ColumnOrName, digits: int) -> Column:
    """Number to text with ``digits`` decimals (half-up); a missing value stays missing."""
    x = _c(c)
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), F.format_string(f"%.{digits}f", x))


def shorten(c: ColumnOrName, n: int = 18) -> Column:
    """First ``n`` characters plus ``...`` when the text is longer."""
    x = _c(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def md5_key(keys: list[str], seed: int | str) -> Column:
    """Hex md5 of the keys' text joined by ``|`` with the seed last (layout independent)."""
    parts = [F.col(k).cast("string") for k in keys] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))
