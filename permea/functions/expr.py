"""Small null-safe column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number pattern for text -> double coercion.  Spark's cast also accepts
# suffixes such as '1d' or '2f'; pandas' to_numeric does not, so guard first.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo: float | None = None, hi: float | None = None) -> Column:
    """``np.clip`` that keeps NULL as NULL (least/greatest skip nulls)."""
    c = col(c)
    e = c
    if lo is not None:
        e = F.greatest(e, F.lit(float(lo)))
    if hi is not None:
        e = F.least(e, F.lit(float(hi)))
    return F.when(c.isNotNull(), e)


def to_number(c) -> Column:
    """Text or number -> double; anything that is not a plain number -> NULL."""
    c = col(c)
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def r6(c) -> Column:
    """Round a double to 6 places (stable output for cross-engine checks)."""
    return F.round(col(c), 6)


def safe_corr(x, y, eps: float = 1e-12) -> Column:
    """Pearson correlation, NULL when either side is (nearly) constant.

    Written as ``covar_pop / (sd_x * sd_y)`` with ``try_divide``: under ANSI
    mode the built-in ``corr`` raises on a zero variance even inside a CASE,
    because the aggregate result is evaluated as a common sub-expression.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()            # pairwise-complete rows only
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > eps) & (sy > eps), F.try_divide(F.covar_pop(x, y), sx * sy))
