"""Scalar functions on names, text and nested values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a channel name says about its kind, in the order in which they are tried.
FLUORESCENT = r"(gfp|rfp|mcherry|dapi|cy5|tritc|fitc)"
LABEL_FREE = ["phase", "bf", "brightfield", "retardance", "dic"]


def channel_kind(name: Column) -> Column:
    """fluorescent, virtual, label_free, filter (EX/EM) or unknown."""
    low = F.lower(name)
    free = F.lit(False)
    for k in LABEL_FREE:
        free = free | F.contains(low, F.lit(k))
    return F.when(F.rlike(low, F.lit(FLUORESCENT)), "fluorescent").when(F.rlike(low, F.lit("virtual|predicted")), "virtual").when(free, "label_free").when(F.rlike(name, F.lit(r"(?i)\bex\d+.*em\d+")), "filter").otherwise("unknown")


def position_parts(path: Column) -> list[Column]:
    """Row, column and field of a position path, leading slashes dropped."""
    p = F.split(F.trim(F.regexp_replace(path, "^/+|/+$", "")), "/")
    return [F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("row", "col", "field"))]


def bbox_centre(box: Column) -> Column:
    """(y, x) centre of a box given as text, '(ymin, xmin, ymax, xmax)'; null if it isn't four numbers."""
    v = F.transform(F.split(F.regexp_replace(box, r"[()\s]", ""), ","), lambda x: x.try_cast("double"))
    ok = (F.size(v) == 4) & F.forall(v, lambda x: x.isNotNull())
    return F.when(ok, F.struct(((v[0] + v[2]) / 2).alias("y"), ((v[1] + v[3]) / 2).alias("x")))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(name)), "[^a-z0-9]+", "_")


def digest12(x: Column) -> Column:
    return F.left(F.sha2(x, 256), F.lit(12))


def first_given(*values: Column, default: str = "unknown") -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(default))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for a zero or missing denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def min_max(x: Column, low: Column, high: Column, eps: float = 1e-8) -> Column:
    """Clamped to low..high, then scaled to -1..1."""
    return 2 * (F.greatest(low, F.least(high, x)) - low) / (high - low + eps) - 1
