"""Qualities, weights and texts of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelore import params as P
from placelore.functions.roads import _choose
from placelore.schema import LARGE, SMALL


def road_quality(metres: Column) -> Column:
    """1 up to a kilometre, falling by the logarithm to 0 at a hundred."""
    return F.when(metres <= 1000, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (F.log10(F.greatest(metres, F.lit(1)).cast("double")) - 3.0) / 2.0)))


def type_quality(rwt: Column) -> Column:
    return _choose(rwt, list(P.TYPE_QUALITY.items()), F.lit(0.5))


def position_quality(position: Column, length: Column) -> Column:
    """Where in a phrase the wider name stands: later is better; 1 if it does not occur. May exceed 1."""
    return F.when(position < 0, F.lit(1.0)).otherwise(position.cast("double") / (length - position + 1))


def local_quality(position: Column, length: Column, rwt: Column) -> Column:
    return position_quality(position, length) * type_quality(rwt)


def admin_quality(position: Column, length: Column, rwt: Column, level: Column) -> Column:
    q = position_quality(position, length)
    factor = F.when(rwt.between(LARGE, SMALL), F.lit(1.0)).otherwise(F.lit(0.9)) * (F.least(F.lit(9), F.greatest(F.lit(2), level)) + 18) / 27
    return F.when(q > 0, q * factor).otherwise(q)


def unique_quality(rwt: Column, metres: Column) -> Column:
    far = (4.5 - F.log10(F.greatest(metres, F.lit(1)).cast("double"))) / 1.5
    return type_quality(rwt) * F.when(metres > P.UNIQUE_SURE, far).otherwise(F.lit(1.0))


def crossing_score(length_a: Column, length_b: Column) -> Column:
    return length_a * length_a + length_b * length_b


def fallback_quality(rwt: Column) -> Column:
    return F.lit(P.FALLBACK_WEIGHT) * _choose(rwt, list(P.FALLBACK_RANK.items()), F.lit(0.0))


def stride(n: Column) -> Column:
    """How far apart partners are drawn from n nodes: the first step from n / partners on that does not divide n.

    At most eight numbers from n / 7 on divide n (its quotients by 1 to 8), so nine tries tell.
    """
    steps = partners(n)
    step = F.floor(n / steps)
    tried = F.filter(F.sequence(step, F.greatest(step, F.least(step + 8, n - 1))), lambda s: n % s != 0)
    return F.greatest(F.lit(1), F.least(n - 1, F.coalesce(F.get(tried, F.lit(0)), F.lit(1)))).cast("long")


def partners(n: Column) -> Column:
    return F.least(n - 1, F.lit(7), F.greatest(F.lit(1), F.floor(n / 2))).cast("long")


def element_text(elem_type: Column, elem_id: Column, rwt: Column) -> Column:
    kind = _choose(elem_type, [(1, "Node"), (2, "Way"), (3, "Relation")], F.lit("Unknown"))
    names = [(100, "PlaceLargeArea"), (105, "PlaceLarge"), (110, "PlaceMedium"), (115, "PlaceSmall"), (200, "RoadMajor"), (205, "RoadMedium"), (210, "RoadMinor"), (300, "Building"), (400, "Island"), (401, "Water")]
    return F.concat(kind, F.lit(" "), elem_id.cast("string"), F.lit(" of type "), _choose(rwt, names, F.lit("Unknown")))
