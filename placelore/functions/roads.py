"""Road labels in texts and in map data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelore import params as P
from placelore.schema import EAST_GOTHLAND, EUROPE, EUROPEAN, NATIONAL, NO_ROAD, REGIONAL, ROAD_TYPES

NUMBER = "^([1-9][0-9]*)"


def _choose(value: Column, pairs, other) -> Column:
    """A literal map; a chain of conditions, so it stays inside generated code."""
    out = None
    for k, v in pairs:
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(other)


def european(number: Column) -> Column:
    """Behind an E: a European road, or else one of East Gothland."""
    return F.when(number.isin(*EUROPEAN), F.lit(EUROPE)).otherwise(F.lit(EAST_GOTHLAND))


def letters_to_type(letters: Column, number: Column) -> Column:
    """County letters in lower case to the road type; unknown letters to NO_ROAD."""
    pairs = [(short.lower(), code) for code, short, _, area in ROAD_TYPES if area is not None and short != "E"]
    return F.when(letters == "e", european(number)).otherwise(_choose(letters, pairs, F.lit(NO_ROAD)))


def short_name(road_type: Column) -> Column:
    return _choose(road_type, [(code, short) for code, short, _, _ in ROAD_TYPES], F.lit("???"))


def long_name(road_type: Column) -> Column:
    return _choose(road_type, [(code, name) for code, _, name, _ in ROAD_TYPES], F.lit("Unknown"))


def type_of_area(code: Column) -> Column:
    """The road type of a county; a municipality's code begins with its county's."""
    county = F.when(code > 100, F.floor(code / 100)).otherwise(code)
    return _choose(county, [(area, road) for road, _, _, area in ROAD_TYPES if area is not None], F.lit(REGIONAL))


def _number(word: Column) -> Column:
    digits = F.regexp_extract(word, NUMBER, 1)
    return F.when(digits != "", F.pmod(F.substring(digits, 1, 9).cast("long"), F.lit(65536)).cast("int")).otherwise(0)


def road_labels(words: Column) -> Column:
    """Distinct (road_type, number) named by a text's words, in order.

    A county letter (or two) and a number in the next word; both in one word; or a word for a national or county road and a
    number in the next word: below 500 a national one, else a regional one whose county is unknown.
    """
    n = F.size(words)

    def label(i: Column) -> Column:
        w, after = F.get(words, i), F.coalesce(F.get(words, i + 1), F.lit(""))
        follows = after.rlike("^[1-9]")
        apart = w.rlike("^([a-z]|[ab][a-d])$") & follows
        one, two = w.rlike("^[a-z][1-9]"), w.rlike("^[ab][a-d][1-9]")
        named = w.isin(*P.ROAD_WORDS) & follows
        k1, k2, k3 = _number(after), _number(F.substring(w, F.lit(2), F.length(w))), _number(F.substring(w, F.lit(3), F.length(w)))
        number = F.when(apart | (named & ~one & ~two), k1).when(one, F.when(k2 < 9999, k2).otherwise(0)).when(two, k3).otherwise(0)
        letters = F.when(apart, w).when(one, F.substring(w, 1, 1)).when(two, F.substring(w, 1, 2))
        kind = F.when(apart | one | two, letters_to_type(letters, number)).when(named, F.when(number < 500, F.lit(NATIONAL)).otherwise(F.lit(REGIONAL))).otherwise(F.lit(NO_ROAD))
        return F.struct(kind.cast("int").alias("road_type"), number.cast("int").alias("number"))

    every = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), label)
    return F.array_distinct(F.filter(every, lambda r: (r["number"] > 0) & (r["road_type"] != NO_ROAD)))


def ref_roads(ref: Column) -> Column:
    """(road_type, number) of a map element's ref tag: parts split at ; or , with a letter prefix and one space, or bare.

    A link such as E 4.04 is the road itself. A part of another shape is passed over.
    """
    parts = F.transform(F.split(ref, "[;,]"), lambda p: F.trim(p))

    def road(p: Column) -> Column:
        letters = F.lower(F.regexp_extract(p, "^(A[BC]|BD|[CDEFGHIKMNOSTUWXYZ]) [1-9]", 1))
        number = F.substring(F.regexp_extract(p, "^(?:(?:A[BC]|BD|[CDEFGHIKMNOSTUWXYZ]) )?([1-9][0-9]*)", 1), 1, 9)
        number = F.when(number != "", number.cast("int")).otherwise(0)
        kind = F.when(letters != "", letters_to_type(letters, number)).when(number >= 500, F.lit(REGIONAL)).otherwise(F.lit(NATIONAL))
        return F.struct(kind.cast("int").alias("road_type"), number.alias("number"))

    return F.array_distinct(F.filter(F.transform(parts, road), lambda r: r["number"] > 0))


def valid_road(way_id: Column, road_type: Column, number: Column, skip: tuple[int, ...] = P.SKIP_WAYS) -> Column:
    """May the way be recorded under the road?"""
    odd = number.between(5300, 5399) & road_type.isin(REGIONAL, 20)
    size = F.when(road_type == EUROPE, number <= 9999).when(road_type == NATIONAL, number < 500).otherwise(number < 4096)
    known = ~way_id.isin(*skip) if skip else F.lit(True)
    return ~odd & (way_id != 0) & (road_type < NO_ROAD) & (number <= 9999) & size & known


def label_text(road_type: Column, number: Column) -> Column:
    """A road in short, such as AB 226."""
    return F.concat(short_name(road_type), F.lit(" "), number.cast("string"))
