"""Raw map elements with tags to silver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelore import params as P
from placelore.functions import geo
from placelore.functions.roads import ref_roads, valid_road
from placelore.operators import lookup
from placelore.schema import BUILDING, INNER, ISLAND, LARGE, LARGE_AREA, MAJOR_ROAD, MEDIUM, MEDIUM_ROAD, MINOR_ROAD, NODE, OUTER, RELATION, SMALL, WATER, WAY

NAME_KEY = "^(name|(alt|old|loc|short|official)_name)(:.*)?$"
PLACE_CLASS = {LARGE: ("city", "municipality"), MEDIUM: ("borough", "suburb", "town", "village"), SMALL: ("quarter", "neighbourhood", "hamlet", "isolated_dwelling"), ISLAND: ("island",)}
NO_NAMES = ("county", "municipality", "traffic_sign")
HIGHWAY_CLASS = {MAJOR_ROAD: ("motorway", "trunk", "primary"), MEDIUM_ROAD: ("secondary", "tertiary"), MINOR_ROAD: ("unclassified", "residential", "service")}
ROAD_HIGHWAYS = ("primary", "secondary", "tertiary", "trunk", "motorway")


def _tag(key: str) -> Column:
    return F.col("tags")[key]


def _any(key: str, classes: dict) -> Column | None:
    out = None
    for code, values in classes.items():
        out = F.when(_tag(key).isin(*values), code) if out is None else out.when(_tag(key).isin(*values), code)
    return out


def node_class() -> Column:
    """A natural water outranks the place tag; nothing known is 0."""
    return F.coalesce(F.when(_tag("natural") == "water", WATER), _any("place", PLACE_CLASS), F.lit(0)).cast("int")


def way_class() -> Column:
    return F.coalesce(F.when(_tag("natural") == "water", WATER), F.when(_tag("place") == "island", ISLAND), _any("highway", HIGHWAY_CLASS), F.when(_tag("building").isNotNull(), BUILDING), F.lit(0)).cast("int")


def relation_class() -> Column:
    return F.coalesce(
        F.when(_tag("building").isNotNull(), BUILDING), F.when(_tag("place") == "island", ISLAND), F.when(_tag("natural") == "water", WATER),
        F.when((_tag("type") == "route") & (_tag("route") == "road"), MAJOR_ROAD), F.when(_tag("boundary") == "administrative", LARGE_AREA), F.lit(0),
    ).cast("int")


def all_names(elements: DataFrame, foreign: tuple[str, ...] = P.FOREIGN) -> DataFrame:
    """elements: (elem_type, elem_id, rwt, tags). (…, key, name): every usable name, a value once for an element.

    Names of one byte and names in foreign languages are left out; of equal values the first key in order stays.
    """
    keys = F.map_filter("tags", lambda k, v: k.rlike(NAME_KEY))
    rows = elements.select("elem_type", "elem_id", "rwt", F.explode(keys).alias("key", "name"))
    last = F.element_at(F.split("key", ":"), -1)
    good = rows.where((F.octet_length("name") >= 2) & ~((F.size(F.split("key", ":")) > 1) & last.isin(*foreign)))
    return good.groupBy("elem_type", "elem_id", "rwt", "name").agg(F.min("key").alias("key"))


def best_name(names: DataFrame) -> DataFrame:
    """The plain name if there is one, else the first by key."""
    return names.groupBy("elem_type", "elem_id", "rwt").agg(F.min_by("name", F.struct(F.col("key") != "name", "key")).alias("name"))


def nodes(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("node_id"), geo.encode_x(F.col("lon")).alias("x"), geo.encode_y(F.col("lat")).alias("y"))


def without(rows: DataFrame, key: str, ids: tuple[int, ...]) -> DataFrame:
    """Rows whose id is not on a list of a few hundred."""
    return rows.where(~F.col(key).isin(*ids)) if ids else rows


def named_elements(nodes_raw: DataFrame, ways_raw: DataFrame, relations_raw: DataFrame, skip_relations: tuple[int, ...] = P.SKIP_RELATIONS) -> DataFrame:
    """(elem_type, elem_id, rwt, tags) of elements that may have names."""
    n = nodes_raw.where(~F.coalesce(_tag("place").isin(*NO_NAMES) | (_tag("highway") == "traffic_sign") | (_tag("traffic_sign").isNotNull()), F.lit(False)))
    w = ways_raw.where(F.size("refs") >= 2)
    r = without(relations_raw, "id", skip_relations)
    part = lambda df, kind, rwt: df.select(F.lit(kind).alias("elem_type"), F.col("id").alias("elem_id"), rwt.alias("rwt"), "tags")
    return part(n, NODE, node_class()).union(part(w, WAY, way_class())).union(part(r, RELATION, relation_class()))


def way_nodes(raw: DataFrame) -> DataFrame:
    """Ways of two nodes or more, a row for each place."""
    return raw.where(F.size("refs") >= 2).select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id")).withColumn("pos", F.col("pos") + 1)


def relation_members(raw: DataFrame) -> DataFrame:
    kind = F.when(F.col("m.type") == "node", NODE).when(F.col("m.type") == "way", WAY).when(F.col("m.type") == "relation", RELATION).otherwise(0)
    role = F.when(F.col("m.role") == "outer", OUTER).when(F.col("m.role") == "inner", INNER).otherwise(0)
    rows = raw.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("pos", "m"))
    return rows.select("rel_id", (F.col("pos") + 1).alias("pos"), kind.alias("member_type"), F.col("m.ref").alias("member_id"), role.alias("role_flags"))


def road_ways(raw: DataFrame, skip: tuple[int, ...] = P.SKIP_WAYS) -> DataFrame:
    """Roads under each number of their ref tag."""
    able = without(raw, "id", skip).where(_tag("ref").isNotNull() & _tag("highway").isin(*ROAD_HIGHWAYS) & (F.size("refs") >= 2))
    rows = able.select(F.col("id").alias("way_id"), F.explode_outer(ref_roads(_tag("ref"))).alias("r")).where("r IS NOT NULL")
    return rows.select("r.road_type", "r.number", "way_id").where(valid_road(F.col("way_id"), F.col("road_type"), F.col("number"), skip))


def scb_areas(raw: DataFrame) -> DataFrame:
    """One relation for an area code: the smallest id."""
    code = F.regexp_extract(F.coalesce(_tag("ref:scb"), _tag("ref:se:scb"), F.lit("")), "^([0-9]{1,4})$", 1)
    return raw.select(F.when(code != "", code.cast("int")).alias("code"), F.col("id").alias("rel_id")).where("code IS NOT NULL").groupBy("code").agg(F.min("rel_id").alias("rel_id"))


def nuts3_areas(raw: DataFrame) -> DataFrame:
    code = F.regexp_extract(F.coalesce(_tag("ref:nuts:3"), F.lit("")), "^SE([0-9]+)$", 1)
    return raw.select(F.when(code != "", code.cast("int")).alias("code"), F.col("id").alias("rel_id")).where("code IS NOT NULL").groupBy("code").agg(F.min("rel_id").alias("rel_id"))


def admin_regions(raw: DataFrame, skip: tuple[int, ...] = P.SKIP_ADMIN) -> DataFrame:
    named = raw.where(_tag("boundary").isin("administrative", "historic")).select(F.col("id").alias("rel_id"), F.expr("try_cast(tags['admin_level'] as int)").alias("admin_level"), _tag("name").alias("name"))
    return lookup.admin_regions(named.where("name IS NOT NULL AND admin_level IS NOT NULL"), skip)


def offset_union(files: list[tuple[DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Several maps as one: ids of each are moved behind those before, members and references along with them."""
    out: list[DataFrame] | None = None
    base = 0
    for n, w, r in files:
        shift = F.lit(base).cast("long")
        moved = [
            n.withColumn("id", F.col("id") + shift),
            w.withColumn("id", F.col("id") + shift).withColumn("refs", F.transform("refs", lambda x: x + shift)),
            r.withColumn("id", F.col("id") + shift).withColumn("members", F.transform("members", lambda m: F.struct(m["type"].alias("type"), (m["ref"] + shift).alias("ref"), m["role"].alias("role")))),
        ]
        out = moved if out is None else [a.unionByName(b) for a, b in zip(out, moved, strict=True)]
        base += 1 + max(df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for df in (n, w, r))
    assert out, "no files"
    return tuple(out)


def build(nodes_raw: DataFrame, ways_raw: DataFrame, relations_raw: DataFrame) -> dict[str, DataFrame]:
    """All silver tables but region_rings (see polygons)."""
    names = all_names(named_elements(nodes_raw, ways_raw, relations_raw))
    w = way_nodes(ways_raw)
    return {
        "nodes": nodes(nodes_raw),
        "way_nodes": w,
        "relation_members": relation_members(relations_raw),
        "names": best_name(names),
        "name_index": lookup.name_index(names),
        "road_ways": road_ways(ways_raw),
        "admin_regions": admin_regions(relations_raw),
        "scb_areas": scb_areas(relations_raw),
    }
