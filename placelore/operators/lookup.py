"""Lookups: phrases to elements, elements to points, points to roads and regions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from placelore.functions import geo
from placelore.functions.text import admin_name, code_key, index_phrases, normalise, split_keys, tokens
from placelore.schema import NO_ROAD, NODE, REGIONAL, RELATION, ROAD_TYPES, WAY
from placelore.scratch import table
from placelore.shipping import ship

#: Grid cells in which regions are looked up: bits of a side.
CELL = 16
#: Nodes of a road from which points look for the nearest by tiles. Changes the work, never the result.
MANY = 4096


def name_index(names: DataFrame) -> DataFrame:
    """(code_key, elem_type, elem_id, rwt, seq): every name under its long runs of words. seq keeps the order of insertion."""
    # dealt anew: names are few bytes in few files, and their folding is far more work than that
    words = names.repartition("elem_type", "elem_id").select("elem_type", "elem_id", "rwt", tokens(F.col("name")).alias("words"))
    words = words.withColumn("keys", split_keys(F.col("words")))
    runs = words.select("elem_type", "elem_id", "rwt", F.posexplode_outer(index_phrases(F.col("keys"))).alias("nth", "code_key")).where("code_key IS NOT NULL")
    return runs.select("code_key", "elem_type", "elem_id", "rwt", (F.col("elem_id") * 64 + F.col("nth")).alias("seq"))


def hits(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """Elements of each phrase; phrases: (query_id, phrase, ...). Computed once and shared by all strategies."""
    return phrases.withColumn("code_key", code_key(F.col("phrase"))).join(index, "code_key")


def payload(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner lookup by id: rows without an entry are left out."""
    return ids.join(table, key)


def counter(way_nodes: DataFrame) -> DataFrame:
    """How many ways use each node."""
    return way_nodes.groupBy("node_id").agg(F.countDistinct("way_id").alias("uses"))


def best_names(elements: DataFrame, names: DataFrame) -> DataFrame:
    return elements.join(names.select("elem_type", "elem_id", "name"), ["elem_type", "elem_id"], "left")


def flat_members(members: DataFrame) -> DataFrame:
    """(rel_id, member_type, member_id): nodes and ways of a relation, through nested relations of any depth. Cycles end too."""
    step = members.select("rel_id", "member_type", "member_id")
    nested = members.where(F.col("member_type") == RELATION).select(F.col("rel_id").alias("parent"), F.col("member_id").alias("child")).distinct()
    front = held = table(nested.select(F.col("parent").alias("rel_id"), F.col("child").alias("at")), "nested")
    while not front.isEmpty():  # until a round reaches no relation that was not reached before
        further = front.join(nested, front["at"] == nested["parent"]).select("rel_id", F.col("child").alias("at")).distinct()
        front = table(further.join(held, ["rel_id", "at"], "left_anti"), "nested")
        held = held.union(front)
    found = held.join(step.withColumnRenamed("rel_id", "at"), "at").select("rel_id", "member_type", "member_id")
    return step.union(found).where(F.col("member_type") != RELATION).distinct()


def sampled(way_nodes: DataFrame) -> DataFrame:
    """The nodes that stand for a way: ends, middle, quarters and eighths, more of them the longer it is."""
    n = F.count("*").over(Window.partitionBy("way_id"))
    at, half = F.col("pos") - 1, lambda k, of: F.floor(F.col("n") * k / of)
    q = F.floor(F.col("n") / 4)
    e = F.floor(F.col("n") / 8)
    keep = (
        (at == 0)
        | (at == F.col("n") - 1)
        | ((F.col("n") > 3) & (at == half(1, 2)))
        | ((F.col("n") > 6) & ((at == q) | (at == half(3, 4))))
        | ((F.col("n") > 12) & ((at == e) | (at == half(3, 8)) | (at == half(5, 8)) | (at == half(7, 8))))
    )
    return way_nodes.withColumn("n", n).where(keep).select("way_id", "node_id").distinct()


def element_nodes(elements: DataFrame, way_nodes: DataFrame, members: DataFrame, sample: bool, relations: bool = True) -> DataFrame:
    """(elem_type, elem_id, node_id) of distinct elements: sample takes the standing nodes of ways only."""
    ways = sampled(way_nodes) if sample else way_nodes.select("way_id", "node_id")
    e = elements.select("elem_type", "elem_id").distinct()
    own = e.where(F.col("elem_type") == NODE).select("elem_type", "elem_id", F.col("elem_id").alias("node_id"))
    of_way = e.where(F.col("elem_type") == WAY).join(ways, F.col("elem_id") == ways["way_id"]).select("elem_type", "elem_id", "node_id")
    # each part is made distinct by itself: that of ways lies as its join dealt it, so its many rows are not dealt once more
    out = own.union(of_way if sample else of_way.distinct())
    if relations:
        rel = e.where(F.col("elem_type") == RELATION).join(members, F.col("elem_id") == F.col("rel_id")).select("elem_type", "elem_id", "member_type", "member_id")
        of_rel = rel.where(F.col("member_type") == NODE).select("elem_type", "elem_id", F.col("member_id").alias("node_id"))
        of_rel = of_rel.union(rel.where(F.col("member_type") == WAY).join(ways, F.col("member_id") == ways["way_id"]).select("elem_type", "elem_id", "node_id"))
        out = out.union(of_rel.distinct())
    return out


def centres(elements: DataFrame, nodes: DataFrame, way_nodes: DataFrame, flat: DataFrame) -> DataFrame:
    """(elem_type, elem_id, x, y): mean of an element's standing nodes; none for elements without known nodes."""
    at = element_nodes(elements, way_nodes, flat, sample=True).join(nodes, "node_id")
    mean = lambda c: F.floor(F.sum(F.col(c).cast("long")) / F.count("*")).cast("int").alias(c)
    return at.groupBy("elem_type", "elem_id").agg(mean("x"), mean("y"))


def representative(elements: DataFrame, way_nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(elem_type, elem_id, node_id): the middle member of a relation, the middle node of a way, until a node is reached.

    Relations nested to any depth are followed; one whose middle members lead back to itself has none.
    """
    mid_way = way_nodes.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("a")).select("way_id", F.element_at("a", (F.floor(F.size("a") / 2) + 1).cast("int"))["node_id"].alias("next"))
    mid_rel = members.groupBy("rel_id").agg(F.sort_array(F.collect_list(F.struct("pos", "member_type", "member_id"))).alias("a")).select("rel_id", F.element_at("a", (F.floor(F.size("a") / 2) + 1).cast("int")).alias("m"))
    now = elements.select("elem_type", "elem_id").distinct().withColumn("t", F.col("elem_type")).withColumn("i", F.col("elem_id").cast("long"))
    mid = table(mid_rel.select("rel_id", F.col("m.member_type").cast("int").alias("to_t"), F.col("m.member_id").alias("to_i")), "middles")
    ends, hops = mid.where(F.col("to_t") != RELATION), mid.where(F.col("to_t") == RELATION).select("rel_id", F.col("to_i").alias("at"))
    for _ in range(hops.count().bit_length()):  # pointers double their reach; what is left then goes in circles
        further = hops.select(F.col("rel_id").alias("at"), F.col("at").alias("next"))
        step = table(hops.join(ends.withColumnRenamed("rel_id", "at"), "at", "left").join(further, "at", "left"), "middles")
        ends = ends.union(step.where("to_t IS NOT NULL").select("rel_id", "to_t", "to_i"))
        hops = step.where("to_t IS NULL AND next IS NOT NULL").select("rel_id", F.col("next").alias("at"))
    r = now.join(ends, (F.col("t") == RELATION) & (F.col("i") == F.col("rel_id")), "left")
    done = r.select("elem_type", "elem_id", F.coalesce("to_t", "t").alias("t"), F.coalesce("to_i", "i").alias("i"))
    w = done.join(mid_way, (F.col("t") == WAY) & (F.col("i") == F.col("way_id")), "left")
    return w.select("elem_type", "elem_id", F.when(F.col("t") == NODE, F.col("i")).otherwise(F.col("next")).alias("node_id")).where("node_id IS NOT NULL")


def road_nodes(road_ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(road_type, number, way_id, pos, node_id, x, y)."""
    return road_ways.join(way_nodes, "way_id").join(nodes, "node_id")


def closest_on_way(points: DataFrame, way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """points: (way_id, px, py). The nearest node of each way, the first one on ties."""
    d2 = geo.squared_dm(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    at = points.join(way_nodes, "way_id").join(nodes, "node_id").withColumn("d2", d2)
    return at.groupBy("way_id", "px", "py").agg(F.min(F.struct("d2", "pos", "node_id")).alias("m")).select("way_id", "px", "py", "m.node_id", "m.d2")


def closest_road_node(points: DataFrame, at_roads: DataFrame) -> DataFrame:
    """points: (key, px, py, road_type, number). The nearest node of the road; an unknown county looks in all of them.

    Returns key, road_type, number, found_type, node_id, x, y, metres.
    """
    p = table(points.select("key", "px", "py", "road_type", "number").distinct(), "points")
    each = p.withColumn("group", F.concat_ws("/", "key", "px", "py"))
    return nearest_by_road(each, at_roads, p.select("road_type", "number").distinct()).drop("group")


def nearest_by_road(points: DataFrame, at_roads: DataFrame, asked: DataFrame) -> DataFrame:
    """points: (group, key, px, py, road_type, number); asked: their distinct (road_type, number).

    Of each group and road the key whose nearest node of the road is nearest, by metres, then key: group, key, road_type,
    number, found_type, node_id, x, y, metres. The points and the nodes of a road meet in one task as arrays, so that pairs
    of them are never rows; of a road with more than MANY nodes a tile of points meets only those that can be nearest.
    """
    ship(points.sparkSession)
    r = at_roads.select(F.col("road_type").alias("found_type"), "number", "way_id", "pos", "node_id", "x", "y")
    # an unknown county stands for the roads of all: one join, so that the nodes of roads are read and dealt once
    every = F.array(*(F.lit(code) for code in (*(t[0] for t in ROAD_TYPES if t[0] > 1), NO_ROAD)))
    links = asked.select("road_type", "number", F.explode(F.when(F.col("road_type") == REGIONAL, every).otherwise(F.array("road_type"))).alias("found_type"))
    r = r.join(links, ["found_type", "number"])
    r = r.select(*(F.col(c).alias(f"at_{c}" if c in ("road_type", "number") else c) for c in r.columns))
    p = points.where("px IS NOT NULL AND py IS NOT NULL").select("group", "key", "px", "py", "road_type", "number")
    made = StructType([p.schema[c] for c in ("group", "key", "road_type", "number")] + [r.schema[c] for c in ("found_type", "node_id", "x", "y")] + [StructField("metres", LongType())])
    made = StructType([StructField(f.name, f.dataType) for f in made])
    return p.groupBy("road_type", "number").cogroup(r.groupBy("at_road_type", "at_number")).applyInArrow(_meet(to_arrow_schema(made), MANY), made)


def _meet(made: pa.Schema, many: int):
    def go(p: pa.Table, r: pa.Table) -> pa.Table:
        if not p.num_rows or not r.num_rows:
            return made.empty_table()
        ints = lambda t, c: t.column(c).to_numpy().astype(np.int64)
        x, y = ints(r, "x"), ints(r, "y")
        # in the order that decides ties, each place once: of equal distances the first stands before the others
        order = np.lexsort([ints(r, c) for c in ("node_id", "pos", "way_id", "found_type")])
        _, first = np.unique(np.stack([x[order], y[order]], 1), axis=0, return_index=True)
        order = order[np.sort(first)]
        px, py = ints(p, "px"), ints(p, "py")
        at, d2 = nearest(px, py, x[order], y[order], many)
        metres = np.floor(np.sqrt(d2.astype(np.float64)) / 10 + 0.5).astype(np.int64)
        group = p.column("group").combine_chunks().dictionary_encode()
        group = (group.combine_chunks() if isinstance(group, pa.ChunkedArray) else group).indices.to_numpy()
        best = np.lexsort([p.column("key").to_numpy(), metres, group])
        best = best[np.r_[True, group[best][1:] != group[best][:-1]]]
        mine, theirs = p.take(pa.array(best)), r.take(pa.array(order[at[best]]))
        cols = [mine.column(c) for c in ("group", "key", "road_type", "number")] + [theirs.column(c) for c in ("found_type", "node_id", "x", "y")] + [pa.array(metres[best])]
        return pa.table([c.cast(f.type) for c, f in zip(cols, made, strict=True)], schema=made)

    return go


def nearest(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, many: int = MANY) -> tuple[np.ndarray, np.ndarray]:
    """For each point the first of the nearest places (x, y), and the square of its distance; exact."""
    at = np.empty(len(px), np.int64)
    if len(x) <= many or len(px) < 2:
        for i in range(0, len(px), size := max(1, (1 << 20) // len(x))):
            at[i : i + size] = _first_nearest(px[i : i + size], py[i : i + size], x, y)
    else:
        side = max(1, int(np.sqrt((float(np.ptp(px)) + 1) * (float(np.ptp(py)) + 1) * 64 / len(px))))
        tx, ty = px // side, py // side
        order = np.lexsort((ty, tx))
        cut = np.flatnonzero(np.r_[True, (np.diff(tx[order]) != 0) | (np.diff(ty[order]) != 0)])
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            mine = order[i:j]
            ax, bx, ay, by = px[mine].min(), px[mine].max(), py[mine].min(), py[mine].max()
            # what is nearest to a point of the tile is no further from its middle than the nearest there and the tile's diagonal
            far = np.hypot(x - (ax + bx) / 2, y - (ay + by) / 2)
            able = np.flatnonzero(far <= (far.min() + np.hypot(float(bx - ax), float(by - ay))) * (1 + 1e-9) + 1)
            for k in range(0, len(mine), size := max(1, (1 << 20) // len(able))):
                some = mine[k : k + size]
                at[some] = able[_first_nearest(px[some], py[some], x[able], y[able])]
    dx, dy = px - x[at], py - y[at]
    return at, dx * dx + dy * dy


def _first_nearest(px, py, x, y) -> np.ndarray:
    if max(np.abs(a).max() for a in (px, py, x, y)) < 1 << 25:  # then every sum is a whole number that a double holds
        fx, fy = x.astype(np.float64), y.astype(np.float64)
        return np.argmin(np.stack([-2.0 * px, -2.0 * py, np.ones(len(px))], 1) @ np.stack([fx, fy, fx * fx + fy * fy]), axis=1)
    dx, dy = px[:, None] - x, py[:, None] - y
    return np.argmin(dx * dx + dy * dy, axis=1)


def region_cells(rings: DataFrame, bits: int = CELL) -> DataFrame:
    """(rel_id, cx, cy, edge): the grid cells that a region may reach into; edge: an edge's box touches the cell.

    A cell that no edge touches lies in the region as a whole or not at all: its middle tells, and cells outside are left out.
    """
    cell = lambda c: F.shiftright(c.cast("long"), bits)
    span = lambda a, b: F.explode(F.sequence(cell(F.least(a, b)), cell(F.greatest(a, b))))
    ring = rings.select("rel_id", F.explode("rings").alias("ring"))
    before = F.concat(F.slice("ring", -1, 1), F.slice("ring", F.lit(1), F.greatest(F.size("ring") - 1, F.lit(0))))
    edge = ring.select("rel_id", F.explode(F.arrays_zip(F.col("ring").alias("a"), before.alias("b"))).alias("e")).select("rel_id", "e.a", "e.b")
    touched = edge.withColumn("cx", span(F.col("a.x"), F.col("b.x"))).withColumn("cy", span(F.col("a.y"), F.col("b.y"))).select("rel_id", "cx", "cy").distinct()
    every = rings.withColumn("cx", span(F.col("minx"), F.col("maxx"))).withColumn("cy", span(F.col("miny"), F.col("maxy")))
    mid = lambda c: F.shiftleft(c, bits) + F.lit(1 << (bits - 1))
    whole = every.join(touched, ["rel_id", "cx", "cy"], "left_anti").where(geo.in_rings(mid(F.col("cx")), mid(F.col("cy")), F.col("rings")))
    return touched.withColumn("edge", F.lit(True)).unionByName(whole.select("rel_id", "cx", "cy", F.lit(False).alias("edge")))


def regions_at(points: DataFrame, rings: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """points with the rel_id of every region that holds them, and the other columns of rings.

    Points and regions meet on grid cells; only points in cells that a region's edge touches are held against its rings.
    """
    px, py = F.col(x), F.col(y)
    cell = lambda c: F.shiftright(c.cast("long"), CELL)
    at = points.withColumn("cx", cell(px)).withColumn("cy", cell(py)).join(region_cells(rings), ["cx", "cy"]).drop("cx", "cy")
    rest = [c for c in rings.columns if c not in ("rel_id", "minx", "miny", "maxx", "maxy", "rings")]
    sure = at.where("NOT edge").join(rings.select("rel_id", *rest), "rel_id")
    near = at.where("edge").join(rings.select("rel_id", "rings", *rest), "rel_id").where(geo.in_rings(px, py, F.col("rings"))).drop("rings")
    return sure.unionByName(near).drop("edge")


def area_codes(points: DataFrame, rings: DataFrame, areas: DataFrame, county: bool | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Reverse geocoding: each point's smallest area code, -1 if none. county: only counties, or only municipalities."""
    level = F.lit(True) if county is None else (F.col("code") < 100 if county else F.col("code") >= 100)
    at = points.select(x, y).distinct()
    found = regions_at(at, rings.join(areas.where(level), "rel_id"), x, y).groupBy(x, y).agg(F.min("code").alias("code"))
    return points.join(found, [x, y], "left").withColumn("code", F.coalesce("code", F.lit(-1)))


def areas_of(points: DataFrame, rings: DataFrame, areas: DataFrame) -> DataFrame:
    """All codes whose area holds the point, joined by commas in order."""
    found = regions_at(points, rings.join(areas, "rel_id"))
    return found.groupBy("x", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_set("code")), lambda c: c.cast("string")), ",").alias("codes"))


def ways_of_road(road_ways: DataFrame, road_type: int, number: int) -> DataFrame:
    return road_ways.where((F.col("road_type") == road_type) & (F.col("number") == number)).select("way_id")


def repaired_roads(road_ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame, rings: DataFrame, areas: DataFrame) -> DataFrame:
    """Regional roads of no known county get the county in which the middle node of their way lies."""
    from placelore.functions.roads import type_of_area

    open_ = road_ways.where(F.col("road_type") == REGIONAL)
    mid = representative(open_.select(F.lit(WAY).alias("elem_type"), F.col("way_id").alias("elem_id")), way_nodes.join(open_.select("way_id").distinct(), "way_id", "left_semi"), _no_members(way_nodes)).select(F.col("elem_id").alias("way_id"), "node_id")
    at = area_codes(mid.join(nodes, "node_id"), rings, areas, county=True).select("way_id", F.when(F.col("code") > 0, type_of_area(F.col("code"))).alias("fixed"))
    return road_ways.join(at, "way_id", "left").select(F.when(F.col("road_type") == REGIONAL, F.coalesce("fixed", "road_type")).otherwise(F.col("road_type")).cast("int").alias("road_type"), "number", "way_id")


def _no_members(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], "rel_id long, pos int, member_type int, member_id long")


def admin_regions(named: DataFrame, skip: tuple[int, ...] = ()) -> DataFrame:
    """named: (rel_id, admin_level, name). Usable regions under their plain names."""
    ok = named.where((F.col("admin_level") > 0) & (F.col("admin_level") < 8) & (F.octet_length("name") > 1))
    ok = ok.where(~F.col("rel_id").isin(*skip)) if skip else ok
    low = ok.select(normalise(F.col("name")).alias("low"), "admin_level", "rel_id")
    # never null, so a join's null filter does not work the expression once more
    return low.select(F.coalesce(admin_name(F.col("low")), F.lit("")).alias("norm_name"), "admin_level", "rel_id")


def admin_by_name(regions: DataFrame) -> DataFrame:
    """One region for a name: the widest level, then the smallest id."""
    return regions.groupBy("norm_name").agg(F.min(F.struct("admin_level", "rel_id")).alias("m")).select("norm_name", "m.admin_level", "m.rel_id")


def identified_regions(phrases: DataFrame, regions: DataFrame) -> DataFrame:
    """(query_id, rel_id, admin_level, norm_name): regions that a query's phrases name, each once."""
    found = phrases.join(admin_by_name(regions), F.col("phrase") == F.col("norm_name"))
    return found.groupBy("query_id", "rel_id", "admin_level").agg(F.min("norm_name").alias("norm_name"))

