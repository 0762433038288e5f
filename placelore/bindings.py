"""Silver tables and texts made from the driver's tables by arithmetic, so that DuckDB can make the same.

A map is derived from the star schema: parts are points, orders are ways over the parts of their lines, customers and nations
are relations, nations and regions have polygons on a grid, and every customer sends a text. Words are made from keys, so
that a word names a handful of elements at any scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELL = 800_000
X0, Y0 = 5_000_000, 4_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word(n: Column, head: str, tail: str) -> Column:
    """A pronounceable-enough word for a number, the same in every engine."""
    n = n.cast("long")
    letter = lambda d: F.substring(F.lit("abcdefghiklmnoprtuvy"), (F.floor(n / d) % 20 + 1).cast("int"), F.lit(1))
    return F.concat(F.lit(head), letter(1), letter(20), letter(400), letter(8000), F.lit(tail))


def sql_word(n: str, head: str, tail: str) -> str:
    letter = lambda d: f"substr('abcdefghiklmnoprtuvy', (({n}) // {d}) % 20 + 1, 1)"
    return f"'{head}' || {letter(1)} || {letter(20)} || {letter(400)} || {letter(8000)} || '{tail}'"


RWT = (("ECONOMY", 110), ("LARGE", 100), ("MEDIUM", 105), ("PROMO", 300), ("SMALL", 115), ("STANDARD", 0))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Points on a helix over the map: neighbours by key are near each other."""
    k = F.col("p_partkey")
    return load(spark, d, "part").select((k + 1).alias("node_id"), (F.lit(X0) + (k * 7919) % 4_000_000).cast("int").alias("x"), (F.lit(Y0) + (F.floor(k / 8) * 104729 + (k % 8) * 1500) % 4_000_000).cast("int").alias("y"))


def node_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rwt = None
    for t, code in RWT:
        rwt = F.when(F.col("p_type") == t, code) if rwt is None else rwt.when(F.col("p_type") == t, code)
    name = F.concat(F.when(k % 3 == 0, F.lit("Norra ")).otherwise(F.lit("")), word(F.floor(k / 40), "K", "by"), F.lit(" "), word(F.floor(k / 5), "s", "ån"), F.when(k % 4 == 0, F.lit(" gård")).otherwise(F.lit("")))
    return load(spark, d, "part").select(F.lit(1).alias("elem_type"), (k + 1).alias("elem_id"), rwt.cast("int").alias("rwt"), name.alias("name"))


def way_nodes(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    near = (F.floor(F.col("l_orderkey") * 7 / 8) + F.col("l_partkey") % 13) % F.col("n")
    lines = load(spark, d, "lineitem").crossJoin(F.broadcast(load(spark, d, "part").agg(F.count("*").alias("n"))))  # one row
    return lines.select((F.col("l_orderkey") + 1).alias("way_id"), F.row_number().over(order).alias("pos"), (near + 1).cast("long").alias("node_id"))


def way_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rwt = F.when(k % 3 == 0, 200).when(k % 3 == 1, 205).otherwise(210)
    return load(spark, d, "orders").select(F.lit(2).alias("elem_type"), (k + 1).alias("elem_id"), rwt.alias("rwt"), F.concat(word(F.floor(k / 2), "G", "gatan")).alias("name"))


def relation_members(spark: SparkSession, d: str) -> DataFrame:
    """Customers hold their orders as ways; nations hold customers and regions nations as relations."""
    o, c, n = load(spark, d, "orders"), load(spark, d, "customer"), load(spark, d, "nation")
    rows = [
        o.select((F.col("o_custkey") + 1).alias("rel_id"), F.lit(2).alias("member_type"), (F.col("o_orderkey") + 1).alias("member_id")),
        c.select((F.col("c_nationkey") + 10_000_001).cast("long").alias("rel_id"), F.lit(3).alias("member_type"), (F.col("c_custkey") + 1).alias("member_id")),
        n.select((F.col("n_regionkey") + 20_000_001).cast("long").alias("rel_id"), F.lit(3).alias("member_type"), (F.col("n_nationkey") + 10_000_001).cast("long").alias("member_id")),
    ]
    order = Window.partitionBy("rel_id").orderBy("member_type", "member_id")
    return rows[0].union(rows[1]).union(rows[2]).select("rel_id", F.row_number().over(order).alias("pos"), "member_type", "member_id", F.lit(1).alias("role_flags"))


def region_edges(spark: SparkSession, d: str) -> DataFrame:
    """Corners of each region's ring in order: a square with a cut corner for a nation, a triangle for a region."""
    n = load(spark, d, "nation").select((F.col("n_nationkey") + 10_000_001).cast("long").alias("rel_id"), (F.lit(X0) + F.col("n_nationkey") % 5 * CELL).cast("long").alias("x"), (F.lit(Y0) + F.floor(F.col("n_nationkey") / 5) * CELL).cast("long").alias("y"))
    square = F.array(*(F.struct(F.lit(i).alias("pos"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for i, (dx, dy) in enumerate(((0, 0), (CELL, 0), (CELL, CELL // 2), (CELL // 2, CELL), (0, CELL)))))
    r = load(spark, d, "region").select((F.col("r_regionkey") + 20_000_001).cast("long").alias("rel_id"), (F.lit(X0) + F.col("r_regionkey") * 600_000).cast("long").alias("x"), F.lit(Y0).cast("long").alias("y"))
    triangle = F.array(*(F.struct(F.lit(i).alias("pos"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for i, (dx, dy) in enumerate(((0, 0), (1_800_000, 0), (900_000, 3_900_000)))))
    return n.select("rel_id", F.explode(square).alias("c")).union(r.select("rel_id", F.explode(triangle).alias("c"))).select("rel_id", "c.pos", "c.x", "c.y")


def region_rings(spark: SparkSession, d: str) -> DataFrame:
    e = region_edges(spark, d)
    box = e.groupBy("rel_id").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"), F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("c"))
    return box.select("rel_id", "minx", "miny", "maxx", "maxy", F.array(F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("rings"))


def region_names(spark: SparkSession, d: str) -> DataFrame:
    """Raw names with their level: nations as municipalities, regions as counties."""
    n = load(spark, d, "nation").select((F.col("n_nationkey") + 10_000_001).cast("long").alias("rel_id"), F.lit(7).alias("admin_level"), F.concat(word(F.col("n_nationkey"), "M", "hult"), F.when(F.col("n_nationkey") % 2 == 0, "s kommun").otherwise(" kommun")).alias("name"))
    r = load(spark, d, "region").select((F.col("r_regionkey") + 20_000_001).cast("long").alias("rel_id"), F.lit(4).alias("admin_level"), F.concat(word(F.col("r_regionkey"), "L", "land"), F.lit("s län")).alias("name"))
    return n.union(r)


def scb_areas(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").select((F.lit(101) + F.col("n_nationkey")).alias("code"), (F.col("n_nationkey") + 10_000_001).cast("long").alias("rel_id"))
    r = load(spark, d, "region").select((F.lit(3) + F.col("r_regionkey")).alias("code"), (F.col("r_regionkey") + 20_000_001).cast("long").alias("rel_id"))
    return n.union(r)


def area_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of nations as municipalities, and of regions as counties under the hundreds of their codes."""
    n = load(spark, d, "nation").select((F.lit(101) + F.col("n_nationkey")).cast("int").alias("code"), F.col("n_name").alias("name"))
    return n.union(load(spark, d, "region").select((F.lit(1) + F.col("r_regionkey")).cast("int"), "r_name"))


def expected(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, x, y): the point behind the first place name of each customer's text."""
    part = load(spark, d, "part").agg(F.count("*").alias("n"))
    c = load(spark, d, "customer").crossJoin(F.broadcast(part))  # a single row
    return c.select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") * 13 % F.col("n") + 1).alias("node_id")).join(nodes(spark, d), "node_id").select("query_id", "x", "y")


def road_ways(spark: SparkSession, d: str) -> DataFrame:
    k = F.floor(F.col("o_orderkey") / 16)
    return load(spark, d, "orders").select((k % 24).cast("int").alias("road_type"), (1 + F.floor(k / 24) % 400).cast("int").alias("number"), (F.col("o_orderkey") + 1).alias("way_id"))


LETTERS = ("e", "rv", "m", "k", "i", "h", "g", "n", "o", "f", "e", "d", "ab", "c", "u", "t", "s", "w", "x", "z", "y", "ac", "bd", "rv")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """One text for each customer, in the manner of a road report."""
    part, road = load(spark, d, "part").agg(F.count("*").alias("n")), load(spark, d, "orders").agg(F.count("*").alias("m"))
    k = F.col("c_custkey")
    p1 = F.floor(k * 13 % F.col("n"))
    r = F.floor((k * 17 % F.col("m")) / 16)
    letters = F.element_at(F.array(*(F.lit(s) for s in LETTERS)), (r % 24 + 1).cast("int"))
    number = F.when(r % 24 == 23, 500 + F.floor(r / 24) % 400).otherwise(1 + F.floor(r / 24) % 400)
    g1 = k * 17 % F.col("m")
    text = F.concat(
        F.lit("Olycka på "), letters, F.lit(" "), number.cast("string"), F.lit(" nära "), word(F.floor(p1 / 40), "K", "by"), F.lit(" "), word(F.floor(p1 / 5), "s", "åns"),
        F.lit(", mellan "), word(F.floor(g1 / 2), "G", "gatan"), F.lit(" och "), word(F.floor((g1 + 2) % F.col("m") / 2), "G", "gatan"), F.lit(".\n# anmälan\nPolisen i "), word(F.col("c_nationkey"), "M", "hult"),
        F.lit(" och "), word(F.col("c_nationkey") % 5, "L", "lands"), F.lit(" län"),
    )
    return load(spark, d, "customer").crossJoin(F.broadcast(part)).crossJoin(F.broadcast(road)).select(k.alias("query_id"), text.alias("text"))  # two single rows


_RWT_SQL = " ".join(f"WHEN '{t}' THEN {c}" for t, c in RWT)
_LETTERS_SQL = "[" + ", ".join(f"'{s}'" for s in LETTERS) + "]"
#: The same tables as DuckDB CTEs, by name. Later ones may use earlier ones.
CTES = {
    "nodes": f"SELECT p_partkey + 1 AS node_id, ({X0} + (p_partkey * 7919) % 4000000)::INT AS x, ({Y0} + ((p_partkey // 8) * 104729 + (p_partkey % 8) * 1500) % 4000000)::INT AS y FROM part",
    "node_names": f"SELECT 1 AS elem_type, p_partkey + 1 AS elem_id, CASE p_type {_RWT_SQL} END AS rwt, CASE WHEN p_partkey % 3 = 0 THEN 'Norra ' ELSE '' END || {sql_word('p_partkey // 40', 'K', 'by')} || ' ' || {sql_word('p_partkey // 5', 's', 'ån')} || CASE WHEN p_partkey % 4 = 0 THEN ' gård' ELSE '' END AS name FROM part",
    "way_nodes": "SELECT l_orderkey + 1 AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, (l_orderkey * 7 // 8 + l_partkey % 13) % (SELECT count(*) FROM part) + 1 AS node_id FROM lineitem",
    "way_names": f"SELECT 2 AS elem_type, o_orderkey + 1 AS elem_id, CASE o_orderkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 205 ELSE 210 END AS rwt, {sql_word('o_orderkey // 2', 'G', 'gatan')} AS name FROM orders",
    "relation_members": "SELECT rel_id, row_number() OVER (PARTITION BY rel_id ORDER BY member_type, member_id) AS pos, member_type, member_id, 1 AS role_flags FROM (SELECT o_custkey + 1 AS rel_id, 2 AS member_type, o_orderkey + 1 AS member_id FROM orders UNION ALL SELECT c_nationkey + 10000001, 3, c_custkey + 1 FROM customer UNION ALL SELECT n_regionkey + 20000001, 3, n_nationkey + 10000001 FROM nation)",
    "region_edges": f"SELECT n_nationkey + 10000001 AS rel_id, c.i AS pos, ({X0} + n_nationkey % 5 * {CELL} + c.dx)::BIGINT AS x, ({Y0} + n_nationkey // 5 * {CELL} + c.dy)::BIGINT AS y FROM nation, (VALUES (0, 0, 0), (1, {CELL}, 0), (2, {CELL}, {CELL // 2}), (3, {CELL // 2}, {CELL}), (4, 0, {CELL})) c(i, dx, dy) UNION ALL SELECT r_regionkey + 20000001, c.i, ({X0} + r_regionkey * 600000 + c.dx)::BIGINT, ({Y0} + c.dy)::BIGINT FROM region, (VALUES (0, 0, 0), (1, 1800000, 0), (2, 900000, 3900000)) c(i, dx, dy)",
    "region_boxes": "SELECT rel_id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM region_edges GROUP BY rel_id",
    "region_names": f"SELECT n_nationkey + 10000001 AS rel_id, 7 AS admin_level, {sql_word('n_nationkey', 'M', 'hult')} || CASE WHEN n_nationkey % 2 = 0 THEN 's kommun' ELSE ' kommun' END AS name FROM nation UNION ALL SELECT r_regionkey + 20000001, 4, {sql_word('r_regionkey', 'L', 'land')} || 's län' FROM region",
    "scb_areas": "SELECT 101 + n_nationkey AS code, n_nationkey + 10000001 AS rel_id FROM nation UNION ALL SELECT 3 + r_regionkey, r_regionkey + 20000001 FROM region",
    "road_ways": "SELECT (o_orderkey // 16) % 24 AS road_type, 1 + (o_orderkey // 16) // 24 % 400 AS number, o_orderkey + 1 AS way_id FROM orders",
    "texts": f"""SELECT k AS query_id, 'Olycka på ' || ({_LETTERS_SQL})[r % 24 + 1] || ' ' || (CASE WHEN r % 24 = 23 THEN 500 + r // 24 % 400 ELSE 1 + r // 24 % 400 END)::VARCHAR || ' nära ' || {sql_word('p1 // 40', 'K', 'by')} || ' ' || {sql_word('p1 // 5', 's', 'åns')} || ', mellan ' || {sql_word('g1 // 2', 'G', 'gatan')} || ' och ' || {sql_word('((g1 + 2) % m) // 2', 'G', 'gatan')} || '.' || chr(10) || '# anmälan' || chr(10) || 'Polisen i ' || {sql_word('c_nationkey', 'M', 'hult')} || ' och ' || {sql_word('c_nationkey % 5', 'L', 'lands')} || ' län' AS text
 FROM (SELECT c_custkey AS k, c_nationkey, m, c_custkey * 13 % n AS p1, (c_custkey * 17 % m) // 16 AS r, c_custkey * 17 % m AS g1 FROM customer, (SELECT count(*) AS n FROM part), (SELECT count(*) AS m FROM orders))""",
}


PLACE_TAG = (("ECONOMY", "town"), ("LARGE", "county"), ("MEDIUM", "city"), ("PROMO", "hamlet"), ("SMALL", "island"), ("STANDARD", "farm"))


def nodes_raw(spark: SparkSession, d: str) -> DataFrame:
    """Points with tags, as they come from a map file."""
    k = F.col("p_partkey")
    place = None
    for t, tag in PLACE_TAG:
        place = F.when(F.col("p_type") == t, tag) if place is None else place.when(F.col("p_type") == t, tag)
    tags = F.map_filter(
        F.create_map(
            F.lit("place"), place, F.lit("natural"), F.when(k % 11 == 0, "water"), F.lit("name"), F.when(k % 4 != 0, F.col("p_name")),
            F.lit("alt_name"), F.when(k % 3 == 0, F.col("p_brand")), F.lit("name:en"), F.when(k % 5 == 0, F.concat(F.col("p_name"), F.lit(" en"))), F.lit("name:sv"), F.when(k % 7 == 0, F.col("p_name")), F.lit("nickname"), F.lit("x"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return load(spark, d, "part").select((k + 1).alias("id"), (F.lit(56.0) + (k % 700) / 70.0).alias("lat"), (F.lit(12.0) + (k % 900) / 100.0).alias("lon"), tags.alias("tags"))


def ways_raw(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    highway = F.element_at(F.array(*(F.lit(h) for h in ("motorway", "secondary", "residential", "footway", "primary"))), (k % 5 + 1).cast("int"))
    ref = F.when(k % 2 == 0, F.concat(F.lit("E "), (k % 70 + 1).cast("string"))).otherwise((k % 900 + 1).cast("string"))
    tags = F.map_filter(F.create_map(F.lit("highway"), highway, F.lit("ref"), F.when(k % 3 == 0, ref), F.lit("building"), F.when(k % 7 == 0, "yes")), lambda _, v: v.isNotNull())
    refs = way_nodes(spark, d).groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda s: s["node_id"]).alias("refs"))
    return load(spark, d, "orders").select((k + 1).alias("id"), tags.alias("tags")).join(refs, F.col("id") == F.col("way_id")).select("id", "refs", "tags")


def ring_ways(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, way_nodes, nodes): each region's ring cut in ways of one edge, every other one backwards."""
    e = region_edges(spark, d)
    n = F.count("*").over(Window.partitionBy("rel_id"))
    node = F.col("rel_id") * 10 + F.col("pos")
    at = e.withColumn("n", n)
    nxt = F.col("rel_id") * 10 + (F.col("pos") + 1) % F.col("n")
    ways = at.select("rel_id", "pos", node.alias("way_id"), F.when(F.col("pos") % 2 == 0, F.array(node, nxt)).otherwise(F.array(nxt, node)).alias("refs"))
    members = ways.select("rel_id", (F.col("pos") + 1).alias("pos"), F.lit(2).alias("member_type"), F.col("way_id").alias("member_id"), F.lit(1).alias("role_flags"))
    return members, ways.select("way_id", F.posexplode("refs").alias("pos", "node_id")).withColumn("pos", F.col("pos") + 1), e.select(node.alias("node_id"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
