"""Rings of regions from their ways, and simpler lines. Both follow a sequence, so they run in Python on whole relations and ways."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.schema import INNER, OUTER, WAY
from placelore.shipping import ship

CORRIDOR = 20


def stitch(ways: list[list[tuple]]) -> list[list[tuple]] | None:
    """Joins ways (lists of (node, x, y)) end to end into closed rings; None if some way is left over."""
    rings, open_ = [], [w for w in ways if w]
    while open_:
        line = list(open_.pop(0))
        while line[0][0] != line[-1][0]:
            for i, w in enumerate(open_):
                if w[0][0] == line[-1][0]:
                    line += w[1:]
                elif w[-1][0] == line[-1][0]:
                    line += w[::-1][1:]
                elif w[-1][0] == line[0][0]:
                    line = w[:-1] + line
                elif w[0][0] == line[0][0]:
                    line = w[::-1][:-1] + line
                else:
                    continue
                del open_[i]
                break
            else:
                return None
        if len(line) > 3:
            rings.append(line[:-1])
    return rings


def region_rings(members: DataFrame, way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rel_id, box, rings) of relations whose outer and inner ways all close into rings; others are left out.

    A relation with a way that has no nodes is left out too. A group is one relation.
    """
    ship(members.sparkSession)
    edge = members.where((F.col("member_type") == WAY) & F.col("role_flags").isin(OUTER, INNER, OUTER | INNER)).select("rel_id", F.col("pos").alias("nth"), F.col("member_id").alias("way_id"))
    at = edge.join(way_nodes, "way_id", "left").join(nodes, "node_id", "left").select("rel_id", "nth", "pos", "node_id", "x", "y")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rel_id": pd.Series([], dtype="int64"), "rings": pd.Series([], dtype="object")})
        if rows[["node_id", "x"]].isna().any().any():
            return none
        ways = [list(zip(g["node_id"], g["x"].astype(int), g["y"].astype(int), strict=True)) for _, g in rows.sort_values(["nth", "pos"]).groupby("nth")]
        rings = stitch(ways)
        if not rings:
            return none
        return pd.DataFrame({"rel_id": [rows["rel_id"].iloc[0]], "rings": [[[{"x": x, "y": y} for _, x, y in ring] for ring in rings]]})

    rings = at.groupBy("rel_id").applyInPandas(one, "rel_id long, rings array<array<struct<x:long,y:long>>>")
    flat = lambda c: F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[c])))
    return rings.select("rel_id", F.array_min(flat("x")).alias("minx"), F.array_min(flat("y")).alias("miny"), F.array_max(flat("x")).alias("maxx"), F.array_max(flat("y")).alias("maxy"), "rings")


def reduced(points: list[tuple], keep: list[bool], corridor: int = CORRIDOR) -> list[bool]:
    """Which points of a line stay: ends, protected ones, and those further than corridor from the line between their neighbours."""
    stay = [k or i in (0, len(points) - 1) for i, k in enumerate(keep)]
    fixed = [i for i, s in enumerate(stay) if s]
    todo = list(zip(fixed, fixed[1:], strict=False))
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        (ax, ay), (bx, by) = points[a], points[b]
        dx, dy = bx - ax, by - ay
        long2 = dx * dx + dy * dy
        far, at = -1.0, a
        for i in range(a + 1, b):
            px, py = points[i]
            t = min(1.0, max(0.0, ((px - ax) * dx + (py - ay) * dy) / long2)) if long2 else 0.0
            d = (px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2
            if d > far:
                far, at = d, i
        if far > corridor * corridor:
            stay[at] = True
            todo += [(a, at), (at, b)]
    return stay


def simplified(way_nodes: DataFrame, nodes: DataFrame, named: DataFrame | None = None, corridor: int = CORRIDOR) -> DataFrame:
    """way_nodes with fewer nodes. Nodes of two ways and nodes with names (named: node_id) stay; a row is one way, so its points are together."""
    ship(way_nodes.sparkSession)
    uses = way_nodes.groupBy("node_id").agg((F.countDistinct("way_id") > 1).alias("shared"))
    at = way_nodes.join(uses, "node_id").join(nodes, "node_id")
    at = at.join(named.select("node_id").distinct().withColumn("named", F.lit(True)), "node_id", "left") if named is not None else at.withColumn("named", F.lit(None).cast("boolean"))
    at = at.select("way_id", "pos", "node_id", "x", "y", (F.col("shared") | F.coalesce("named", F.lit(False))).alias("keep"))

    lines = at.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", "x", "y", "keep"))).alias("line"))

    def go(batches):
        for batch in batches:
            way, pos, node = [], [], []
            for w, line in zip(batch.column("way_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                stay = reduced([(p["x"], p["y"]) for p in line], [p["keep"] for p in line], corridor)
                left = [p["node_id"] for p, s in zip(line, stay, strict=True) if s]
                if len(left) >= 2:
                    way += [w] * len(left)
                    pos += range(1, len(left) + 1)
                    node += left
            yield pa.RecordBatch.from_arrays([pa.array(way, pa.int64()), pa.array(pos, pa.int32()), pa.array(node, pa.int64())], ["way_id", "pos", "node_id"])

    return lines.mapInArrow(go, "way_id long, pos int, node_id long")
