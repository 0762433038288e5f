from __future__ import annotations

import math

from pyspark.sql import functions as F

from placelore import params as P
from placelore.functions import geo, roads, scoring, text
from placelore.operators import lookup, strategies


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(expression.alias("out")).first()["out"]


def test_folding_keeps_swedish_letters(spark):
    assert one(spark, text.normalise(F.col("t")), t="ÅÄÖ É ü Æß … – ”x” ²®") == "åäö e u aess ... - \"x\" 2"


def test_combining_marks(spark):
    assert one(spark, text.normalise(F.col("t")), t="ä ö å") == "ä ö å"


def test_tokens_split_at_gaps_not_at_hyphens(spark):
    assert one(spark, text.tokens(F.col("t")), t="Väg-korsning: A/B, c_d (e) 漢") == ["väg-korsning:", "a", "b", "c", "d", "e"]


def test_read_words_skips_comments_stop_words_and_punctuation(spark):
    assert one(spark, text.read_words(F.col("t")), t="# nej\nEn bil på väg\n\n- bil") == ["bil", "väg", "bil"]
    assert one(spark, text.read_words(F.col("t"), unique=True), t="bil bil\nbil") == ["bil", "bil"]


def test_alternatives(spark):
    f = lambda w: one(spark, text.alternatives(F.col("w")), w=w)
    assert f("skolan") == ["skolan", "skola", "skol"]
    assert f("året") == ["året", "år"]
    assert f("lunds") == ["lunds", "lund"]
    assert f("hus") == ["hus"]


def test_spans_replace_the_last_word_only(spark):
    w = spark.createDataFrame([(["gamla", "bron", "lunds"],)], "w array<string>").withColumn("f", F.transform("w", text.alternatives))
    got = w.select(text.combinations(F.col("w"), F.col("f"), vague=("gamla",)).alias("c")).first()["c"]
    assert set(got) == {"gamla bron lunds", "gamla bron lund", "gamla bron", "bron lunds", "bron lund", "bron", "lunds", "lund"}


def test_index_phrases(spark):
    f = lambda *w: one(spark, text.index_phrases(F.array(*(F.lit(x) for x in w))))
    assert f("a") == ["a"]
    assert f("a", "b", "c") == ["a b c", "a b", "b c", "a", "b", "c"]
    assert f("a", "b", "c", "d") == ["a b c d", "a b c", "b c d", "a b", "b c", "c d"]


def test_admin_names(spark):
    f = lambda n: one(spark, text.admin_name(F.col("n")), n=n)
    assert (f("lunds kommun"), f("västerås kommun"), f("landskapet skåne"), f("uppsala län")) == ("lund", "västerås", "skåne", "uppsala")


def test_byte_position(spark):
    assert one(spark, text.byte_position(F.col("a"), F.col("b")), a="åäö x", b="x") == 7
    assert one(spark, text.byte_position(F.col("a"), F.col("b")), a="abc", b="x") == -1


def road_list(spark, *words):
    got = one(spark, roads.road_labels(F.array(*(F.lit(w) for w in words))))
    return [(r["road_type"], r["number"]) for r in got]


def test_road_labels(spark):
    assert road_list(spark, "e", "20") == [(0, 20)]
    assert road_list(spark, "e", "33") == [(10, 33)]
    assert road_list(spark, "k600", "ab226") == [(3, 600), (12, 226)]
    assert road_list(spark, "väg", "40", "länsväg", "612") == [(1, 40), (23, 612)]
    assert road_list(spark, "q", "7", "väg", "05", "e") == []
    assert road_list(spark, "e20", "e", "20") == [(0, 20)]


def test_ref_roads(spark):
    f = lambda r: [(x["road_type"], x["number"]) for x in one(spark, roads.ref_roads(F.col("r")), r=r)]
    assert f("E 4.04") == [(0, 4)]
    assert f("40;42") == [(1, 40), (1, 42)]
    assert f("K 600") == [(3, 600)]
    assert f("1234") == [(23, 1234)]
    assert f("Q 7, E 20") == [(0, 20)]


def test_grid(spark):
    rows = spark.range(2000).select((F.lit(4.5) + F.col("id") * 0.015).alias("lon"), (F.lit(54.0) + F.col("id") * 0.0085).alias("lat"))
    x = rows.withColumn("x", geo.encode_x(F.col("lon"))).withColumn("y", geo.encode_y(F.col("lat")))
    off = x.agg(F.max(F.abs(geo.encode_x(geo.decode_lon(F.col("x"))) - F.col("x"))).alias("dx"), F.max(F.abs(geo.encode_y(geo.decode_lat(F.col("y"))) - F.col("y"))).alias("dy")).first()
    assert off["dx"] <= 1 and off["dy"] <= 1


def test_distances(spark):
    c = [F.lit(v) for v in (5_000_000, 4_000_000, 5_000_300, 4_000_400)]
    assert one(spark, geo.distance_xy(*c)) == 50
    assert one(spark, geo.distance_lat_lon(c[0], c[1], c[0], c[1])) == 0


def test_quality_edges(spark):
    assert [one(spark, scoring.road_quality(F.lit(d))) for d in (0, 1000, 10_000, 100_000)] == [1.0, 1.0, 0.5, 0.0]
    assert one(spark, scoring.position_quality(F.lit(-1), F.lit(9))) == 1.0


def test_point_in_rings(spark):
    ring = spark.createDataFrame([([[(0, 0), (10, 0), (10, 10), (0, 10)]],)], "rings array<array<struct<x:long,y:long>>>")
    points = spark.createDataFrame([(5, 5), (15, 5), (-1, 5), (5, 11), (9, 1)], "x int, y int")
    got = {(r["x"], r["y"]): r["i"] for r in points.crossJoin(ring).select("x", "y", geo.in_rings(F.col("x"), F.col("y"), F.col("rings")).alias("i")).collect()}
    assert got == {(5, 5): True, (15, 5): False, (-1, 5): False, (5, 11): False, (9, 1): True}


def test_sampled_way_nodes(spark):
    for n, want in ((1, {0}), (2, {0, 1}), (3, {0, 2}), (4, {0, 2, 3}), (6, {0, 3, 5}), (7, {0, 1, 3, 5, 6}), (12, {0, 3, 6, 9, 11}), (13, {0, 1, 3, 4, 6, 8, 9, 11, 12})):
        w = spark.range(n).select(F.lit(1).alias("way_id"), (F.col("id") + 1).alias("pos"), F.col("id").alias("node_id"))
        assert {r["node_id"] for r in lookup.sampled(w).collect()} == want, n


def test_nested_relations_with_a_cycle(spark):
    m = spark.createDataFrame([(1, 1, 3, 2, 0), (2, 1, 3, 1, 0), (2, 2, 1, 7, 0), (1, 2, 2, 9, 0)], "rel_id long, pos int, member_type int, member_id long, role_flags int")
    got = {tuple(r) for r in lookup.flat_members(m).collect()}
    assert got == {(1, 1, 7), (1, 2, 9), (2, 1, 7), (2, 2, 9)}


def test_local_matches_in_the_far_north(spark):
    """East-west pairs within the limit by great circle match at every latitude, those beyond it do not."""
    names = spark.createDataFrame([], "elem_type int, elem_id long, name string")
    rows = [(i, lat, 25.0, km / (60 * P.MILE * math.cos(math.radians(lat)))) for i, (lat, km) in enumerate((lat, km) for lat in (58.0, 67.9, 69.1, 71.4) for km in (19_900, 20_100))]
    at = spark.createDataFrame([(1, k * 100 + i, lat, lon + k * d) for i, lat, lon, d in rows for k in (0, 1)], "elem_type int, elem_id long, lat double, lon double")
    centre = at.select("elem_type", "elem_id", geo.encode_x(F.col("lon")).alias("x"), geo.encode_y(F.col("lat")).alias("y"))
    hits = spark.createDataFrame([(i, "by", 1, 100 + i) for i, *_ in rows], "query_id int, phrase string, elem_type int, elem_id long")
    places = spark.createDataFrame([(i, 1, i, 100) for i, *_ in rows], "query_id int, elem_type int, elem_id long, rwt int")
    got = {r["query_id"] for r in strategies.local_matches(hits, centre, places, names).collect()}
    assert got == {0, 2, 4, 6}
