"""A small map of our own, from raw elements to ranked places; rings, lines, documents, files and the stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from placelore.functions import geo
from placelore.operators import ingest, lookup, polygons, render
from placelore.plans.locate import Map, compare, locate
from placelore.schema import RAW
from placelore.sources import files
from placelore.streaming.locate_stream import locate_stream, read_texts


def at(lat, lon):
    return lat, lon


@pytest.fixture(scope="module")
def raw(spark):
    n = [
        (1, 58.40, 15.60, {"place": "town", "name": "Ekstad"}),
        (2, 58.42, 15.65, {"place": "hamlet", "name": "Lillby"}),
        (3, 58.60, 15.90, {"place": "hamlet", "name": "Fjärrby"}),
        (4, 58.41, 15.61, {"name": "Gula bron"}),
        (5, 58.405, 15.605, {}),
        (6, 58.406, 15.606, {}),
        (7, 58.404, 15.607, {}),
        (8, 58.41, 15.70, {"place": "county", "name": "Länet"}),
        *[(20 + i, lat, lon, {}) for i, (lat, lon) in enumerate(((58.0, 15.0), (58.0, 16.5), (59.0, 16.5), (59.0, 15.0)))],
        (30, 58.40, 15.62, {"natural": "water", "place": "island", "name": "Sjön", "name:en": "The Lake", "alt_name": "S"}),
    ]
    w = [
        (100, [5, 6], {"highway": "residential", "name": "Storgatan"}),
        (101, [6, 7], {"highway": "residential", "name": "Kyrkogatan"}),
        (102, [5, 7], {"highway": "primary", "ref": "E 4.04"}),
        (103, [5], {"highway": "primary", "name": "För kort"}),
        (110, [20, 21, 22], {}),
        (111, [20, 23, 22], {}),
    ]
    r = [
        (200, [("way", 110, "outer"), ("way", 111, "outer")], {"boundary": "administrative", "admin_level": "7", "name": "Ekstads kommun", "ref:scb": "0586"}),
        (201, [("way", 110, "outer"), ("way", 999, "outer")], {"boundary": "administrative", "admin_level": "4", "name": "Öppna län", "ref:nuts:3": "SE123"}),
    ]
    return tuple(spark.createDataFrame(rows, ddl) for rows, ddl in zip((n, w, r), RAW.values(), strict=True))


@pytest.fixture(scope="module")
def the_map(spark, raw):
    s = ingest.build(*raw)
    s["region_rings"] = polygons.region_rings(s["relation_members"], s["way_nodes"], s["nodes"])
    return Map(**s)


def test_classes_and_names(raw):
    n, w, r = raw
    classes = {x["id"]: x["c"] for x in n.select("id", ingest.node_class().alias("c")).collect()}
    assert (classes[1], classes[2], classes[8], classes[30]) == (110, 115, 0, 401)
    names = {(x["elem_type"], x["elem_id"]): x["name"] for x in ingest.best_name(ingest.all_names(ingest.named_elements(n, w, r))).collect()}
    assert names[1, 30] == "Sjön" and (1, 8) not in names and (2, 103) not in names and names[3, 200] == "Ekstads kommun"
    assert {(x["road_type"], x["number"], x["way_id"]) for x in ingest.road_ways(w).collect()} == {(0, 4, 102)}
    assert {(x["code"], x["rel_id"]) for x in ingest.scb_areas(r).collect()} == {(586, 200)}
    assert {(x["code"], x["rel_id"]) for x in ingest.nuts3_areas(r).collect()} == {(123, 201)}
    assert {(x["norm_name"], x["admin_level"]) for x in ingest.admin_regions(r).collect()} == {("ekstad", 7), ("öppna", 4)}


def test_rings_close_or_the_region_is_left_out(the_map):
    got = the_map.region_rings.collect()
    assert [(r["rel_id"], len(r["rings"]), len(r["rings"][0])) for r in got] == [(200, 1, 4)]


def test_stitching_turns_ways_around():
    p = lambda *ids: [(i, i, i) for i in ids]
    assert len(polygons.stitch([p(1, 2), p(3, 2), p(3, 4, 1), p(7, 8), p(8, 9, 7)])) == 2
    assert polygons.stitch([p(1, 2), p(2, 3)]) is None


def test_lines_lose_points_inside_the_corridor():
    line = [(0, 0), (50, 5), (100, 0), (150, 90), (200, 0)]
    assert polygons.reduced(line, [False] * 5) == [True, False, True, True, True]
    assert polygons.reduced(line, [False, True, False, False, False]) == [True, True, True, True, True]


def test_locate_finds_the_places(spark, the_map):
    texts = spark.createDataFrame([(1, "En bil körde av vägen i Lillby nära Ekstad"), (2, "Krock där Storgatan möter Kyrkogatan"), (3, "Stopp på E 4 vid Ekstad"), (4, "Vid Gula bron"), (5, "Fjärrby"), (6, "")], "query_id long, text string")
    out = locate(texts, the_map).orderBy("query_id", "rank").collect()
    best = {}
    for r in out:
        best.setdefault(r["query_id"], r)
    assert best[2]["strategy"] == "crossing" and best[2]["elements"] == "1/6"
    assert best[3]["strategy"] == "road"
    assert {r["strategy"] for r in out if r["query_id"] == 1} & {"local", "admin"}
    assert best[4]["elements"].startswith("1/4")
    assert set(best) == {1, 2, 3, 4, 5}
    assert all(r["scb_code"] == 586 for r in out)
    want = spark.createDataFrame([(1, 58.42, 15.65), (2, 58.406, 15.606), (3, 58.405, 15.605), (4, 58.41, 15.61), (5, 58.60, 15.90)], "query_id long, lat double, lon double")
    want = want.select("query_id", geo.encode_x(F.col("lon")).alias("x"), geo.encode_y(F.col("lat")).alias("y"))
    assert all(r["metres"] < 1500 for r in compare(locate(texts, the_map), want).collect())


def test_documents(spark, the_map, tmp_path):
    texts = spark.createDataFrame([(1, "Lillby & Ekstad")], "query_id long, text string")
    found = locate(texts, the_map)
    doc = json.loads(render.as_json(found).first()["document"])
    assert doc["results"][0]["rank"] == 1 and doc["results"][0]["url"].startswith("https://")
    xml = render.as_xml(found).first()["document"]
    assert xml.count("<result>") == len(doc["results"])
    assert render.as_html(found).first()["document"].count("<li>") == len(doc["results"])
    elements = [e for r in doc["results"] for e in r["origin"]["elements"]]
    assert elements and all(e.split("/")[0] in render.KINDS and e.split("/")[1].isdigit() for e in elements)
    assert xml.count("<element>") == len(elements) and xml.count("</elements>") == len(doc["results"])
    html = render.as_html(found).first()["document"]
    assert html.count("<img") == 9 * len(doc["results"]) and all(f"{render.ELEMENT}{e}" in html for e in elements)
    roads = the_map.way_nodes.join(the_map.nodes, "node_id").select("way_id", "pos", "x", "y")
    drawing = render.as_svg(the_map.region_rings, found.select("x", "y"), roads, found.select("x", "y", F.lit("A & B").alias("caption")))
    render.write_svg(drawing, str(tmp_path / "map"), compress=True)
    import glob
    import gzip
    import xml.etree.ElementTree as tree

    (file,) = glob.glob(str(tmp_path / "map" / "*.gz"))
    shapes = [e.tag.rsplit("}", 1)[1] for e in tree.fromstring(gzip.open(file, "rt", encoding="utf-8").read())]
    n = len(doc["results"])
    assert shapes == ["path"] * shapes.count("path") + ["circle"] * n + ["text"] * n and "path" in shapes


def test_files(spark, tmp_path, the_map):
    (tmp_path / "stop.txt").write_text("# a comment\noch\n\nmed\n")
    assert files.word_list(spark, str(tmp_path / "stop.txt")) == ("med", "och")
    (tmp_path / "areas.csv").write_text("05;Östergötlands län\n0586;Ekstad\n")
    assert {(r["code"], r["name"]) for r in files.area_names(spark, str(tmp_path / "areas.csv")).collect()} == {(5, "Östergötlands län"), (586, "Ekstad")}
    (tmp_path / "set.config").write_text('# x\ntempdir = "maps";\nmapname = "${tempdir}/e";\n')
    s = files.Settings.load(str(tmp_path / "set.config"))
    assert s.get("mapname") == "maps/e" and s.path("tempdir") == str(tmp_path / "maps")
    tables = {k: getattr(the_map, k) for k in ("nodes", "way_nodes", "relation_members", "names", "name_index", "road_ways", "admin_regions", "scb_areas", "region_rings")}
    assert not files.has_snapshot(spark, str(tmp_path / "silver"))
    files.write_snapshot(tables, str(tmp_path / "silver"))
    assert files.has_snapshot(spark, str(tmp_path / "silver"))
    back = files.read_snapshot(spark, str(tmp_path / "silver"))
    assert sorted(map(tuple, back["names"].collect())) == sorted(map(tuple, the_map.names.collect()))


def test_stream_equals_batch(spark, tmp_path, the_map):
    rows = [(1, "Lillby nära Ekstad"), (2, "Storgatan och Kyrkogatan"), (3, "Fjärrby")]
    for i, (q, t) in enumerate(rows):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.json").write_text(json.dumps({"query_id": q, "text": t}) + "\n")
    got = []
    query = locate_stream(read_texts(spark, str(tmp_path / "in"), 2), the_map, lambda df, _: got.extend(map(tuple, df.collect())), str(tmp_path / "cp"), once=True)
    query.awaitTermination()
    batch = locate(spark.createDataFrame(rows, "query_id long, text string"), the_map)
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in batch.collect())


def test_offsets_move_members_too(spark, raw):
    n, w, r = ingest.offset_union([raw, raw])
    assert n.count() == 2 * raw[0].count()
    top = 202
    assert {x["m"] for x in r.where(F.col("id") > top).select(F.explode("members.ref").alias("m")).collect()} == {top + x for x in (110, 111, 999)}


def test_representative_and_counter(the_map):
    e = the_map.way_nodes.select(F.lit(2).alias("elem_type"), F.col("way_id").alias("elem_id"))
    got = {r["elem_id"]: r["node_id"] for r in lookup.representative(e, the_map.way_nodes, the_map.relation_members).collect()}
    assert got[110] == 21 and got[100] == 6
    assert {r["node_id"]: r["uses"] for r in lookup.counter(the_map.way_nodes).collect()}[5] == 2


def test_members_of_deeply_nested_relations(spark):
    """A chain of 12 relations whose last one leads back to the third; each holds a node of its own."""
    rows = [(i, 0, 3, i % 12 + 1 if i < 12 else 3, 0) for i in range(1, 13)] + [(i, 1, 1, 100 + i, 0) for i in range(1, 13)]
    m = spark.createDataFrame(rows, "rel_id long, pos int, member_type int, member_id long, role_flags int")
    got = {tuple(r) for r in lookup.flat_members(m).collect()}
    assert got == {(i, 1, 100 + j) for i in range(1, 13) for j in range(min(i, 3), 13)}


def test_representative_of_nested_relations(spark):
    """Middle members are followed to any depth; relations that lead back to themselves have no node."""
    members = [(i, 1, 3, i + 1) for i in range(100, 140)] + [(140, 1, 1, 7), (200, 1, 3, 201), (201, 1, 3, 200), (300, 1, 2, 5), (301, 1, 3, 999)]
    m = spark.createDataFrame(members, "rel_id long, pos int, member_type int, member_id long")
    w = spark.createDataFrame([(5, 1, 70), (5, 2, 71), (5, 3, 72)], "way_id long, pos int, node_id long")
    e = spark.createDataFrame([(3, 100), (3, 139), (3, 200), (3, 300), (3, 301), (1, 4), (2, 5)], "elem_type int, elem_id long")
    got = {(r["elem_type"], r["elem_id"]): r["node_id"] for r in lookup.representative(e, w, m).collect()}
    assert got == {(3, 100): 7, (3, 139): 7, (3, 300): 71, (1, 4): 4, (2, 5): 71}


def test_regions_and_roads_by_grid_cells(spark, monkeypatch):
    """Cells against plain Python, on a ring with a hole and a notch and on roads near and far; no join without equality."""
    import random

    rng = random.Random(4)
    c = 1 << lookup.CELL
    outer = [(0, 0), (9 * c, 0), (9 * c, 7 * c + 5), (5 * c, 3 * c), (0, 7 * c)]
    hole = [(c, c), (2 * c + 9, c), (2 * c, 2 * c)]
    ring = lambda r: [dict(x=x, y=y) for x, y in r]
    rings = spark.createDataFrame([(1, 0, 0, 9 * c, 7 * c + 5, [ring(outer), ring(hole)], "a")], "rel_id long, minx long, miny long, maxx long, maxy long, rings array<array<struct<x:long,y:long>>>, name string")
    points = [(rng.randrange(-c, 10 * c), rng.randrange(-c, 8 * c)) for _ in range(2000)] + outer + hole
    df = spark.createDataFrame(points, "x int, y int").distinct()
    want = {(r["x"], r["y"]) for r in df.crossJoin(rings).where(geo.in_rings(F.col("x"), F.col("y"), F.col("rings"))).collect()}
    at = lookup.regions_at(df, rings)
    got = [(r["x"], r["y"]) for r in at.where("name = 'a'").collect()]
    assert set(got) == want and len(got) == len(want) and 500 < len(want) < 1900
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = lookup.regions_at(df, rings)._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "NestedLoop" not in plan and "Cartesian" not in plan

    roads = [(rng.choice((1, 2, 23)), rng.randrange(1, 4), i, 1, i, rng.randrange(1, 30_000_000), rng.randrange(1, 15_000_000)) for i in range(300)]
    asked = [(i, rng.randrange(1, 30_000_000), rng.randrange(1, 15_000_000), rng.choice((1, 2, 23)), rng.randrange(1, 5)) for i in range(200)]
    asked += [(1000 + i, r[5] + rng.randrange(-9, 9), r[6], r[0], r[1]) for i, r in enumerate(roads[:50])]
    ask = spark.createDataFrame(asked, "key long, px int, py int, road_type int, number int")
    on = spark.createDataFrame(roads, "road_type int, number int, way_id long, pos int, node_id long, x int, y int")
    near = {}
    for k, px, py, t, n in asked:
        able = [((r[5] - px) ** 2 + (r[6] - py) ** 2, r[0], r[2], r[4]) for r in roads if r[1] == n and (r[0] == t if t != 23 else r[0] > 1)]
        if able:
            near[k] = min(able)[3]
    for many in (4096, 100, 0):  # no road, some, all by cells
        monkeypatch.setattr(lookup, "MANY", many)
        assert {r["key"]: r["node_id"] for r in lookup.closest_road_node(ask, on).collect()} == near


def test_names_that_end_in_s():
    from placelore import params as P

    assert len(P.S_STEMS) == len(set(P.S_STEMS)) == 21 and len(P.VAGUE_WORDS) == len(set(P.VAGUE_WORDS))
    assert (len(P.SKIP_RELATIONS), len(P.SKIP_WAYS), len(P.SKIP_ADMIN)) == (6, 114, 23)


def test_admin_names_and_comment_lines(spark):
    from placelore.functions import text

    names = ["Alingsås kommun", "Strängnäs kommun", "Uppsala kommun", "Stockholms län", "Borås kommun"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.admin_name(text.normalise(F.col("n")))).collect()] == ["alingsås", "strängnäs", "uppsala", "stockholm", "borås"]
    said = spark.createDataFrame([("Ett\n#två\n°#tre\nfyra fyra\r#fem\n#\n\nA→B",)], "t string")
    assert said.select(text.read_words(F.col("t"), stop_words=())).first()[0] == ["ett", "tre", "fyra", "fyra", "fem", "a-b"]
    assert said.select(text.read_words(F.col("t"), stop_words=(), unique=True)).first()[0] == ["ett", "tre", "fyra", "fem", "a-b"]


def test_tables_of_a_scope_are_removed_at_its_end(spark):
    import os

    from placelore.scratch import scope, scratch_dir, table

    folder = scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    for _ in range(3):
        with scope():
            assert table(spark.range(3), "inner").count() == 3
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before


def test_nearest_places_by_tiles_and_with_ties():
    """Against plain Python: the first of equal distances, with and without tiles, and beyond what a double holds."""
    import random

    import numpy as np

    rng = random.Random(7)
    for span in (40, 20_000_000, 2_000_000_000):
        x, y, px, py = (np.array([rng.randrange(span) for _ in range(n)], np.int64) for n in (300, 300, 200, 200))
        want = [min(range(300), key=lambda i: ((x[i] - a) ** 2 + (y[i] - b) ** 2, i)) for a, b in zip(px.tolist(), py.tolist(), strict=True)]
        for many in (4096, 0):
            at, d2 = lookup.nearest(px, py, x, y, many)
            assert at.tolist() == want and d2.tolist() == [(x[i] - a) ** 2 + (y[i] - b) ** 2 for i, a, b in zip(want, px.tolist(), py.tolist(), strict=True)]


def test_strategies_work_on_keys_not_on_every_hit(spark):
    """Local matches from keys are those from hits; elements outside a text's regions are never rows of that text."""
    import random

    from placelore.operators import strategies

    rng = random.Random(9)
    entries = spark.createDataFrame([(f"k{k}", 1, k * 100 + i, rng.choice((100, 105, 300)), k * 100 + i) for k in range(6) for i in range(20)], "code_key string, elem_type int, elem_id long, rwt int, seq long")
    centre = spark.createDataFrame([(1, k * 100 + i, rng.randrange(8_000_000, 9_000_000), rng.randrange(5_000_000, 6_000_000)) for k in range(6) for i in range(20)], "elem_type int, elem_id long, x int, y int")
    keyed = spark.createDataFrame([(q, f"k{k}", f"k{k}") for q in range(5) for k in rng.sample(range(6), 3)], "query_id long, phrase string, code_key string")
    names = spark.createDataFrame([], "elem_type int, elem_id long, name string")
    places = strategies.global_places(keyed, entries)
    got = strategies.local_matches_of_keys(keyed, entries, centre, places, names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, strategies.local_matches(keyed.join(entries, "code_key"), centre, places, names).collect())) != []

    corner = [{"x": x, "y": y} for x, y in ((8_000_000, 5_000_000), (8_300_000, 5_000_000), (8_300_000, 6_000_000), (8_000_000, 6_000_000))]
    rings = spark.createDataFrame([(7, 8_000_000, 5_000_000, 8_300_000, 6_000_000, [corner])], "rel_id long, minx long, miny long, maxx long, maxy long, rings array<array<struct<x:long,y:long>>>")
    regions = spark.createDataFrame([(2, 7, 4, "land")], "query_id long, rel_id long, admin_level int, norm_name string")
    found = strategies.admin_matches(keyed, entries, centre, regions, rings)
    spread = strategies.spread_elements(entries, centre).collect()
    mine = {r["code_key"] for r in keyed.where("query_id = 2").collect()}
    want = {(r["code_key"], r["elem_id"]) for r in spread if r["code_key"] in mine and 8_000_000 <= r["x"] < 8_300_000}
    assert {(r["phrase"], r["elem_id"]) for r in found.collect()} == want and want
    assert {r["query_id"] for r in found.collect()} == {2}


def test_windows_that_name_nothing_fall_out_early(spark):
    from placelore import bindings as B
    from placelore.operators import lookup, strategies
    from placelore.plans.locate import read
    from placelore.plans.queries import the_map

    d = "/root/testdata/sf0.001"
    m, rows = the_map(spark, d), lambda df: sorted(map(tuple, df.collect()))
    r = read(B.texts(spark, d), m, cache=True)
    assert rows(r.keyed) == rows(lookup.hits(r.phrases, m.name_index).select("query_id", "phrase", "code_key").distinct())
    assert 0 < 5 * r.named.count() < r.spans.count()
    assert rows(strategies.crossings(r.named, r.entries, m.way_nodes)) == rows(strategies.crossings(r.spans, m.name_index, m.way_nodes))
    assert rows(lookup.identified_regions(r.spans, m.admin_regions)) == rows(lookup.identified_regions(r.phrases, m.admin_regions))


def test_windows_that_can_name_nothing_are_not_stored(spark):
    from placelore import bindings as B
    from placelore.functions.text import code_key
    from placelore.plans.locate import name_ends, read
    from placelore.plans.queries import the_map

    d = "/root/testdata/sf0.001"
    m = the_map(spark, d)
    r = read(B.texts(spark, d), m, cache=True)
    each = r.spans.withColumn("code_key", code_key(F.col("phrase")))
    ends = {x["code_key"] for x in name_ends(m).collect()}
    want = sorted(tuple(x) for x in each.collect() if {x["code_key"].split(" ")[0], x["code_key"].split(" ")[-1]} <= ends)
    assert sorted(map(tuple, r.windows.collect())) == want and 0 < 5 * len(want) < each.count()


def test_keys_of_words_are_made_at_once(spark):
    from placelore.functions.text import code_key, split_keys

    words = [["a:b", "été", "ÿ", "s:t"], [], ["o'x", "+", "grüß"]]
    t = spark.createDataFrame([(w,) for w in words], "w array<string>")
    for x in t.select("w", split_keys(F.col("w")).alias("k"), F.transform("w", code_key).alias("each")).collect():
        assert x["k"] == x["each"], x["w"]


def test_keys_named_by_many_texts_are_intersected_once(spark, monkeypatch):
    from placelore.operators import strategies

    stored = {}

    def keep(df, name):
        stored[name] = df
        return df

    monkeypatch.setattr(strategies, "table", keep)
    spans = spark.createDataFrame([(q, b, 1, p) for q in range(40) for b, p in ((1, "ga"), (2, "gb"))], "query_id long, begin int, length int, phrase string")
    index = spark.createDataFrame([("ga", 2, 1), ("gb", 2, 2), ("gb", 2, 3)], "code_key string, elem_type int, elem_id long")
    way_nodes = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 8), (3, 1, 9)], "way_id long, pos int, node_id long")
    assert sorted(map(tuple, strategies.crossings(spans, index, way_nodes).collect())) == [(q, 8, 2, "ga", "gb") for q in range(40)]
    assert stored["pairs"].select("few", "many").distinct().collect() == [("ga", "gb")]
    assert "nodes" not in stored["pairs"].columns


def test_dedupe_against_plain_python_over_batches(spark):
    """Texts that go on over several Arrow batches, equal rows, rows that only their strategy tells apart; results are dealt once."""
    import random

    from placelore.operators import ranking

    r = random.Random(3)
    rows = [(r.randrange(9), r.choice("ab"), r.randrange(60_000), r.randrange(60_000), r.randrange(4) / 4, f"o{r.randrange(2)}", "") for _ in range(600)]
    rows += [(t, "b" if s == "a" else "a", x, y, q, o, e) for t, s, x, y, q, o, e in rows[:50]] + rows[:20] + [(99, "a", 5, 5, 0.5, "o", "")]
    key = lambda s: (-s[4], *s[2:4], *s[5:])
    near = lambda a, b: sum(((abs(a[i] - b[i]) + 5) // 10) ** 2 for i in (2, 3)) < 10**6 and all(abs(a[i] - b[i]) < 10**4 for i in (2, 3))
    want = [a for a in set(rows) if not any(a[0] == b[0] and near(a, b) and key(b) < key(a) for b in rows)]
    df = spark.createDataFrame(rows, "query_id long, strategy string, x int, y int, quality double, origin string, elements string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ranking.dedupe(df)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2  # twice that before: both sides of a join were dealt
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_results_in_portions_and_nothing_of_a_portion_stays(spark, the_map, monkeypatch):
    import os

    from placelore.plans import locate as L
    from placelore.scratch import scope, scratch_dir

    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["Storgatan och Kyrkogatan i Ekstad", "Gula bron i Ekstad", "nära Lillby", "inget"] * 3)], "query_id long, text string")
    with scope():
        whole = sorted(map(tuple, L.best_results(texts, the_map).collect()))
    monkeypatch.setattr(L, "PORTION", 4)
    folder = scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scope():
        assert sorted(map(tuple, L.best_results(texts, the_map).collect())) == whole != []
        made = [p.rsplit("-", 1)[0] for p in set(os.listdir(folder)) - before]
        assert made.count("best") > 1 and "results" not in made


def test_shuffle_files_go_with_the_table_they_were_made_for(spark):
    import glob
    import time

    from placelore.scratch import table

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: set(glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))
    df = spark.range(10_000).repartition(3, "id")
    before, end = files(), time.time() + 10
    made = table(df, "dealt")
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert made.count() == 10_000
