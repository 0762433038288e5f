"""Tables, enumerations and their codes."""

from __future__ import annotations

#: Element types.
UNKNOWN, NODE, WAY, RELATION = range(4)
#: Real-world types; their numeric order is meaningful: the smaller of two places is the more important one.
LARGE_AREA, LARGE, MEDIUM, SMALL = 100, 105, 110, 115
MAJOR_ROAD, MEDIUM_ROAD, MINOR_ROAD, BUILDING, ISLAND, WATER = 200, 205, 210, 300, 400, 401
PLACES = (LARGE_AREA, LARGE, MEDIUM, SMALL)
#: Member roles, as bits.
OUTER, INNER = 1, 2

#: Road types by code, with short name and county (regional roads are numbered within their county), and the
#: county's area code.
ROAD_TYPES = (
    (0, "E", "European Road", None),
    (1, "Nat", "National Road", None),
    (2, "M", "Skåne Län", 12),
    (3, "K", "Blekinge Län", 10),
    (4, "I", "Gotlands Län", 9),
    (5, "H", "Kalmar Län", 8),
    (6, "G", "Kronobergs Län", 7),
    (7, "N", "Hallands Län", 13),
    (8, "O", "Västra Götalands Län", 14),
    (9, "F", "Jönköpings Län", 6),
    (10, "E", "Östergötlands Län", 5),
    (11, "D", "Södermanlands Län", 4),
    (12, "AB", "Stockholms Län", 1),
    (13, "C", "Uppsala Län", 3),
    (14, "U", "Västmanlands Län", 19),
    (15, "T", "Örebro Län", 18),
    (16, "S", "Värmlands Län", 17),
    (17, "W", "Dalarnas Län", 20),
    (18, "X", "Gävleborgs Län", 21),
    (19, "Z", "Jämtlands Län", 23),
    (20, "Y", "Västernorrlands Län", 22),
    (21, "AC", "Västerbottens Län", 24),
    (22, "BD", "Norrbottens Län", 25),
    (23, "Reg", "Regional Road", None),
    (24, "???", "Unknown", None),
)
EUROPE, NATIONAL, EAST_GOTHLAND, REGIONAL, NO_ROAD = 0, 1, 10, 23, 24
#: Numbers of European roads; other numbers behind an E are roads of East Gothland.
EUROPEAN = (4, 6, 10, 12, 14, 16, 18, 20, 22, 45, 47, 55, 65, 265)

#: Silver tables, as DDL.
TABLES = {
    "nodes": "node_id long, x int, y int",
    "way_nodes": "way_id long, pos int, node_id long",
    "relation_members": "rel_id long, pos int, member_type int, member_id long, role_flags int",
    "names": "elem_type int, elem_id long, rwt int, name string",
    "name_index": "code_key string, elem_type int, elem_id long, rwt int, seq long",
    "road_ways": "road_type int, number int, way_id long",
    "admin_regions": "norm_name string, admin_level int, rel_id long",
    "scb_areas": "code int, rel_id long",
    "region_rings": "rel_id long, minx long, miny long, maxx long, maxy long, rings array<array<struct<x:long,y:long>>>",
}
#: Bronze tables: raw map elements with their tags.
RAW = {
    "nodes_raw": "id long, lat double, lon double, tags map<string,string>",
    "ways_raw": "id long, refs array<long>, tags map<string,string>",
    "relations_raw": "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>",
}
