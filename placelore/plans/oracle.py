"""The operators in DuckDB's SQL, as common table expressions that name what they use."""

from __future__ import annotations

import re

from placelore import params as P
from placelore.bindings import CTES
from placelore.functions.text import DROPPED, FOLD_FROM, FOLD_TO, REPLACED, SYMBOLS_FROM, SYMBOLS_TO
from placelore.schema import EUROPEAN, ROAD_TYPES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def normalise(c: str) -> str:
    out = f"lower({c})"
    for a, b in REPLACED:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return f"translate({out}, {q(FOLD_FROM + SYMBOLS_FROM + DROPPED)}, {q(FOLD_TO + SYMBOLS_TO)})"


def tokens(c: str) -> str:
    plain = f"regexp_replace({normalise(c)}, '[^\\x00-\\x7F\\x{{00C0}}-\\x{{00FF}}]', '', 'g')".replace("{{", "{").replace("}}", "}")
    return f"list_filter(regexp_split_to_array({plain}, '[ ?!\"''#%*&()=,;._\\n\\r\\t/]+'), lambda w: w <> '')"


def read_words(c: str, unique: bool = False) -> str:
    stop = "[" + ", ".join(q(w) for w in P.STOP_WORDS) + "]"
    each = tokens("ln")
    if unique:  # in order of first place; each line's words are made once
        each = f"list_transform([{each}], lambda ws: list_filter(ws, lambda w, i: list_position(ws, w) = i))[1]"
    lines = f"list_filter(string_split({c}, chr(10)), lambda s: s <> '' AND NOT starts_with(s, '#'))"
    return f"list_filter(flatten(list_transform({lines}, lambda ln: {each})), lambda w: NOT list_contains({stop}, w) AND NOT regexp_full_match(w, '[!-/:-@\\[-`{{-~]'))".replace("{{", "{")


def phrase_words(c: str) -> str:
    return f"list_filter({c}, lambda w: NOT regexp_full_match(w, '[a-z]|[0-9]+'))"


def alternatives(w: str) -> str:
    no = ", ".join(q(x) for x in P.NO_DEFINITE)
    return f"CASE WHEN strlen({w}) > 4 AND regexp_matches({w}, '[ae][tn]$') THEN CASE WHEN {w} IN ({no}) THEN [{w}, {w}[:-3]] ELSE [{w}, {w}[:-2], {w}[:-3]] END WHEN strlen({w}) > 4 AND {w}[-1:] = 's' THEN [{w}, {w}[:-2]] ELSE [{w}] END"


def code_key(c: str) -> str:
    return f"regexp_replace({c}, '[^a-z0-9åäöéüø\\- ]', '~', 'g')"


def decode_lat(y: str) -> str:
    return f"(({y} - 0.5) / {P.LAT_SCALE} + {P.MIN_LAT})::DOUBLE"


def decode_lon(x: str) -> str:
    return f"(({x} - 0.5) / {P.LON_SCALE} + {P.MIN_LON})::DOUBLE"


def _lat(y: str) -> str:
    return f"radians(({y}::DOUBLE - 0.5::DOUBLE) / {P.LAT_SCALE}::DOUBLE + {P.MIN_LAT}::DOUBLE)"


def _lon(x: str) -> str:
    return f"(({x}::DOUBLE - 0.5::DOUBLE) / {P.LON_SCALE}::DOUBLE + {P.MIN_LON}::DOUBLE)"


def lat_lon(x1: str, y1: str, x2: str, y2: str) -> str:
    turn = f"radians({_lon(x1)} - {_lon(x2)})"
    cosine = f"sin({_lat(y1)}) * sin({_lat(y2)}) + cos({_lat(y1)}) * cos({_lat(y2)}) * cos({turn})"
    return f"(CASE WHEN {x1} = {x2} AND {y1} = {y2} THEN 0 ELSE floor(degrees(acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, {cosine})))) * 60 * {P.MILE}::DOUBLE + 0.5) END)::BIGINT"


def xy2(x1: str, y1: str, x2: str, y2: str) -> str:
    axis = lambda a, b: f"((abs({a}::BIGINT - {b}::BIGINT) + 5) // 10)"
    return f"({axis(x1, x2)} * {axis(x1, x2)} + {axis(y1, y2)} * {axis(y1, y2)})"


def xy(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"floor(sqrt({xy2(x1, y1, x2, y2)} + 0.5::DOUBLE))::BIGINT"


def dm2(x1: str, y1: str, x2: str, y2: str) -> str:
    d = lambda a, b: f"({a}::BIGINT - {b}::BIGINT)"
    return f"({d(x1, x2)} * {d(x1, x2)} + {d(y1, y2)} * {d(y1, y2)})"


def metres(d2: str) -> str:
    return f"floor(sqrt({d2}::DOUBLE) / 10 + 0.5)::BIGINT"


def choose(c: str, pairs, other: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k if isinstance(k, int) else q(k)} THEN {v if isinstance(v, (int, float)) else q(v)}" for k, v in pairs) + f" ELSE {other} END"


def type_quality(c: str) -> str:
    return "(" + choose(c, P.TYPE_QUALITY.items(), "0.5") + ")::DOUBLE"


def short_name(c: str) -> str:
    return choose(c, [(code, short) for code, short, _, _ in ROAD_TYPES], "'???'")


def letters_type(letters: str, number: str) -> str:
    pairs = [(short.lower(), code) for code, short, _, area in ROAD_TYPES if area is not None and short != "E"]
    return f"CASE WHEN {letters} = 'e' THEN CASE WHEN {number} IN {EUROPEAN} THEN 0 ELSE 10 END ELSE {choose(letters, pairs, '24')} END"


def position(text: str, part: str) -> str:
    return f"(CASE WHEN instr({text}, {part}) = 0 THEN -1 ELSE strlen(substr({text}, 1, instr({text}, {part}) - 1)) END)"


def position_quality(text: str, part: str) -> str:
    p = position(text, part)
    return f"(CASE WHEN {p} < 0 THEN 1.0::DOUBLE ELSE {p}::DOUBLE / (strlen({text}) - {p} + 1) END)"


_ROAD_WORDS = "(" + ", ".join(q(w) for w in P.ROAD_WORDS) + ")"
_VAGUE = "(" + ", ".join(q(w) for w in P.VAGUE_WORDS) + ")"
_NUM = lambda c: f"CASE WHEN regexp_extract({c}, '^([1-9][0-9]*)', 1) <> '' THEN substr(regexp_extract({c}, '^([1-9][0-9]*)', 1), 1, 9)::BIGINT % 65536 ELSE 0 END"


def _run(size: int) -> str:
    head = {1: "''", 2: "words[i] || ' '", 3: "words[i] || ' ' || words[i + 1] || ' '"}[size]
    where = f"WHERE phrase NOT IN {_VAGUE}" if size == 1 else ""
    last = f"words[i + {size - 1}]"
    return f"SELECT * FROM (SELECT query_id, i AS b, {size} AS l, {head} || unnest({alternatives(last)}) AS phrase FROM (SELECT query_id, words, unnest(range(1, len(words) - {size - 2})) AS i FROM pwords WHERE len(words) >= {size})) {where}"


def index_of(names: str) -> str:
    run = lambda k: f"list_transform(range(1, n - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))"
    return f"""SELECT {code_key('phrase')} AS code_key, elem_type, elem_id, rwt, elem_id * 64 + nth AS seq FROM (
 SELECT elem_type, elem_id, rwt, phrase, generate_subscripts(runs, 1) - 1 AS nth FROM (SELECT elem_type, elem_id, rwt, runs, unnest(runs) AS phrase FROM (
  SELECT *, list_concat({run('n')}, list_concat(CASE WHEN n > 1 THEN {run('(n - 1)')} ELSE [] END, CASE WHEN n > 2 THEN {run('(n - 2)')} ELSE [] END)) AS runs FROM (
   SELECT elem_type, elem_id, rwt, {tokens('name')} AS w, len({tokens('name')}) AS n FROM {names})) WHERE n > 0))"""


def index_of_rows(names: str) -> str:
    """As index_of, but plainly: a row for each run with its number in order."""
    part = lambda back: f"SELECT elem_type, elem_id, rwt, {back} AS back, i, array_to_string(w[i:i + n - {back} - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, {back} + 2)) AS i FROM named WHERE n > {back})"
    return f"""SELECT {code_key('phrase')} AS code_key, elem_type, elem_id, rwt, elem_id * 64 + row_number() OVER (PARTITION BY elem_type, elem_id ORDER BY back, i) - 1 AS seq
 FROM (WITH named AS (SELECT elem_type, elem_id, rwt, {tokens('name')} AS w, len({tokens('name')}) AS n FROM {names}) {part(0)} UNION ALL {part(1)} UNION ALL {part(2)})"""


_WORD = "words[i]"
_NEXT = "coalesce(words[i + 1], '')"
_APART = f"(regexp_full_match({_WORD}, '[a-z]|[ab][a-d]') AND regexp_matches({_NEXT}, '^[1-9]'))"
_ONE, _TWO = f"regexp_matches({_WORD}, '^[a-z][1-9]')", f"regexp_matches({_WORD}, '^[ab][a-d][1-9]')"
_NAMED = f"({_WORD} IN {_ROAD_WORDS} AND regexp_matches({_NEXT}, '^[1-9]'))"
_SAMPLED = "pos = 1 OR pos = n OR (n > 3 AND pos - 1 = n // 2) OR (n > 6 AND (pos - 1 = n // 4 OR pos - 1 = 3 * n // 4)) OR (n > 12 AND (pos - 1 = n // 8 OR pos - 1 = 3 * n // 8 OR pos - 1 = 5 * n // 8 OR pos - 1 = 7 * n // 8))"
_PARTNERS = "least(n - 1, 7, greatest(1, n // 2))"
_STRIDE = f"greatest(1, least(n - 1, coalesce(list_filter(range(n // {_PARTNERS}, greatest(n // {_PARTNERS}, n - 1) + 1), lambda s: n % s <> 0)[1], 1)))"
_BETTER = "(b.quality > a.quality OR (b.quality = a.quality AND (b.x, b.y, b.origin, b.elements) < (a.x, a.y, a.origin, a.elements)))"
_FB = choose("rwt", P.FALLBACK_RANK.items(), "0.0")

ALL = CTES | {
    "names": "SELECT * FROM node_names UNION ALL SELECT * FROM way_names",
    "name_index": index_of_rows("names"),
    "words": f"SELECT query_id, {read_words('text')} AS words FROM texts WHERE strlen(text) > 3",
    "pwords": f"SELECT query_id, {phrase_words('words')} AS words FROM words",
    "spans": " UNION ALL ".join(_run(s) for s in (3, 2, 1)),
    "phrases": "SELECT DISTINCT query_id, phrase FROM spans",
    "hits": f"SELECT query_id, phrase, code_key, elem_type, elem_id, rwt, seq FROM (SELECT *, {code_key('phrase')} AS code_key FROM phrases) JOIN name_index USING (code_key)",
    "road_types": "SELECT * FROM (VALUES " + ", ".join(f"({c}, {q(s)}, {q(n)}, {a if a is not None else 'NULL'})" for c, s, n, a in ROAD_TYPES) + ") t(road_type, short, long, area)",
    "labels": f"""SELECT DISTINCT query_id, road_type, number FROM (
 SELECT query_id, CASE WHEN letters IS NOT NULL THEN {letters_type('letters', 'number')} WHEN nm THEN CASE WHEN number < 500 THEN 1 ELSE 23 END ELSE 24 END AS road_type, number FROM (
  SELECT query_id, {_NAMED} AS nm, CASE WHEN {_APART} THEN {_WORD} WHEN {_ONE} THEN {_WORD}[1] WHEN {_TWO} THEN {_WORD}[1:2] END AS letters,
   CASE WHEN {_APART} OR ({_NAMED} AND NOT {_ONE} AND NOT {_TWO}) THEN {_NUM(_NEXT)} WHEN {_ONE} THEN CASE WHEN {_NUM(_WORD + '[2:]')} < 9999 THEN {_NUM(_WORD + '[2:]')} ELSE 0 END WHEN {_TWO} THEN {_NUM(_WORD + '[3:]')} ELSE 0 END AS number
  FROM (SELECT query_id, words, unnest(range(1, len(words) + 1)) AS i FROM words))) WHERE number > 0 AND road_type <> 24""",
    "at_roads": "SELECT road_type, number, way_id, pos, node_id, x, y FROM road_ways JOIN way_nodes USING (way_id) JOIN nodes USING (node_id)",
    "road_pairs": "SELECT DISTINCT h.query_id, h.phrase, h.elem_id, l.road_type, l.number, n.x AS px, n.y AS py FROM hits h JOIN labels l USING (query_id) JOIN nodes n ON n.node_id = h.elem_id WHERE h.elem_type = 1 AND h.rwt IN (100, 105, 110, 115)",
    "road_near": f"""SELECT elem_id, road_type, number, m.found_type AS found_type, m.node_id AS node_id, m.x AS x, m.y AS y, {metres('m.d2')} AS metres FROM (
 SELECT elem_id, p.road_type, p.number, min({{'d2': {dm2('px', 'py', 'r.x', 'r.y')}, 'found_type': r.road_type, 'way_id': way_id, 'pos': pos, 'node_id': node_id, 'x': r.x, 'y': r.y}}) AS m
 FROM (SELECT DISTINCT elem_id, road_type, number, px, py FROM road_pairs) p JOIN at_roads r ON r.number = p.number AND (r.road_type = p.road_type OR (p.road_type = 23 AND r.road_type > 1)) GROUP BY ALL)""",
    "road_matches": "SELECT query_id, phrase, m.found_type AS road_type, number, m.elem_id AS elem_id, m.node_id AS node_id, m.x AS x, m.y AS y, m.metres AS metres FROM (SELECT query_id, phrase, road_type, number, min({'metres': metres, 'elem_id': elem_id, 'found_type': found_type, 'node_id': node_id, 'x': x, 'y': y}) AS m FROM road_pairs JOIN road_near USING (elem_id, road_type, number) GROUP BY query_id, phrase, road_type, number)",
    "road_results": f"SELECT query_id, 'road' AS strategy, x, y, {P.ROAD_WEIGHT}::DOUBLE * (CASE WHEN metres <= 1000 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (log10(metres::DOUBLE) - 3.0::DOUBLE) / 2.0::DOUBLE)) END) AS quality, 'Road ' || ({short_name('road_type')}) || ' ' || number || ' near ''' || phrase || '''' AS origin, '1/' || elem_id || ',1/' || node_id AS elements FROM road_matches WHERE metres < {P.ROAD_METRES}",
    "span_nodes": f"SELECT DISTINCT query_id, b, l, phrase, node_id FROM (SELECT query_id, b, l, phrase, elem_type, elem_id FROM (SELECT *, {code_key('phrase')} AS code_key FROM spans) JOIN name_index USING (code_key)) JOIN (SELECT 1 AS elem_type, node_id AS elem_id, node_id FROM nodes UNION ALL SELECT DISTINCT 2, way_id, node_id FROM way_nodes) USING (elem_type, elem_id)",
    "crossings": f"SELECT query_id, node_id, -m.s AS score, m.a AS phrase_a, m.b AS phrase_b FROM (SELECT a.query_id, a.node_id, min({{'s': -(a.l * a.l + b.l * b.l), 'a': a.phrase, 'b': b.phrase}}) AS m FROM span_nodes a JOIN span_nodes b ON a.query_id = b.query_id AND a.node_id = b.node_id AND b.b - (a.b + a.l) BETWEEN 0 AND {P.MAX_GAP} AND instr(a.phrase, b.phrase) = 0 AND instr(b.phrase, a.phrase) = 0 GROUP BY ALL)",
    "crossing_results": f"SELECT query_id, 'crossing' AS strategy, x, y, {P.CROSSING_WEIGHT}::DOUBLE * score / max(score) OVER (PARTITION BY query_id) AS quality, 'Crossing of ''' || phrase_a || ''' and ''' || phrase_b || '''' AS origin, '1/' || node_id AS elements FROM crossings JOIN nodes USING (node_id)",
    "sampled": f"SELECT DISTINCT way_id, node_id FROM (SELECT *, count(*) OVER (PARTITION BY way_id) AS n FROM way_nodes) WHERE {_SAMPLED}",
    "centre_nodes": "SELECT 1 AS elem_type, node_id AS elem_id, node_id FROM nodes UNION ALL SELECT 2, way_id, node_id FROM sampled",
    "centre": "SELECT elem_type, elem_id, (sum(x::BIGINT) // count(*))::INT AS x, (sum(y::BIGINT) // count(*))::INT AS y FROM centre_nodes JOIN nodes USING (node_id) GROUP BY ALL",
    "admin_regions": f"""SELECT CASE WHEN starts_with(low, 'landskapet ') THEN low[12:] WHEN low <> stem AND stem || 's' IN ({', '.join(q(s) for s in P.S_STEMS)}) THEN stem || 's' ELSE stem END AS norm_name, admin_level, rel_id FROM (
 SELECT *, CASE """
    + " ".join(f"WHEN suffix(low, {q(s)}) THEN low[:-{len(s) + 1}]" for s in P.ADMIN_SUFFIXES)
    + f""" ELSE low END AS stem FROM (SELECT *, {normalise('name')} AS low FROM region_names WHERE admin_level BETWEEN 1 AND 7 AND strlen(name) > 1))""",
    "admin_by_name": "SELECT norm_name, m.admin_level AS admin_level, m.rel_id AS rel_id FROM (SELECT norm_name, min({'admin_level': admin_level, 'rel_id': rel_id}) AS m FROM admin_regions GROUP BY norm_name)",
    "regions": "SELECT query_id, rel_id, admin_level, min(norm_name) AS norm_name FROM phrases JOIN admin_by_name ON phrase = norm_name GROUP BY query_id, rel_id, admin_level",
    "spread": f"""SELECT query_id, phrase, elem_type, elem_id, rwt, x, y FROM (
 SELECT *, lag(elem_type) OVER w AS pt, lag(elem_id) OVER w AS pi, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (SELECT DISTINCT query_id, phrase, elem_type, elem_id, rwt FROM hits) JOIN centre USING (elem_type, elem_id) WINDOW w AS (PARTITION BY query_id, phrase ORDER BY elem_type, elem_id))
 WHERE NOT coalesce((pt = elem_type AND abs(pi - elem_id) <= {P.ADMIN_SKIP_IDS}) OR {xy('px', 'py', 'x', 'y')} < {P.ADMIN_SKIP_METRES}, false)""",
    "edges": "SELECT rel_id, x AS ax, y AS ay, coalesce(lag(x) OVER w, last_value(x) OVER (PARTITION BY rel_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS bx, coalesce(lag(y) OVER w, last_value(y) OVER (PARTITION BY rel_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS by_ FROM region_edges WINDOW w AS (PARTITION BY rel_id ORDER BY pos)",
    "admin_pairs": "SELECT s.*, r.rel_id, r.admin_level, r.norm_name FROM spread s JOIN regions r USING (query_id)",
    "admin_inside": "SELECT t.x, t.y, t.rel_id FROM (SELECT DISTINCT x, y, rel_id FROM admin_pairs) t JOIN edges e USING (rel_id) WHERE (ay > y) <> (by_ > y) AND x < ax + trunc((bx - ax) * (y - ay) / nullif(by_ - ay, 0)::DOUBLE)::BIGINT GROUP BY t.x, t.y, t.rel_id HAVING count(*) % 2 = 1",
    "admin_matches": "SELECT * FROM admin_pairs JOIN admin_inside USING (x, y, rel_id) QUALIFY row_number() OVER (PARTITION BY query_id, phrase, elem_type, elem_id, admin_level ORDER BY rel_id) = 1",
    "admin_results": f"""SELECT query_id, 'admin' AS strategy, x, y, {P.ADMIN_WEIGHT}::DOUBLE * (CASE WHEN qq > 0 THEN qq * (CASE WHEN rwt BETWEEN 105 AND 115 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END) * (least(9, greatest(2, admin_level)) + 18) / 27 ELSE qq END) AS quality, '''' || phrase || ''' inside ''' || norm_name || '''' AS origin, elem_type || '/' || elem_id || ',3/' || rel_id AS elements
 FROM (SELECT *, {position_quality('phrase', 'norm_name')} AS qq FROM admin_matches)""",
    "places": "SELECT query_id, elem_type, elem_id, rwt, min(seq) AS seq FROM hits WHERE rwt IN (100, 105, 110, 115) GROUP BY query_id, elem_type, elem_id, rwt QUALIFY rwt = min(rwt) OVER (PARTITION BY query_id)",
    "local_near": f"""SELECT l.query_id, l.phrase, l.elem_type, l.elem_id, c.x, c.y, p.elem_type AS g_type, p.elem_id AS g_id, p.rwt AS g_rwt, {lat_lon('c.x', 'c.y', 'g.x', 'g.y')} AS metres
 FROM (SELECT DISTINCT query_id, phrase, elem_type, elem_id FROM hits ANTI JOIN places USING (query_id, elem_type, elem_id)) l JOIN centre c USING (elem_type, elem_id) JOIN places p ON p.query_id = l.query_id JOIN centre g ON g.elem_type = p.elem_type AND g.elem_id = p.elem_id""",
    "local_matches": f"SELECT query_id, phrase, elem_type, elem_id, x, y, m.metres AS metres, m.g_type AS g_type, m.g_id AS g_id, m.g_rwt AS g_rwt, g_name FROM (SELECT query_id, phrase, elem_type, elem_id, x, y, min({{'metres': metres, 'g_type': g_type, 'g_id': g_id, 'g_rwt': g_rwt}}) AS m FROM local_near WHERE metres <= {P.LOCAL_METRES} GROUP BY ALL) LEFT JOIN (SELECT elem_type AS gt, elem_id AS gi, {normalise('name')} AS g_name FROM names) ON gt = m.g_type AND gi = m.g_id",
    "local_results": f"SELECT query_id, 'local' AS strategy, x, y, {P.LOCAL_WEIGHT}::DOUBLE * (CASE WHEN g_name IS NULL THEN 1.0::DOUBLE ELSE {position_quality('phrase', 'g_name')} END) * {type_quality('g_rwt')} AS quality, '''' || phrase || ''' near ''' || coalesce(g_name, '') || '''' AS origin, elem_type || '/' || elem_id || ',' || g_type || '/' || g_id AS elements FROM local_matches",
    "counted": f"SELECT * FROM (SELECT code_key, elem_type, elem_id, rwt, min(seq) AS seq, count(*) AS times FROM name_index SEMI JOIN hits USING (code_key) GROUP BY ALL) QUALIFY sum(times) OVER (PARTITION BY code_key) < {P.UNIQUE_HITS}",
    "counted2": "SELECT *, sum(times) OVER (PARTITION BY code_key) AS hits FROM counted",
    "group_nodes": "SELECT DISTINCT code_key, node_id FROM counted2 JOIN (SELECT 1 AS elem_type, node_id AS elem_id, node_id FROM nodes UNION ALL SELECT DISTINCT 2, way_id, node_id FROM way_nodes) USING (elem_type, elem_id) WHERE hits > 1",
    "group_each": "SELECT *, row_number() OVER (PARTITION BY code_key ORDER BY node_id) - 1 AS i, count(*) OVER (PARTITION BY code_key) AS n FROM group_nodes JOIN nodes USING (node_id)",
    "group_dist": f"SELECT a.code_key, a.node_id, a.i, b.i AS j, {lat_lon('a.x', 'a.y', 'b.x', 'b.y')} AS d FROM (SELECT *, (i + unnest(range(1, {_PARTNERS} + 1)) * {_STRIDE}) % n AS j FROM group_each WHERE n > 1) a JOIN group_each b ON b.code_key = a.code_key AND b.i = a.j",
    "group_spread": "SELECT code_key, list_sort(list(d) FILTER (i < j))[(count(*) FILTER (i < j)) // 4 + 1] AS quartile FROM group_dist GROUP BY code_key",
    "group_mid": "SELECT code_key, m.node_id AS central FROM (SELECT code_key, min({'mean': mean, 'node_id': node_id}) AS m FROM (SELECT code_key, node_id, sum(d) // count(*) AS mean FROM group_dist GROUP BY ALL) GROUP BY code_key)",
    "unique_keys": f"""SELECT code_key, elem_type, elem_id, rwt, x, y, 0 AS metres FROM counted2 JOIN centre USING (elem_type, elem_id) WHERE hits = 1
 UNION ALL SELECT code_key, m.elem_type, m.elem_id, m.rwt, m.x, m.y, quartile FROM (
  SELECT code_key, quartile, min({{'d2': {dm2('c.x', 'c.y', 'n.x', 'n.y')}, 'seq': seq, 'elem_type': elem_type, 'elem_id': elem_id, 'rwt': rwt, 'x': c.x, 'y': c.y}}) AS m
  FROM counted2 JOIN centre c USING (elem_type, elem_id) JOIN group_spread USING (code_key) JOIN group_mid USING (code_key) JOIN nodes n ON n.node_id = central WHERE hits > 1 AND quartile > 0 AND quartile < {P.UNIQUE_METRES} GROUP BY code_key, quartile)""",
    "unique_matches": "SELECT h.query_id, h.phrase, u.elem_type, u.elem_id, u.rwt, u.x, u.y, u.metres FROM (SELECT DISTINCT query_id, phrase, code_key FROM hits) h JOIN unique_keys u USING (code_key)",
    "unique_results": f"SELECT query_id, 'unique' AS strategy, x, y, {P.UNIQUE_WEIGHT}::DOUBLE * {type_quality('rwt')} * (CASE WHEN metres > {P.UNIQUE_SURE} THEN (4.5::DOUBLE - log10(metres::DOUBLE)) / 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS quality, 'Only ''' || phrase || '''' AS origin, elem_type || '/' || elem_id AS elements FROM unique_matches",
    "fallback_results": f"SELECT query_id, 'place' AS strategy, m.x AS x, m.y AS y, {P.FALLBACK_WEIGHT}::DOUBLE * ({_FB.replace('CASE rwt', 'CASE m.rwt')})::DOUBLE AS quality, 'Place ' || m.elem_type || '/' || m.elem_id AS origin, m.elem_type || '/' || m.elem_id AS elements FROM (SELECT query_id, min({{'o': CASE WHEN rwt = 100 THEN -seq ELSE seq END, 'elem_type': elem_type, 'elem_id': elem_id, 'rwt': rwt, 'x': x, 'y': y}}) AS m FROM places JOIN centre USING (elem_type, elem_id) WHERE rwt IN (100, 105, 110) GROUP BY query_id)",
    "results": " UNION ".join(f"SELECT * FROM {s}_results" for s in ("road", "crossing", "admin", "local", "unique", "fallback")),
    "deduped": f"SELECT * FROM results a WHERE NOT EXISTS (SELECT 1 FROM results b WHERE b.query_id = a.query_id AND {_BETTER} AND {xy2('a.x', 'a.y', 'b.x', 'b.y')} < {P.DEDUPE_METRES**2})",
    "ranked": f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, x, y, origin, elements) AS rank FROM deduped QUALIFY rank <= {P.TOP_K}",
    "coded": "SELECT p.x, p.y, min(code) AS code FROM (SELECT DISTINCT x, y FROM ranked) p JOIN edges e ON (ay > y) <> (by_ > y) AND x < ax + trunc((bx - ax) * (y - ay) / nullif(by_ - ay, 0)::DOUBLE)::BIGINT JOIN scb_areas USING (rel_id) WHERE code >= 100 GROUP BY p.x, p.y, rel_id, code HAVING count(*) % 2 = 1",
    "coded_min": "SELECT x, y, min(code) AS code FROM coded GROUP BY x, y",
}


def sql(final: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """final, behind the expressions that it uses, in the order of their definition."""
    every = ALL | (extra or {})
    need: set[str] = set()

    def want(text: str) -> None:
        for name in every:
            if name not in need and re.search(rf"(?<![\w.']){name}(?![\w'(])", text):
                need.add(name)
                want(every[name])

    want(final)
    parts, done = [], set()

    def put(name: str) -> None:
        if name in done:
            return
        done.add(name)
        for other in every:
            if other in need and other != name and re.search(rf"(?<![\w.']){other}(?![\w'(])", every[name]):
                put(other)
        parts.append(f"{name} AS ({every[name]})")

    for name in every:
        if name in need:
            put(name)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + final
