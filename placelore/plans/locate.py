"""The facade: texts and a map in, ranked places out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore import params as P
from placelore.functions import geo
from placelore.functions.text import MOST_FORMS, alternatives, code_key, phrase_words, read_words, spans, split_keys
from placelore.operators import lookup, ranking, strategies
from placelore.scratch import scope, table

#: Phrases that name something, about so many of them at a time, are followed to results. Changes the work, never the result.
PORTION = 1_000_000


@dataclass
class Map:
    """The silver tables. flat: nested relations resolved, made from relation_members if not given."""

    nodes: DataFrame
    way_nodes: DataFrame
    relation_members: DataFrame
    names: DataFrame
    road_ways: DataFrame
    admin_regions: DataFrame
    scb_areas: DataFrame
    region_rings: DataFrame
    name_index: DataFrame | None = None
    flat: DataFrame | None = None

    def __post_init__(self):
        self.name_index = self.name_index if self.name_index is not None else lookup.name_index(self.names)
        self.flat = self.flat if self.flat is not None else lookup.flat_members(self.relation_members)

    def stored(self) -> Map:
        """The same map with its tables written to the shared scratch folder, for maps that are views of other data.

        A map that was read from a snapshot has no need of it. relation_members stay as they are: only flat is read from here on.
        """
        return Map(**{f.name: getattr(self, f.name) if f.name == "relation_members" else table(getattr(self, f.name), f.name) for f in fields(self)})


@dataclass
class Read:
    """What is made of the texts before any strategy runs.

    hits has a row for each element of each phrase. It is keyed, the phrases that name something, and entries, what their keys
    name, joined by code_key; strategies use these two. named: the windows of keyed. windows: of all windows (spans) those that
    can name an element or a region, by their first and last word.
    """

    words: DataFrame
    spans: DataFrame
    windows: DataFrame
    phrases: DataFrame
    named: DataFrame
    keyed: DataFrame
    entries: DataFrame
    hits: DataFrame


def searchable(texts: DataFrame) -> DataFrame:
    """Texts of more than three bytes; shorter ones, and null, are not searched."""
    return texts.where(F.octet_length("text") > 3)


def read(texts: DataFrame, m: Map, stop_words=P.STOP_WORDS, vague=P.VAGUE_WORDS, cache: bool = False) -> Read:
    """texts: (query_id, text). Texts of three bytes or fewer are not searched. cache: write what is made once, for several uses."""
    # dealt anew: a small file is one task, and words and spans are far more work than its bytes
    # in as many parts as the session shuffles to: left to adaptive execution, few bytes become few tasks again
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = searchable(texts).repartition(parts, "query_id").select("query_id", read_words(F.col("text"), stop_words).alias("words"))
    words = table(words, "words") if cache else words
    able = words.select("query_id", phrase_words(F.col("words")).alias("w")).withColumn("forms", F.transform("w", alternatives))
    # outer, and filtered behind: an inner explode would make the optimiser work the whole expression once more as a filter
    each = able.select("query_id", F.explode_outer(spans(F.col("w"), F.col("forms"), vague=vague)).alias("s")).where("s IS NOT NULL").select("query_id", "s.begin", "s.length", "s.phrase")
    each = each.withColumn("code_key", code_key(F.col("phrase")))
    phrases = each.select("query_id", "phrase").distinct()
    able_to_name = table(windows(able, table(name_ends(m), "ends"), vague), "windows") if cache else each
    entries = m.name_index.join(able_to_name.select("code_key").distinct(), "code_key", "left_semi")
    entries = table(entries, "entries") if cache else entries
    # few windows name something: those that do not go before phrases are told apart
    named = able_to_name.join(entries.select("code_key").distinct(), "code_key", "left_semi").select("query_id", "begin", "length", "phrase", "code_key")
    named = table(named, "named") if cache else named
    keyed = named.select("query_id", "phrase", "code_key").distinct()
    keyed = table(keyed, "keyed") if cache else keyed
    return Read(words, each.drop("code_key"), able_to_name, phrases, named, keyed, entries, keyed.join(entries, "code_key") if cache else lookup.hits(phrases, m.name_index))


def name_ends(m: Map) -> DataFrame:
    """(code_key): the first and the last word of every key of the index and of every region's name, each once."""
    keys = m.name_index.select("code_key").union(m.admin_regions.select(code_key(F.col("norm_name"))))
    ends = F.array(F.substring_index("code_key", " ", 1), F.substring_index("code_key", " ", -1))
    return keys.select(F.explode(ends).alias("code_key")).distinct()


def windows(able: DataFrame, ends: DataFrame, vague=P.VAGUE_WORDS, most: int = P.MAX_WORDS) -> DataFrame:
    """(query_id, begin, length, phrase, code_key): the windows of text.spans whose first and last word are among ends.

    able: (query_id, w, forms). A word that begins no name ends all its windows before they are formed.
    """
    i = F.col("i")
    # the keys of a text's words are made at once, and those of their forms are cut from them: a form is the head of its word
    at = able.select("query_id", "w", "forms", split_keys(F.col("w")).alias("keys"))
    at = at.withColumn("i", F.explode_outer(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)))).where("i IS NOT NULL")
    ahead = [F.get(c, i + k).alias(f"{c}{k}") for k in range(1, most) for c in ("w", "forms", "keys")]
    at = at.select("query_id", (i + 1).alias("begin"), F.get("forms", i).alias("forms0"), F.get("keys", i).alias("keys0"), *ahead)
    cut = lambda key, form: F.substring(key, F.lit(1), F.length(form))
    first = at.select("*", F.posexplode_outer("forms0").alias("nth", "head")).where("head IS NOT NULL").drop("forms0")
    first = first.withColumn("key", cut(F.col("keys0"), F.col("head"))).join(ends.withColumnRenamed("code_key", "key"), "key", "left_semi")
    made = [(1, F.when(~F.col("head").isin(*vague), F.col("head")) if vague else F.col("head"), F.col("key"), F.col("key"))]
    for size in range(2, most + 1):
        so_far = lambda c, head: F.concat_ws(" ", head, *(f"{c}{k}" for k in range(1, size - 1)))  # noqa: B023, E731
        for j in range(MOST_FORMS):
            last = F.when(F.col("nth") == 0, F.get(f"forms{size - 1}", F.lit(j)))  # only the last word of a window takes other forms
            key = cut(F.col(f"keys{size - 1}"), last)
            made.append((size, F.concat(so_far("w", "head"), F.lit(" "), last), F.concat(so_far("keys", "key"), F.lit(" "), key), key))
    rows = F.array(*(F.struct(F.lit(size).alias("length"), p.alias("phrase"), key.alias("code_key"), last.alias("last")) for size, p, key, last in made))
    each = first.select("query_id", "begin", F.explode(rows).alias("s")).select("query_id", "begin", "s.*").where("phrase IS NOT NULL")
    return each.join(ends.withColumnRenamed("code_key", "last"), "last", "left_semi").select("query_id", "begin", "length", "phrase", "code_key")


def query_stats(r: Read) -> DataFrame:
    """Words and distinct phrases of each text."""
    n = r.phrases.groupBy("query_id").agg(F.count("*").alias("n_phrases"))
    return r.words.select("query_id", F.size("words").cast("long").alias("n_words")).join(n, "query_id", "left").withColumn("n_phrases", F.coalesce("n_phrases", F.lit(0)))


def results(texts: DataFrame, m: Map, cache: bool = True) -> DataFrame:
    """All results of all strategies, unranked.

    What several strategies use (words, spans, keys and what they name, centres) is worked once and written to the shared scratch folder: they
    read it from there, plans stay short, and a lost executor costs no more than its tasks.
    """
    return _ground(texts, m, cache)[0](lambda of_texts: of_texts)


def _ground(texts: DataFrame, m: Map, cache: bool) -> tuple[Callable[[Callable[[DataFrame], DataFrame]], DataFrame], DataFrame]:
    """All that is worked once, for texts and for keys, as a function from a choice of texts to their results; and the named phrases.

    The choice is a filter of tables by query_id.
    """
    r = read(texts, m, cache=cache)
    keep = table if cache else lambda df, _: df
    centre = lookup.centres(r.entries, m.nodes, m.way_nodes, m.flat)
    centre = keep(centre, "centres")
    places = keep(strategies.global_places(r.keyed, r.entries), "global-places")
    regions = keep(lookup.identified_regions(r.windows, m.admin_regions), "regions")
    said, near = strategies.road_keys(r.keyed, r.entries, r.words, m.nodes, lookup.road_nodes(m.road_ways, m.way_nodes, m.nodes))
    near = keep(near, "roads-of-keys")
    pairs, shared = strategies.crossing_keys(r.named, r.entries, m.way_nodes)
    shared = keep(shared, "shared-nodes")
    inside = keep(strategies.inside_regions(r.entries, centre, regions, m.region_rings), "inside")
    points = keep(strategies.located(r.entries, centre), "points")
    only = keep(strategies.unique_keys(r.entries, centre, m.nodes, m.way_nodes, m.flat), "unique-keys")
    g = strategies.placed(places, centre, m.names)

    def found(of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return ranking.union([
            strategies.road_results(strategies.road_rows(of(said), near)),
            strategies.crossing_results(strategies.crossing_rows(of(pairs), shared), m.nodes),
            strategies.admin_results(strategies.admin_rows(of(r.keyed), of(regions), inside)),
            strategies.local_results(strategies.local_rows(of(r.keyed), points, of(g))),
            strategies.unique_results(of(r.keyed).join(only, "code_key")),
            strategies.fallback_results(of(places), centre),
        ])

    return found, r.keyed


def best_results(texts: DataFrame, m: Map, k: int | None = P.TOP_K, dedupe_metres: int = P.DEDUPE_METRES, rank: bool = True, cache: bool = True) -> DataFrame:
    """Results after dedupe; rank: with their rank, and the best k of each text.

    Results are many times the tables, and only those that stay are kept: texts go through in portions, each to its end, and
    what a portion wrote goes before the next one begins.
    """
    found, keyed = _ground(texts, m, cache)

    def end(rows: DataFrame) -> DataFrame:
        rows = ranking.dedupe(rows, dedupe_metres) if dedupe_metres else rows
        return ranking.ranked(rows, k) if rank else rows

    if not cache:
        return end(found(lambda of_texts: of_texts))
    n = -(-keyed.count() // PORTION) or 1
    done = []
    for i in range(n):
        part = F.pmod(F.xxhash64("query_id"), F.lit(n)) == i
        with scope():
            some = table(found(lambda of_texts: of_texts.where(part)), "results")  # noqa: B023
            done.append(table(end(some), "best", outer=True))
    return ranking.union(done)


def locate(texts: DataFrame, m: Map, k: int | None = P.TOP_K, dedupe_metres: int = P.DEDUPE_METRES, areas: DataFrame | None = None, cache: bool = True) -> DataFrame:
    """Ranked places of each text: query_id, rank, strategy, x, y, lat, lon, quality, scb_code, origin, elements.

    areas: (code, name) adds municipality and county names.
    """
    best = best_results(texts, m, k, dedupe_metres, cache=cache)
    coded = lookup.area_codes(best, m.region_rings, m.scb_areas, county=False).withColumnRenamed("code", "scb_code")
    out = coded.select("query_id", "rank", "strategy", "x", "y", geo.decode_lat(F.col("y")).alias("lat"), geo.decode_lon(F.col("x")).alias("lon"), "quality", "scb_code", "origin", "elements")
    return out if areas is None else with_names(out, areas)


def with_names(coded: DataFrame, areas: DataFrame) -> DataFrame:
    """coded: (scb_code, ...) with the names of its municipality and, by the hundreds of the code, county; null if unknown.

    areas: (code, name), a fixed list of a few hundred rows, so it is broadcast.
    """
    county = F.when(F.col("scb_code") > 100, F.floor(F.col("scb_code") / 100).cast("int"))
    out = coded.join(F.broadcast(areas.select(F.col("code").alias("scb_code"), F.col("name").alias("municipality"))), "scb_code", "left")
    return out.withColumn("c", county).join(F.broadcast(areas.select(F.col("code").alias("c"), F.col("name").alias("county"))), "c", "left").drop("c")


def compare(found: DataFrame, expected: DataFrame) -> DataFrame:
    """expected: (query_id, x, y). The great-circle metres from each text's results to the nearest expected point."""
    e = expected.select("query_id", F.col("x").alias("ex"), F.col("y").alias("ey"))
    d = geo.distance_lat_lon(F.col("x"), F.col("y"), F.col("ex"), F.col("ey"))
    return found.join(e, "query_id").groupBy("query_id").agg(F.min(d).alias("metres"))
