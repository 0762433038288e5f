"""N-gram Jaccard join by MinHash banding: documents whose word 5-gram sets have a similarity of 0.8 or more.

1. ``signed``    every whole text becomes a set of 5-grams; kept are its MinHash bands, a 1-bit sketch, size and fingerprint.
2. Documents of one set (copies) become one node, counted by partial aggregates, so a large group of copies is one row.
3. Bands are shuffled by their hash. In a bucket every node is paired with the bucket's smallest node: a star, not all pairs.
4. Pairs are verified on full sets, and verified links give classes (connected components).
5. Pairs of a bucket that star and classes leave open, those of nodes in different classes, are verified too, in blocks of
   bounded size that emit one link for two classes. So every candidate pair is either verified or already inside one class,
   and no bucket, not even a large one just under the threshold, emits its pairs.
6. Links are counted inside classes, on full sets, in blocks of bounded size that emit counts and never pairs.

Size and sketch only skip pairs: sizes those with |A| < |B| * threshold, which cannot be linked; sketches those further apart
than SIGMAS standard deviations from what the threshold makes likely (3 in ten million linked pairs, far below what banding
itself may miss). Without it a group of copies just under the threshold would cost its square.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.llm.anchors import packed, slices, texts_of
from placelore.llm.arrays import BASE, U, groups, mix, prefix, span, split_words
from placelore.llm.common import read, table
from placelore.llm.components import components
from placelore.shipping import ship

WORDS, THRESHOLD = 5, 0.8
#: Probability that a pair at the threshold shares a band, at least; hashes at most; bits of the sketch.
RECALL, HASHES, BITS = 0.9995, 128, 512
#: Standard deviations that a pair's sketches may be further apart than expected at the threshold.
SIGMAS = 5.0
#: Nodes of a block in which pairs are verified or counted.
BLOCK = 256


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that reach the recall within the hashes."""
    best = (hashes, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of all texts, and the text of each; a shorter text is one n-gram of all its words."""
    _, _, _, of, sym = split_words(texts)
    at = np.flatnonzero(of[words - 1 :] == of[: len(of) - words + 1]) if len(of) >= words else np.zeros(0, np.int64)
    pre = prefix(sym)
    gram, owner = mix(span(pre, at, at + words)), of[at]
    many = np.bincount(of, minlength=len(texts))
    short = np.flatnonzero((many > 0) & (many < words))
    begin = np.cumsum(many) - many
    extra = mix(span(pre, begin[short], begin[short] + many[short]) + many[short].astype(U) * U(BASE))
    gram, owner = np.concatenate([gram, extra]), np.concatenate([owner, short])
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])] if len(gram) else np.zeros(0, bool)
    return gram[new], owner[new]


def signatures(gram: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    """32-bit MinHash values, one row for each set; sets are gram[starts[i]:starts[i + 1]], none empty.

    One 64-bit product gives two hashes: its upper and its lower half.
    """
    rng = np.random.default_rng(5)
    mult = rng.integers(1, 1 << 63, hashes // 2, dtype=np.int64).astype(U) * U(2) + U(1)
    shift = rng.integers(0, 1 << 63, hashes // 2, dtype=np.int64).astype(U)
    out = np.empty((len(starts), hashes), np.uint32)
    for first in range(0, len(starts), 32):  # a stretch that stays in the cache
        last = min(first + 32, len(starts))
        low, high = starts[first], starts[last] if last < len(starts) else len(gram)
        part, at = gram[low:high], starts[first:last] - low
        for j in range(hashes // 2):
            both = (part * mult[j] + shift[j]).view(np.uint32).reshape(-1, 2)
            out[first:last, 2 * j] = np.minimum.reduceat(both[:, 0], at)
            out[first:last, 2 * j + 1] = np.minimum.reduceat(both[:, 1], at)
    return out


def node_id(doc_id: str, text: str):
    """A document's id; rows without one get an id from their text, above all real ids."""
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))


def signed(docs: DataFrame, words: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    hashes = max(bands * rows, BITS)

    def go(batches):
        for batch in slices(batches, 1024):
            texts, ids = texts_of(batch, "body"), batch.column("node").to_numpy()
            for first, last in groups(texts, 1 << 19):
                gram, of = shingles(texts[first:last], words)
                if not len(gram):
                    continue
                have, starts = np.unique(of, return_index=True)
                size = np.diff(np.r_[starts, len(gram)])
                sig = mix(signatures(gram, starts, hashes))
                place = np.arange(1, rows + 1, dtype=U) * U(BASE)
                band = np.stack([mix((sig[:, b * rows : (b + 1) * rows] * place).sum(1, dtype=U) + U(b)) for b in range(bands)], 1)
                bits = np.packbits((sig[:, :BITS] & U(1)).astype(np.uint8), axis=1).view(np.int64)
                k1 = np.add.reduceat(mix(gram), starts)
                k2 = np.add.reduceat(mix(gram ^ U(BASE)), starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:last][have]), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(size.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), bits.shape[1]).cast(pa.list_(pa.int64())), pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))],
                    ["node", "k1", "k2", "size", "sketch", "bands"],
                )

    kept = docs.select(node_id(doc_id, text).alias("node"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    return kept.mapInArrow(go, "node long, k1 long, k2 long, size int, sketch array<long>, bands array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(node, grams): the sorted set of each of the nodes, as bytes, made anew from the texts."""

    def go(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in slices(batches, 1024):
            texts = [press.decompress(z) for z in batch.column("z").to_pylist()]
            for first, last in groups(texts, 1 << 19):
                gram, of = shingles(texts[first:last], words)
                edge = np.searchsorted(of, np.arange(last - first + 1))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, last - first), pa.array([gram[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], ["node", "grams"])

    kept = docs.select(node_id(doc_id, text).alias("node"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    held = kept.join(nodes, "node", "left_semi").mapInArrow(packed, "node long, z binary")
    return held.groupBy("node").agg(F.first("z").alias("z")).mapInArrow(go, "node long, grams binary")


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def go(batches):
        for batch in slices(batches, 64):
            a, b = (batch.column(c).to_pylist() for c in ("ga", "gb"))
            ok = [similar(np.frombuffer(x, U), np.frombuffer(y, U), threshold) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    return both.select("a", "b", "ga", "gb").mapInArrow(go, "a long, b long")


def near(x: str, y: str, threshold: float):
    """Can the two rows reach the threshold, by size and sketch?"""
    c = lambda side, name: F.col(f"{side}.{name}")
    agree = (1 + threshold) / 2
    bound = BITS * (1 - agree) + SIGMAS * math.sqrt(BITS * agree * (1 - agree))
    apart = reduce(add, (F.bit_count(c(x, "sketch")[i].bitwiseXOR(c(y, "sketch")[i])) for i in range(BITS // 64)))
    return (F.least(c(x, "size"), c(y, "size")) >= F.greatest(c(x, "size"), c(y, "size")) * threshold - 1e-9) & (apart <= F.lit(int(bound)))


def linked_in(t: pa.Table, threshold: float) -> np.ndarray:
    """Which rows of a pair of blocks (or of one block) are linked, on full sets. Of two blocks only pairs across them count."""
    side = t.column("side").to_numpy()
    grams = [np.frombuffer(g, U) for g in t.column("grams").to_pylist()]
    size = np.array([len(g) for g in grams])
    flat, of = np.concatenate(grams), np.repeat(np.arange(len(grams)), size)
    _, code, many = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(many > 1)
    place = np.full(len(many), -1)
    place[shared] = np.arange(len(shared))
    of, code = of[many[code] > 1], place[code[many[code] > 1]]
    order = np.argsort(code, kind="stable")
    of, code = of[order], code[order]
    both = np.zeros((len(grams), len(grams)))
    for low in range(0, len(shared), 4096):
        i, j = np.searchsorted(code, [low, low + 4096])
        x = np.zeros((len(grams), min(4096, len(shared) - low)), np.float32)
        x[of[i:j], code[i:j] - low] = 1
        both += x @ x.T
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if t.column("i")[0] != t.column("j")[0]:
        linked &= side[:, None] != side[None, :]
    return linked


def block_links(threshold: float):
    """For two blocks of a class (or one): how many documents each node of one is linked to in the other."""

    def go(t: pa.Table) -> pa.Table:
        copies = t.column("copies").to_numpy()
        links = (linked_in(t, threshold) * copies[None, :]).sum(1).astype(np.int64)
        return pa.table({"node": t.column("node"), "links": pa.array(links)})

    return go


def block_bridges(threshold: float):
    """For two blocks of a bucket (or one): a link for each two classes that are linked there."""

    def go(t: pa.Table) -> pa.Table:
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        a, b = np.nonzero(linked_in(t, threshold) & (comp[:, None] < comp[None, :]))
        _, first = np.unique(np.stack([comp[a], comp[b]], 1), axis=0, return_index=True)
        return pa.table({"a": pa.array(node[a[first]]), "b": pa.array(node[b[first]])})

    return go


def in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, node, ...) once for each pair of blocks (i <= j) of its key that holds the row's block; side: is it block j?"""
    size = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(size, key).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    every = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return every.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "side": F.when(F.col("block") > F.col("other"), 1).otherwise(0)}).drop("blocks", "block", "other")


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, links: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: the class it belongs to and the number of documents it is linked to.

    Words are runs of characters other than space and U+0009 to U+000D, unchanged; a text of fewer words than an n-gram is
    one n-gram. Two documents are linked if their n-gram sets have a Jaccard similarity of threshold or more. Classes are
    connected components of links; class_id is the smallest id in it. Copies count as links; no pair is emitted.

    Returns node (the document's id), class_id and, with links, n_links, a row for each distinct document. Texts without
    words (null, empty, blank) are not linked. Rows that share an id are one document to the classes; rows without an id
    get one from their text, above 2 ** 62. An empty table gives an empty result. Other columns are not looked at.
    """
    ship(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    sign = table(signed(docs, words, bands, rows, doc_id, text), "signed")
    nodes = table(sign.groupBy("k1", "k2").agg(F.min("node").alias("rep"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("size", "sketch", "bands"))), "nodes")
    band = nodes.select(F.col("rep").alias("node"), "size", F.explode("bands").alias("band"))
    hub = band.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    sketch = nodes.select(F.col("rep").alias("node"), "sketch")
    full = table(band.join(hub, "band").join(sketch, "node"), "buckets")
    heads = full.where("node = hub").select("node", "size", "sketch").distinct().select(F.col("node").alias("hub"), F.struct("size", "sketch").alias("h"))
    star = full.where("node <> hub").groupBy("hub", "node").agg(F.first(F.struct("size", "sketch")).alias("m")).join(heads, "hub").where(near("m", "h", threshold))
    pairs = table(star.select(F.col("hub").alias("a"), F.col("node").alias("b")), "pairs")
    want = full.select("node").distinct()
    sets = table(sets_of(docs, want, words, doc_id, text), "sets")
    edges = table(verified(pairs, sets, threshold), "links")
    comp = components(edges)
    # pairs of a bucket between different classes
    led = full.drop("hub").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = led.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    open_ = led.join(mixed, "band", "left_semi").select("band", "node", "comp")
    edges2 = table(in_blocks(open_, "band").join(sets, "node").groupBy("band", "i", "j").applyInArrow(block_bridges(threshold), "a long, b long").distinct(), "links")
    if not edges2.isEmpty():
        comp = components(edges.union(edges2))
    member = sign.select("node", "k1", "k2").distinct().join(nodes.select("k1", "k2", "rep", "copies"), ["k1", "k2"])
    out = member.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("node", "rep", "copies", F.coalesce("comp", "rep").alias("class_id"))
    if links:
        out = out.join(counted(comp, nodes, sets, threshold).withColumnRenamed("node", "rep"), "rep", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    one = out.groupBy("node").agg(F.min("class_id").alias("class_id"), *([F.sum("n_links").alias("n_links")] if links else []))
    every = docs.select(node_id(doc_id, text).alias("node")).distinct().join(one, "node", "left")
    return every.select("node", F.coalesce("class_id", "node").alias("class_id"), *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []))


def counted(comp: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, links): documents of other nodes that the node is linked to, counted in pairs of blocks of each class."""
    m = comp.join(nodes.select(F.col("rep").alias("node"), "copies"), "node")
    got = in_blocks(m, "comp").join(sets, "node").groupBy("comp", "i", "j").applyInArrow(block_links(threshold), "node long, links long")
    return got.groupBy("node").agg(F.sum("links").alias("links"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("node", "doc_id")


#: Classes over a relation ``docs`` of doc_id and text: brute force over all shared shingles.
CLASS_SQL = r"""
sw AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM docs
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM sw WHERE len(words) > 0)
), cnt AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN cnt p ON p.doc_id = a JOIN cnt q ON q.doc_id = b WHERE 5 * c >= 4 * (p.n + q.n - c)
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
), class AS (
  SELECT a AS doc_id, least(a, min(b)) AS class_id FROM reach GROUP BY a
)"""

SQL = (
    "WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), "
    + CLASS_SQL
    + """
SELECT doc_id, coalesce(class_id, doc_id)::BIGINT AS class_id, coalesce(n, 0)::BIGINT AS n_links
FROM docs LEFT JOIN class USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM both_ways GROUP BY a) USING (doc_id)
"""
)
