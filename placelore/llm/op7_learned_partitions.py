"""Approximate nearest neighbours by learned partitions of a balanced neighbour graph.

A bounded sample gets its exact neighbour graph, and the graph a balanced partition that cuts few edges. A small network
learns to tell a vector's partition; it then places every vector of the table and routes each query to its most probable
partitions, where all vectors are compared. How many those are is read from queries that the fit has not seen, whose exact
neighbours are found among all vectors: as many as the recall takes, up to all. Partitions stand in groups, which are salted
into blocks of bounded size, so a hot one is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placelore.llm.common import read, table
from placelore.shipping import ship

#: Vectors, at most, that the partition and the network are fitted on.
SAMPLE = 8192
NEIGHBOURS, HIDDEN, EPOCHS = 10, 128, 12
#: Vectors, about, of a partition, and partitions at most: the sample has 32 vectors for each.
EACH, MOST = 256, 256
#: Partitions of a group, which a query visits once; vectors and queries of a block.
GROUP, VECTORS, QUERIES = 32, 8192, 4096
#: Pairs, about, whose exact scores are worked at once.
PAIRS = 1 << 16
#: Partitions of a query, at least, and the share of its true neighbours that they must hold.
PROBES, RECALL = 8, 0.9
#: Queries that recall is measured on; with fewer than LEAST, all partitions are searched. Standard errors it must be above.
TRIALS, LEAST, ERRORS = 512, 32, 2.0
K = 20


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row its k rows of largest inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_partition(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.05) -> np.ndarray:
    """Halves by principal direction, then moves rows to where most of their neighbours are while no part overflows."""
    n = len(x)
    label = np.zeros(n, np.int64)
    todo, made = [(np.arange(n), parts)], 0
    while todo:
        rows, p = todo.pop()
        if p == 1:
            label[rows] = made
            made += 1
            continue
        centred = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        left = p // 2
        split = len(order) * left // p
        todo += [(order[:split], left), (order[split:], p - left)]
    room = int(np.ceil(slack * n / parts))
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        src = np.repeat(np.arange(n), near.shape[1])
        np.add.at(votes, (src, label[near].ravel()), 1)
        np.add.at(votes, (near.ravel(), label[src]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < n // 200:
            break
    return label


class Router:
    """A network with one hidden layer from a vector to the logits of its partition."""

    def __init__(self, x: np.ndarray, label: np.ndarray, parts: int, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 0):
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        self.scale = 1.0 / max(1e-12, float(np.sqrt((x**2).mean())))
        w = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        step, x = 0, x * self.scale
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            rate = 0.01 * (1 - epoch / epochs)
            for i in range(0, len(x), 256):
                some = order[i : i + 256]
                a, y = x[some], label[some]
                h = np.maximum(0, a @ w[0] + w[1])
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(some)), y] -= 1
                p /= len(some)
                back = (p @ w[2].T) * (h > 0)
                step += 1
                for j, g in enumerate((a.T @ back, back.sum(0), h.T @ p, p.sum(0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    w[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x * self.scale) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed in the order of the components: equal vectors get equal scores."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def nearest(q_id, q, v_id, v, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of v for each of q but its own id, ties to the smaller id, by exact scores."""
    n = min(k + len(v_id) - len(np.unique(v_id)), len(v_id))  # repeated rows of one id may not crowd out others
    out = []
    for i in range(0, len(q), 256):
        rough = q[i : i + 256] @ v.T
        own = q_id[i : i + 256, None] == v_id[None, :]
        rough[own] = -np.inf
        cut = np.partition(rough, len(v_id) - n, axis=1)[:, len(v_id) - n]
        near = (rough >= (cut - 1e-9 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0))))[:, None]) & ~own
        many = np.cumsum(near.sum(1))
        first = 0
        while first < len(near):  # so many rows that their pairs stay few
            last = max(first + 1, int(np.searchsorted(many, PAIRS + (many[first - 1] if first else 0), side="right")))
            row, col = np.nonzero(near[first:last])
            row += i + first
            out.append(best_of(row, v_id[col], inner(q[row], v[col]), k))
            first = last
    row, ids, score = (np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3))
    return q_id[row], ids, score


def best_of(q, v_id, score, k: int, *more) -> tuple[np.ndarray, ...]:
    """Of the rows of each q the k best, ties to the smaller id, each id once."""
    order = np.lexsort((-score, v_id, q))
    order = order[np.r_[True, (np.diff(q[order]) != 0) | (np.diff(v_id[order]) != 0)][: len(order)]]
    order = order[np.lexsort((v_id[order], -score[order], q[order]))]
    _, first, count = np.unique(q[order], return_index=True, return_counts=True)
    order = order[np.arange(len(order)) - np.repeat(first, count) < k]
    return tuple(c[order] for c in (q, v_id, score, *more))


def rough_nearest(q_id, q, v_id, v, at, k: int) -> tuple[np.ndarray, ...]:
    """(place of the query, id, score, partition): the k best of v for each of q but its own id, by scores of one product."""
    k += len(v_id) - len(np.unique(v_id))  # repeated rows of one id may not crowd out others
    n = min(k + 1, len(v_id))
    out = []
    for i in range(0, len(q), 128):
        s = q[i : i + 128] @ v.T
        s[q_id[i : i + 128, None] == v_id[None, :]] = -np.inf
        c = np.argpartition(s, len(v_id) - n, axis=1)[:, len(v_id) - n :]
        s, row = np.take_along_axis(s, c, 1), np.repeat(np.arange(i, i + len(s)), n)
        real = np.isfinite(s.ravel())
        out.append((row[real], v_id[c.ravel()][real], s.ravel()[real], at[c.ravel()][real]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def fewest(query: np.ndarray, turn: np.ndarray, parts: int, least: int, recall: float) -> int:
    """The smallest number of partitions, from least on, that reaches the recall for sure; else all.

    A row for each true neighbour: its query, and how many partitions of that query's order come before its own.
    """
    _, of = np.unique(query, return_inverse=True)
    if not len(of) or of.max() + 1 < LEAST:
        return parts
    held = np.zeros((of.max() + 1, parts))
    np.add.at(held, (of, turn), 1)
    held = held.cumsum(1) / held.sum(1, keepdims=True)
    sure = held.mean(0) - ERRORS * held.std(0, ddof=1) / np.sqrt(len(held)) >= recall
    return int(next((p for p in range(least, parts) if sure[p - 1]), parts))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, probes: int = PROBES, sample: int = SAMPLE, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """For each query its k nearest vectors by inner product among the partitions it is routed to, but its own id.

    Returns query_id, rank, vec_id, score. Every vector is placed in a partition; only the fit uses a sample. A query goes to
    probes partitions, or to so many more that queries held out of the fit find the given share of their true neighbours, and
    always to so many that k candidates stand there, if the table has them.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without an id, nor vectors of
    another length than most have (of equally frequent lengths the shorter counts). Of repeated rows of one id the nearest
    counts as a candidate, and the smallest vector asks. Ties go to the smaller id. An empty table gives an empty result. Other
    columns are not looked at. Placed vectors are written once to the shared scratch folder.
    """
    ship(vectors.sparkSession)
    e = F.col(f"`{embedding}`")
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    def valid(df: DataFrame) -> DataFrame:
        good = e.isNotNull() & F.forall(e, real) & F.exists(e, lambda x: x != 0) & F.col(f"`{vec_id}`").isNotNull()
        return df.where(F.coalesce(good, F.lit(False))).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(e, lambda x: x.cast("double")).alias("v"))

    rows = valid(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total, spare = sizes["n"], sizes["n"] - sizes["ids"]
    rows = rows.where(F.size("v") == sizes["d"])
    asked = valid(queries).where(F.size("v") == sizes["d"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    h = F.xxhash64("vec_id")
    some = rows.withColumn("h", h).orderBy("h", "vec_id").limit(sample).collect()
    x = np.array([r["v"] for r in some])
    parts = int(max(1, min(MOST, total // EACH, len(x) // 32)))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    router = Router(unit, balanced_partition(unit, neighbour_graph(unit, NEIGHBOURS), parts), parts)
    towards = lambda v: router.logits(v / np.linalg.norm(v, axis=1, keepdims=True))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                at = towards(matrix(batch.column("v"))).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(at, pa.int32())], ["vec_id", "v", "part"])

    placed = table(rows.mapInArrow(place, "vec_id long, v array<double>, part int"), "placed")
    holds = np.zeros(parts, np.int64)
    for r in placed.groupBy("part").count().collect():  # a row for each partition
        holds[r["part"]] = r["count"]
    if parts > probes:
        held = asked.where(h > some[-1]["h"]) if len(some) == sample else asked.limit(0)
        trial = held.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(TRIALS).collect()
        t_id, t = np.array([r["vec_id"] for r in trial], np.int64), np.array([r["v"] for r in trial])

        def truth(batches):
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            for batch in batches:
                if batch.num_rows:
                    got = rough_nearest(t_id, t, batch.column("vec_id").to_numpy(), matrix(batch.column("v")), batch.column("part").to_numpy(), k)
                    q, v, score, part = (np.concatenate(c) for c in zip(best, got, strict=True))
                    best = best_of(q, v, score, k, part)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["query", "vec_id", "score", "part"])

        least, probes = probes, parts
        if len(trial) >= LEAST:
            single = placed.mapInArrow(truth, "query long, vec_id long, score double, part long").groupBy("query", "vec_id").agg(F.max_by("part", "score").alias("part"), F.max("score").alias("score"))
            nearer = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
            true = single.withColumn("nth", F.row_number().over(nearer)).where(F.col("nth") <= k).select("query", "part").collect()
            query, part = np.array([r["query"] for r in true], np.int64), np.array([r["part"] for r in true], np.int64)
            turn = np.argsort(np.argsort(-towards(t), axis=1), axis=1)
            probes = fewest(query, turn[query, part], parts, least, recall)
    probes = min(probes, parts)

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-towards(matrix(batch.column("v"))), axis=1, kind="stable")
                enough = (holds[order].cumsum(1) < k + 1 + spare).sum(1) + 1  # its own row and repeated ones are no candidates
                take = np.minimum(parts, np.maximum(probes, enough))
                of = np.repeat(np.arange(len(order)), take)
                best = order[np.arange(parts) < take[:, None]]
                best = best[np.lexsort((best, of))]
                new = np.r_[True, (of[1:] != of[:-1]) | (best[1:] // GROUP != best[:-1] // GROUP)]  # a row for each group
                of = pa.array(of[new])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[np.flatnonzero(new), best.size], pa.int32()), pa.array(best, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(of), batch.column("v").take(of), lists, pa.array(best[new] // GROUP, pa.int32())], ["vec_id", "v", "probed", "grp"])

    placed = placed.withColumn("grp", F.floor(F.col("part") / GROUP).cast("int"))
    routed = asked.mapInArrow(route, "vec_id long, v array<double>, probed array<int>, grp int")
    salts = {g: -(-int(holds[g * GROUP : (g + 1) * GROUP].sum()) // VECTORS) for g in range(-(-parts // GROUP))}
    chunks = {r["grp"]: -(-r["count"] // QUERIES) for r in routed.groupBy("grp").count().collect()}
    of = lambda m: F.element_at(F.array(*(F.lit(max(1, m.get(g, 1))) for g in range(-(-parts // GROUP)))), F.col("grp") + 1)
    left = routed.withColumn("chunk", F.pmod(h, of(chunks)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), of(salts) - 1)))
    right = placed.withColumn("salt", F.pmod(h, of(salts)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), of(chunks) - 1)))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if a.num_rows and b.num_rows:
            q_id, q, v_id, v, at = a.column("vec_id").to_numpy(), matrix(a.column("v").combine_chunks()), b.column("vec_id").to_numpy(), matrix(b.column("v").combine_chunks()), b.column("part").to_numpy()
            probed = a.column("probed").combine_chunks()
            row, part = probed.value_parent_indices().to_numpy(), probed.flatten().to_numpy()
            for p in np.unique(at):
                some = row[part == p]
                if len(some):
                    got.append(nearest(q_id[some], q[some], v_id[at == p], v[at == p], k))
        got = best_of(*(np.concatenate(c) for c in zip(*got, strict=True)), k)
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.float64())})

    keys = ["grp", "salt", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.pmod("vec_id", F.lit(20)) == 0))
