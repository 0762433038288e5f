"""Temperature mixing of sources: flattened token shares, realised as budgeted permutations of blocks of documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placelore.llm.common import fresh, read, table
from placelore.shipping import ship

#: No source is repeated more often than this.
REPETITION = 2.0
#: Least tokens of a block; and blocks, about, at most in all: blocks grow with the corpus, their number doesn't.
BLOCK_TOKENS, BLOCKS = 1 << 16, 1 << 20
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which their table (a short row each) is broadcast; beyond, the hot ones are salted instead.
FEW_SOURCES, SALTS = 50_000, 64
#: Inner points that one pass over the totals tries at once; passes.
POINTS, PASSES = 63, 9


def _sums(totals: DataFrame, points: list[float]) -> list[tuple[float, float]]:
    """For each exponent t: sum of p ** t and of p ** t * ln p over the sources, p being a share."""
    p = F.col("share")
    row = totals.agg(*(F.sum(F.pow(p, F.lit(t))).alias(f"z{i}") for i, t in enumerate(points)), *(F.sum(F.pow(p, F.lit(t)) * F.log(p)).alias(f"l{i}") for i, t in enumerate(points))).first()
    return [(row[f"z{i}"], row[f"l{i}"]) for i in range(len(points))]


def entropy_exponent(totals: DataFrame, target: float) -> float:
    """The exponent in [0, 1] whose weights have the target entropy, in nats. Entropy falls as the exponent rises.

    Each pass bisects on POINTS inner points at once. A target above ln(sources) gives 0, one below the entropy of the shares 1.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        points = [low + (high - low) * i / (POINTS + 1) for i in range(POINTS + 2)]
        ok = [math.log(z) - t * s / z >= target for t, (z, s) in zip(points, _sums(totals, points), strict=True)]
        if not ok[0]:
            return low
        if ok[-1]:
            return high
        i = max(j for j in range(len(ok)) if all(ok[: j + 1]))
        low, high = points[i], points[i + 1]
    return (low + high) / 2


def repetition_exponent(least: float, most: float, limit: float) -> float:
    """The smallest exponent in [0, 1] at which the rarest source repeats no more than limit times as often as the largest.

    Weights w = p ** t / Z repeat a source w / p times as often as its natural share, so the extremes of p decide.
    """
    repeats = lambda t: (least / most) ** (t - 1)
    low, high = 0.0, 1.0
    if repeats(low) <= limit:
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if repeats(mid) <= limit else (mid, high)
    return high


def word_count(text: str):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def with_blocks(rows: DataFrame, blocks: DataFrame, source: str, code: str, sources: int) -> DataFrame:
    """rows with their source's number of blocks. A hot source never fills one task: rows stay where they are, or are salted."""
    if sources <= FEW_SOURCES:
        return rows.join(F.broadcast(blocks), source)
    (salt,) = fresh(rows, "mix_salt")
    salted = blocks.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.col(code), F.lit(SALTS)).cast("int")).join(salted, [source, salt]).drop(salt)


def mix(docs: DataFrame, limit: float = REPETITION, entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: bool = False) -> DataFrame:
    """Schedules documents so that sources come at the weights share ** t / Z.

    t: bisected so that no source is repeated more than limit times, or, if entropy is given, to weights of that entropy.
    budget: tokens of the mixture; by default the least that shows every source whole at least once, so nothing is lost.
    A source of weight w gets w * budget tokens: whole passes over its blocks, each pass permuted anew, and of the last pass
    blocks up to the budget (the last block is taken if at least half of it fits).

    Returns a row for each scheduled document: doc_id, source, n_tokens (words), epoch (from 0), block, slot (the block's
    place in its source's schedule, from 1) and position (how far into the source's share the block's middle is, from 0 to 1:
    ordering by it interleaves the sources by weight); with keep all columns of docs and nothing else.

    A null text counts as empty; null sources are one source; sources without any token keep their documents, once, as one
    block. Rows with null ids, and repeated rows, are scheduled like any others. An empty table gives an empty result. Texts
    are read once: words, code and what is returned are written to the shared scratch folder.
    """
    ship(docs.sparkSession)
    s, n, b, at, many, epoch, slot, position = fresh(docs, *(f"mix_{c}" for c in ("source", "tokens", "block", "code", "blocks", "epoch", "slot", "position")))
    code = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(f"`{doc_id}`").cast("string"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))), 1, 8), 16, 10).cast("long")
    whole = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))
    wanted = docs.columns if keep else dict.fromkeys((doc_id, source))
    tagged = table(docs.select(*(F.col(f"`{c}`") for c in wanted), whole.alias(s), word_count(f"`{text}`").alias(n), code.alias(at)), "tagged")
    totals = tagged.groupBy(F.col(s).alias("s")).agg(F.sum(n).alias("tokens"))
    grand = totals.agg(F.sum("tokens").alias("t"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least"), F.max("tokens").alias("most"), F.count("*").alias("sources")).first()
    total = grand["t"] or 0
    if entropy is None:
        t = repetition_exponent(grand["least"] / total, grand["most"] / total, limit) if total else 1.0
    else:
        t = entropy_exponent(totals.where("tokens > 0").select((F.col("tokens") / F.lit(total)).alias("share")), entropy) if total else 1.0
    # e: how often each source is shown, before rounding to blocks
    if budget is None:
        e = F.pow(F.lit(float(grand["most"] or 1)) / F.col("tokens"), F.lit(1.0 - t))
    else:
        z = totals.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(t)))).first()[0] or 1.0
        e = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(t)) / F.lit(z) * F.lit(float(budget)) / F.col("tokens")
    each = max(block_tokens, -(-total // BLOCKS))
    shown = totals.select("s", "tokens", F.when(F.col("tokens") > 0, e).otherwise(F.lit(1.0)).alias("e"), F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(each))).alias("blocks"))
    dealt = with_blocks(tagged, shown.select(F.col("s").alias(s), F.col("blocks").alias(many)), s, at, grand["sources"]).withColumn(b, F.pmod(F.col(at), F.col(many))).drop(many, at)
    block = dealt.groupBy(F.col(s).alias("s"), F.col(b).alias("b")).agg(F.sum(n).alias("n")).join(shown, "s")
    runs = block.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil("e").cast("int") - 1))))
    permuted = Window.partitionBy("s").orderBy("epoch", F.md5(F.concat_ws("|", F.lit(seed), "s", "epoch", "b")), "b")
    placed = runs.withColumn("before", F.coalesce(F.sum("n").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("slot", F.row_number().over(permuted))
    quota = F.col("e") * F.col("tokens")
    taken = placed.where((F.col("tokens") == 0) | (F.col("before") + F.col("n") / 2 <= quota)).select(F.col("s").alias(s), F.col("b").alias(b), F.col("epoch").alias(epoch), F.col("slot").cast("long").alias(slot), F.when(F.col("tokens") == 0, 0.0).otherwise((F.col("before") + F.col("n") / 2) / quota).alias(position))
    out = dealt.join(taken, [s, b])
    if keep:
        return out.select(*(F.col(f"`{c}`") for c in docs.columns))
    return out.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(n).alias("n_tokens"), F.col(epoch).alias("epoch"), F.col(b).alias("block"), F.col(slot).alias("slot"), F.col(position).alias("position"))


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"), "block", "slot", F.round("position", 6).alias("position"))


#: The schedule over a relation ``docs`` of doc_id, text and source.
MIX_SQL = r"""
tagged AS (
  SELECT *, coalesce('=' || source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n,
         ('0x' || substr(md5(concat_ws('|', 'mix', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT AS code
  FROM docs
), totals AS (
  SELECT s, sum(n)::BIGINT AS tokens FROM tagged GROUP BY s
), edge AS (
  SELECT min(tokens) FILTER (tokens > 0)::DOUBLE AS least, max(tokens)::DOUBLE AS most, sum(tokens) AS total FROM totals
), tau AS (
  SELECT most, greatest(65536, ceil(total / 1048576.0)) AS each,
         CASE WHEN most / least <= 2.0 THEN 1.0 ELSE ln(2.0) / ln(most / least) END AS d FROM edge
), shown AS (
  SELECT s, tokens, CASE WHEN tokens > 0 THEN pow(most / tokens, d) ELSE 1.0 END AS e, greatest(1, ceil(tokens / each))::BIGINT AS blocks
  FROM totals, tau
), dealt AS (
  SELECT tagged.*, code % blocks AS b FROM tagged JOIN shown USING (s)
), block AS (
  SELECT s, b, sum(n)::BIGINT AS n FROM dealt GROUP BY s, b
), runs AS (
  SELECT s, b, n, tokens, e, unnest(range(0, greatest(1, ceil(e)::BIGINT))) AS epoch FROM block JOIN shown USING (s)
), placed AS (
  SELECT *, coalesce(sum(n) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, row_number() OVER p AS slot
  FROM runs WINDOW p AS (PARTITION BY s ORDER BY epoch, md5(concat_ws('|', 'mix', s, epoch::VARCHAR, b::VARCHAR)), b)
), taken AS (
  SELECT s, b, epoch, slot, CASE WHEN tokens = 0 THEN 0.0 ELSE (before + n / 2.0) / (e * tokens) END AS position
  FROM placed WHERE tokens = 0 OR before + n / 2.0 <= e * tokens
)"""

SQL = (
    "WITH docs AS (SELECT doc_id, text, source FROM documents), "
    + MIX_SQL
    + """
SELECT doc_id, source, n AS n_tokens, epoch::BIGINT AS epoch, b AS block, slot::BIGINT AS slot, round(position, 6) AS position
FROM dealt JOIN taken USING (s, b)
"""
)
