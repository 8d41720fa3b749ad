"""Mixing sources to target weights by temperature.

Source shares are raised to an exponent and normalised. The exponent is bisected: the smaller it
is, the more even the mixture (entropy) and the more often small sources repeat. The weights are
then realised: documents fall into blocks of their source by a hash, every pass over a source
takes its blocks in an order of its own, and the last pass ends where the source's budget does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labourmill.llm.shared import hash60, join_hot, key_text, materialize, words_of

#: Entropy of the mixture, as a part of that of an even one.
TARGET_ENTROPY = 0.98
#: No source is seen more often than this, its most favoured documents once more at most.
MAX_REPEATS = 2.0
#: Blocks of each source; a budget is met to about one block in so many.
BLOCKS = 256
#: Bisections of the exponent; so many in a row are settled by one pass over the sources' totals.
STEPS, AT_ONCE = 60, 6


def source_weights(
    totals: DataFrame, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS, budget: int | None = None
) -> DataFrame:
    """source, tokens, weight, target_tokens, exponent from one row (source, tokens) a source.

    The exponent is the least in 0..1 (60 bisections) at which the entropy is not above the
    target and repeats are not above the limit; at 1 the shares stay as they are. Without a
    budget the mixture is as large as it must be for every document to appear once. A source
    without tokens has weight 0. A pass sums the powers of all shares at the 63 exponents that the
    next six bisections can ask for, so sources may be as many as hosts: they never meet.
    """
    some = totals.filter("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    top, low, n = some.agg(F.max("t"), F.min("t"), F.count(F.lit(1))).first()
    if not n:
        return totals.select("source", F.col("tokens").cast("long").alias("tokens"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("target_tokens"), F.lit(1.0).alias("exponent"))
    shares = some.select((F.col("t") / top).alias("share"))

    def sums(points: list[float]) -> list[tuple[float, float]]:
        """Of the shares' powers at each point, and of these times the shares' logarithms."""
        powers = shares.select("share", F.explode(F.lit(points)).alias("x")).withColumn("power", F.pow("share", "x"))
        found = {x: (z, logs) for x, z, logs in powers.groupBy("x").agg(F.sum("power"), F.sum(F.col("power") * F.log("share"))).collect()}  # a row a point
        return [found[x] for x in points]

    def too_even(x: float, z: float, logs: float) -> bool:
        """Whether the exponent must be larger."""
        entropy = math.log(z) - x * logs / z
        return (target_entropy is not None and entropy > target_entropy * math.log(n)) or (max_repeats is not None and (top / low) ** (1 - x) > max_repeats)

    lo, hi = 0.0, 1.0
    for _ in range(STEPS // AT_ONCE):
        points = [lo + (hi - lo) * i / (1 << AT_ONCE) for i in range(1, 1 << AT_ONCE)]
        even = [too_even(x, *s) for x, s in zip(points, sums(points), strict=True)]
        a, b = 0, 1 << AT_ONCE  # places of lo and hi among the points
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (middle, b) if even[middle - 1] else (a, middle)
        lo, hi = lo + (hi - lo) * a / (1 << AT_ONCE), lo + (hi - lo) * b / (1 << AT_ONCE)
    z = sums([hi])[0][0]
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double") / top, F.lit(hi))).otherwise(0.0)
    # Without a budget the largest source, whose power is 1, is seen just once.
    size = F.lit(float(budget)) / z if budget is not None else F.lit(top)
    return totals.select("source", F.col("tokens").cast("long").alias("tokens"), (power / z).alias("weight"), (power * size).alias("target_tokens"), F.lit(hi).alias("exponent"))


def block_plan(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """source, block, epoch: the blocks that each pass over a source takes.

    ``blocks`` has (source, block, tokens). A pass takes all blocks but the last, which takes
    those whose middle lies within what is left of the budget, in an order drawn for that pass.
    Blocks without tokens are taken by the first pass and no other.
    Windows run over the blocks of one source and pass, not over documents.
    """
    passes = weights.select("source", "target_tokens", F.when(F.col("tokens") > 0, F.floor(F.col("target_tokens") / F.col("tokens"))).otherwise(0).alias("full"), F.col("tokens").alias("all"))
    wanted = blocks.join(passes, "source").select(
        "source", "block", "tokens", "all", "target_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))).alias("epoch")
    )
    order = W.partitionBy("source", "epoch").orderBy(hash60(F.concat_ws(":", "source", "epoch", "block")), "block")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.col("target_tokens") - F.col("epoch") * F.col("all")
    ends = wanted.withColumn("middle", before + F.col("tokens") / 2.0)
    once = (F.col("tokens") == 0) & (F.col("epoch") == 0)
    return ends.filter(((F.col("tokens") > 0) & (F.col("middle") <= left)) | once).select("source", "block", "epoch")


def _blocked(docs: DataFrame, tokens: Column, key: str, source: str, blocks: int) -> DataFrame:
    """row (all columns but epoch), source, block, tokens."""
    kept = [f"`{c}`" for c in docs.columns if c != "epoch"]
    block = hash60(F.concat(F.lit("block:"), key_text(F.col(f"`{key}`")))) % blocks
    return docs.select(F.struct(*kept).alias("row"), key_text(F.col(f"`{source}`")).alias("source"), block.alias("block"), tokens.cast("long").alias("tokens"))


def mix(
    docs: DataFrame, tokens: Column, key: str = "doc_id", source: str = "source", blocks: int = BLOCKS, **target
) -> DataFrame:
    """``docs`` with the column epoch (int): a row for each pass that takes the document.

    ``tokens`` is the number of tokens of a row. Rows with equal keys and sources go together; a
    null source is a source. Documents of sources without tokens appear once. A column named
    epoch is replaced. Only (source, block) totals are shuffled; the plan has at most ``blocks``
    rows for each source and pass, and a hot source spreads over its blocks.
    """
    blocked = _blocked(docs, tokens, key, source, blocks)
    sums = materialize(blocked.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    totals = materialize(sums.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    plan = block_plan(sums, source_weights(totals, **target)).groupBy("source", "block").agg(F.sort_array(F.collect_list("epoch")).alias("epochs"))
    taken = materialize(plan.join(sums, ["source", "block"]).select("source", "block", "epochs", "rows"))
    return join_hot(blocked, taken, ["source", "block"], "rows").select("row.*", F.explode(F.col("epochs").cast("array<int>")).alias("epoch"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens (words), epoch: every pass over every document of the mixture."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"))
    counted = materialize(docs)
    return mix(counted, F.col("n_tokens"))


ORACLE = f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
    ('0x' || substr(md5('block:' || coalesce('=' || doc_id::VARCHAR, '')), 1, 15))::BIGINT % {BLOCKS} AS block
  FROM documents
),
blocks AS (SELECT s, block, sum(n_tokens)::BIGINT AS tokens FROM counted GROUP BY ALL),
totals AS (SELECT s, sum(tokens)::DOUBLE AS t FROM blocks GROUP BY s),
filled AS (SELECT list(t ORDER BY s) AS ts, max(t) AS top, min(t) AS low FROM totals WHERE t > 0),
bisect AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END
  FROM (
    SELECT step, lo, hi, mid, pow(top / low, 1 - mid) > {MAX_REPEATS}
      OR list_sum(list_transform(ps, lambda p: -(p / list_sum(ps)) * ln(p / list_sum(ps)))) > {TARGET_ENTROPY} * ln(len(ts)) AS up
    FROM (SELECT *, list_transform(ts, lambda t: pow(t / top, mid)) AS ps FROM (SELECT *, (lo + hi) / 2 AS mid FROM bisect, filled WHERE step < {STEPS}))
  )
),
fitted AS (SELECT hi AS x, top FROM bisect, filled WHERE step = {STEPS}),
targets AS (SELECT s, t, CASE WHEN t > 0 THEN pow(t / top, x) * top ELSE 0 END AS target FROM totals, fitted),
wanted AS (
  SELECT s, block, tokens, t, target, unnest(range(0, CASE WHEN t > 0 THEN floor(target / t)::BIGINT ELSE 0 END + 1)) AS epoch
  FROM blocks JOIN targets USING (s)
),
placed AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY s, epoch ORDER BY ('0x' || substr(md5(s || ':' || epoch || ':' || block), 1, 15))::BIGINT, block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + tokens / 2.0 AS middle FROM wanted
)
SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch
FROM counted JOIN placed USING (s, block)
WHERE (tokens > 0 AND middle <= target - epoch * t) OR (tokens = 0 AND epoch = 0)
"""
