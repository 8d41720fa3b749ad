"""Document fingerprints by SimHash, and search among them by permuted block tables.

Every run of three words votes with its 64-bit hash, as often as it occurs: for each bit, set or
not set. A fingerprint has the bits that more than half of the votes set, so texts that share
most of their runs differ in few bits. To find fingerprints within a radius, the 64 bits are cut
into blocks; however the differing bits fall, some choice of blocks has few of them or none, so a
table for each choice, keyed by these blocks, holds every near fingerprint under a key that
differs in no more bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labourmill.llm.shared import bind, materialize, words_of

BITS = 64
#: Words of a run that votes as one term.
RUN = 3
#: About so many documents stand in one bucket of the order by doc_id, within these many buckets.
BUCKET_ROWS = 500
MOST_BUCKETS = 65_536
#: Bits that near fingerprints differ in at most, and blocks of the tables. At sf0.1 587 of the 590
#: pairs of differing texts with a five-word Jaccard similarity of 0.75 or more are this near.
RADIUS = 13
BLOCKS = 4
#: Fingerprints of a table, and queries, that meet in a task; and the most tasks.
TILE = 131_072
SHARE = 16_384
MOST_TASKS = 10_000
_PAIR = (1 << 32) | 1


def _terms(text: Column, run: int = RUN) -> Column:
    """One hash for each place of a word: of it and the next ones, as far as there are any."""
    return bind(words_of(text), lambda words: F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, run)])))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fingerprint (long) of each group of rows with equal keys; their texts vote together.

    Votes are counted two bits to a number, 32 bits each, so a text may have any number of words.
    Nulls and texts without words have the fingerprint 0. If ``texts`` is dealt by some of the
    keys already, nothing is shuffled.
    """
    votes = texts.select(*keys, F.explode_outer(_terms(F.col(text))).alias("__h"))
    sums = [F.sum(F.shiftrightunsigned("__h", j).bitwiseAND(F.lit(_PAIR))).alias(f"__{j}") for j in range(BITS // 2)]
    counted = votes.groupBy(*keys).agg(F.count("__h").alias("__n"), *sums)
    bits = F.lit(0).cast("long")
    for j in range(BITS // 2):
        low = F.col(f"__{j}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"__{j}", 32)
        for at, count in ((j, low), (j + BITS // 2, high)):
            bits = bits.bitwiseOR(F.shiftleft(F.coalesce(2 * count > F.col("__n"), F.lit(False)).cast("long"), at))
    return counted.select(*keys, bits.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Part of the bits that two fingerprints have in common."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def shown(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def in_order(docs: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text, bucket, guest: documents dealt in ranges of doc_id, each range with its follower.

    A bucket also has, as a guest, the first document after it (the last bucket: the first of
    all), so every document finds its next one in its own bucket. Bounds are doc_ids that occur,
    from approximate quantiles; at most MOST_BUCKETS numbers, in one row. A null doc_id comes
    first.
    """
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("key"))
    n = min(MOST_BUCKETS, -(-docs.count() // rows) or 1)
    shares = [i / n for i in range(1, n)] or [0.5]
    bounds = materialize(
        keyed.agg(
            F.array_sort(F.array_distinct(F.array_prepend(F.percentile_approx("key", shares, max(10_000, 4 * n)), F.min("key")))).alias("bounds")
        )
    )
    key = F.col("key")

    def searched(found: Column) -> Column:
        """The last bound that isn't above the key, by halving."""
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(n.bit_length() + 1)),
            F.struct(F.lit(0).alias("lo"), F.size(found).alias("hi")),
            lambda s, _: bind(
                F.floor((s["lo"] + s["hi"]) / 2).cast("int"),
                lambda mid: F.when(F.get(found, mid) <= key, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi"))),
            ),
            lambda s: s["lo"],
        )

    def dealt(found: Column, at: Column) -> Column:
        own = F.struct(at.alias("bucket"), F.lit(False).alias("guest"))
        guest = F.struct(F.when(at > 0, at - 1).otherwise(F.size(found) - 1).alias("bucket"), F.lit(True).alias("guest"))
        return F.when(F.get(found, at) == key, F.array(own, guest)).otherwise(F.array(own))

    placed = keyed.withColumn("bounds", bounds.select("bounds").scalar()).select(
        "doc_id", "text", bind(F.col("bounds"), lambda found: bind(searched(found), lambda at: dealt(found, at))).alias("dealt")
    )
    return placed.select("doc_id", "text", F.inline("dealt"))


def edit_likeness(docs: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """Each row of (doc_id, text) with its fingerprint, an edited text's, and the next document's.

    The edited text ends in the beginning of the next document (by doc_id, then text; after the
    last the first) in place of its own last quarter. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Texts are shuffled once.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = W.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    ranked = in_order(texts, rows).select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))
    n, k = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - k), F.coalesce(F.col("next"), F.lit("")).substr(F.lit(1), k))
    row = ["bucket", "place", "guest", "doc_id", "n_chars", "edited_sha256"]
    both = ranked.select("bucket", "place", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited")).select(
        "bucket", "place", "guest", "doc_id", "n_chars",
        F.when(~F.col("guest"), F.sha2(F.col("edited").cast("binary"), 256)).alias("edited_sha256"),
        F.explode(
            F.when(F.col("guest"), F.array(F.struct(F.lit(False).alias("is_edit"), F.col("text").alias("text"))))
            .otherwise(F.array(F.struct(F.lit(False).alias("is_edit"), F.col("text").alias("text")), F.struct(F.lit(True).alias("is_edit"), F.col("edited").alias("text"))))
        ).alias("v"),
    ).select(*row, "v.*")
    prints = fingerprints(both, [*row, "is_edit"])
    wide = prints.groupBy(*row).agg(
        F.max(F.when(~F.col("is_edit"), F.col("fingerprint"))).alias("fp"), F.max(F.when(F.col("is_edit"), F.col("fingerprint"))).alias("edited_fp")
    )
    near = wide.withColumn("next_fp", F.lead("fp").over(W.partitionBy("bucket").orderBy("place")))
    return near.filter(~F.col("guest")).select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> tuple[list[int], int]:
    """One mask a table: the bits of the blocks that are its key. And how many of a key's bits may differ.

    With more blocks than ``radius`` the keys are all blocks but so many, and none may differ.
    Otherwise a key is one block; of the bits that differ, the block with the fewest has at most
    a block's equal share. Signed, as Spark's long is.
    """
    if not (0 <= radius <= BITS and 1 <= blocks <= BITS):
        raise ValueError("the radius and the blocks must lie within a fingerprint's bits")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(each, max(1, blocks - radius))]
    return [_signed(m) for m in masks], radius // blocks


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _probes(masks: list[int], flips: int) -> list[tuple[int, int, int]]:
    """table, mask, flip: every way to change up to ``flips`` bits of a table's key."""
    bits = [[i for i in range(BITS) if m >> i & 1] for m in masks]
    return [(t, m, _signed(sum(1 << i for i in some))) for t, m in enumerate(masks) for k in range(flips + 1) for some in combinations(bits[t], k)]


def _search(asked: np.ndarray, found: np.ndarray, table: int, radius: int, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of the two within ``radius`` bits, with their distance, that ``table`` is the first to yield.

    ``found`` is ordered by its key in the table; each probe of a query names a range of it.
    """
    of_table, flips = block_masks(radius, blocks)
    masks = [np.uint64(m & ((1 << BITS) - 1)) for m in of_table]
    keys = found & masks[table]
    order = np.argsort(keys, kind="stable")
    found, keys = found[order], keys[order]
    ways = np.array([f & ((1 << BITS) - 1) for t, _, f in _probes(of_table, flips) if t == table], np.uint64)
    low = (int(masks[table]) & -int(masks[table])).bit_length() - 1
    width = int(masks[table]).bit_count()
    if width <= 20 and int(masks[table]) >> low == (1 << width) - 1:  # one block: where each of its values begins
        bounds = np.searchsorted(keys >> np.uint64(low), np.arange((1 << width) + 1, dtype=np.uint64))
        ranges = lambda p: (bounds[p >> np.uint64(low)], bounds[(p >> np.uint64(low)) + np.uint64(1)])
    else:
        ranges = lambda p: (np.searchsorted(keys, p, "left"), np.searchsorted(keys, p, "right"))
    for at in range(0, len(asked), 32):
        some = asked[at : at + 32]
        first, end = (x.ravel() for x in ranges((some & masks[table])[:, None] ^ ways[None]))
        n = end - first
        before = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(before - first, n)
        who = np.repeat(np.repeat(some, len(ways)), n)
        apart = who ^ found[place]
        ok = np.nonzero(np.bitwise_count(apart) <= radius)[0]
        who, place, apart = who[ok], place[ok], apart[ok]
        new = np.ones(len(ok), bool)
        for earlier in masks[:table]:
            new &= np.bitwise_count(apart & earlier) > flips
        yield who[new], found[place[new]], np.bitwise_count(apart[new])


def near_fingerprints(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """query, found, bits_apart: for each distinct fingerprint of ``queries`` the distinct ones of
    ``corpus`` within ``radius`` bits (column fingerprint, long), itself included if there.

    Every fingerprint of the corpus has a row in each table; the first table in which a query meets
    it yields the pair. Equal fingerprints are one before they are joined, so copies make no pairs.
    Tables are cut into tiles of TILE fingerprints, by their hash, that meet the queries in shares of
    SHARE, so however often a key occurs, what a task holds and compares is bounded; probes are made
    in the task. With four blocks and 13 bits a query has 2788 keys of 16 bits and is held against
    about a twentieth of the corpus.
    """
    spark = queries.sparkSession

    def distinct(df: DataFrame, name: str) -> DataFrame:
        return materialize(df.select(F.col("fingerprint").alias(name)).filter(F.col(name).isNotNull()).distinct())

    asked, found, tables = distinct(queries, "query"), distinct(corpus, "found"), len(block_masks(radius, blocks)[0])
    tiles, shares = -(-found.count() // TILE) or 1, -(-asked.count() // SHARE) or 1
    keys = ["table", "tile", "share"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    # As many tasks as there are meetings: rows are few for the work they make.
    tasks = min(MOST_TASKS, max(tables * tiles * shares, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    mine = asked.withColumn("share", dealt("query", shares)).select("*", each(tables).alias("table")).select("*", each(tiles).alias("tile")).repartition(tasks, *keys)
    its = found.withColumn("tile", dealt("found", tiles)).select("*", each(tables).alias("table")).select("*", each(shares).alias("share")).repartition(tasks, *keys)

    def run(key: tuple, q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))]
        if len(q) and len(t):
            parts += _search(q["query"].to_numpy(np.int64).view(np.uint64), t["found"].to_numpy(np.int64).view(np.uint64), int(key[0]), radius, blocks)
        query, near, apart = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"query": query.view(np.int64), "found": near.view(np.int64), "bits_apart": apart.astype(np.int32)})

    return mine.groupBy(*keys).cogroup(its.groupBy(*keys)).applyInPandas(run, "query long, found long, bits_apart int")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def simhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, n_near, n_near_prints of every document whose id is divisible by 20:
    rows and distinct fingerprints, of all documents, within RADIUS bits of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.xxhash64("text").alias("h"), "text")
    prints = materialize(fingerprints(docs, ["doc_id", "h"]))
    queries = prints.filter(F.col("doc_id") % 20 == 0)
    sizes = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("rows"))
    near = near_fingerprints(queries, prints).join(sizes.withColumnRenamed("fingerprint", "found"), "found")
    found = near.groupBy("query").agg(F.sum("rows").alias("n_near"), F.count(F.lit(1)).alias("n_near_prints"))
    return queries.join(found.withColumnRenamed("query", "fingerprint"), "fingerprint").select("doc_id", shown(F.col("fingerprint")).alias("fingerprint"), "n_near", "n_near_prints")
