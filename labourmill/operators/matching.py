"""Raw skills to taxonomy concepts: by label similarity, by vectors, and both in a cascade.

Where there are more than BLOCK labels, those above a threshold are found by filter and verify: two texts whose ratio reaches it have a
certain number of pairs of letters in common, so they share one of their rarest pairs. Postings of
these are joined, common pairs of letters counted, and only what is left has its ratio worked out.

Vectors beyond BLOCK go by pivots (``neighbours``).

Other searches compare distinct queries with all labels or vectors. Up to BLOCK targets, counted before,
go to every task whole, and queries stay where they are. More are cut into blocks of that size,
and every block meets every share of the queries once; each meeting keeps its best k, and the best
of these are taken by query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labourmill.functions import scalars
from labourmill.functions.ratio import Labels, ratio
from labourmill.operators import neighbours
from labourmill.sources import scratch, skew

FUZZY_SCORE, CASCADE_CONFIDENCE = 80.0, 0.85
EMBEDDING_SCORE, LABEL_WEIGHT = 0.72, 0.6
#: Targets of one block.
BLOCK = 20_000


def _searched(queries: DataFrame, targets: DataFrame, query: str, target: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over parts of the queries and parts of the targets, so that each two meet once."""
    spark = queries.sparkSession
    n, shares = targets.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n <= BLOCK:
        sent = spark.sparkContext.broadcast(targets.toPandas())

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield run(batch, sent.value)

        return queries.repartition(shares, query).mapInPandas(each, schema)
    blocks = -(-n // BLOCK)
    q = queries.withColumn("__s", F.pmod(F.xxhash64(query), F.lit(shares))).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    t = targets.withColumn("__b", F.pmod(F.xxhash64(target), F.lit(blocks))).withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    return q.groupBy("__b", "__s").cogroup(t.groupBy("__b", "__s")).applyInPandas(run, schema)


def _best(found: DataFrame, query: str, k: int, *order: Column) -> DataFrame:
    place = F.row_number().over(W.partitionBy(query).orderBy(*order))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _grams(text: Column, width: int) -> Column:
    """A text's runs of ``width`` characters, each with its number among equal ones."""
    n = F.char_length(text)
    parts = F.when(n >= width, F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(F.array_sort(parts)), lambda g: F.transform(g, lambda x, i: F.concat(x, F.lit("#"), (i - F.array_position(g, x)).cast("string"))))[0]


def _common(lengths: Column, share: float, width: int) -> Column:
    """Fewest common grams of two texts with a ratio of ``share``, by the sum of their lengths.

    A ratio r of texts with n letters in all leaves out (1 - r) n letters and keeps r n / 2, which
    have that many grams less width - 1; a letter left out breaks width - 1 of them at most.
    """
    return F.ceil(lengths * (share / 2 - (width - 1) * (1 - share)) - (width - 1) - 1e-9)


def _prefixes(texts: DataFrame, often: DataFrame, share: float, width: int) -> DataFrame:
    """A row for each of a text's rarest grams that it could share with an alike one: name, n, grams, gram."""
    each = skew.join_split(texts.select("name", F.explode("grams").alias("gram")), often, "gram", F.col("name"))
    # A gram that no label has is the rarest of all, and meets nothing.
    counted = each.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("known"))
    least = _common(2 * F.col("n") / (2 - share), share, width)
    unknown = F.size("grams") - F.size("known")
    first = F.slice("known", F.lit(1), F.greatest(F.size("grams") - least + 1 - unknown, F.lit(0)).cast("int"))
    return texts.join(counted, "name").select("name", "n", "grams", F.explode(F.transform(first, lambda g: g["gram"])).alias("gram"))


def fuzzy_candidates(raw: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """raw_skill, label: all pairs whose token-sort ratio may reach ``least`` (above 67), and few others.

    Pairs of letters serve where they say something; raw skills that are too short for that, and
    the short labels that may be like them, go by single letters.
    """
    share = least / 100
    if share <= 2 / 3:
        raise ValueError("below 67 pairs of letters leave nothing out")
    asked = scratch.kept(raw.select(F.col("raw_skill").alias("name"), sorted_tokens(F.col("raw_skill")).alias("text")).filter("text != ''").withColumn("n", F.char_length("text")))
    known = scratch.kept(labels.select(F.col("label").alias("name"), sorted_tokens(F.col("label")).alias("text")).distinct().withColumn("n", F.char_length("text")))
    short = _common(2 * F.col("n") / (2 - share), share, 2) < 1
    longest = (2 - share) / share + 1e-9
    found = []
    for width, some, others in ((2, asked.filter(~short), known), (1, asked.filter(short), known.join(F.broadcast(asked.filter(short).agg(F.max("n").alias("most"))), F.lit(True)).filter(F.col("n") <= F.col("most") * longest).drop("most"))):
        a, b = (x.select("name", "n", _grams(F.col("text"), width).alias("grams")) for x in (some, others))
        often = b.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
        mine = _prefixes(a, often, share, width)
        its = _prefixes(b, often, share, width).select(F.col("name").alias("label"), F.col("n").alias("m"), F.col("grams").alias("its"), "gram")
        near = (F.col("m") * longest >= F.col("n")) & (F.col("n") * longest >= F.col("m"))
        enough = F.size(F.array_intersect("grams", "its")) >= _common(F.col("n") + F.col("m"), share, width)
        found.append(skew.join_split(mine, its, "gram", F.col("name")).filter(near).filter(enough).select(F.col("name").alias("raw_skill"), "label"))
    return found[0].unionByName(found[1]).distinct()


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (raw_skill, label) whose token-sort ratio is at least that, with their score (0 to 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = np.array([ratio(a, b) for a, b in zip(batch["a"], batch["b"], strict=True)], np.float64)
            some = score >= least
            yield pd.DataFrame({"raw_skill": batch["raw_skill"][some], "label": batch["label"][some], "score": score[some] / 100.0})

    return pairs.select("raw_skill", "label", sorted_tokens(F.col("raw_skill")).alias("a"), sorted_tokens(F.col("label")).alias("b")).mapInPandas(run, "raw_skill string, label string, score double")


def fuzzy_top_k(raw: DataFrame, labels: DataFrame, k: int = 3, least: float = 0.0) -> DataFrame:
    """raw_skill, rank, label, uri, score (0 to 1) of the k labels with the best token-sort ratio.

    ``raw`` has distinct raw_skill; ``labels`` (label, uri, pos). Among equals the label with the
    least pos comes first. Blank skills have none. Only labels with a ratio of at least ``least``
    (0 to 100) count. Up to BLOCK labels are all compared, which takes a task less than looking
    for candidates does. Of more, with a threshold of FUZZY_SCORE or more, candidates are found by
    their pairs of letters; with a lower one these come first, and only skills that have fewer than
    k such labels are compared with all. The result is the same.
    """
    if labels.count() <= BLOCK:
        return _compared(raw, labels, k, least)
    if least >= FUZZY_SCORE:
        near = _verified(fuzzy_candidates(raw, labels, least), least).join(labels.select("label", "uri", "pos"), "label")
        return _best(near, "raw_skill", k, F.desc("score"), F.col("pos")).select("raw_skill", "rank", "label", "uri", "score")
    near = scratch.kept(fuzzy_top_k(raw, labels, k, FUZZY_SCORE))
    enough = near.filter(F.col("rank") == k).select("raw_skill")
    rest = scratch.kept(raw.select("raw_skill").join(enough, "raw_skill", "left_anti"))
    return near.join(enough, "raw_skill", "left_semi").unionByName(_compared(rest, labels, k, least))


def _compared(raw: DataFrame, labels: DataFrame, k: int, least: float) -> DataFrame:
    """``fuzzy_top_k`` by comparing with all labels. Those whose length alone keeps them below
    ``least`` are left out; the others are compared all at once, in as many steps as the longest
    has characters.
    """

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        known, pos = Labels(t["label"].tolist()), t["pos"].to_numpy(np.int64)
        parts = []
        for skill, text in zip(q["raw_skill"], q["text"], strict=True):
            found, scores = known.ratios(text, least)
            best = np.lexsort((pos[found], -scores))[:k]
            parts.append(pd.DataFrame({"raw_skill": skill, "at": found[best], "score": scores[best] / 100.0}))
        every = pd.concat(parts) if parts else pd.DataFrame({"raw_skill": [], "at": np.zeros(0, np.int64), "score": []})
        at = every["at"].to_numpy(np.int64)
        return pd.DataFrame({"raw_skill": every["raw_skill"].to_numpy(object), "label": t["label"].to_numpy(object)[at], "uri": t["uri"].to_numpy(object)[at], "pos": pos[at], "score": every["score"].to_numpy(np.float64)})

    asked = raw.select("raw_skill", scalars.normalize_text(F.col("raw_skill")).alias("text")).filter("text != ''")
    found = _searched(asked, labels.select("label", "uri", "pos"), "raw_skill", "label", run, "raw_skill string, label string, uri string, pos long, score double")
    return _best(found, "raw_skill", k, F.desc("score"), F.col("pos")).select("raw_skill", "rank", "label", "uri", "score")


def sorted_tokens(text: Column) -> Column:
    words = F.filter(F.split(scalars.normalize_text(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def fuzzy_match(raw: DataFrame, labels: DataFrame, least: float = FUZZY_SCORE) -> DataFrame:
    """raw_skill, uri, label, confidence of the best label with at least that ratio.

    What has the same tokens in any order is found by an equi-join; only the rest is compared.
    """
    exact = labels.groupBy(sorted_tokens(F.col("label")).alias("t")).agg(F.min_by(F.struct("label", "uri"), "pos").alias("l"))
    keyed = raw.select("raw_skill", sorted_tokens(F.col("raw_skill")).alias("t")).filter("t != ''")
    exact = scratch.kept(exact)
    same = keyed.join(exact, "t").select("raw_skill", F.col("l.uri").alias("uri"), F.col("l.label").alias("label"), F.lit(1.0).alias("confidence"))
    rest = keyed.join(exact, "t", "left_anti").select("raw_skill")
    near = fuzzy_top_k(rest, labels, 1, least).select("raw_skill", "uri", "label", F.col("score").alias("confidence"))
    return same.unionByName(near)


def knn_top_k(queries: DataFrame, concepts: DataFrame, k: int = 3, label_weight: float = LABEL_WEIGHT) -> DataFrame:
    """text, rank, uri, score of the k concepts with the largest weighted cosine.

    ``queries`` (text, vec); ``concepts`` (uri, label_vec, desc_vec). Queries without vector have
    no row; concepts without either vector are never found. Up to BLOCK concepts are all
    compared, in a matrix product for each STRIPE of queries; more go by ``neighbours.nearest``, with the same
    result.
    """
    if concepts.count() > BLOCK:
        return neighbours.nearest(queries, concepts, k, label_weight)

    def unit(rows: pd.Series) -> np.ndarray:
        x = np.stack([np.asarray(r, np.float64) for r in rows])
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"text": pd.Series(dtype=object), "uri": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})]
        if not len(q) or not len(t):
            return parts[0]
        labels, descriptions, uri = unit(t["label_vec"]).T, unit(t["desc_vec"]).T, t["uri"].to_numpy()
        for at in range(0, len(q), neighbours.STRIPE):
            some = q.iloc[at : at + neighbours.STRIPE]
            x = unit(some["vec"])
            scores = label_weight * x @ labels + (1 - label_weight) * x @ descriptions
            top = np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :k]  # t is ordered by uri
            parts.append(pd.DataFrame({"text": np.repeat(some["text"].to_numpy(), top.shape[1]), "uri": uri[top.ravel()], "score": np.take_along_axis(scores, top, 1).ravel()}))
        return pd.concat(parts)

    whole = concepts.filter("label_vec is not null and desc_vec is not null").select("uri", "label_vec", "desc_vec").orderBy("uri")
    found = _searched(queries.filter("vec is not null").select("text", "vec"), whole, "text", "uri", run, "text string, uri string, score double")
    return _best(found, "text", k, F.desc(F.round("score", 12)), F.col("uri")).select("text", "rank", "uri", "score")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def pair_similarity(pairs: DataFrame, queries: DataFrame, concepts: DataFrame, label_weight: float = LABEL_WEIGHT) -> DataFrame:
    """``pairs`` (text, uri) with their weighted cosine; 0 where either has no vector."""
    both = pairs.join(queries.select("text", "vec"), "text", "left").join(concepts.select("uri", "label_vec", "desc_vec"), "uri", "left")
    score = label_weight * cosine(F.col("vec"), F.col("label_vec")) + (1 - label_weight) * cosine(F.col("vec"), F.col("desc_vec"))
    return both.withColumn("score", F.coalesce(score, F.lit(0.0))).select(*pairs.columns, "score")


def embedding_match(raw: DataFrame, queries: DataFrame | None, concepts: DataFrame | None, labels: DataFrame | None = None, least: float = EMBEDDING_SCORE) -> DataFrame:
    """raw_skill, uri, confidence of the best concept with at least that score; without vectors by labels."""
    if queries is None:
        top = fuzzy_top_k(raw, labels, 3).withColumnRenamed("raw_skill", "text")
    else:
        top = knn_top_k(queries.join(raw.select(F.col("raw_skill").alias("text")), "text", "left_semi"), concepts, 3)
    return top.filter((F.col("rank") == 1) & (F.col("score") >= least)).select(F.col("text").alias("raw_skill"), "uri", F.col("score").alias("confidence"))


def cascade_map_skills(raw: DataFrame, labels: DataFrame, concepts: DataFrame, chains: DataFrame, queries: DataFrame | None = None, vectors: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """One row for each distinct raw_skill: esco_uri, esco_label, esco_type, skill_category, confidence, method.

    Labels first, then vectors, then a model's answers (raw_skill, uri, label, confidence,
    method); each stage only sees what the ones before left. What none maps has nulls.
    """
    worklist = scratch.kept(raw.select("raw_skill").distinct())
    fuzzy = scratch.kept(fuzzy_match(worklist, labels).filter(F.col("confidence") >= CASCADE_CONFIDENCE).withColumn("method", F.lit("fuzzy")))
    left = scratch.kept(worklist.join(fuzzy.select("raw_skill"), "raw_skill", "left_anti"))
    near = embedding_match(left, queries, vectors, labels).join(concepts.select("uri", F.col("preferred_label").alias("label")), "uri", "left").withColumn("method", F.lit("embedding"))
    near = scratch.kept(near)
    stages = fuzzy.unionByName(near)
    if answers is not None:
        rest = left.join(near.select("raw_skill"), "raw_skill", "left_anti")
        prefixed = F.when(F.col("method").startswith("llm"), F.col("method")).otherwise(F.concat(F.lit("llm_"), "method"))
        stages = stages.unionByName(answers.filter("uri is not null").join(rest, "raw_skill", "left_semi").select("raw_skill", "uri", "label", "confidence", prefixed.alias("method")))
    typed = stages.join(concepts.select("uri", "skill_type"), "uri", "left").join(chains, "uri", "left")
    mapped = typed.select(
        "raw_skill", F.col("uri").alias("esco_uri"), F.col("label").alias("esco_label"), F.coalesce("skill_type", F.lit("")).alias("esco_type"),
        scalars.skill_category(F.col("label"), F.col("chain")).alias("skill_category"), "confidence", "method",
    )
    return worklist.join(mapped, "raw_skill", "left")
