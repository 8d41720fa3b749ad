"""A quality classifier that borrows strength from the site: hierarchical empirical Bayes.

A document's own evidence is a naive Bayes log odds over binned text statistics, counted from all
labelled documents. Documents' probabilities are then summed by host and by path; a host's mean
is shrunk towards the corpus, a path's towards its host, by as much as such means differ (moments).
A document's verdict combines its own evidence with the odds of its path as the other documents
there tell them, so nothing counts twice and a sparse site hardly moves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.llm.shared import bind, join_hot, key_text, materialize, words_of

#: Bounds of a prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1e6)
KEEP_FROM = 0.5
#: Evidence is taken at this rate: the statistics overlap, and naive Bayes counts them all in full.
EVIDENCE = 0.5


def _share(part: Column, whole: Column) -> Column:
    """0 to 20: twentieths, with none and nearly none apart."""
    return F.when(part == 0, F.lit(0)).otherwise(F.least(F.lit(20), F.ceil(20 * part / F.greatest(whole, F.lit(1)))))


def text_features(text: Column) -> Column:
    """Names of a text's bins, one a statistic. Null: as the empty text."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))

    def of(words: Column) -> Column:
        n, chars = F.size(words), F.char_length(text)
        lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
        bins = {
            "words": F.floor(2 * F.log2(n + F.lit(1.0))),
            "length": F.least(F.lit(30), F.floor(2.0 * chars / F.greatest(n, F.lit(1)))),
            "upper": _share(count(r"\p{Lu}+"), chars),
            "digit": _share(count("[0-9]+"), chars),
            "symbol": _share(count(r"[#*$%&|<>{}=_~^+@\\/]+"), chars),
            "stop": _share(count("[.,;:!?]+"), n),
            "mark": _share(count("!+"), n),
            "distinct": _share(F.size(F.array_distinct(words)), n),
            "line": bind(lines, lambda x: _share(F.size(x) - F.size(F.array_distinct(x)), F.size(x))),
        }
        return F.array(*[F.concat(F.lit(name), value.cast("string")) for name, value in bins.items()])

    return bind(words_of(text), of)


def evidence_weights(labelled: DataFrame) -> DataFrame:
    """feature, weight from rows of (features, good): log odds of each bin, with one document added
    to either class. There are a few hundred bins, whatever the corpus."""
    each = labelled.select(F.explode("features").alias("feature"), F.col("good").cast("double").alias("good"))
    counts = each.groupBy("feature").agg(F.sum("good").alias("yes"), F.sum(1 - F.col("good")).alias("no"))
    totals = labelled.agg(F.sum(F.col("good").cast("double")).alias("all_yes"), F.sum(1 - F.col("good").cast("double")).alias("all_no"))
    return counts.join(F.broadcast(totals), F.lit(True)).select(
        "feature", F.log((F.col("yes") + 1) / (F.col("all_yes") + 2) / ((F.col("no") + 1) / (F.col("all_no") + 2))).alias("weight")
    )


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _weight(mean: Column, spread: Column) -> Column:
    least, most = PRIOR_WEIGHT
    return F.when(spread > 0, F.greatest(F.lit(least), F.least(F.lit(most), mean * (1 - mean) / spread - 1))).otherwise(F.lit(most))


def site_sums(scored: DataFrame) -> DataFrame:
    """host, path, n, s, host_n, host_s, all_n, all_s, k_host, k_path from rows of (host, path, p):
    numbers and sums of p of each path, host and all, and how many documents a host's and a path's
    prior weigh.

    Sums by (host, path) are taken before anything is shuffled; a host with a third of all rows
    is a few sums.
    """
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    corpus = hosts.agg(F.sum("host_n").alias("all_n"), F.sum("host_s").alias("all_s"), F.var_pop(F.col("host_s") / F.col("host_n")).alias("spread")).select(
        "all_n", "all_s", _weight(F.col("all_s") / F.col("all_n"), F.col("spread")).alias("k_host")
    )
    within = paths.join(hosts.join(F.broadcast(corpus), F.lit(True)), "host")  # a row a path
    quality = _shrunk(F.col("host_s"), F.col("host_n"), F.col("k_host"), F.col("all_s") / F.col("all_n"))
    spread = within.agg(F.avg(quality).alias("mean"), F.avg(F.pow(F.col("s") / F.col("n") - quality, 2)).alias("spread")).select(_weight(F.col("mean"), F.col("spread")).alias("k_path"))
    return within.join(F.broadcast(spread), F.lit(True))


def _shrunk(total: Column, n: Column, k: Column, prior: Column) -> Column:
    return (total + k * prior) / (n + k)


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path, host_quality, path_quality from rows of (host, path, p)."""
    sums = site_sums(scored)
    host = _shrunk(F.col("host_s"), F.col("host_n"), F.col("k_host"), F.col("all_s") / F.col("all_n"))
    return sums.withColumn("host_quality", host).select("host", "path", "host_quality", _shrunk(F.col("s"), F.col("n"), F.col("k_path"), F.col("host_quality")).alias("path_quality"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, evidence, host_quality, path_quality, score, keep for each row of ``docs``.

    ``labels`` has (doc_id, quality 0 or 1); rows with nulls don't count, and a doc_id with
    several labels counts each. All labels are used, none is sampled. Without labels of both
    classes the evidence is what one document added to each class says. Null hosts and paths are
    sites of their own. host_quality and path_quality are those of a document's site without the
    document itself; alone in the corpus, it has the labels' share of good ones.
    """
    features = materialize(
        docs.select(
            "doc_id", key_text(F.col(f"`{host}`")).alias("host"), key_text(F.col(f"`{path}`")).alias("path"), text_features(F.col(f"`{text}`")).alias("features")
        )
    )
    known = labels.select("doc_id", (F.col("quality") == 1).alias("good")).dropna()
    labelled = features.select("doc_id", "features").join(known, "doc_id").select("features", "good")
    # One row: a few hundred weights, and the share of good labels.
    weights = materialize(
        evidence_weights(labelled).agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("weights")).join(
            labelled.agg(((F.sum(F.col("good").cast("double")) + 1) / (F.count(F.lit(1)) + 2)).alias("prior")), F.lit(True)
        )
    )

    def total(bins: Column, map_: Column) -> Column:
        return F.aggregate(bins, F.lit(0.0), lambda a, b: a + F.coalesce(F.try_element_at(map_, b), F.lit(0.0)))

    fitted = features.join(F.broadcast(weights), F.lit(True))
    evidence = F.round(EVIDENCE * total(F.col("features"), F.col("weights")), 9)
    own = materialize(
        fitted.select("doc_id", "host", "path", evidence.alias("evidence"), F.coalesce("prior", F.lit(0.5)).alias("prior")).withColumn(
            "p", 1 / (1 + F.exp(-(_logit(F.col("prior")) + F.col("evidence"))))
        )
    )
    sites = materialize(site_sums(own.select("host", "path", "p")))
    p, one = F.col("p"), F.lit(1)
    corpus = _shrunk(F.col("all_s") - p, F.col("all_n") - 1, one, F.col("prior"))
    judged = join_hot(own, sites, ["host", "path"], "n").withColumn("host_quality", _shrunk(F.col("host_s") - p, F.col("host_n") - 1, F.col("k_host"), corpus))
    judged = judged.withColumn("path_quality", _shrunk(F.col("s") - p, F.col("n") - 1, F.col("k_path"), F.col("host_quality")))
    score = F.round(1 / (1 + F.exp(-(_logit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_quality")))) + F.col("evidence")))), 9)
    return judged.select(
        "doc_id", "evidence", F.round("host_quality", 9).alias("host_quality"), F.round("path_quality", 9).alias("path_quality"), score.alias("score"), (score >= KEEP_FROM).alias("keep")
    )


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; its host is the source, and its path the language within it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
