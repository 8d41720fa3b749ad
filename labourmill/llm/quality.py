"""Quality rules with verdicts on hosts.

Each document is held against its own rules. Failures are then summed by host, a beta prior is
fitted to the hosts' failure rates by moments, every host's rate is shrunk towards that prior (a
host of three documents hardly moves it, one of a million stands on its own), and documents of
hosts whose shrunk rate passes a limit go too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.llm.shared import bind, join_hot, key_text, materialize, words_of

#: A document fails with fewer words, or with a larger percentage of its words in repeated windows.
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Words of a window that counts as repeated when the text has it twice.
WINDOW = 8
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1e6)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more in ``words``.

    Windows are compared by 64-bit hashes. Where all hashes differ, which is the common case,
    that is known from a hash set; else the hashes are sorted with their places.
    """
    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (window - 1), F.lit(0))),
        lambda _, i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]),
    )

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
                lambda x: x["i"],
            )
        )
        # From one repeated window's start to the next: at most a window's words are covered.
        total = lambda at: F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window)))),
            F.lit(0).cast("long"),
            lambda a, b: a + b,
        )
        return bind(placed, lambda s: bind(again(s), total))

    return bind(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
    )


def document_rules(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long). Null: no words."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    return bind(words_of(text), of)


def fails_base(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), rejected from rows of (host, base_failed).

    Documents are summed before the shuffle, so a host with a third of all rows costs one row a
    task. With a single host, or none that differs, the prior has its largest weight. An empty
    table has no hosts.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    least, most = PRIOR_WEIGHT
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.var_pop(raw).alias("spread"),
    ).select(
        "mean",
        F.when(F.col("spread") > 0, F.greatest(F.lit(least), F.least(F.lit(most), F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1)))
        .otherwise(F.lit(most))
        .alias("weight"),
    )
    # One row of two numbers.
    shrunk = hosts.join(F.broadcast(prior), F.lit(True))
    rate = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    return shrunk.select("host", "n_docs", "n_failed", F.round(rate, 9).alias("rate")).withColumn("rejected", F.col("rate") > max_rate)


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id if not given) with the rules' counts and verdicts.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    host_rate (double), kept. Rows without a host share one; repeated rows are judged each.
    The counts are written once to the shared folder and read for both the sums and the verdicts.
    """
    keep = ["doc_id"] if keep is None else keep
    rules = docs.select(*[F.col(f"`{c}`") for c in keep], key_text(F.col(f"`{host}`")).alias("__host"), document_rules(F.col(f"`{text}`")).alias("__r"))
    flat = rules.select(*[f"`{c}`" for c in keep], "__host", "__r.*")
    counts = materialize(flat.withColumn("base_failed", fails_base(F.col("n_words"), F.col("n_repeat_words"))))
    verdicts = materialize(
        host_verdicts(counts.select(F.col("__host").alias("host"), "base_failed")).select(F.col("host").alias("__host"), F.col("n_docs").alias("__n"), F.col("rate").alias("host_rate"), "rejected")
    )
    return (
        join_hot(counts, verdicts, ["__host"], "__n")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))
        .drop("__host", "__n", "rejected")
    )


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass their own rules and whose host isn't rejected, all columns.

    Texts don't travel and aren't written: the rules are worked out for the hosts' sums and again
    where each row is read.
    """
    failed = bind(words_of(F.col(f"`{text}`")), lambda w: fails_base(F.size(w).cast("long"), repeated_words(w)))
    marked = docs.select(F.struct("*").alias("row"), key_text(F.col(f"`{host}`")).alias("host"), failed.alias("failed"))
    counts = materialize(marked.select("host", F.col("failed").alias("base_failed")))
    verdicts = materialize(host_verdicts(counts).select("host", "n_docs", "rejected"))
    return join_hot(marked.filter("NOT failed"), verdicts, ["host"], "n_docs").filter("NOT rejected").select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judge(docs)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_RULES = f"""
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
windows AS (
  SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM docs)
),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM again) GROUP BY r),
counts AS (
  SELECT doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (SELECT count(*) - count(DISTINCT l) FROM (SELECT unnest(string_split(text, chr(10))) AS l) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]'))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered USING (r)
),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM counts),
hosts AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS f FROM judged GROUP BY host),
prior AS (
  SELECT m, CASE WHEN v > 0 THEN greatest({PRIOR_WEIGHT[0]}, least({PRIOR_WEIGHT[1]}, m * (1 - m) / v - 1)) ELSE {PRIOR_WEIGHT[1]} END AS k
  FROM (SELECT sum(f) / sum(n) AS m, var_pop(f / n) AS v FROM hosts)
),
rates AS (SELECT host, round((f + m * k) / (n + k), 9) AS host_rate FROM hosts, prior)
"""
ORACLE = f"""
WITH {_RULES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate,
  NOT base_failed AND NOT host_rate > {MAX_HOST_RATE} AS kept
FROM judged JOIN rates USING (host)
"""
