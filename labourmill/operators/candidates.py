"""Candidates for a model that maps skills, and the reading of its answers.

Windows are within a batch of skills. The whole corpus as one pool is the case of one batch, so
only what can still be shown goes into them: each task leaves out the rest of its own rows first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labourmill.functions import scalars
from labourmill.operators.matching import pair_similarity
from labourmill.sources import scratch, skew, taxonomy

PRIORITY = {"fuzzy": 0, "embedding": 1, "graph_parent": 2, "graph_sibling": 3}
SLOTS = {"fuzzy": 15, "embedding": 15, "graph_sibling": 5, "graph_parent": 3}
EXACT, BOOST = 0.95, 0.15
#: Scores of what the graph adds, where nothing better is known.
PARENT_SCORE, SIBLING_SCORE = 0.5, 0.4
#: Answers, skills or candidates of one task, about.
TASK_ITEMS = 100_000
ANSWERS = "mappings array<struct<raw_skill:string,esco_id:string,esco_uri:string,esco_label:string,confidence:string,reasoning:string>>"


def gather_candidates(fuzzy: DataFrame, embedding: DataFrame, least: float = 0.72) -> DataFrame:
    """batch_id, uri, score (largest), category (earliest), texts from hits (batch_id, text, uri, score)."""
    hits = fuzzy.withColumn("p", F.lit(PRIORITY["fuzzy"])).unionByName(embedding.filter(F.col("score") >= least).withColumn("p", F.lit(PRIORITY["embedding"])))
    one = hits.groupBy("batch_id", "uri").agg(F.max("score").alias("score"), F.min("p").alias("p"), F.array_sort(F.collect_set("text")).alias("texts"))
    return one.select("batch_id", "uri", "score", F.when(F.col("p") == 0, "fuzzy").otherwise("embedding").alias("category"), "texts")


def graph_expand(candidates: DataFrame, edges: DataFrame, concepts: DataFrame, queries: DataFrame, vectors: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``candidates`` with their parents and siblings (batch_id, uri, score, category).

    A parent has its child's score. A sibling has its best similarity to the candidate's texts and
    must reach the threshold; without texts it has a modest score. What is found more than once is
    a candidate before a parent before a sibling, with its best score.
    """
    own = candidates.select("batch_id", "uri", "score", "category")
    up = candidates.join(taxonomy.taxonomy_parent(edges, concepts).withColumnRenamed("child_uri", "uri"), "uri").select(
        "batch_id", F.col("parent_uri").alias("uri"), F.coalesce("score", F.lit(PARENT_SCORE)).alias("score"), F.lit("graph_parent").alias("category")
    )
    # Siblings meet the different texts of all candidates below their parent; a candidate that finds itself so stays one.
    texts = candidates.join(taxonomy.parents(edges).withColumnRenamed("child_uri", "uri"), "uri").select("batch_id", "parent_uri", F.explode_outer("texts").alias("text")).distinct()
    children = taxonomy.taxonomy_children(edges, concepts).distinct().withColumnRenamed("child_uri", "uri")
    beside = skew.join_split(children, texts, "parent_uri", F.col("uri")).select("batch_id", "uri", "text")
    known = beside.filter("text is not null") if threshold > 0 else beside.limit(0)
    scored = pair_similarity(known, queries, vectors).filter(F.col("score") >= threshold).groupBy("batch_id", "uri").agg(F.max("score").alias("score"))
    plain = (beside.filter("text is null") if threshold > 0 else beside).select("batch_id", "uri").distinct().withColumn("score", F.lit(SIBLING_SCORE))
    side = scored.unionByName(plain).withColumn("category", F.lit("graph_sibling"))
    order = F.coalesce(*[F.when(F.col("category") == c, F.lit(p)) for c, p in PRIORITY.items()])
    return own.unionByName(up).unionByName(side).groupBy("batch_id", "uri").agg(F.min_by(F.struct("score", "category"), F.struct(F.when(order < 2, 0).otherwise(order), -F.col("score"))).alias("b")).select("batch_id", "uri", "b.*")


def select_candidates(candidates: DataFrame, limit: int) -> DataFrame:
    """The candidates that a batch's prompt shows, with their ``place`` in it (by score).

    Near-exact label hits are boosted. Each category's best take its slots; what is left of the
    limit goes to the best of the others.
    """
    boosted = candidates.withColumn("score", F.when((F.col("category") == "fuzzy") & (F.col("score") >= EXACT), F.least(F.col("score") + BOOST, F.lit(1.0))).otherwise(F.col("score")))
    by_score = (F.desc("score"), F.col("uri"))
    slots = F.coalesce(*[F.when(F.col("category") == c, F.lit(n)) for c, n in SLOTS.items()], F.lit(0))
    # What isn't among its category's slots and the limit beyond them can't be shown.
    ranked = boosted.withColumn("in_category", F.row_number().over(W.partitionBy("batch_id", "category").orderBy(*by_score))).filter(F.col("in_category") <= max(SLOTS.values()) + max(limit, 0))
    sure = ranked.withColumn("sure", F.col("in_category") <= slots)
    batch = W.partitionBy("batch_id")
    filled = sure.withColumn("n_sure", F.sum(F.col("sure").cast("int")).over(batch)).withColumn("rest", F.row_number().over(W.partitionBy("batch_id", "sure").orderBy(*by_score)))
    kept = filled.filter(F.col("sure") | (F.col("rest") <= F.lit(limit) - F.col("n_sure")))
    return kept.withColumn("place", F.row_number().over(batch.orderBy(*by_score))).select("batch_id", "place", "uri", "score", "category")


def number_candidates(selected: DataFrame, concepts: DataFrame) -> DataFrame:
    """batch_id, n, text: the candidates' lines, numbered from 1; unknown concepts have none."""
    known = selected.join(concepts.select("uri", "preferred_label", "alt_labels"), "uri")
    numbered = known.withColumn("id", F.row_number().over(W.partitionBy("batch_id").orderBy("place")))
    alt = F.array_join("alt_labels", ", ")
    line = F.concat(F.lit("- ["), F.col("id").cast("string"), F.lit("] Label: "), "preferred_label", F.when(alt != "", F.concat(F.lit(" | Alt: "), alt)).otherwise(""))
    return numbered.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("id", line.alias("l")))).alias("s")).select("batch_id", "n", F.array_join(F.transform("s", lambda x: x["l"]), "\n").alias("text"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``number`` from 0 in that order, without one task that sees them all.

    Rows are dealt to tasks by ranges of the order (rows that are alike in it by their hash too),
    sorted there and written once; the rows before each range are counted from what was written.
    """
    spark = rows.sparkSession
    by = [F.col(o) for o in order] + [F.xxhash64(*rows.columns)]
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.kept(rows.repartitionByRange(shares, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    # An id is the number of its task times 2 ** 33 and the row's place there.
    share, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r.s, r.n) for r in placed.groupBy(share.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a task
    before = [(s, sum(n for _, n in counts[:i])) for i, (s, _) in enumerate(counts)]
    starts = F.broadcast(spark.createDataFrame(before, "__s long, __before long"))
    return placed.withColumn("__s", share).join(starts, "__s").withColumn("number", F.col("__before") + place).select(*rows.columns, "number")


def batch_skills(rows: DataFrame, key: str, size: int = 15, group: str | None = None) -> DataFrame:
    """``rows`` with ``batch`` from 0: so many to a batch, in order of the key, within each ``group`` or (without one) over all rows."""
    if group is None:
        return numbered(rows, key).withColumn("batch", F.floor(F.col("number") / size)).drop("number")
    place = F.row_number().over(W.partitionBy(group).orderBy(key))
    return rows.withColumn("batch", F.floor((place - 1) / size))


def resolve_model_answers(answers: DataFrame, asked: DataFrame, numbered: DataFrame, concepts: DataFrame, allow_extra: bool = False) -> DataFrame:
    """batch_id, raw_skill, uri, label, confidence, reasoning, via_graph from a model's answers.

    ``answers`` (batch_id, text) holds JSON; ``asked`` (batch_id, raw_skill) the skills of each
    batch; ``numbered`` (batch_id, id, uri, category) its candidates. A candidate's number, also as
    text or first of a list, stands for its uri. Unknown uris go. A skill is found as it is, then
    in lower case; else its item goes, or stays under its own name. Of several items for one skill
    the last counts.
    """
    # Compressed tables look small to Spark: a few tasks would have all rows, or a table would be sent to all. So tasks are as many as the rows need.
    n = max(answers.sparkSession.sparkContext.defaultParallelism, *(-(-rows.count() // TASK_ITEMS) for rows in (answers, asked, numbered)))
    texts = answers.select("batch_id", "text").repartition(n, "batch_id", "text")
    items = texts.select("batch_id", F.posexplode(scalars.parse_model_json(F.col("text"), ANSWERS)["mappings"]).alias("pos", "m")).select("batch_id", "pos", "m.*")
    said = F.coalesce("esco_id", "esco_uri", F.lit(""))
    first = F.when(said.startswith("["), F.coalesce(F.get(F.from_json(said, "array<string>"), F.lit(0)), F.lit(""))).otherwise(said)
    plain = items.withColumn("said", first).withColumn("id", F.when(F.col("said").rlike("^[0-9]+$"), F.col("said").try_cast("int")))
    # A candidate goes by its number, and one from the graph by its uri too, so items meet both at once.
    number, name = (lambda c: F.concat(F.lit("#"), F.col(c).cast("string"))), (lambda c: F.concat(F.lit("="), c))
    alike = W.partitionBy("batch_id", "uri")
    flagged = numbered.select("batch_id", "id", "uri", F.col("category").startswith("graph_").alias("g")).repartition(n, "batch_id", "uri").withColumn("nth", F.row_number().over(alike.orderBy("id"))).withColumn("g", F.max("g").over(alike))
    called = flagged.select("batch_id", F.col("uri").alias("by_id"), "g", F.explode(F.array(number("id"), F.when(F.col("g") & (F.col("nth") == 1), name("uri")))).alias("called")).filter("called is not null")
    dealt = plain.withColumn("called", F.coalesce(number("id"), name("said"))).repartition(n, "batch_id", "called")
    met = dealt.join(called.repartition(n, "batch_id", "called").hint("merge"), ["batch_id", "called"], "left")
    known = met.withColumn("uri", F.when(F.col("id").isNotNull(), F.col("by_id")).otherwise(F.col("said"))).join(concepts.select("uri"), "uri", "left_semi")
    value = F.struct("uri", F.coalesce("esco_label", F.lit("")).alias("label"), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce("reasoning", F.lit("")).alias("reasoning"), F.coalesce("g", F.lit(False)).alias("via_graph"))
    # Items and the skills asked for meet by their skill in lower case; an item's target differs from it in case at most.
    told = known.select("batch_id", F.lower("raw_skill").alias("low"), "raw_skill", "pos", value.alias("v"))
    both = told.unionByName(asked.filter("batch_id is not null").select("batch_id", F.lower("raw_skill").alias("low"), "raw_skill"), allowMissingColumns=True).filter("raw_skill is not null").repartition(n, "batch_id", "low")
    is_asked = F.col("pos").isNull()
    exact = F.max(is_asked).over(W.partitionBy("batch_id", "low", "raw_skill"))
    loose = F.min(F.when(is_asked, F.col("raw_skill"))).over(W.partitionBy("batch_id", "low"))
    found = both.withColumn("exact", exact).withColumn("loose", loose).filter(~is_asked)
    target = F.when(F.col("exact"), F.col("raw_skill")).otherwise(F.coalesce("loose", "raw_skill") if allow_extra else F.col("loose"))
    rows = found.select("batch_id", "low", target.alias("raw_skill"), "pos", "v").filter("raw_skill is not null")
    return rows.groupBy("batch_id", "low", "raw_skill").agg(F.max_by("v", "pos").alias("v")).select("batch_id", "raw_skill", "v.*")


def flatten_model_skills(answers: DataFrame) -> DataFrame:
    """id, skill from answers (text) with results of skills; blank skills go."""
    rows = answers.select(F.explode(scalars.parse_model_json(F.col("text"), "results array<struct<id:string,skills:array<string>>>")["results"]).alias("r"))
    return rows.select("r.id", F.explode("r.skills").alias("skill")).select("id", scalars.strip(F.col("skill")).alias("skill")).filter("skill != ''")
