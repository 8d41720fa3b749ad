"""The skills taxonomy: concepts, labels and hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.functions import scalars
from labourmill.sources import schemas, scratch, skew

#: Concepts whose chains double right away.
FEW = 100_000
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def _labels(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), scalars.strip), lambda x: x != "")


def _concepts(rows: DataFrame, kind: Column, separator: str) -> DataFrame:
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    return rows.select(
        F.col("conceptUri").alias("uri"), has("preferredLabel").alias("preferred_label"), _labels(has("altLabels"), separator).alias("alt_labels"), has("description").alias("description"), kind.alias("skill_type")
    )


def read_taxonomy_skills(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """uri, preferred_label, alt_labels, description, skill_type. ``separator`` (a pattern) parts the
    alternative labels; collection files have ``[|]``."""
    rows = spark.read.options(**_CSV).csv(path)
    return _concepts(rows, F.coalesce(F.col("skillType"), F.lit("")), separator)


def read_taxonomy_groups(spark: SparkSession, path: str, skills: DataFrame) -> DataFrame:
    """Group concepts that aren't skills."""
    return without_known(_concepts(spark.read.options(**_CSV).csv(path), F.lit("group"), "\n"), skills)


def without_known(groups: DataFrame, skills: DataFrame) -> DataFrame:
    return groups.join(skills.select("uri"), "uri", "left_anti")


def read_taxonomy_edges(spark: SparkSession, path: str) -> DataFrame:
    """child_uri, parent_uri, edge_ord (file, line): of several files the one with the later name comes later.

    A CSV file with quoted line breaks is read by one task, so its lines keep their order.
    """
    rows = spark.read.options(**_CSV).csv(path)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return rows.select(F.col("conceptUri").alias("child_uri"), F.col("broaderUri").alias("parent_uri"), order.alias("edge_ord"))


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The entries, and one row with version and thresholds."""
    rows = spark.read.schema(schemas.GOLDEN).option("multiLine", True).json(path)
    return rows.select(F.explode("entries").alias("e")).select("e.*"), rows.select("version", "esco_version", "thresholds.*")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """uri, label_vec, desc_vec (array of float)."""
    return spark.read.parquet(path).select("uri", "label_vec", "desc_vec")


def label_index(concepts: DataFrame, order: str) -> DataFrame:
    """label (lower case), uri, pos: the last concept with a label has it, at the place of the first.

    ``order`` is the column with the concepts' order, a whole number; pos has it in the upper bits
    and the label's place in the concept in the lower twenty.
    """
    each = concepts.select("uri", F.col(order).alias("o"), F.posexplode(F.concat(F.array("preferred_label"), "alt_labels")).alias("i", "label"))
    placed = each.select("uri", F.lower("label").alias("label"), (F.shiftleft(F.col("o").cast("long"), 20) + F.col("i")).alias("pos"))
    return placed.groupBy("label").agg(F.max_by("uri", "pos").alias("uri"), F.min("pos").alias("pos"))


def parents(edges: DataFrame) -> DataFrame:
    """child_uri, parent_uri: of several parents the last one."""
    return edges.groupBy("child_uri").agg(F.max_by("parent_uri", "edge_ord").alias("parent_uri"))


def taxonomy_parent(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Each concept's parent, if that is known."""
    return parents(edges).join(concepts.select(F.col("uri").alias("parent_uri")), "parent_uri", "left_semi").select("child_uri", "parent_uri")


def taxonomy_children(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """parent_uri, child_uri of all edges whose child is known."""
    return edges.select("parent_uri", "child_uri").join(concepts.select(F.col("uri").alias("child_uri")), "child_uri", "left_semi").select("parent_uri", "child_uri")


def taxonomy_siblings(edges: DataFrame, concepts: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """uri, sibling_uri: the other known children of a concept's parent.

    Pairs grow with the square of a parent's children: with ``only`` (uri) they are made for these
    concepts alone, and ``sibling_groups`` has the same without pairs.
    """
    own = parents(edges).select(F.col("child_uri").alias("uri"), "parent_uri")
    if only is not None:
        own = own.join(only.select("uri").distinct(), "uri")
    other = taxonomy_children(edges, concepts).withColumnRenamed("child_uri", "sibling_uri").distinct()
    return skew.join_split(other, own, "parent_uri", F.col("sibling_uri")).filter("uri != sibling_uri").select("uri", "sibling_uri")


def sibling_groups(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """uri, parent_uri, n_siblings of every concept with a parent: its siblings are that parent's
    children, which ``taxonomy_children`` has, without itself. One row a concept, no pairs."""
    children = taxonomy_children(edges, concepts).distinct()
    sizes = children.groupBy("parent_uri").agg(F.count(F.lit(1)).alias("n"))
    own = parents(edges).select(F.col("child_uri").alias("uri"), "parent_uri")
    member = children.select("parent_uri", F.col("child_uri").alias("uri"), F.lit(1).alias("self"))
    told = own.join(member, ["parent_uri", "uri"], "left")
    return skew.join_split(told, sizes, "parent_uri", F.col("uri")).select("uri", "parent_uri", (F.col("n") - F.coalesce("self", F.lit(0))).alias("n_siblings"))


def taxonomy_chain(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """uri, chain: labels of a concept's ancestors from the root down, itself left out.

    It ends where a parent isn't known, or where the hierarchy comes back to a concept that the
    chain has. ``concepts`` has each uri once. Chains are made for the concepts that are parents;
    the others, which no chain comes back to, take their parent's with it.
    """
    up = parents(edges).filter("child_uri != parent_uri").withColumnRenamed("child_uri", "uri")
    return _chains(_marked(concepts.select("uri", F.col("preferred_label").alias("label")).join(up, "uri", "left"), edges)).select("uri", F.reverse("labels").alias("chain"))


def _marked(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (uri and others) with ``above``, which is true for the parents of ``edges`` and null for the others."""
    return scratch.kept(rows.join(edges.select(F.col("parent_uri").alias("uri")).distinct().withColumn("above", F.lit(True)), "uri", "left"))


def _with_parents(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The left join of ``rows`` with what ``table`` has by their parent_uri."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != "parent_uri"]
    return skew.join_split(rows.filter("parent_uri IS NOT NULL"), table, "parent_uri", F.col("uri"), "left").unionByName(rows.filter("parent_uri IS NULL").select("*", *none))


def _chains(marked: DataFrame) -> DataFrame:
    """uri, label, labels (from the parent up) of rows (uri, label, parent_uri, above).

    Where at most half of them are parents, these are done first, by themselves: so all rounds
    together have at most twice the rows. The rest, or FEW, double.
    """
    n, over = marked.count(), marked.filter("above")
    if n <= FEW or 2 * over.count() > n:
        return _doubled(marked)
    over = scratch.kept(_chains(_marked(over.drop("above"), over)))
    none = F.array().cast("array<string>")
    told = _with_parents(marked.filter("above IS NULL").select("uri", "label", "parent_uri"), over.select(F.col("uri").alias("parent_uri"), F.concat(F.array("label"), "labels").alias("labels")))
    return over.unionByName(told.select("uri", "label", F.coalesce("labels", none).alias("labels")))


def _doubled(rows: DataFrame) -> DataFrame:
    """uri, label, labels of rows (uri, label, parent_uri).

    Chains double: a concept that knows its next 2 ** k ancestors takes those of the last one of
    them, so a hierarchy of n levels takes log n rounds, each written once. A chain that comes back
    is cut there and done, so cycles end it like roots.
    """
    first = _with_parents(rows.select("uri", "label", "parent_uri"), rows.select(F.col("uri").alias("parent_uri"), F.col("label").alias("over"), F.lit(True).alias("known")))
    none = F.array().cast("array<string>")
    has = F.col("known").isNotNull()
    now = scratch.kept(first.select("uri", "label", F.when(has, F.array("parent_uri")).otherwise(none).alias("up"), F.when(has, F.array("over")).otherwise(none).alias("labels"), F.when(has, F.col("parent_uri")).alias("top")))
    done = now.filter("top IS NULL").select("uri", "label", "labels")
    while True:
        open_ = now.filter("top IS NOT NULL")
        if not open_.take(1):
            break
        further = now.select(F.col("uri").alias("top"), F.col("up").alias("up2"), F.col("labels").alias("labels2"), F.col("top").alias("top2"))
        both = skew.join_split(open_, further, "top", F.col("uri"))
        # What comes again comes at the end: from there on the walk only repeats itself.
        new = F.array_remove(F.array_distinct(F.concat("up", "up2")), F.col("uri"))
        longer = both.select("uri", "label", new.alias("up"), (F.size("up") + F.size("up2")).alias("n"), F.concat("labels", "labels2").alias("labels"), "top2")
        cut = F.size("up") < F.col("n")
        grown = scratch.kept(longer.select("uri", "label", "up", F.slice("labels", F.lit(1), F.size("up")).alias("labels"), F.when(~cut, F.col("top2")).alias("top")))
        done = done.unionByName(grown.filter("top IS NULL").select("uri", "label", "labels"))
        # Those that are done go on to serve others.
        now = grown.unionByName(now.join(grown.select("uri"), "uri", "left_anti"))
        now = scratch.kept(now)
    return done
