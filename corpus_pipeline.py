"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the shared folder and reads it again for the next one. All but the last return the columns of
``documents``, and other columns that ``docs`` has, whatever their names. An empty table stays
empty in every stage. Nulls: a null source is a source, a null text is an empty one (it stays null
where texts are returned), and a null doc_id is a key like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.llm import jaccard, mixing, packing, pii, quality
from labourmill.llm.shared import discard, key_text, materialize, words_of

#: A text with words has a character other than the six that part them.
WORD = r"[^\x20\x09-\x0D]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and whose host isn't rejected.

    Repeated rows are judged each; null, empty and blank texts have too few words and go. A host
    whose shrunk rate is just the limit stays.
    """
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows that links connect: the one with the least doc_id.

    Rows are told apart by doc_id and text. A null doc_id counts as the greatest, and of rows of
    a group with equal doc_ids the one whose text has the least hash stays; of copies with one
    doc_id any one. So rows without a doc_id, or with one that occurs again, stay where no link
    connects them. Rows without words link with nothing and all stay.
    """
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    key = key_text(F.col("doc_id"))
    keyed = docs.filter(~blank).select(F.struct("*").alias("row"), F.xxhash64(key, "text").alias("key"), F.xxhash64(F.lit("again"), "text", key).alias("again"))
    classes = jaccard.similar_documents(keyed.select(F.col("key").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("key"), "component_id").distinct()
    named = keyed.select("key", F.col("row.doc_id").alias("doc_id")).distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = classes.join(named, "key").groupBy("component_id").agg(F.min_by("key", order).alias("key")).select("key")
    # Two rows with one key, should that happen, both stay.
    return keyed.join(first, "key", "left_semi").dropDuplicates(["key", "again"]).select("row.*").unionByName(docs.filter(blank))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by the name of its kind.

    n_chars is counted anew. Repeated rows stay; of spans that overlap the first one counts, and
    of those that begin together the kind listed first.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of small sources again as their weight asks for.

    Repeated rows go together. Documents without words come once. Blocks of a source whose draws
    tie stand in order of their number.
    """
    return mixing.mix(docs, F.size(words_of(F.col("text")))).drop("epoch")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids; an empty text has the end id alone.

    Repeated rows are packed each, in the order in which the table is read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Shingle classes, label models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
