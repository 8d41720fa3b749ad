"""Packing documents into fixed sequences: concatenate and cut.

A first pass turns every document into ids and writes them, with its place in its partition. The
partitions' totals, summed up in order, give each partition's place in the whole, so every
document's global offset is known without any task seeing more than its own partition. The second
pass cuts at multiples of the sequence length; a document that crosses a cut has a piece on
either side. Only the last sequence has padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labourmill.llm.shared import materialize

SEQUENCE = 2048
#: Ends every document.
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _encoder(path: str):
    """A function from texts to lists of ids, those that ``tokenizers`` gives for the file.

    A byte-level BPE file without normaliser has the same ids in ``tiktoken``, at a quarter of
    the time: a merge's rank is its place in the vocabulary. Other files are read by
    ``tokenizers`` itself.
    """
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (
        model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding") and not model.get("dropout")
        and not model.get("ignore_merges") and all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in spec["added_tokens"])
    )
    if plain:
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in merges]
        if order == sorted(order):
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # of byte-level files
            encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
            return lambda texts: [encoding.encode(t, allowed_special="all") for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def encode(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """part, begin, doc_id, ids from (doc_id, text): ids as little-endian 32-bit numbers, deflated.

    ``begin`` counts the ids before the document in its partition. A null text is empty and has
    the end id alone. The tokenizer's file is opened where the task runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, begin = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [np.array([*x, end_id], "<u4") for x in tokens([t or "" for t in some.column("text").to_pylist()])]
                sizes = np.array([len(x) for x in ids], np.int64)
                begins = begin + np.cumsum(sizes) - sizes
                begin += int(sizes.sum())
                wide = max(int(x.max()) for x in ids) > 0xFFFF
                stored = [x.tobytes() if wide else x.astype("<u2").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(begins), some.column("doc_id"), pa.array(sizes), pa.array(stored, pa.binary())],
                    names=["part", "begin", "doc_id", "n_ids", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "part int, begin long, doc_id long, n_ids long, ids binary"
    )


def pack(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of ``length`` ids.

    Columns: doc_id, start (the document's ids before the piece), length, ids (binary,
    little-endian 32-bit), doc_tokens, sequence_id, offset, opens and closes (whether the piece
    has its document's first and last id). An empty table gives none. Repeated rows are packed
    each; a null doc_id stays null.
    """
    stored = materialize(encode(docs, path or default_tokenizer(), end_id))
    # One row for each partition that was read, so few however long the texts are.
    totals = stored.groupBy("part").agg(F.max(F.col("begin") + F.col("n_ids")).alias("total"))
    # The partitions' totals are summed in blocks of 1000 partitions, then the blocks' among themselves.
    blocks = totals.groupBy((F.col("part") / 1000).cast("int").alias("block")).agg(F.sum("total").alias("block_total"))
    block_base = blocks.select("block", (F.sum("block_total").over(W.orderBy("block")) - F.col("block_total")).alias("block_base"))
    within = totals.withColumn("block", (F.col("part") / 1000).cast("int")).withColumn(
        "inner", F.sum("total").over(W.partitionBy("block").orderBy("part")) - F.col("total")
    )
    bases = within.join(block_base, "block").select("part", (F.col("inner") + F.col("block_base")).alias("base"))
    placed = stored.join(F.broadcast(bases), "part").select("doc_id", "n_ids", "ids", (F.col("base") + F.col("begin")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, n, ids, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                ends = [*range((at // length + 1) * length - at, n, length), n]
                rows += [(doc_id, a, b - a, values[a:b].tobytes(), n, (at + a) // length, (at + a) % length, a == 0, b == n) for a, b in zip([0, *ends], ends, strict=False)]
                if len(rows) >= 2000:
                    yield table(rows)
                    rows = []
            yield table(rows)

    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_())]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return placed.mapInArrow(
        cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, opens boolean, closes boolean"
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, its ids as their CRC-32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
