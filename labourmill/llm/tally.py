"""How often the tokens of documents occur in a corpus, without a row a token.

Tasks hash millions of tokens; as rows of a shuffle these would cost far more than the texts. Here
a block (some documents of one task) sends each bucket of the hash space one packed string with
its tokens of that bucket. The bucket sorts what all blocks sent and answers every block with one
count a token. What several documents of a block share travels once, so a token that a third of
all documents hold costs its bucket one entry a block.

Buckets are as many as the texts' bytes ask for, so one fits a task whatever the input's size.
Blocks grow with their number, up to a bound, so that a row of the exchange stays worth its cost;
rows are never more than tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labourmill.llm.words import CHUNK, U, chunks

_FIELDS = [("block", pa.int64()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary()), ("told", pa.binary()), ("payload", pa.binary())]
PACKED = "block long, bucket int, tokens binary, counts binary, told binary, payload binary"
#: Counts go up to here.
MOST = 255
#: Rows that a task hands over at once.
BATCH_ROWS = 20_000
#: Bytes of text whose tokens one bucket gets, and of which a block sends it a row; and of the largest block.
BUCKET_BYTES, ROW_BYTES, MOST_BLOCK_BYTES = 32_000_000, 500, 64_000_000


@dataclass
class Sent:
    """What a block sends: tokens whose counts it asks for, each distinct; how often it has each
    (None: once); tokens that it has several times and only tells of; and what it keeps for
    itself, from the order in which it will get the counts."""

    asked: np.ndarray
    counts: np.ndarray | None
    told: np.ndarray
    payload: Callable[[np.ndarray, np.ndarray], bytes]


@dataclass
class Exchange:
    """Number of buckets, and bytes of text of a block."""

    buckets: int
    block: int


def exchange_for(docs: DataFrame, text: str = "text") -> Exchange:
    """Sized by the bytes of all texts, which are summed for it: one number comes to the driver.
    Four buckets for each shuffle partition at least, or chance makes partitions uneven."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    return Exchange(buckets, min(max(CHUNK, ROW_BYTES * buckets), MOST_BLOCK_BYTES))


def batch_of(fields: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> U(32)) % U(buckets)).astype(np.int64)


def tell(docs: DataFrame, send: Callable[[pa.RecordBatch], Sent], receive: Callable[[bytes, np.ndarray], pa.RecordBatch], schema: str, exchange: Exchange, text: str = "text") -> DataFrame:
    """Rows of ``schema``, made by ``receive`` from each block's payload and the counts it asked for.

    ``send`` gets batches of about a block's bytes of the column ``text``. Counts are over all
    blocks, at most MOST, and in the order that the payload's maker was given. Tokens of a bucket
    are told apart by 32 more bits: now and then two pass for one, so a count may be too large,
    never too small. A task that runs again must find its rows in the same order: ``docs`` is read
    from files, or sorted within its partitions.
    """
    fields, buckets = _FIELDS, exchange.buckets

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        part = task << 32
        for i, batch in enumerate(chunks(batches, text, exchange.block)):
            sent = send(batch)
            bucket = bucket_of(sent.asked, buckets)
            order = np.argsort(bucket, kind="stable")
            low = (sent.asked[order] & U(0xFFFFFFFF)).astype("<u4")
            times = np.minimum(sent.counts[order], MOST).astype(np.uint8) if sent.counts is not None else None
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            told_bucket = bucket_of(sent.told, buckets)
            told_order = np.argsort(told_bucket, kind="stable")
            told = (sent.told[told_order] & U(0xFFFFFFFF)).astype("<u4")
            told_cuts = np.searchsorted(told_bucket[told_order], np.arange(buckets + 1))
            rows = [(part + i, (task + i) % buckets, None, None, None, sent.payload(order, bucket[order]))]
            for b in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(told_cuts) > 0)).tolist():
                a, e, c, d = cuts[b], cuts[b + 1], told_cuts[b], told_cuts[b + 1]
                rows.append((part + i, b, low[a:e].tobytes(), times[a:e].tobytes() if times is not None else None, told[c:d].tobytes(), None))
                if len(rows) == BATCH_ROWS:
                    yield batch_of(fields, rows)
                    rows = []
            yield batch_of(fields, rows)

    def reducer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        asks = [r for r in got if r["tokens"] is not None]
        out = [(r["block"], -1, None, None, None, r["payload"]) for r in got if r["tokens"] is None]
        if asks:
            each = [np.frombuffer(r["tokens"], "<u4") for r in asks]
            told = [np.frombuffer(r["told"], "<u4") for r in asks]
            times = [np.frombuffer(r["counts"], np.uint8) if r["counts"] is not None else np.ones(len(x), np.uint8) for r, x in zip(asks, each, strict=True)]
            times += [np.full(len(x), 2, np.uint8) for x in told]
            _, where = np.unique(np.concatenate(each + told), return_inverse=True)
            sums = np.minimum(np.bincount(where, weights=np.concatenate(times)), MOST).astype(np.uint8)[where]
            begin = 0
            for r, x in zip(asks, each, strict=True):
                out.append((r["block"], r["bucket"], None, sums[begin : begin + len(x)].tobytes(), None, None))
                begin += len(x)
        return pa.Table.from_batches([batch_of(fields, out)])

    def collector(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = table.select(["bucket", "counts", "payload"]).to_pylist()
        payload = next(r["payload"] for r in got if r["bucket"] < 0)
        counts = b"".join(r["counts"] for r in sorted((r for r in got if r["bucket"] >= 0), key=lambda r: r["bucket"]))
        return pa.Table.from_batches([receive(payload, np.frombuffer(counts, np.uint8))])

    sent = docs.mapInArrow(mapper, PACKED)
    return sent.groupBy("bucket").applyInArrow(reducer, PACKED).groupBy("block").applyInArrow(collector, schema)
