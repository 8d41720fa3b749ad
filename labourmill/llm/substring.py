"""Removing passages that repeat, by super-k-mers.

A window is some consecutive words of one document. The minimiser of a window is the least hash
of its short word runs; neighbouring windows mostly share it, and such a stretch of windows (a
super-k-mer) travels as one packed string to the bucket of its minimiser. Equal windows have
equal minimisers, so each bucket counts its windows by sorting their hashes, and what the hashes
call equal is held against its words. Before that, the minimisers alone are counted: a stretch
whose minimiser occurs nowhere else holds no repeated window and needs no journey.

A run of words that a large part of the corpus has would gather all windows around it in one
bucket. Stretches with a very frequent minimiser are therefore split once more, by the hash of
each window: first only these hashes travel, each to the bucket of its own, and windows whose hash
occurs once are done; the few others then travel as their words and are held against each other
like the rest, equal ones of a block as one. Hashes are those of ``words``, with a key of the run.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.llm import words as wd
from labourmill.llm.shared import materialize
from labourmill.llm.tally import BATCH_ROWS, BUCKET_BYTES, MOST, Exchange, Sent, batch_of, bucket_of, exchange_for, tell
from labourmill.llm.words import U, chunks

WINDOW = 35
#: Words of the runs whose least hash is a window's minimiser.
RUN = 5


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive keys, by doubling."""
    have, out = 1, keys
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(keys) - width + 1], out[width - have : len(keys) - have + 1]) if have < width else out


def stretches(w: wd.Words, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, minimiser, and text of every super-k-mer of ``w``.

    A minimiser is told by its place, the leftmost of equals: equal windows have it at the same
    distance, so two of them are never in one stretch.
    """
    none = np.zeros(0, np.int64)
    at, hashes = w.windows(run)
    first, _ = w.windows(window)
    if not len(first):
        return none, none, np.zeros(0, U), none
    runs = np.full(len(w.start), np.iinfo(np.uint64).max, U)
    runs[at] = hashes
    keys = (runs & U(0xFFFFFFFF00000000)) | np.arange(len(runs), dtype=U)
    place = (_least(keys, window - run + 1)[first] & U(0xFFFFFFFF)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return first[begins], np.diff([*begins, len(first)]), runs[place[begins]], w.text_of()[first[begins]]


def equal_windows(w: wd.Words, first: np.ndarray, hashes: np.ndarray, window: int) -> np.ndarray:
    """A number for each window of words (joined by one space): equal ones have the same.

    Windows with one hash are held against the first of them, consecutive ones as one string. If
    any differs, all are told apart by their words.
    """
    _, lead, where = np.unique(hashes, return_index=True, return_inverse=True)
    leader = lead[where]
    at = np.flatnonzero(leader != np.arange(len(first)))
    if not len(at):
        return where
    other, data = leader[at], w.data.tobytes()
    goes_on = (np.diff(at) == 1) & (np.diff(other) == 1) & (np.diff(first[at]) == 1) & (np.diff(first[other]) == 1)
    begins = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    ends = np.append(begins[1:], len(at)) - 1
    mine = zip(w.start[first[at[begins]]].tolist(), w.end[first[at[ends]] + window - 1].tolist(), strict=True)
    its = zip(w.start[first[other[begins]]].tolist(), w.end[first[other[ends]] + window - 1].tolist(), strict=True)
    if all(data[a:b] == data[c:d] for (a, b), (c, d) in zip(mine, its, strict=True)):
        return where
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(w.start[first].tolist(), w.end[first + window - 1].tolist(), strict=True)])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's hash; rows that agree in both are told the same."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _shared_stretches(docs: DataFrame, window: int, run: int, exchange: Exchange, key: wd.Key) -> DataFrame:
    """doc_id, h, flags: for each stretch of a document a bit whether its minimiser occurs again, then
    for each a bit whether it is very frequent."""

    def send(batch: pa.RecordBatch) -> Sent:
        _, _, minimiser, text = stretches(wd.split(batch.column("text"), key), window, run)
        values, where, counts = np.unique(minimiser, return_inverse=True, return_counts=True)
        keys = [batch.column("doc_id"), batch.column("h")]
        return Sent(values, counts, np.zeros(0, U), lambda order, _: pickle.dumps((keys, text.astype(np.uint32), where.astype(np.uint32), order.astype(np.uint32))))

    def receive(payload: bytes, counts: np.ndarray) -> pa.RecordBatch:
        (doc_id, h), text, where, order = pickle.loads(payload)
        often = np.zeros(len(order), np.uint8)
        often[order] = counts
        often = often[where]
        cuts = np.searchsorted(text, np.arange(len(doc_id) + 1))
        some = [i for i in range(len(doc_id)) if (often[cuts[i] : cuts[i + 1]] > 1).any()]
        packed = [np.packbits(often[cuts[i] : cuts[i + 1]] > 1).tobytes() + np.packbits(often[cuts[i] : cuts[i + 1]] >= MOST).tobytes() for i in some]
        return pa.RecordBatch.from_arrays([doc_id.take(pa.array(some, pa.int64())), h.take(pa.array(some, pa.int64())), pa.array(packed, pa.binary())], names=["doc_id", "h", "flags"])

    found = tell(docs, send, receive, "doc_id long, h long, flags binary", exchange)
    return found.groupBy("doc_id", "h").agg(F.max("flags").alias("flags"))


#: What a block sends a bucket, in one row: stretches as words and how often it has each, windows as
#: hashes and how often it has each (``seen``); and what it keeps for itself (``payload``).
_FIELDS = [("block", pa.int64()), ("bucket", pa.int32()), ("packed", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("seen", pa.binary()), ("payload", pa.binary())]
_PACKED = "block long, bucket int, packed binary, counts binary, hashes binary, seen binary, payload binary"
_PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def window_hashes(w: wd.Words, at: np.ndarray, window: int) -> np.ndarray:
    """Both hashes of the windows that begin at the words ``at``."""
    out = np.empty(len(at), _PAIR)
    out["a"], out["b"] = wd.runs(w.hash, window)[at], wd.runs(w.other, window)[at]
    return out


def _covered(starts: np.ndarray, window: int) -> bytes:
    """First word and end of each stretch of words that the windows beginning at ``starts`` (ascending) cover."""
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + window]))
    last = np.append(new[1:] - 1, len(starts) - 1)
    return np.stack([starts[new], starts[last] + window], 1).astype("<u4").tobytes()


def repeated_ranges(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, h, ranges, more of the documents with repeated windows.

    ``ranges`` and ``more`` hold pairs of little-endian 32-bit numbers: first word and end of each
    stretch of words that repeated windows cover, in ``more`` those with a very frequent minimiser.
    """
    keyed = _keyed(docs)
    exchange, key = exchange_for(keyed), wd.Key.draw()
    first = materialize(_first_pass(keyed, window, run, exchange, key))
    told = first.groupBy("doc_id", "h").agg(F.max("ranges").alias("ranges"), F.max("open").alias("open"))
    asked = _joined(keyed, told.filter("open is not null"), "open", "inner").sortWithinPartitions("h", "doc_id")
    # Buckets by the bytes of words that will travel, about eight a word.
    opened = told.agg(F.sum(F.octet_length("open"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-opened // 4 * window * 8 // BUCKET_BYTES))
    second = _second_pass(asked, window, Exchange(buckets, exchange.block), key).groupBy("doc_id", "h").agg(F.max("ranges").alias("more"))
    return told.select("doc_id", "h", "ranges", F.lit(None).cast("binary").alias("more")).unionByName(second.select("doc_id", "h", F.lit(None).cast("binary").alias("ranges"), "more")).groupBy("doc_id", "h").agg(F.max("ranges").alias("ranges"), F.max("more").alias("more"))


def _second_pass(asked: DataFrame, window: int, exchange: Exchange, key: wd.Key) -> DataFrame:
    """doc_id, h, ranges: which of the windows that begin at the words ``open`` of a text (little-endian
    32-bit numbers) are equal to another one, by their words. Equal windows are open in all texts or in none."""
    buckets = exchange.buckets

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        part = task << 32
        for i, batch in enumerate(chunks(batches, size=exchange.block)):
            w = wd.split(batch.column("text"), key)
            opened = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("open").to_pylist()]
            text = np.repeat(np.arange(len(opened)), [len(x) for x in opened])
            at = np.concatenate([np.zeros(0, np.int64), *opened]) + w.first[text]
            hashes = window_hashes(w, at, window)
            where = equal_windows(w, at, hashes, window)
            _, lead, which, seen = np.unique(where, return_index=True, return_inverse=True, return_counts=True)
            bucket = bucket_of(hashes["a"][lead], buckets)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            payload = pickle.dumps(([batch.column("doc_id"), batch.column("h")], text.astype(np.uint32), np.concatenate([np.zeros(0, np.int64), *opened]).astype(np.uint32), place[which].astype(np.uint32)))
            rows = [(part + i, (task + i) % buckets, None, None, None, None, payload)]
            data, begin, end = w.data.tobytes(), w.start[at[lead]], w.end[at[lead] + window - 1]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[b] : cuts[b + 1]]
                packed = b"\n".join(b" ".join(data[x:y].split()) for x, y in zip(begin[mine].tolist(), end[mine].tolist(), strict=True))
                rows.append((part + i, b, packed, seen[mine].astype("<u4").tobytes(), None, None, None))
            for k in range(0, len(rows), BATCH_ROWS):
                yield batch_of(_FIELDS, rows[k : k + BATCH_ROWS])

    def reducer(bucket: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        asks = [r for r in got if r["packed"] is not None]
        out = [(r["block"], -1, None, None, None, None, r["payload"]) for r in got if r["payload"] is not None]
        if asks:
            # A line is a window; equal lines are equal windows.
            lines = [r["packed"].split(b"\n") for r in asks]
            times: dict[bytes, int] = {}
            for r, some in zip(asks, lines, strict=True):
                for line, n in zip(some, np.frombuffer(r["counts"], "<u4").tolist(), strict=True):
                    times[line] = times.get(line, 0) + n
            out += [(r["block"], r["bucket"], None, None, np.array([times[x] > 1 for x in some]).tobytes(), None, None) for r, some in zip(asks, lines, strict=True)]
        return pa.Table.from_batches([batch_of(_FIELDS, out)])

    def collector(block: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = sorted(table.select(["bucket", "hashes", "payload"]).to_pylist(), key=lambda r: r["bucket"])
        (doc_id, h), text, at, place = pickle.loads(next(r["payload"] for r in got if r["payload"] is not None))
        hit = np.frombuffer(b"".join(r["hashes"] for r in got if r["hashes"] is not None), bool)[place]
        text, at = text[hit], at[hit].astype(np.int64)
        some = np.unique(text)
        cuts = np.searchsorted(text, [*some.tolist(), len(doc_id)])
        ranges = [_covered(at[a:b], window) for a, b in zip(cuts, cuts[1:], strict=False)]
        take = pa.array(some, pa.int64())
        return pa.Table.from_arrays([doc_id.take(take), h.take(take), pa.array(ranges, pa.binary())], names=["doc_id", "h", "ranges"])

    return asked.mapInArrow(mapper, _PACKED).groupBy("bucket").applyInArrow(reducer, _PACKED).groupBy("block").applyInArrow(collector, "doc_id long, h long, ranges binary")


def _first_pass(keyed: DataFrame, window: int, run: int, exchange: Exchange, key: wd.Key) -> DataFrame:
    """doc_id, h, ranges, open: what ``repeated_ranges`` calls ranges, and the first words of windows
    with a very frequent minimiser whose hash occurs again."""
    buckets = exchange.buckets
    flags = _shared_stretches(keyed, window, run, exchange, key)
    # Sorted, so that a task that runs again finds its rows in the same order.
    asked = _joined(keyed, flags, "flags", "inner").sortWithinPartitions("h", "doc_id")

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        part = task << 32
        for i, batch in enumerate(chunks(batches, size=exchange.block)):
            w = wd.split(batch.column("text"), key)
            first, size, minimiser, text = stretches(w, window, run)
            cuts = np.searchsorted(text, np.arange(len(w) + 1))
            keep, hot = np.zeros(len(first), bool), np.zeros(len(first), bool)
            for d, bits in enumerate(batch.column("flags").to_pylist()):
                n = cuts[d + 1] - cuts[d]
                told = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
                keep[cuts[d] : cuts[d + 1]], hot[cuts[d] : cuts[d + 1]] = told[:n], told[-(-n // 8) * 8 :][:n]
            # Very frequent: each window by its hashes. A block sends what it has several times once, with its count.
            hot &= keep
            n = size[hot]
            windows = np.repeat(first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hashes, which_hash, seen = np.unique(window_hashes(w, windows, window), return_inverse=True, return_counts=True)
            hash_bucket = bucket_of(hashes["a"], buckets)
            by_bucket = np.argsort(hash_bucket, kind="stable")
            hash_place = np.empty(len(hashes), np.int64)
            hash_place[by_bucket] = np.arange(len(hashes))
            hash_text = np.repeat(text[hot], n)
            # The others as their words.
            some = np.flatnonzero(keep & ~hot)
            first, size, minimiser, text = first[some], size[some], minimiser[some], text[some]
            order: dict[tuple[int, bytes], int] = {}
            times: list[int] = []
            which = np.zeros(len(first), np.int64)
            data = w.data.tobytes()
            for k, b in enumerate(bucket_of(minimiser, buckets).tolist()):
                words = b" ".join(data[w.start[first[k]] : w.end[first[k] + size[k] + window - 2]].split())
                j = which[k] = order.setdefault((b, words), len(order))
                if j == len(times):
                    times.append(0)
                times[j] += 1
            by: dict[int, list[tuple[int, bytes]]] = {}
            for (b, words), j in order.items():
                by.setdefault(b, []).append((j, words))
            sequence = [j for b in sorted(by) for j, _ in by[b]]  # the order in which answers come
            place = np.empty(len(sequence), np.int64)
            place[sequence] = np.arange(len(sequence))
            payload = pickle.dumps(([batch.column("doc_id"), batch.column("h")], text, first - w.first[text], size, place[which], hash_text, windows - w.first[hash_text], hash_place[which_hash]))
            rows = [(part + i, (task + i) % buckets, None, None, None, None, payload)]
            cuts = np.searchsorted(hash_bucket[by_bucket], np.arange(buckets + 1))
            for b in sorted({*by, *np.flatnonzero(np.diff(cuts)).tolist()}):
                words = (b"\n".join(x for _, x in by[b]), np.array([times[j] for j, _ in by[b]], "<u4").tobytes()) if b in by else (None, None)
                mine = by_bucket[cuts[b] : cuts[b + 1]]
                hashed = (hashes[mine].tobytes(), seen[mine].astype("<u4").tobytes()) if len(mine) else (None, None)
                rows.append((part + i, b, *words, *hashed, None))
            for k in range(0, len(rows), BATCH_ROWS):
                yield batch_of(_FIELDS, rows[k : k + BATCH_ROWS])

    def reducer(bucket: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        asks, hashed = [r for r in got if r["packed"] is not None], [r for r in got if r["hashes"] is not None]
        out = [(r["block"], -1, None, None, None, None, r["payload"]) for r in got if r["payload"] is not None]
        told: dict[int, list] = {r["block"]: [None, None] for r in asks + hashed}
        if asks:
            lines = [r["packed"].split(b"\n") for r in asks]
            w = wd.split(pa.array([x for some in lines for x in some], pa.large_binary()).cast(pa.large_string()), key)
            times = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in asks]).astype(np.int64)
            first, hashes = w.windows(window)
            text = w.text_of()[first]
            where = equal_windows(w, first, hashes, window)
            again = np.bincount(where, weights=times[text])[where] > 1
            cuts = np.searchsorted(text, np.arange(len(w) + 1))
            begin = 0
            for r, some in zip(asks, lines, strict=True):
                told[r["block"]][0] = pickle.dumps([np.packbits(again[cuts[j] : cuts[j + 1]]).tobytes() for j in range(begin, begin + len(some))])
                begin += len(some)
        if hashed:
            each = [np.frombuffer(r["hashes"], _PAIR) for r in hashed]
            _, where = np.unique(np.concatenate(each), return_inverse=True)
            again = np.bincount(where, weights=np.concatenate([np.frombuffer(r["seen"], "<u4") for r in hashed]))[where] > 1
            begin = 0
            for r, x in zip(hashed, each, strict=True):
                told[r["block"]][1] = again[begin : begin + len(x)].tobytes()
                begin += len(x)
        out += [(block, bucket[0].as_py(), bits, None, flags, None, None) for block, (bits, flags) in told.items()]
        return pa.Table.from_batches([batch_of(_FIELDS, out)])

    def collector(block: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = sorted(table.select(["bucket", "packed", "hashes", "payload"]).to_pylist(), key=lambda r: r["bucket"])
        (doc_id, h), text, first, size, place, hash_text, windows, hash_place = pickle.loads(next(r["payload"] for r in got if r["payload"] is not None))
        bits = [x for r in got if r["packed"] is not None for x in pickle.loads(r["packed"])]
        again = np.frombuffer(b"".join(r["hashes"] for r in got if r["hashes"] is not None), bool)
        hit = again[hash_place] if len(hash_place) else np.zeros(0, bool)
        hash_text, windows = hash_text[hit], windows[hit]
        cuts, hash_cuts = (np.searchsorted(x, np.arange(len(doc_id) + 1)) for x in (text, hash_text))
        some, ranges, opened = [], [], []
        for d in range(len(doc_id)):
            starts = [first[k] + np.flatnonzero(np.unpackbits(np.frombuffer(bits[place[k]], np.uint8), count=size[k])) for k in range(cuts[d], cuts[d + 1])]
            at = np.sort(np.concatenate([np.zeros(0, np.int64), *starts]))
            mine = windows[hash_cuts[d] : hash_cuts[d + 1]]
            if len(at) or len(mine):
                some.append(d)
                ranges.append(_covered(at, window) if len(at) else None)
                opened.append(np.sort(mine).astype("<u4").tobytes() if len(mine) else None)
        take = pa.array(some, pa.int64())
        return pa.Table.from_arrays([doc_id.take(take), h.take(take), pa.array(ranges, pa.binary()), pa.array(opened, pa.binary())], names=["doc_id", "h", "ranges", "open"])

    return asked.mapInArrow(mapper, _PACKED).groupBy("bucket").applyInArrow(reducer, _PACKED).groupBy("block").applyInArrow(collector, "doc_id long, h long, ranges binary, open binary")


def _joined(keyed: DataFrame, told: DataFrame, columns: str | list[str], how: str) -> DataFrame:
    columns = [columns] if isinstance(columns, str) else columns
    other = told.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), *columns)
    return keyed.join(other, (F.col("h") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id")), how).select("doc_id", "h", "text", *columns)


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of (doc_id, text).

    A word goes if a window over it also starts anywhere else, in the same document too; so the
    copies of a text all go. Null and empty texts have no words. Repeated rows repeat each other.
    """
    told = _joined(_keyed(docs), repeated_ranges(docs, window, run), ["ranges", "more"], "left")

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            counts, removed, kept = [], [], []
            told_ = (batch.column(c).to_pylist() for c in ("ranges", "more"))
            for text, *some in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), *told_, strict=True):
                words = text.split()
                counts.append(len(words))
                if any(some):
                    stay = np.ones(len(words), bool)
                    for ranges in filter(None, some):
                        for a, b in np.frombuffer(ranges, "<u4").reshape(-1, 2):
                            stay[a:b] = False
                    words = list(compress(words, stay.tolist()))
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]
            )

    return told.mapInArrow(run_, "doc_id long, n_words long, n_removed long, kept string")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM docs)
),
hashed AS (SELECT r, i, md5_number(w) AS w FROM windows),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY w) AS n FROM hashed) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM again),
left_ AS (
  SELECT d.r, string_agg(d.word, ' ' ORDER BY d.p) AS kept, count(*) AS n
  FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs) d ANTI JOIN gone g ON d.r = g.r AND d.p = g.p
  GROUP BY d.r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_ USING (r)
"""
