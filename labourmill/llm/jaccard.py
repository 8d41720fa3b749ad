"""Exact similarity join of documents on word shingles, by T-occurrence search.

Two documents link when their shingle sets' Jaccard similarity reaches the threshold. The steps:

1. Every document's shingles are counted over the corpus (``tally``). A linked document shares at
   least ``threshold`` of its own shingles with another, so one that shares less is done.
2. The others, one for each set of shingles, are counted among themselves. In an order from rare
   to frequent, two sets that link share one of their first n - ceil(threshold * n) + 1 shingles:
   each such shingle ties its sets to the least of them, and the ties' components are cells.
   Sets of different cells don't link. Common passages come last in that order, so they tie only
   sets that hold little else.
3. Within a cell, DivideSkip: of a set's inverted lists the longest are put aside, the short ones
   are merged, and what occurs often enough is looked up in the long ones by binary search. The
   most central sets ask first; pairs that are already connected aren't looked for again, and the
   largest group that they leave needn't ask, so a group of many near copies costs few searches.
   A larger cell is dealt in blocks: each is searched by itself, the most central sets of all then
   ask every block, and the sets that they leave those blocks that have one of their prefix shingles.
4. Links' components are the classes.

Hashes only tell where to look. Two sets are the same if both of a run's keyed hashes (122 bits
that no text can foresee) agree on all their shingles; two different sets link only after their
words have been compared, so each set brings its words along, compressed.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labourmill.llm import words as wd
from labourmill.llm.components import components
from labourmill.llm.shared import materialize
from labourmill.llm.tally import Exchange, Sent, batch_of, exchange_for, tell
from labourmill.llm.words import U

SHINGLE = 5
THRESHOLD = 75  # per cent
#: A cell with more sets, or more shingles, is dealt in blocks of so many.
CELL_SETS = 128
CELL_SHINGLES = 1_000_000
#: The most central sets of a cell, which ask first.
PIVOTS = 8


def shingles(w: wd.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of the distinct shingles of each text, by the first in ascending order, and each one's text.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    at = w.begins(size)
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < size))
    text = np.concatenate([w.text_of()[at], short])
    hashes, others = (np.concatenate([wd.runs(h, size)[at], w.whole(short, h)]) for h in (w.hash, w.other))
    order = np.lexsort((hashes, text))
    text, hashes, others = text[order], hashes[order], others[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    met = np.flatnonzero(~new)
    if (others[met] != others[met - 1]).any():  # two shingles of one text, one hash: less than once in 2 ** 40 texts
        raise ValueError("two shingles met in a hash: run again, and other hashes are drawn")
    return hashes[new], others[new], text[new]


def _set_keys(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One number for each set, of all its shingles and their number."""
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(wd.mix(hashes), dtype=U, out=sums[1:])
    return wd.mix((sums[cuts[1:]] - sums[cuts[:-1]]) ^ wd.mix(np.diff(cuts).astype(U))).view(np.int64)


def worded(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    """The shingles of a text as words."""
    words = text.split()
    return set(zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else {tuple(words)}


def alike(a: set, b: set, threshold: int) -> bool:
    common = len(a & b)
    return 100 * common >= threshold * (len(a) + len(b) - common)


def _need(n: int, threshold: int) -> int:
    """Fewest shingles that a set of n shares with any that it links with."""
    return -(-threshold * n // 100)


def document_sets(docs: DataFrame, exchange: Exchange, key: wd.Key, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, h, n, set_key, open of every row of (doc_id, h, text): size and key of its set, and
    whether it may link. Sets are told apart by two sums of 64 bits, one of each hash."""

    def send(batch: pa.RecordBatch) -> Sent:
        tokens, others, doc = shingles(wd.split(batch.column("text"), key, lower=True), size)
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        values, where, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        several = counts[where] > 1
        known = np.bincount(doc[several], minlength=batch.num_rows)
        asked = doc[~several]
        keys = _set_keys(tokens, cuts), _set_keys(others, cuts)

        def payload(order: np.ndarray, bucket: np.ndarray) -> bytes:
            # Whose each token is: as counts a document and bucket (within a bucket they stand in order of document), or one by one.
            n = int(bucket.max()) + 1 if len(bucket) else 0
            if n * batch.num_rows <= 2 * len(asked):
                of = np.bincount(bucket * batch.num_rows + asked[order], minlength=n * batch.num_rows)
                of = of.astype(np.uint8 if not len(of) or of.max() < 256 else np.uint32)
                return pickle.dumps((batch.column("doc_id"), batch.column("h"), np.diff(cuts), keys, known, True, of))
            return pickle.dumps((batch.column("doc_id"), batch.column("h"), np.diff(cuts), keys, known, False, asked[order].astype(np.uint32)))

        return Sent(tokens[~several], None, values[counts > 1], payload)

    def receive(payload: bytes, counts: np.ndarray) -> pa.RecordBatch:
        doc_id, h, n, keys, known, counted, of = pickle.loads(payload)
        doc = np.repeat(np.tile(np.arange(len(n)), len(of) // max(1, len(n))), of) if counted else of
        shared = known + np.bincount(doc[counts > 1], minlength=len(n))
        columns = {"doc_id": doc_id, "h": h, "n": n.astype(np.int64), "set_key": keys[0], "check": keys[1], "open": (n > 0) & (100 * shared >= threshold * n)}
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))

    rows = materialize(tell(docs, send, receive, "doc_id long, h long, n long, set_key long, check long, open boolean", exchange))
    # Where two sets have one key, next to never, both sums make a new one.
    twice = materialize(rows.groupBy("set_key").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b").select("set_key", F.lit(True).alias("twice")))
    return rows.join(twice, "set_key", "left").withColumn("old_key", F.col("set_key")).withColumn("set_key", F.when(F.col("twice"), F.xxhash64("set_key", "check")).otherwise(F.col("set_key"))).drop("twice")


def candidate_sets(docs: DataFrame, exchange: Exchange, key: wd.Key, size: int, threshold: int) -> DataFrame:
    """set_key, n, tokens, prefix, text of the sets (rows of ``docs``, one or more for each) that may link.

    ``docs`` has text, set_key and the sums old_key and check. ``tokens`` has the shingles that
    other sets have too, from rare to frequent; ``prefix`` how many of them may tie the set to others. ``text`` is a text of the
    set, in lower case and compressed.
    """

    def send(batch: pa.RecordBatch) -> Sent:
        w = wd.split(batch.column("text"), key, lower=True)
        tokens, others, doc = shingles(w, size)
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        keys = np.asarray(batch.column("set_key"))
        # Of rows with one set the first one counts; and only rows that have the set that was asked for.
        right = (_set_keys(tokens, cuts) == np.asarray(batch.column("old_key"))) & (_set_keys(others, cuts) == np.asarray(batch.column("check"))) & (np.diff(cuts) > 0)
        at = np.flatnonzero(right)
        use = np.zeros(len(keys), bool)
        use[at[np.unique(keys[at], return_index=True)[1]]] = True
        tokens, doc = tokens[use[doc]], doc[use[doc]]
        values, where, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        pack, chosen = zstandard.ZstdCompressor(1).compress, np.flatnonzero(use)
        texts = [pack(w.data[w.start[w.first[d]] : w.end[w.first[d + 1] - 1]].tobytes()) for d in chosen.tolist()]
        payload = (keys[use], np.diff(cuts)[use], texts, values, where.astype(np.uint32))
        return Sent(values, counts, np.zeros(0, U), lambda order, _: pickle.dumps((*payload, order.astype(np.uint32))))

    def receive(payload: bytes, counts: np.ndarray) -> pa.RecordBatch:
        keys, n, texts, values, where, order = pickle.loads(payload)
        often = np.zeros(len(values), np.int64)
        often[order] = counts
        rows, begin = [], 0
        for set_key, size_, text in zip(keys.tolist(), n.tolist(), texts, strict=True):
            mine = where[begin : begin + size_]
            begin += size_
            mine = mine[np.lexsort((values[mine], often[mine]))]
            shared = often[mine] > 1
            need = _need(size_, threshold)
            if shared.sum() >= need:
                rows.append((set_key, size_, values[mine[shared]].tobytes(), int(shared[: size_ - need + 1].sum()), text))
        fields = [("set_key", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.int32()), ("text", pa.binary())]
        return batch_of(fields, rows)

    return tell(docs, send, receive, "set_key long, n long, tokens binary, prefix int, text binary", exchange)


def _ties(sets: DataFrame) -> DataFrame:
    """a, b: ties that connect all sets with a prefix shingle in common.

    A batch ties its own sets first, each to the least one with the same shingle, and sends on
    only that one: a shingle that very many sets have is a row a batch in the shuffle.
    """

    def run(batches):
        for batch in batches:
            keys, tokens, prefix = (c.to_pylist() for c in batch.columns)
            each = [np.frombuffer(t, np.int64)[:p] for t, p in zip(tokens, prefix, strict=True)]
            key, token = np.repeat(np.array(keys, np.int64), [len(x) for x in each]), np.concatenate([*each, np.zeros(0, np.int64)])
            order = np.lexsort((key, token))
            key, token = key[order], token[order]
            first = np.ones(len(token), bool)
            first[1:] = token[1:] != token[:-1]
            least = key[np.flatnonzero(first)][np.cumsum(first) - 1] if len(key) else key
            pairs = np.unique(np.stack([key[~first], least[~first]], 1), axis=0)
            n = len(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key[first], pairs[:, 0]])), pa.array(np.concatenate([token[first], pairs[:, 1]])), pa.array(np.arange(first.sum() + n) >= first.sum())], names=["set_key", "other", "tied"]
            )

    sent = sets.select("set_key", "tokens", "prefix").filter("prefix > 0").mapInArrow(run, "set_key long, other long, tied boolean")
    listed = sent.filter("not tied").select("set_key", F.col("other").alias("token"))
    least = listed.groupBy("token").agg(F.min("set_key").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    across = listed.join(least, "token").select(F.col("set_key").alias("a"), "b")
    return sent.filter("tied").select(F.col("set_key").alias("a"), F.col("other").alias("b")).unionByName(across).filter("a != b").distinct()


class _Sets:
    """Sets of one task: sorted shingles, full sizes, compressed texts, and who is connected with whom."""

    def __init__(self, table: pa.Table, size: int, threshold: int):
        self.keys, self.sizes = table["set_key"].to_pylist(), np.array(table["n"].to_pylist(), np.int64)
        self.tokens = [np.sort(np.frombuffer(t, U)) for t in table["tokens"].to_pylist()]
        self.texts, self.size, self.threshold = table["text"], size, threshold
        keys = self.keys
        self.group = np.arange(len(keys))
        self.links: list[tuple[int, int]] = []

    def index(self, some: list[int]) -> None:
        """Make the inverted lists of some sets: each shingle's owners stand together, in order."""
        flat = np.concatenate([np.zeros(0, U), *(self.tokens[i] for i in some)])
        owner = np.repeat(np.array(some, np.int64), [len(self.tokens[i]) for i in some])
        order = np.lexsort((owner, flat))
        self.owners = owner[order]
        self.values, self.begins, self.lengths = np.unique(flat[order], return_index=True, return_counts=True)

    def central(self, k: int) -> tuple[list[int], np.ndarray]:
        """The k indexed sets whose shingles are, on average, in most of the others; and all sets' scores."""
        score = np.bincount(self.owners, weights=np.repeat(self.lengths, self.lengths), minlength=len(self.keys)) / self.sizes
        return np.lexsort((np.array(self.keys), -score))[:k].tolist(), score

    def connect(self) -> tuple[int, float]:
        """All links among the sets, as far as they connect more. The most central set, and its score a set."""
        self.index(list(range(len(self.keys))))
        first, score = self.central(PIVOTS)
        for q in first:
            self.ask(q)
        # Of two sets that aren't connected yet, one at least is outside the largest group.
        for q in np.flatnonzero(self.group != np.bincount(self.group).argmax()).tolist():
            self.ask(q)
        return self.keys[first[0]], float(score[first[0]]) / len(self.keys)

    def ask(self, q: int) -> None:
        """DivideSkip: the links of one set with the indexed ones that it isn't connected with."""
        at = np.minimum(np.searchsorted(self.values, self.tokens[q]), max(len(self.values) - 1, 0))
        lists = at[self.values[at] == self.tokens[q]] if len(self.values) else at[:0]
        least = _need(int(self.sizes[q]), self.threshold)
        if len(lists) < least:
            return
        lists = lists[np.argsort(self.lengths[lists], kind="stable")]
        mine = [self.owners[a : a + n] for a, n in zip(self.begins[lists].tolist(), self.lengths[lists].tolist(), strict=True)]
        # The longer the longest list, the fewer are worth putting aside.
        aside = min(least - 1, int(least / (0.0085 * np.log2(len(mine[-1]) + 1) + 1)))
        short, long_ = mine[: len(mine) - aside], mine[len(mine) - aside :]
        merged = np.sort(np.concatenate(short), kind="stable")  # merges the runs, sorted as they are
        found, counts = np.unique(merged, return_counts=True)
        some = (counts >= least - aside) & (self.group[found] != self.group[q]) & (100 * self.sizes[found] >= self.threshold * self.sizes[q])
        found, counts = found[some], counts[some]
        for left, one in zip(range(aside - 1, -1, -1), long_, strict=True):
            if not len(found):
                break
            place = np.minimum(np.searchsorted(one, found), len(one) - 1)
            counts = counts + (one[place] == found)
            some = counts + left >= least
            found, counts = found[some], counts[some]
        asks = None
        for j in found[100 * counts >= self.threshold * (self.sizes[q] + self.sizes[found] - counts)].tolist():
            if self.group[j] == self.group[q]:
                continue
            asks = self.worded(q) if asks is None else asks
            if alike(asks, self.worded(j), self.threshold):
                self.links.append((self.keys[q], self.keys[j]))
                self.group[self.group == self.group[j]] = self.group[q]

    def worded(self, i: int) -> set[tuple[bytes, ...]]:
        return worded(zstandard.ZstdDecompressor().decompress(self.texts[i].as_py()), self.size)

    def search(self, queries: list[int], index: list[int]) -> None:
        """All links of the queries with the indexed sets, as far as they connect more."""
        self.index(index)
        for q in queries:
            self.ask(q)

    def root(self, i: int) -> int:
        """The number of a set's group."""
        return int(self.group[i])

    def found(self) -> pa.Table:
        a, b = zip(*self.links, strict=True) if self.links else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _cell_links(cells: DataFrame, size: int, threshold: int) -> DataFrame:
    """a, b: links that connect all linked sets of each cell (cell, set_key, n, tokens, text), a cell a task."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sets = _Sets(table, size, threshold)
        sets.connect()
        return sets.found()

    return cells.groupBy("cell").applyInArrow(run, "a long, b long")


def _links_within(blocks: DataFrame, size: int, threshold: int) -> DataFrame:
    """cell, a, b, score: links that connect all linked sets of each (cell, block), and a row with its
    most central set (a) and that one's score; b is null there, score elsewhere."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sets = _Sets(table, size, threshold)
        centre, score = sets.connect()
        links = sets.found()
        columns = [[key[0].as_py()] * (len(links) + 1), [*links["a"].to_pylist(), centre], [*links["b"].to_pylist(), None], [None] * len(links) + [score]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["cell", "a", "b", "score"])

    return blocks.groupBy("cell", "block").applyInArrow(run, "cell long, a long, b long, score double")


def _block_links(tasks: DataFrame, size: int, threshold: int) -> DataFrame:
    """a, b: links of the sets that ask with those that don't, of each (cell, block, chunk)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sets = _Sets(table, size, threshold)
        asks = table["asks"].to_pylist()
        sets.group = np.unique(np.array(table["group"].to_pylist(), np.int64), return_inverse=True)[1]  # connected in an earlier step
        sets.search([i for i, x in enumerate(asks) if x], [i for i, x in enumerate(asks) if not x])
        return sets.found()

    return tasks.groupBy("cell", "block", "chunk").applyInArrow(run, "a long, b long")


def _heads(sets: DataFrame) -> DataFrame:
    """cell, block, set_key, n, token: a row for each prefix shingle of each set."""

    def run(batches):
        for batch in batches:
            each = [np.frombuffer(t, np.int64)[:p] for t, p in zip(batch.column("tokens").to_pylist(), batch.column("prefix").to_pylist(), strict=True)]
            take = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
            names = ["cell", "block", "set_key", "n"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names), pa.array(np.concatenate([np.zeros(0, np.int64), *each]))], names=[*names, "token"])

    return sets.select("cell", "block", "set_key", "n", "tokens", "prefix").mapInArrow(run, "cell long, block long, set_key long, n long, token long")


def _large_links(cells: DataFrame, size: int, threshold: int) -> DataFrame:
    """As ``_cell_links`` for cells (cell, set_key, n, tokens, text, prefix, blocks) too large for a task.

    Each task has about a block of a cell's sets and as many that ask it, however large the cell.
    """
    dealt = cells.withColumn("block", F.pmod(F.xxhash64("set_key"), "blocks"))
    columns = ["cell", "block", "chunk", "set_key", "n", "tokens", "text", "asks", "group"]

    def rows(some: DataFrame, asks: bool) -> DataFrame:
        return some.withColumn("asks", F.lit(asks)).select(columns)

    # First each block by itself; the most central sets of all blocks then ask every block.
    within = materialize(_links_within(dealt.select("cell", "block", "set_key", "n", "tokens", "text"), size, threshold))
    rank = F.row_number().over(W.partitionBy("cell").orderBy(F.desc("score"), "a"))
    centres = within.filter("b IS NULL").withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).select("cell", F.col("a").alias("set_key"))
    pivots = dealt.join(centres, ["cell", "set_key"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    alone = {"chunk": F.lit(0).cast("long"), "group": F.col("set_key")}
    early = materialize(_block_links(rows(dealt.withColumns(alone), False).unionByName(rows(pivots.withColumns(alone), True)), size, threshold).unionByName(within.filter("b IS NOT NULL").select("a", "b")))
    # Then those outside their cell's largest group ask where they have a prefix shingle in common, and no length against it.
    groups = components(early).withColumnRenamed("node", "set_key")
    known = materialize(dealt.join(groups, "set_key", "left").withColumn("group", F.coalesce("component", "set_key")).drop("component"))
    largest = known.groupBy("cell", "group").agg(F.count(F.lit(1)).alias("sets")).groupBy("cell").agg(F.max_by("group", F.struct("sets", "group")).alias("largest"))
    asking = materialize(known.join(largest, "cell").filter("group != largest").drop("largest"))
    there = _heads(known).groupBy("cell", "token", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    met = _heads(asking).select("cell", "token", "set_key", "n").join(there, ["cell", "token"]).filter((100 * F.col("hi") >= threshold * F.col("n")) & (100 * F.col("n") >= threshold * F.col("lo")))
    met = materialize(met.select("cell", "block", "set_key").distinct())
    sizes = materialize(met.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / CELL_SETS).cast("long").alias("chunks")))
    chunk = F.pmod(F.xxhash64("set_key", F.lit(1)), "chunks")
    ask = met.join(asking.drop("block"), ["cell", "set_key"]).join(sizes, ["cell", "block"]).withColumn("chunk", chunk)
    every = known.join(sizes, ["cell", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return early.unionByName(_block_links(rows(every, False).unionByName(rows(ask, True)), size, threshold))


def similar_documents(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, one row for each row of ``docs`` (doc_id, text).

    component_id is the least doc_id that links reach, the row's own included. A text without
    words (or null) has no shingles and links with nothing; copies link with each other. A
    doc_id that is null stays so and counts as the greatest: its component_id is the least of
    its component, null if there is none. Other columns are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    exchange, key = exchange_for(texts), wd.Key.draw()
    rows = document_sets(texts, exchange, key, size, threshold)
    one = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    classes = materialize(
        rows.filter("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.max("open").alias("open"), F.min("old_key").alias("old_key"), F.min("check").alias("check"), F.min(one).alias("one"))
    )
    # A row of each set is read again; sorted, so that a task that runs again finds its rows in the same order.
    asked = classes.filter("open").select("one.*", "set_key", "old_key", "check")
    again = texts.join(asked, (F.col("h") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("text", "set_key", "old_key", "check", "h", "doc_id")
    sets = materialize(candidate_sets(again.sortWithinPartitions("h", "doc_id", "set_key"), exchange, key, size, threshold).dropDuplicates(["set_key"]))
    cell = components(_ties(sets)).select(F.col("node").alias("set_key"), F.col("component").alias("cell"))
    placed = sets.join(cell, "set_key")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("cell_sets"), F.sum(F.length("tokens") / 8).alias("cell_tokens"))
    blocks = F.greatest(F.ceil(F.col("cell_sets") / CELL_SETS), F.ceil(F.col("cell_tokens") / CELL_SHINGLES)).cast("long")
    over = materialize(sizes.select("cell", blocks.alias("blocks")).filter("blocks > 1"))
    links = _cell_links(placed.join(over.select("cell"), "cell", "left_anti").select("cell", "set_key", "n", "tokens", "text"), size, threshold)
    if over.take(1):
        links = links.unionByName(_large_links(materialize(placed.join(over, "cell")), size, threshold))
    joined = components(links).select(F.col("node").alias("set_key"), "component")
    merged = classes.join(joined, "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    least = merged.groupBy("component").agg(F.min("least").alias("component_id"))
    named = merged.join(least, "component").select("set_key", "component_id")
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.filter("n > 0").join(named, "set_key").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(words[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, least(len(words), 1) + 1))) AS i FROM docs)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM docs JOIN least_ USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
