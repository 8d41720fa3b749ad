"""Secrets in texts: rules, and a convolutional network over the characters of what they leave open.

Base kinds (assign, access, hex) are decided by their rule alone. Other candidates (long runs of
the characters that keys are made of, passwords within addresses) are judged by a small network
over the characters of the candidate and of its surroundings: filters of five characters, the
highest answer of each within the candidate and around it, and a logistic output. It is trained on
labelled findings: what the base rules found is secret, runs that are plainly words, numbers or
paths of these aren't; the name that gave an assignment away is hidden from the network. Its
thresholds come from the scores of all labelled findings of the corpus, as they are and in other
dress: the highest that still keeps the recall asked for. Scores are calibrated by an isotonic fit over the same counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.llm.shared import discard, materialize
from labourmill.llm.words import chunks

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "url")
#: Names that an assignment's left side ends in.
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_URL = re.compile(rb"://[^\s:/@]+:([^\s@/]+)@")
ASSIGNED, ACCESS, HEX, RUN = 6, 20, 24, 16
_PARTS = re.compile(r"[-_/+=]+")
_PLAIN = re.compile(r"[A-Z]?[a-z]*|[A-Z]+|[0-9]+")
#: Characters of context on either side.
CONTEXT = 16

#: Labelled findings of either label that train the network, about; longer ones don't.
SAMPLE, LONGEST = 2000, 512
FILTERS, WIDTH, EPOCHS, BATCH, RATE = 24, 5, 6, 64, 0.01
RECALL = 0.95
#: Scores are counted in so many bins, between these log odds.
BINS, ODDS = 1000, 12.0
#: Candidates have a threshold by length: below the first of these, below the second, and the rest. A class with
#: fewer labelled secrets than FEW has the threshold of all.
LENGTHS, FEW = (24, 40), 50
#: For thresholds a labelled secret counts so many times in other dress, another finding once.
DRESSES = 4
_EDGE, _OTHER = 128, 127
_VOCABULARY = 129
#: Characters that the network looks at at once.
PIECE = 100_000


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_ALNUM = bytes(c for c in range(128) if chr(c).isalnum())
#: Alphabets that keys are written in.
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", _ALNUM.decode(), _ALNUM.decode() + "+/", _ALNUM.decode() + "-_")
_HEX, _TOKEN = _class(b"0123456789abcdef"), _class(_ALNUM + b"+/_=-")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of all longest runs of ``least`` or more such characters within a text."""
    inside = np.concatenate([[False], kind[data], [False]])
    cut = np.zeros(len(data) + 1, bool)  # a text begins here
    cut[offsets] = True
    here, before = inside[1:], inside[:-1]
    start = np.flatnonzero(here & (~before | cut))
    end = np.flatnonzero(before & (~here | cut))
    some = end - start >= least
    return start[some], end[some]


def _places(data: bytes, what: bytes) -> list[int]:
    out, at = [], data.find(what)
    while at >= 0:
        out.append(at)
        at = data.find(what, at + 1)
    return out


def _matches(data: bytes, places: list[int], pattern: re.Pattern, offsets: np.ndarray) -> Iterator[re.Match]:
    """The leftmost matches, none overlapping, of a pattern that begins at some of the places; within a text."""
    done = 0
    ends = offsets[np.searchsorted(offsets, np.array(places, np.int64), side="right")].tolist() if places else []
    for at, end in zip(places, ends, strict=True):
        if at >= done and (m := pattern.match(data, at, end)):
            done = m.end()
            yield m


def plain(value: str) -> bool:
    """Whether a run is words, each in one case, and numbers, with marks between them."""
    return all(_PLAIN.fullmatch(p) for p in _PARTS.split(value))


def candidates(texts: pa.Array) -> list[list[dict]]:
    """Base findings and other candidates of each text: kind, start, end (code points), label (1: secret,
    0: not, -1: open), and what the network sees: value, before, after."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    if not len(data):
        return out
    plain_bytes, low = data.tobytes(), _LOWER[data].tobytes()
    found: list[tuple[int, int, int, int, int]] = []  # kind, first and end byte, and those of the value
    for m in _matches(plain_bytes, sorted(p for n in NAMES for p in _places(low, n)), _ASSIGN, offsets):
        if m.end() - m.start(1) >= ASSIGNED:
            found.append((0, m.start(), m.end(), m.start(1), m.end()))
    for m in _matches(plain_bytes, _places(plain_bytes, b"AKIA"), _ACCESS, offsets):
        if m.end() - m.start() >= ACCESS:
            found.append((1, m.start(), m.end(), m.start(), m.end()))
    for a, b in zip(*(x.tolist() for x in _runs(data, offsets, _HEX, HEX)), strict=True):
        found.append((2, a, b, a, b))

    def free(some: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Those that overlap nothing found so far."""
        change = np.zeros(len(data) + 1, np.int64)
        for _, a, b, _, _ in found:
            change[a] += 1
            change[b] -= 1
        taken = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
        return [x for x in some if taken[x[1]] == taken[x[2]]]

    found += free([(4, *m.span(1), *m.span(1)) for m in _matches(plain_bytes, _places(plain_bytes, b"://"), _URL, offsets)])
    found += free([(3, a, b, a, b) for a, b in zip(*(x.tolist() for x in _runs(data, offsets, _TOKEN, RUN)), strict=True)])
    # Bytes to code points.
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    of = (np.searchsorted(offsets, np.array([x[1] for x in found], np.int64), side="right") - 1).tolist()
    for (kind, a, b, c, d), t in zip(found, of, strict=True):
        first, end = int(offsets[t]), int(offsets[t + 1])
        value = plain_bytes[c:d].decode(errors="replace")
        shape = plain(value) if kind != 4 else False
        label = (-1 if shape else 1) if kind < len(BASE) else 0 if shape else -1
        before = plain_bytes[max(first, a - 4 * CONTEXT) : a].decode(errors="ignore")[-CONTEXT:]
        after = plain_bytes[b : min(end, b + 4 * CONTEXT)].decode(errors="ignore")[:CONTEXT]
        out[t].append({"kind": kind, "start": int(points[a] - points[first]), "end": int(points[b] - points[first]), "label": label, "value": value, "before": before, "after": after})
    for some in out:
        some.sort(key=lambda x: (x["start"], x["kind"]))
    return out


@dataclass
class Network:
    """Filters (place, character, filter) with their offsets, and the output's weights."""

    filters: np.ndarray
    offset: np.ndarray
    weights: np.ndarray
    bias: float


def _layout(shown: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of (before, value, after) in a row, edges between them, and where each
    candidate's three parts begin."""
    edge = "\uffff\uffff"
    parts = [p for before, value, after in shown for p in (edge + before, value, after + edge)]
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.where(code == 0xFFFF, _EDGE, np.minimum(code, _OTHER)).astype(np.int64)
    sizes = np.array([len(p) for p in parts], np.int64)
    return code, np.cumsum(sizes) - sizes


def _answers(net: Network, code: np.ndarray, first: int, end: int) -> np.ndarray:
    """What each filter says at the places first:end."""
    half = WIDTH // 2
    padded = np.concatenate([np.full(half, _EDGE), code[max(0, first - half) : end + half], np.full(half, _EDGE)])
    begin = half + first - max(0, first - half)
    z = np.broadcast_to(net.offset, (end - first, len(net.offset))).copy()
    for j in range(WIDTH):
        at = begin + j - half
        z += net.filters[j][padded[at : at + end - first]]
    return np.maximum(z, 0)


def _pooled(net: Network, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each part's highest answer of each filter, in pieces of bounded size however long a candidate is."""
    out = np.zeros((len(starts), len(net.offset)), np.float32)
    for first in range(0, len(code), PIECE):
        end = min(first + PIECE, len(code))
        h = _answers(net, code, first, end)
        a, b = np.searchsorted(starts, first, side="right") - 1, np.searchsorted(starts, end)
        some = np.maximum(starts[a:b], first) - first
        out[a:b] = np.maximum(out[a:b], np.maximum.reduceat(h, some, axis=0))
    return out


def _inputs(pool: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each candidate: the filters within it and around it, and its length."""
    three = pool.reshape(-1, 3, pool.shape[1])
    size = np.log2(np.maximum(lengths, 1))[:, None] / 4 - 1
    return np.concatenate([three[:, 1], np.maximum(three[:, 0], three[:, 2]), np.clip(size, -1, 2)], 1).astype(np.float32)


def score(net: Network, shown: list[tuple[str, str, str]]) -> np.ndarray:
    """Log odds of each (before, value, after)."""
    if not shown:
        return np.zeros(0)
    code, starts = _layout(shown)
    x = _inputs(_pooled(net, code, starts), np.array([len(v) for _, v, _ in shown], np.int64))
    return (x @ net.weights).astype(np.float64) + net.bias


@dataclass
class Wardrobe:
    """What findings are dressed anew with: words, and surroundings (before, after)."""

    words: list[str]
    around: list[tuple[str, str]]

    def dress(self, rng: np.random.Generator, known: bool) -> tuple[str, str, str]:
        """A finding in other dress: (before, value, after).

        A secret's characters are drawn anew, often from another alphabet, with or without a short
        name before; a plain run's words are put together anew as identifiers, paths, dates and
        numbers. Both stand in the surroundings of any finding.
        """
        before, after = self.around[rng.integers(len(self.around))]
        if known:
            letters = _ALPHABETS[rng.integers(len(_ALPHABETS))]
            value = "".join(letters[i] for i in rng.integers(len(letters), size=rng.integers(RUN, 65)))
            if rng.random() < 0.3:
                value = "".join(chr(97 + i) for i in rng.integers(26, size=rng.integers(2, 5))) + "-_"[rng.integers(2)] + value
            return before, value, after
        some = [self.words[i] for i in rng.integers(len(self.words), size=rng.integers(2, 5))]
        numbers = [str(n) for n in rng.integers(0, 3000, size=len(some))]
        shape = rng.integers(5)
        if shape == 0:
            value = "".join(w.title() for w in some) + (numbers[0] if rng.random() < 0.3 else "")
        elif shape == 1:
            value = "-_/"[rng.integers(3)].join(w.lower() + (n if rng.random() < 0.2 else "") for w, n in zip(some, numbers, strict=True))
        elif shape == 2:
            value = "/" + "/".join(w.lower() for w in some) + f"-{rng.integers(10)}-{rng.integers(100)}"
        elif shape == 3:
            value = f"{rng.integers(1970, 2040)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}T{rng.integers(24):02}-{rng.integers(60):02}-{rng.integers(60):02}"
        else:
            value = "".join(str(d) for d in rng.integers(10, size=rng.integers(RUN, 31)))
        return before, value, after


def wardrobe(findings: list[tuple[str, str, str]], labels: list[int]) -> Wardrobe:
    words = [w for (_, v, _), y in zip(findings, labels, strict=True) if not y for w in re.findall(r"[A-Za-z]{3,9}", v)]
    return Wardrobe(words or ["value", "name", "item"], [(b, a) for b, _, a in findings])


def train(findings: list[tuple[str, str, str]], labels: list[int], dressed: int = SAMPLE, seed: int = 7) -> Network | None:
    """The network fitted to findings (before, value, after) and their labels; None without both labels.

    ``dressed`` findings of either label join them in other dress. Adam on mini-batches; both
    labels weigh the same. Equal input gives an equal network.
    """
    label = np.array(labels, np.int64)
    if not label.any() or label.all():
        return None
    rng, clothes = np.random.default_rng(seed), wardrobe(findings, labels)
    shown = [*findings, *(clothes.dress(rng, y == 1) for y in (1, 0) for _ in range(dressed))]
    label = np.concatenate([label, np.repeat([1, 0], dressed)])
    net = Network(rng.normal(0, 0.1, (WIDTH, _VOCABULARY, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32), 0.0)
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    params = [net.filters, net.offset, net.weights, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    half, step = WIDTH // 2, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(shown))
        for begin in range(0, len(order), BATCH):
            some = order[begin : begin + BATCH]
            batch = [("", shown[i][1], "") if rng.random() < 0.3 else shown[i] for i in some.tolist()]  # surroundings may lack
            code, starts = _layout(batch)
            h = _answers(net, code, 0, len(code))
            pool = np.maximum.reduceat(h, starts, axis=0)
            x = _inputs(pool, np.array([len(v) for _, v, _ in batch]))
            p = 1 / (1 + np.exp(-np.clip(x @ net.weights + params[3][0], -30, 30)))
            error = ((p - label[some]) * weight[some] / len(some)).astype(np.float32)
            grads = [np.zeros_like(net.filters), np.zeros_like(net.offset), x.T @ error, error.sum(keepdims=True)]
            # Back to the highest answers: of the value, and of the higher of the two sides.
            inner, outer = error[:, None] * net.weights[None, :FILTERS], error[:, None] * net.weights[None, FILTERS : 2 * FILTERS]
            three = pool.reshape(-1, 3, FILTERS)
            left = three[:, 0] >= three[:, 2]
            back = np.stack([outer * left, inner, outer * ~left], 1).reshape(-1, FILTERS)
            part = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
            at, f = np.nonzero((h == pool[part]) & (h > 0))
            g = back[part[at], f]
            grads[1] += np.bincount(f, weights=g, minlength=FILTERS).astype(np.float32)
            padded = np.concatenate([np.full(half, _EDGE), code, np.full(half, _EDGE)])
            for j in range(WIDTH):
                flat = np.bincount(padded[at + j] * FILTERS + f, weights=g, minlength=_VOCABULARY * FILTERS)
                grads[0][j] += flat.reshape(_VOCABULARY, FILTERS).astype(np.float32)
            step += 1
            for param, grad, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.bias = float(params[3][0])
    return net


def bins(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((odds + ODDS) / (2 * ODDS) * BINS), 0, BINS - 1).astype(np.int64)


def threshold(secret: np.ndarray, recall: float) -> int:
    """The highest bin such that it and those above have that share of the secrets counted by bin."""
    above = np.cumsum(secret[::-1])[::-1]
    return int(np.flatnonzero(above >= recall * secret.sum()).max())


def isotonic(secret: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of secrets by bin, never falling: neighbours that would fall are pooled."""
    blocks: list[list[float]] = []
    for s, o in zip(secret.tolist(), other.tolist(), strict=True):
        blocks.append([s + 1e-6 * 0.5, s + o + 1e-6, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + n, blocks[-1][2] + k]
    return np.repeat([a / n for a, n, _ in blocks], [k for _, _, k in blocks])


def _size_class(lengths: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(LENGTHS), lengths, side="right")


_FOUND = "array<struct<kind:int,start:bigint,end:bigint,label:int,value:string,before:string,after:string>>"
_FOUND_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("value", pa.string()), ("before", pa.string()), ("after", pa.string())]))
_SCORED = "array<struct<start:bigint,kind:int,end:bigint,label:int,size:int,bin:int>>"
_SCORED_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("label", pa.int32()), ("size", pa.int32()), ("bin", pa.int32())]))


def _scored(c: dict) -> bool:
    """Candidates that the network judges: labelled ones, and all but the base kinds'."""
    return c["label"] >= 0 or c["kind"] >= len(BASE)


def _sample(found: DataFrame, sample: int) -> list:
    """About ``sample`` different findings of either label, drawn by their hash."""
    columns = ["label", "value", "before", "after"]
    labelled = found.select(F.inline("found")).filter((F.col("label") >= 0) & (F.char_length("value") <= LONGEST)).select(columns).distinct()
    n = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(*columns), F.lit(1_000_000))
    share = {y: min(1_000_000, -(-1_000_000 * sample // max(1, n.get(y, 0)))) for y in (0, 1)}
    return sorted(map(tuple, labelled.filter(place < F.when(F.col("label") == 1, share[1]).otherwise(share[0])).collect()))


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """The key of each row of ``docs`` and ``spans``: array of (start, kind, end, base, probability), by start, then kind.

    start and end count code points, the end exclusive; kind indexes KINDS. Base kinds have all
    their findings; of other candidates those that reach the threshold of their length, which keeps
    ``recall`` of the labelled secrets, as they are and in other dress. ``probability`` is the calibrated score, null for base
    kinds. A null or empty text has none; repeated rows have theirs each; long texts and long runs
    are seen whole. Without labelled findings of both labels nothing is added.

    The network is fitted on about ``sample`` findings of either label; counts for thresholds and
    calibration are over all labelled findings. Findings, not texts, are written, once.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(candidates(batch.column("text")), _FOUND_TYPE)], names=["key", "found"])

    plain_docs = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind_of_key = plain_docs.schema["key"].dataType.simpleString()
    found = materialize(plain_docs.mapInArrow(scan, f"key {kind_of_key}, found {_FOUND}"))
    rows = _sample(found, sample)
    findings, labels = [(b, v, a) for _, v, b, a in rows], [y for y, _, _, _ in rows]
    net, clothes = train(findings, labels, sample), wardrobe(findings, labels)

    def dressed(c: dict) -> list[dict]:
        """A labelled finding in other dress, always the same for equal findings."""
        rng = np.random.default_rng(zlib.crc32(f"{c['before']}|{c['value']}|{c['after']}".encode(errors="replace")))
        some = [clothes.dress(rng, c["label"] == 1) for _ in range(DRESSES if c["label"] == 1 else 1)]
        return [{"kind": -1, "start": 0, "end": 0, "label": c["label"], "value": v, "before": b, "after": a} for b, v, a in some]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found").to_pylist()
            if net:
                lists = [[*some, *(d for c in some if c["label"] >= 0 for d in dressed(c))] for some in lists]
            flat = [c for some in lists for c in some]
            asked = [c for c in flat if _scored(c)]
            said = iter(bins(score(net, [(c["before"], c["value"], c["after"]) for c in asked])).tolist() if net else [-1] * len(asked))
            sizes = iter(_size_class(np.array([len(c["value"]) for c in flat], np.int64)).tolist())
            told = [
                [{"start": c["start"], "kind": c["kind"], "end": c["end"], "label": c["label"], "size": next(sizes), "bin": next(said) if _scored(c) else -1} for c in some]
                for some in lists
            ]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(told, _SCORED_TYPE)], names=["key", "scored"])

    scored = materialize(found.mapInArrow(judge, f"key {kind_of_key}, scored {_SCORED}"))
    discard(found)
    # By label, whether in other dress, length and bin: at most 4 * 3 * BINS rows.
    counts = np.zeros((2, 2, len(LENGTHS) + 1, BINS))
    labelled = scored.select(F.inline("scored")).filter((F.col("label") >= 0) & (F.col("bin") >= 0))
    for r in labelled.groupBy("label", (F.col("kind") < 0).alias("dressed"), "size", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["label"], int(r["dressed"]), r["size"], r["bin"]] = r["n"]
    secret = counts[1]
    chance = isotonic(secret.sum((0, 1)), counts[0].sum((0, 1))) if net else np.zeros(BINS)

    def least_bin(own: np.ndarray) -> int:
        """The highest bin that keeps the recall of the findings as they are, and of those in other dress."""
        return min(threshold(x, recall) for x in own)

    of_all = least_bin(secret.sum(1)) if net else BINS
    least = [least_bin(secret[:, k]) if net and secret[:, k].sum(1).min() >= FEW else of_all for k in range(len(LENGTHS) + 1)]
    base = lambda c: c["kind"] < len(BASE)
    own = F.filter("scored", lambda c: c["kind"] >= 0)
    kept = F.filter(own, lambda c: base(c) | (c["bin"] >= F.get(F.array(*map(F.lit, least)), c["size"])))
    chances = F.lit([float(x) for x in chance])

    def told(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), base(c).alias("base"), F.when(~base(c), F.get(chances, c["bin"])).alias("probability"))

    return scored.select(F.col("key").alias(key), F.transform(kept, told).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets of every document."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
