"""Similarity of labels, for use inside tasks."""

from __future__ import annotations

import numpy as np

#: A text of up to so many characters is compared with many others at once.
WORD = 62


def sort_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit for each place of ``a`` that isn't matched yet."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & where.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence by both lengths; two empty texts are equal."""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(sort_tokens(a), sort_tokens(b))


class Labels:
    """Texts that others are compared with, all at once: their characters as rows of numbers."""

    def __init__(self, texts: list[str]):
        self.texts = [sort_tokens(t) for t in texts]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.order = np.argsort(self.lengths, kind="stable")
        wide = int(self.lengths.max(initial=0))
        self.characters = np.zeros((len(texts), wide), np.int32)
        for i, t in enumerate(self.texts):
            self.characters[i, : len(t)] = [ord(c) + 1 for c in t]

    def ratios(self, text: str, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Places of the labels whose ratio to ``text`` (its tokens sorted) is at least ``least``, and the ratios.

        Labels whose length alone keeps them below aren't compared: they stand in order of length.
        """
        mine = sort_tokens(text)
        n = len(mine)
        low, high = (n * least / (200 - least), n * (200 - least) / least) if least else (0, np.inf)
        some = self.order[np.searchsorted(self.lengths[self.order], low) : np.searchsorted(self.lengths[self.order], high, side="right")]
        some = some[self.lengths[some] + n > 0]
        if not len(some):
            return some, np.zeros(0)
        if n > WORD:
            found = np.array([common_subsequence(mine, self.texts[i]) for i in some.tolist()])
        else:
            found = self._common(mine, some)
        scores = 200.0 * found / (n + self.lengths[some])
        return some[scores >= least], scores[scores >= least]

    def _common(self, mine: str, some: np.ndarray) -> np.ndarray:
        """Longest common subsequences: a bit for each place of ``mine`` that isn't matched yet, for each label."""
        codes = np.unique(np.array([ord(c) + 1 for c in mine], np.int32))
        where = np.zeros(len(codes) + 1, np.uint64)  # the last one: a character that isn't there
        for i, c in enumerate(mine):
            where[np.searchsorted(codes, ord(c) + 1)] |= np.uint64(1 << i)
        full = np.uint64((1 << len(mine)) - 1)
        free = np.full(len(some), full, np.uint64)
        for p in range(int(self.lengths[some].max())):
            c = self.characters[some, p]
            at = np.minimum(np.searchsorted(codes, c), max(len(codes) - 1, 0))
            hit = free & where[np.where(codes[at] == c, at, len(codes)) if len(codes) else np.zeros(len(c), np.int64)]
            free = ((free + hit) | (free - hit)) & full
        return len(mine) - np.bitwise_count(free).astype(np.int64)
