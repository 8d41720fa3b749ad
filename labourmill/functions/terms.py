"""Skills in texts by large dictionaries: all terms in one pass over a text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the terms of one automaton, which a task builds (25 bytes each in the tests' numbers, 26 at random).
CHARACTERS = 4_000_000
#: Rows of one frame that a task gives back, about.
ROWS = 10_000


def _automata(terms: list[str]) -> Iterator[list[str]]:
    """The terms in parts of at most CHARACTERS (one term at least)."""
    part, size = [], 0
    for term in terms:
        if part and size + len(term) > CHARACTERS:
            yield part
            part, size = [], 0
        part.append(term)
        size += len(term)
    if part:
        yield part


def _found_by(rows: DataFrame, key: str, part: list[str], into: str) -> DataFrame:
    """key, ``into``: the part's terms in the column __low of ``rows``. The automaton keeps lengths only: the text has the words."""
    sent = rows.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for term in sent.value:
            known.add_word(term)
        known.make_automaton()
        for batch in batches:
            at, words = [], []
            for place, text in enumerate(batch["__low"]):
                some = {text[end - n + 1 : end + 1] for end, n in known.iter(text)}
                at += [place] * len(some)
                words += some
                if len(words) >= ROWS:
                    yield pd.DataFrame({key: batch[key].iloc[at].array, into: words})
                    at, words = [], []
            yield pd.DataFrame({key: batch[key].iloc[at].array, into: pd.Series(words, dtype=object)})

    return rows.mapInPandas(run, T.StructType([rows.schema[key], T.StructField(into, T.StringType())]))


def extract_terms(rows: DataFrame, key: str, text: str, terms: list[str], into: str = "skill") -> DataFrame:
    """key, ``into``: a row for each of the (different) terms that the lower-case text has anywhere in it.

    The same as ``scalars.extract_skills``, but the time goes by the text and by what is found, not
    by the number of terms. Terms of more than CHARACTERS in all are looked for in as many passes
    as they need, each in tasks of its own, so a task has one automaton however many there are; a
    null text is empty, and an empty term is in every text.
    """
    listed = list(dict.fromkeys(terms))
    named = rows.select(F.col(key), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__low"))
    found = [_found_by(named, key, part, into) for part in _automata([t for t in listed if t])]
    if "" in listed or not found:
        found.append(rows.select(key, F.lit("").alias(into)) if "" in listed else rows.select(key, F.lit("").alias(into)).limit(0))
    return reduce(DataFrame.unionByName, found)
