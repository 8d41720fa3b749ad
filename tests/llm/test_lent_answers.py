"""Preference rows from lent answers: real pairs on the tables, and odd cases by hand."""

import duckdb
import pytest

from labourmill.llm import chat, queries

SF = "/root/testdata/sf0.01"


def plain(row):
    return tuple(repr(x) for x in row)


def test_every_answer_has_a_pair(spark, monkeypatch):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    answered = con.sql("SELECT count(DISTINCT conv_id) FROM conversations WHERE role = 'assistant'").fetchall()[0][0]
    got = queries.QUERIES["lent_answers"](spark, SF).collect()
    pairs = [r for r in got if r.rejected_id is not None]
    assert len(pairs) == answered > 0
    assert all(r.chosen != r.rejected and r.rejected_mask for r in pairs)
    assert sum(bool(r.prompt) == (r.prompt_turns > 0) for r in pairs) == len(pairs) and any(r.prompt for r in pairs)
    want = con.sql(queries.ORACLES["lent_answers"])
    assert want.columns == got[0].__fields__
    assert sorted(map(plain, got)) == sorted(map(plain, want.fetchall()))


@pytest.mark.parametrize("name", ["op9_preferences"])
def test_registered_query_has_pairs(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = queries.QUERIES[name](spark, SF).collect()
    answered = con.sql("SELECT count(DISTINCT conv_id) FROM conversations WHERE role = 'assistant'").fetchall()[0][0]
    assert sum(r.rejected is not None for r in got) == answered and sum(bool(r.prompt) for r in got) > answered / 2
    want = con.sql(queries.ORACLES[name])
    assert sorted(map(plain, got)) == sorted(map(plain, want.fetchall())) and want.columns == got[0].__fields__


def test_pairs_of_both_kinds(spark):
    turn = lambda k, *said: [(k, i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(said)]
    turns = turn(1, "hi", "yes") + turn(2, "hi", "no") + turn(3, "hi", "maybe") + turn(4, "what", "that", "more") + turn(5, "alone") + turn(None, "nobody", "this")
    df = spark.createDataFrame(turns + turns[:1], "conv_id long, turn long, role string, text string")
    got = {r.chosen_id: r for r in chat.preference_rows(chat.paired(df.filter("true").dropDuplicates())).collect()}
    assert set(got) == {1, 3, 4, 5, None}
    assert (got[1].rejected_id, got[1].prompt_turns) == (2, 1) and got[5].rejected is None
    for k, own in ((3, "maybe"), (4, "that"), (None, "this")):
        assert own in got[k].chosen and own not in got[k].rejected and got[k].prompt_turns == 1 and got[k].rejected_mask
    assert chat.preference_rows(chat.paired(df.limit(0))).count() == 0


@pytest.mark.parametrize("lenders", [1000, 2])
def test_lent_answers_by_hand(spark, lenders):
    turns = [
        (None, 0, "user", "q"), (None, 1, "assistant", "a"), (1, 0, "user", "q1"), (1, 1, "assistant", "a"), (1, 2, "user", "thanks"), (2, 0, "system", "s"), (2, 1, "user", "q2"),
        (3, 0, "assistant", "old"), (3, 1, "user", None), (3, 2, "assistant", "b é"), (70_000, 0, "assistant", "a"), (70_001, 0, None, None),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.chosen_id: r for r in chat.preference_rows(chat.pair_by_answer(df, lenders)).collect()}
    assert set(got) == {None, 1, 2, 3, 70_000, 70_001}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    for k in (2, 70_001):
        assert (got[k].rejected_id, got[k].prompt_turns, got[k].rejected) == (None, 0, None)
    if lenders == 1000:
        assert {k: got[k].rejected_id for k in (None, 1, 70_000)} == {None: 3, 1: 3, 70_000: 3}
        assert (got[3].rejected_id, got[3].rejected, got[3].prompt_turns) == (70_000, turn("assistant", "a"), 2)
        assert (got[1].prompt, got[1].chosen, got[1].rejected) == (turn("user", "q1"), turn("assistant", "a") + turn("user", "thanks"), turn("assistant", "b é"))
        assert (got[70_000].prompt, got[70_000].rejected) == ("", turn("assistant", "b é"))
    first = chat.preference_rows(chat.pair_by_answer(df.filter("NOT conv_id <=> 70000"), 1000)).filter("chosen_id = 3").first()
    assert (first.rejected_id, first.rejected) == (None, turn("assistant", "a"))  # of the conversation without id
    assert chat.preference_rows(chat.pair_by_answer(df.limit(0))).count() == 0
