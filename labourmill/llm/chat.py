"""Preference data from conversations: one prompt, two completions.

Two conversations that begin alike are a chosen and a rejected one; one that no other begins like
is held against itself with another's last answer. The longest common prefix of turns is the
prompt, rendered once; what follows in each is its completion, with the ranges of characters that
a model should learn from: what the assistant says and the mark that ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labourmill.llm.shared import bind, hash60, key_text, materialize

BEGIN, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
#: Ranks are counted within ranges of so many ids, and over the ranges' counts.
RANGE = 256
#: About so many conversations lend each other their answers.
LENDERS = 1024


def assemble(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of (turn, role, text), in order) from a row a turn.

    Repeated turn numbers stand in order of role and text; null roles and texts are empty. Rows
    without a conv_id make one conversation.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))


def pair_by_opening(conversations: DataFrame) -> DataFrame:
    """chosen_id, chosen, rejected_id, rejected: conversations with one first turn, two by two.

    In ascending order of conv_id the first of each two is the chosen one. An odd one at the end
    has no rejected one (null). Ranks come from counts of ranges of ids and places within a
    range, so an opening that very many conversations have is spread over its ranges.
    """
    first = F.col("turns")[0]
    keyed = conversations.select(
        "conv_id", "turns", F.sha2(F.concat_ws("\x00", first["role"], first["text"]), 256).alias("opening"), F.coalesce(F.floor(F.col("conv_id") / RANGE), F.lit(-(1 << 62))).alias("range")
    )
    counts = keyed.groupBy("opening", "range").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("opening", "range", (F.sum("n").over(W.partitionBy("opening").orderBy("range")) - F.col("n")).alias("base"))
    place = F.row_number().over(W.partitionBy("opening", "range").orderBy(F.col("conv_id").asc_nulls_first()))
    ranked = keyed.withColumn("place", place).join(bases, ["opening", "range"]).withColumn("rank", F.col("base") + F.col("place") - 1)
    two = ranked.groupBy("opening", F.floor(F.col("rank") / 2).alias("pair")).agg(F.sort_array(F.collect_list(F.struct("rank", "conv_id", "turns"))).alias("both"))
    a, b = F.get("both", F.lit(0)), F.get("both", F.lit(1))
    return two.select(a["conv_id"].alias("chosen_id"), a["turns"].alias("chosen"), b["conv_id"].alias("rejected_id"), b["turns"].alias("rejected"))


def pair_by_answer(turns: DataFrame, lenders: int = LENDERS) -> DataFrame:
    """chosen_id, chosen, rejected_id, rejected: every conversation, and the same with a worse answer.

    The rejected side has the turns before the last assistant turn, and that turn with the text
    of another conversation's last assistant turn: of the next one by conv_id (after the last the
    first; a null conv_id comes first) in a group drawn by hash whose text differs. A conversation
    without assistant turns, or in whose group all answers are equal, has no rejected side (null).
    """
    count = turns.filter(F.col("role") == LEARNED_ROLE).agg(F.count_distinct("conv_id")).first()[0]
    # Turns are dealt by group, so neither the groups of turns nor the windows shuffle them again.
    group = hash60(F.concat(F.lit("lend:"), key_text(F.col("conv_id")))) % (count // lenders + 1)
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.withColumn("lend", group).repartition("lend").groupBy("lend", "conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    k = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"] == LEARNED_ROLE), True) + 1
    # k: number of the last assistant turn; where there is none, one more than there are turns.
    placed = whole.withColumn("k", k.cast("int")).withColumn("answer", F.get("turns", F.col("k") - 1)["text"])
    lends = F.col("answer").isNotNull()
    own = F.struct(F.col("conv_id").alias("id"), F.col("answer").alias("text"))
    down = W.partitionBy("lend", lends).orderBy(F.col("conv_id").desc_nulls_last())
    # The next different answer is the next that differs from the one just before it.
    other = placed.withColumn("new", F.when(F.lead("answer").over(down) != F.col("answer"), own))
    after = down.rowsBetween(W.unboundedPreceding, -1)
    every = down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = other.select(
        "conv_id", "turns", "k", "answer", F.last("new", ignorenulls=True).over(after).alias("next"), F.last(own).over(every).alias("first"), F.last("new", ignorenulls=True).over(every).alias("second")
    )
    lent = F.when(F.col("answer").isNotNull(), F.coalesce("next", F.when(F.col("first.text") != F.col("answer"), F.col("first")).otherwise(F.col("second"))))
    last = F.get("turns", F.col("k") - 1)
    swapped = F.concat(F.slice("turns", F.lit(1), F.col("k") - 1), F.array(F.struct(last["turn"].alias("turn"), last["role"].alias("role"), F.col("lent.text").alias("text"))))
    return found.withColumn("lent", lent).select(
        F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"), F.col("lent.id").alias("rejected_id"), F.when(F.col("lent").isNotNull(), swapped).alias("rejected")
    )


def _rendered(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n")))


def _learned(turns: Column) -> Column:
    """Ranges of characters of the rendered turns that count, as start:end."""
    step = lambda a, t: F.struct(
        (a["at"] + F.char_length(t["role"]) + F.char_length(t["text"]) + len(BEGIN + "\n" + END + "\n")).alias("at"),
        F.when(
            t["role"] == LEARNED_ROLE,
            bind(
                a["at"] + F.char_length(t["role"]) + len(BEGIN + "\n"),
                lambda begin: F.array_append(a["ranges"], F.concat_ws(":", begin.cast("string"), (begin + F.char_length(t["text"]) + len(END)).cast("string"))),
            ),
        )
        .otherwise(a["ranges"])
        .alias("ranges"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("ranges"))
    return F.aggregate(turns, start, step, lambda a: F.array_join(a["ranges"], ","))


def preference_rows(pairs: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask.

    Turns are common while role and text agree; their numbers don't matter. Where one
    conversation begins with all of the other, the shorter one's completion is empty. Without a
    rejected conversation nothing is common, and its columns are null.
    """
    same = F.zip_with("chosen", "rejected", lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    differ = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    common = F.when(F.col("rejected").isNull(), F.lit(0)).when(differ == 0, F.size("chosen")).otherwise(differ - 1).cast("int")
    cut = pairs.withColumn("k", common)
    rest = lambda c: F.slice(c, F.col("k") + 1, F.greatest(F.size(c) - F.col("k"), F.lit(0)))
    return cut.select(
        "chosen_id", "rejected_id", F.col("k").cast("long").alias("prompt_turns"), F.array_join(_rendered(F.slice("chosen", F.lit(1), F.col("k"))), "").alias("prompt"),
        F.array_join(_rendered(rest("chosen")), "").alias("chosen"), _learned(rest("chosen")).alias("chosen_mask"),
        F.array_join(_rendered(rest("rejected")), "").alias("rejected"), _learned(rest("rejected")).alias("rejected_mask"),
    )


def paired(turns: DataFrame) -> DataFrame:
    """chosen_id, chosen, rejected_id, rejected: conversations that begin alike two by two, the
    others with an answer that another one lends (null where none can)."""
    alike = materialize(pair_by_opening(assemble(turns)))
    odd = alike.filter("rejected IS NULL").select(F.col("chosen_id").alias("__id"))
    lent = pair_by_answer(turns)
    return alike.filter("rejected IS NOT NULL").unionByName(lent.join(odd, F.col("chosen_id").eqNullSafe(F.col("__id")), "left_semi"))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference rows of all conversations."""
    return preference_rows(paired(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def lent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference rows of all conversations, each against itself with another's answer."""
    return preference_rows(pair_by_answer(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OPENING_ORACLE = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
),
ranked AS (
  SELECT conv_id, opening, row_number() OVER (PARTITION BY opening ORDER BY conv_id) - 1 AS rank
  FROM (SELECT conv_id, role || chr(0) || text AS opening FROM turns WHERE i = 1)
),
pairs AS (
  SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id
  FROM ranked a LEFT JOIN ranked b ON a.opening = b.opening AND b.rank = a.rank + 1 WHERE a.rank % 2 = 0
),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
common AS (
  SELECT chosen_id, rejected_id, CASE WHEN rejected_id IS NULL THEN 0 ELSE least(x.n, y.n, coalesce(
    (SELECT min(c.i) - 1 FROM turns c JOIN turns r ON c.i = r.i WHERE c.conv_id = chosen_id AND r.conv_id = rejected_id AND (c.role <> r.role OR c.text <> r.text)), x.n)) END AS k
  FROM pairs JOIN sizes x ON x.conv_id = chosen_id LEFT JOIN sizes y ON y.conv_id = rejected_id
),
shown AS (SELECT *, '{BEGIN}' || role || chr(10) || text || '{END}' || chr(10) AS r FROM turns),
done AS (
  SELECT conv_id, k, string_agg(r, '' ORDER BY i) FILTER (i <= k) AS prompt, coalesce(string_agg(r, '' ORDER BY i) FILTER (i > k), '') AS completion,
    coalesce(string_agg((pos + length(role) + {len(BEGIN) + 1}) || ':' || (pos + length(role) + {len(BEGIN) + 1} + length(text) + {len(END)}), ',' ORDER BY i) FILTER (i > k AND role = '{LEARNED_ROLE}'), '') AS mask
  FROM (
    SELECT s.*, c.k, coalesce(sum(length(r)) FILTER (i > k) OVER (PARTITION BY s.conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
    FROM shown s JOIN (SELECT chosen_id AS conv_id, k FROM common UNION ALL SELECT rejected_id, k FROM common WHERE rejected_id IS NOT NULL) c USING (conv_id)
  ) GROUP BY conv_id, k
)
SELECT chosen_id, rejected_id, c.k::BIGINT AS prompt_turns, coalesce(x.prompt, '') AS prompt, x.completion AS chosen, x.mask AS chosen_mask, y.completion AS rejected, y.mask AS rejected_mask
FROM common c JOIN done x ON x.conv_id = chosen_id LEFT JOIN done y ON y.conv_id = rejected_id
"""

LENT_ORACLE = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
),
lasts AS (SELECT conv_id, max(i) FILTER (role = '{LEARNED_ROLE}') AS k FROM turns GROUP BY conv_id),
answers AS (
  SELECT t.conv_id, k, text, ('0x' || substr(md5('lend:=' || t.conv_id), 1, 15))::BIGINT % ((SELECT count(k) FROM lasts) // {LENDERS} + 1) AS lend
  FROM turns t JOIN lasts l ON l.conv_id = t.conv_id AND l.k = t.i
),
lent AS (
  SELECT a.conv_id, a.k, arg_min({{'id': b.conv_id, 'text': b.text}}, (b.conv_id < a.conv_id, b.conv_id)) AS other
  FROM answers a JOIN answers b ON a.lend = b.lend AND a.text <> b.text GROUP BY ALL
),
sides AS (
  SELECT t.conv_id, 'chosen' AS side, i, role, text, i < k AS shared FROM turns t LEFT JOIN lent USING (conv_id)
  UNION ALL
  SELECT t.conv_id, 'rejected', i, role, CASE WHEN i = k THEN other.text ELSE text END, i < k FROM turns t JOIN lent USING (conv_id) WHERE i <= k
),
shown AS (SELECT *, coalesce(shared, false) AS prompt, '{BEGIN}' || role || chr(10) || text || '{END}' || chr(10) AS r FROM sides),
placed AS (SELECT *, (coalesce(sum(length(r)) FILTER (NOT prompt) OVER (PARTITION BY conv_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + {len(BEGIN) + 1})::BIGINT AS begin_ FROM shown),
done AS (
  SELECT conv_id, side, count(*) FILTER (prompt) AS k, coalesce(string_agg(r, '' ORDER BY i) FILTER (prompt), '') AS prompt, coalesce(string_agg(r, '' ORDER BY i) FILTER (NOT prompt), '') AS completion,
    coalesce(string_agg(begin_ || ':' || (begin_ + length(text) + {len(END)}), ',' ORDER BY i) FILTER (NOT prompt AND role = '{LEARNED_ROLE}'), '') AS mask
  FROM placed GROUP BY ALL
)
SELECT c.conv_id AS chosen_id, other.id AS rejected_id, c.k::BIGINT AS prompt_turns, c.prompt, c.completion AS chosen, c.mask AS chosen_mask, r.completion AS rejected, r.mask AS rejected_mask
FROM done c LEFT JOIN done r ON r.conv_id = c.conv_id AND r.side = 'rejected' LEFT JOIN lent l ON l.conv_id = c.conv_id WHERE c.side = 'chosen'
"""

ORACLE = f"""
WITH alike AS ({OPENING_ORACLE}), lent AS ({LENT_ORACLE})
SELECT * FROM alike WHERE rejected IS NOT NULL
UNION ALL SELECT lent.* FROM lent JOIN alike ON lent.chosen_id IS NOT DISTINCT FROM alike.chosen_id WHERE alike.rejected IS NULL
"""
