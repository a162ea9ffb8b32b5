"""Chat logs: collapse of cumulative snapshots, then rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered: role and text take the places.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def rolled(turns: str) -> Column:
    """The hash of every turn prefix of an array of (turn, role, text): each is the hash of the one before and its turn."""
    def step(state, t):
        one = F.concat_ws("\x1f", F.coalesce(F.try_element_at(state, F.lit(-1)), F.lit("")), F.length(t["role"]).cast("string"), t["role"], t["text"])
        return F.concat(state, F.array(F.sha2(one.cast("binary"), 256)))

    return F.aggregate(turns, F.array().cast("array<string>"), step)


def maximal_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                          text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, rendered: the conversations that are neither a proper prefix nor a later copy of another one.

    Turns are ordered by number; role and text (null counts as empty) make up their content. A logged conversation
    whose turns are the first turns of a longer one is a snapshot of it and goes; of equal conversations the
    smallest id stays. Rolling hashes name all turn prefixes; prefixes of the longer ones are anti-joined on (length, hash).

    Rows without a conversation id or turn number are left out. Repeated rows count once; several rows of one turn
    number are ordered by role and text. Other columns play no part. A conversation is one row of the result, so
    its turns are brought together; conversations themselves are never gathered.
    """
    own = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                       F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.where("conv_id is not null and turn is not null").distinct()
    talks = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    hashed = talks.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "turns", rolled("turns").alias("hashes"))
    hashed = hashed.withColumn("whole", F.element_at("hashes", -1))
    first = hashed.groupBy("whole").agg(F.min("conv_id").alias("conv_id"))
    prefixes = hashed.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("whole")).distinct()
    stay = first.join(prefixes, "whole", "left_anti").select("conv_id")
    one = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))
    return (hashed.join(stay, "conv_id", "left_semi")
            .select("conv_id", "n_turns", F.array_join(F.transform("turns", one), "").alias("rendered")))


SQL = f"""
with t as (select distinct conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null and turn is not null),
p as (select conv_id, row_number() over w k, count(*) over (partition by conv_id) n,
             string_agg(length(r) || chr(31) || r || chr(31) || x, chr(30)) over (w rows between unbounded preceding and current row) h
      from t window w as (partition by conv_id order by turn, r, x)),
whole as (select min(conv_id) conv_id, h from p where k = n group by h),
stay as (select conv_id from whole where h not in (select h from p where k < n))
select conv_id, count(*) n_turns, string_agg('{OPEN}' || r || chr(10) || x || '{CLOSE.strip()}' || chr(10), '' order by turn, r, x) rendered
from t where conv_id in (select conv_id from stay) group by conv_id
"""
