"""Chat formatting by a grammar round trip, in DataFrame functions only.

Grammar of the output::

    conversation := turn*
    turn         := "### " role ": " body "</turn>" "\\n"
    escape       := "\\" followed by one of \\ # < :

A body holds neither ``### `` nor ``</turn>`` outside escapes. A turn is first rendered as it
is. The deterministic parser reads the rendering back; if it does not recover the very role and
text, the next rendering of the ladder is taken: backslashes and control strings escaped, then
every special character escaped (the parser inverts that for any text). The whole conversation
is parsed once more; one that is not recovered is rendered with the last rung throughout.

Defined results: null role or text is the empty string; rows with equal turn numbers are ordered
by role, then text; repeated rows are turns of their own; a null conversation id is one
conversation; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", ": ", "</turn>"
_SPECIAL = r"([\\#<:])"


def _protect(s: Column) -> Column:
    """Escapes become %E.% and literal percent signs %P, so that no control string is left inside an escape."""
    return F.regexp_replace(F.replace(s, F.lit("%"), F.lit("%P")), r"\\" + _SPECIAL, "%E$1%")


def _plain(s: Column) -> Column:
    return F.replace(F.regexp_replace(s, "%E" + _SPECIAL + "%", "$1"), F.lit("%P"), F.lit("%"))


def _escaped_length(s: Column) -> Column:
    """Characters of a protected piece as it stands in the output."""
    return F.length(F.replace(F.regexp_replace(s, "%E" + _SPECIAL + "%", "##"), F.lit("%P"), F.lit("%")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text, head_chars, body_chars); role is null where the grammar is broken."""
    pieces = F.split(_protect(formatted), END + "\n", -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(p: Column) -> Column:
        at = F.instr(p, SEP)
        role, body = F.substring(p, F.lit(len(HEAD) + 1), at - 1 - len(HEAD)), F.substring(p, at + len(SEP), F.length(p))
        good = p.startswith(HEAD) & (at > len(HEAD)) & ~F.contains(body, F.lit(HEAD)) & ~F.contains(body, F.lit(END))
        return F.struct(
            F.when(good, _plain(role)).alias("role"),
            _plain(body).alias("text"),
            (_escaped_length(role) + len(HEAD) + len(SEP)).alias("head_chars"),
            _escaped_length(body).alias("body_chars"),
        )

    return F.transform(pieces, one)


def _render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), F.regexp_replace(role, _SPECIAL, r"\\$1"), F.lit(SEP), body, F.lit(END + "\n"))


def _ladder(text: Column) -> list[Column]:
    return [text, F.regexp_replace(text, r"(\\|### |</turn>)", r"\\$1"), F.regexp_replace(text, _SPECIAL, r"\\$1")]


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (as the parser reads ``formatted``; see :func:`parse`).

    The loss mask covers the bodies of assistant turns: with head_chars and body_chars the turns
    give its runs in ``formatted`` (a turn is head, body, then the end mark and a newline).
    Rendering is done row by row, before the turns of a conversation meet.
    """
    r = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    source = F.array(F.struct(F.col("role"), F.col("text")))
    choices = [_render(F.col("role"), b) for b in _ladder(F.col("text"))]
    same = lambda c: F.transform(parse(c), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == source
    piece = F.when(same(choices[0]), choices[0]).when(same(choices[1]), choices[1]).otherwise(choices[2])
    r = r.withColumn("piece", piece).withColumn("safe", choices[2])
    g = r.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece", "safe"))).alias("t"))
    g = g.select(
        "conv_id",
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("first"),
        F.array_join(F.transform("t", lambda x: x["safe"]), "").alias("safe"),
    ).withColumn("read", parse(F.col("first")))
    good = F.transform("read", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.col("source")
    return g.select(
        "conv_id", F.when(good, F.col("first")).otherwise(F.col("safe")).alias("formatted"),
        F.when(good, F.col("read")).otherwise(parse(F.col("safe"))).alias("turns"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the output."""
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the query adds to those of the table.
PLANTED = (-7, [(0, "user"), (1, "assistant")], "\\### Assistant: </turn> ok")


def op7(spark, sf_dir: str) -> DataFrame:
    from .runtime import read

    conv, turns, said = PLANTED
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select explode(array(" + ",".join(f"struct({conv}L as conv_id, {i}L as turn, '{r}' as role)" for i, r in turns) + ")) as t").select("t.*", F.lit(said).alias("text"))
    return digest(format_conversations(t.unionByName(extra)))


ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role,'') as role, coalesce(text,'') as text from conversations
  union all select -7, i, r, '\### Assistant: </turn> ok' from (values (0,'user'),(1,'assistant')) v(i, r)
), p as (
  select *, length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + 4 + 2 + 8 +
    case when regexp_matches(text || '</turn>', '\\[\\#<:]') or contains(text, '### ') or contains(text, '</turn>')
         then length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) else length(text) end as chars
  from t
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from p group by conv_id
"""
