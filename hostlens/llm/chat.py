"""Chat formatting by quotation linking, with DataFrame functions only.

A message is a row (conversation, turn, role, text). Its lines have a quote level: the number of ``>`` marks that
begin the line. A passage is a run of lines of one level without a blank line between; its wording is normalised
(case, white space) and hashed. A quoted passage links to the first message of the conversation, before the quoting
one, that has the same passage unquoted. The parent of a message is the latest message that its shallowest linked
quotes name. A conversation in reply order lists each message after its parent, siblings by turn: ordering by
(conversation, ``reply_path``), as ``conversations`` does, gives it, so no conversation has to fit in one task.

Null texts count as empty. Messages without linked quotes have no parent and stand at their own turn. Null
conversations or turns link with nothing. Of repeated (conversation, turn) rows all are kept; the first in order of
wording decides nothing, as links name turns. A passage that quotes only marks or blanks is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm._common import saved

MARKS = r"^(?:[ \t]*>)+"


def _lines(text: Column) -> Column:
    """Lines with their quote level and the rest of the line."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
    return F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))


def passages(text: Column) -> Column:
    """Array of (level, normalised wording), in order; passages without letters or digits are left out."""
    lines = _lines(text)
    # Each run's first line: the level changes, or this line or the one before is blank.
    blank = lambda x: F.trim(F.regexp_replace(x["body"], r"\s+", " ")) == ""
    begins = lambda a: F.filter(
        F.sequence(F.lit(0), F.size(a) - 1),
        lambda i: (i == 0) | (F.get(a, i)["level"] != F.get(a, F.greatest(i - 1, F.lit(0)))["level"]) | F.get(a, i)["blank"] | F.get(a, F.greatest(i - 1, F.lit(0)))["blank"],
    )
    marked = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), x["body"].alias("body"), blank(x).alias("blank")))
    pack = F.struct(marked.alias("a"))
    runs = F.transform(F.array(pack), lambda p: F.struct(p["a"].alias("a"), begins(p["a"]).alias("b")))[0]

    def one(p: Column) -> Column:
        span = lambda k: F.coalesce(F.get(p["b"], k + 1), F.size(p["a"])) - F.get(p["b"], k)
        body = lambda k: F.array_join(F.transform(F.slice(p["a"], F.get(p["b"], k) + 1, span(k)), lambda x: x["body"]), " ")
        return F.transform(p["b"], lambda b, k: F.struct(F.get(p["a"], b)["level"].alias("level"), F.lower(F.trim(F.regexp_replace(body(k), r"\s+", " "))).alias("body")))

    made = F.transform(F.array(runs), one)[0]
    return F.filter(made, lambda x: x["body"].rlike(r"[\p{L}\p{N}]"))


def without_quotes(text: Column) -> Column:
    """The text's own lines, without blank lines at its ends."""
    own = F.transform(F.filter(_lines(text), lambda x: x["level"] == 0), lambda x: x["body"])
    return F.regexp_replace(F.array_join(own, "\n"), r"\A\s+|\s+\z", "")


def quote_links(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row per quoted passage: conversation, turn, level, digest, original_turn (null: no original before it)."""
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.explode(passages(F.col(text_col))).alias("p"))
    rows = rows.select("conv", "turn", F.col("p.level").alias("level"), F.sha2("p.body", 256).alias("digest"))
    # One row per conversation and wording, so the join below has one match at most and no hot side.
    first = rows.where("level = 0").groupBy("conv", "digest").agg(F.min("turn").alias("first"))
    quoted = rows.where("level > 0").groupBy("conv", "turn", "level", "digest").agg(F.count("*").alias("times"))
    found = quoted.join(first, ["conv", "digest"], "left")
    return found.select("conv", "turn", "level", "digest", "times", F.when(F.col("first") < F.col("turn"), F.col("first")).alias("original_turn"))


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, parent_turn, depth, reply_path, n_quotes, n_linked, text (own).

    ``reply_path`` has the turns from the first message of the thread to this one as a text that sorts like the list:
    19 digits each, with dots between (a negative turn begins with a minus and counts up from the smallest number).
    """
    links = quote_links(messages, conv_col, turn_col, text_col)
    by_message = links.groupBy("conv", "turn").agg(
        F.sum("times").alias("n_quotes"), F.sum(F.when(F.col("original_turn").isNotNull(), F.col("times")).otherwise(0)).alias("n_linked"),
        F.max_by("original_turn", F.when(F.col("original_turn").isNotNull(), F.struct(-F.col("level"), F.col("original_turn")))).alias("parent_turn"),
    )
    by_message = saved(by_message, "links")
    paths = _paths(by_message.where("parent_turn is not null").select("conv", "turn", "parent_turn"))
    known = by_message.join(paths, ["conv", "turn"], "left")
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), without_quotes(F.col(text_col)).alias("text"))
    rows = rows.join(known, ["conv", "turn"], "left")
    path = F.coalesce(F.col("path"), F.array(F.col("turn")))
    return rows.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "parent_turn", (F.size(path) - 1).alias("depth"),
        F.array_join(F.transform(path, _sortable), ".").alias("reply_path"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("text").alias(text_col),
    )


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of ``format_chat``, conversation after conversation, each in the order of replies."""
    return format_chat(messages, conv_col, turn_col, role_col, text_col).orderBy(conv_col, "reply_path", role_col, text_col)


def _sortable(turn: Column) -> Column:
    digits = F.lpad(turn.cast("long").bitwiseAND(F.lit(2**63 - 1)).cast("string"), 19, "0")
    return F.when(turn < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def _paths(edges: DataFrame) -> DataFrame:
    """Turns from the top of the thread for each message with a parent. The known part of all paths doubles each round."""
    rows = edges.select("conv", "turn", F.array("turn").alias("path"), F.col("parent_turn").alias("top"))
    while not rows.where("top is not null").isEmpty():
        upper = rows.select("conv", F.col("turn").alias("top"), F.col("path").alias("upper"), F.col("top").alias("next"))
        joined = rows.join(upper, ["conv", "top"], "left")
        # A top that isn't in the table has no parent: it begins the path.
        path = F.when(F.col("top").isNull(), F.col("path")).when(F.col("upper").isNull(), F.concat(F.array("top"), F.col("path"))).otherwise(F.concat("upper", "path"))
        rows = saved(joined.select("conv", "turn", path.alias("path"), F.when(F.col("upper").isNotNull(), F.col("next")).alias("top")), "paths")
    return rows.select("conv", "turn", "path")
