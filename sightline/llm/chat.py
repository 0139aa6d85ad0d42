"""Chat formatting by quotation linking.

DataFrame functions only. A message's lines carry quote marks (``>``, nested as ``> >``); lines of one level in a row are a
passage. Quoted passages and their lines, lower-cased and with white space evened out, are hashed and joined to the
earliest message of the conversation whose own text holds the same passage or line. Where that finds nothing, as with a part of a
line, windows of WINDOW words of the quote are hashed and joined to those of earlier texts: the message that holds COVERED of a
quote's windows is its origin. A message replies to the message that its
level-1 quotes lead to (the latest such; deeper quotes count where level 1 leads nowhere); following replies to their
root gives threads. Messages are ordered by thread, and within it by turn: a reply always comes after what it replies to.

Defined results
* null and empty texts: an empty message; a message of quotes only has an empty text;
* quotes that lead to no earlier message link nothing; a message without any link keeps its quotes' text in `unlinked` (null elsewhere); lines that say who wrote a quote go with it;
* null conversation ids or turns: the message is kept, without links, as its own thread;
* several rows of one conversation and turn are one message for links and are all kept; equal rows too;
* an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stash

#: Quote marks in front of a line.
MARKS = r"^(?:[\x20\t]{0,3}>)+"
#: The line before a quote that names its author.
SAID = r"(?:^|\n)[^\n]*\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s?:\s*$"


#: Words of a window, and the share of a quote's windows that its origin holds.
WINDOW, COVERED = 4, 0.8


def evened(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def passages(text: Column) -> Column:
    """Array of (level, body): lines of one quote level in a row; level 0 is the message's own text."""
    line = lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS + r"\x20?", "").alias("body"))
    starts = lambda ls: F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | (F.get(ls, i)["level"] != F.get(ls, i - 1)["level"]))

    def cut(ls: Column, at: Column) -> Column:
        part = lambda s, k: F.slice(ls, s + 1, F.coalesce(F.get(at, k + 1), F.size(ls)) - s)
        made = lambda p, k: F.struct(F.get(p, F.lit(0))["level"].alias("level"), F.array_join(F.transform(p, lambda x: x["body"]), "\n").alias("body"))
        whole = F.transform(at, lambda s, k: let(part(s, k), lambda p: made(p, k)))
        unsaid = lambda w: F.transform(w, lambda p, k: F.struct(p["level"].alias("level"), F.when((p["level"] == 0) & (k + 1 < F.size(w)), F.regexp_replace(p["body"], SAID, "")).otherwise(p["body"]).alias("body")))
        return let(whole, unsaid)

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), line)
    return let(lines, lambda ls: let(starts(ls), lambda at: cut(ls, at)))


def _keys(bodies: Column) -> Column:
    """Hashes of evened passages and of their evened lines, without blank ones, as (key, whole)."""
    whole = F.transform(bodies, lambda b: F.struct(evened(b).alias("t"), F.lit(True).alias("whole")))
    lines = F.transform(F.flatten(F.transform(bodies, lambda b: F.split(b, "\n", -1))), lambda b: F.struct(evened(b).alias("t"), F.lit(False).alias("whole")))
    return F.transform(F.filter(F.concat(whole, lines), lambda x: x["t"] != ""), lambda x: F.struct(F.xxhash64(x["t"]).alias("key"), x["whole"].alias("whole")))


def parsed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    parts = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), passages(F.col(text_col)).alias("parts"))
    own = F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["body"])
    return parts.select("conv", "turn", "role", F.trim(F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")).alias("text"), own.alias("own"), F.filter("parts", lambda p: p["level"] > 0).alias("quotes"))


def threads(replies: DataFrame) -> DataFrame:
    """root and depth of each message that replies, from (conv, turn, reply_to), by doubling the steps towards the root."""
    now = stash(replies.select("conv", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth")), "threads")
    while True:
        further = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        step = now.join(further, (F.col("conv") == F.col("c")) & (F.col("root") == F.col("t")), "left")
        now = stash(step.select("conv", "turn", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("t").isNotNull().alias("moved")), "threads")
        if now.filter("moved").isEmpty():
            return now.drop("moved")


def _windows(body: Column) -> Column:
    """Hashes of all windows of WINDOW words; none of shorter texts."""
    hashed = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, WINDOW), " "))))
    return let(F.split(evened(body), " "), lambda w: F.when(F.size(w) >= WINDOW, hashed(w)).otherwise(F.array().cast("array<bigint>")))


def by_windows(found: DataFrame, left: DataFrame) -> DataFrame:
    """conv, turn and reply_to of those rows of left (conv, turn, quotes) whose quotes are parts of earlier texts of found (conv, turn, text)."""
    each = left.select("conv", "turn", F.posexplode("quotes").alias("q", "x")).select("conv", "turn", "q", F.col("x.level").alias("level"), _windows(F.col("x.body")).alias("w"))
    asked = each.select("conv", "turn", "q", "level", F.size("w").alias("n"), F.explode("w").alias("key"))
    texts = found.join(left.select("conv").distinct(), "conv", "left_semi")
    origins = texts.select("conv", "turn", F.explode(_windows(F.col("text"))).alias("key")).groupBy("conv", "key").agg(F.min("turn").alias("origin"))
    met = asked.join(origins, ["conv", "key"]).filter("origin < turn").groupBy("conv", "turn", "q", "level", "n", "origin").agg(F.count("*").alias("hits"))
    return met.filter(F.col("hits") >= COVERED * F.col("n")).groupBy("conv", "turn").agg(F.coalesce(F.max(F.when(F.col("level") == 1, F.col("origin"))), F.max("origin")).alias("reply_to"))


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: its text without quotes, n_quotes, quote_depth, reply_to, root_turn, reply_depth, rendered (role and text) and unlinked;
    rows are sorted by conversation, thread and turn over the whole result.
    """
    found = stash(parsed(messages, conv_col, turn_col, role_col, text_col), "parsed")
    quoting = found.filter(F.size("quotes") > 0)
    levelled = F.flatten(F.transform("quotes", lambda q: F.transform(_keys(F.array(q["body"])), lambda k: F.struct(q["level"].alias("level"), k["key"].alias("key"), k["whole"].alias("whole")))))
    asked = quoting.select("conv", "turn", F.explode(levelled).alias("q")).select("conv", "turn", "q.*")
    # a text's own passages and, where quotes part them, the text as a whole
    held = F.array_distinct(F.transform(F.concat(_keys(F.col("own")), _keys(F.array("text"))), lambda k: k["key"]))
    origins = found.join(quoting.select("conv").distinct(), "conv", "left_semi").select("conv", "turn", F.explode(held).alias("key")).groupBy("conv", "key").agg(F.min("turn").alias("origin"))
    met = asked.join(origins, ["conv", "key"]).filter("origin < turn")
    near, whole = F.col("level") == 1, F.col("whole")
    best = lambda cond: F.max(F.when(cond, F.col("origin")))
    linked = stash(met.groupBy("conv", "turn").agg(F.coalesce(best(near & whole), best(near), best(whole), F.max("origin")).alias("reply_to")), "linked")
    left = quoting.select("conv", "turn", "quotes").join(linked, ["conv", "turn"], "left_anti")
    replies = stash(linked.unionByName(by_windows(found, left)), "replies")
    bodies = F.when(F.size("quotes") > 0, F.array_join(F.transform("quotes", lambda q: q["body"]), "\n")).alias("bodies")
    out = found.select("conv", "turn", "role", "text", bodies, F.size("quotes").alias("n_quotes"), F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).alias("quote_depth"))
    known = replies.join(threads(replies), ["conv", "turn"])
    out = out.join(known, ["conv", "turn"], "left").select("conv", "turn", "role", "text", "n_quotes", "quote_depth", "reply_to", F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("reply_depth"), F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("text")).alias("rendered"), F.when(F.col("reply_to").isNull(), F.col("bodies")).alias("unlinked"))
    ordered = out.repartitionByRange("conv", "root_turn", "turn", "text").sortWithinPartitions("conv", "root_turn", "turn", "text")
    return ordered.withColumnsRenamed({"conv": conv_col, "turn": turn_col, "role": role_col})


def op7_chat_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
