"""Quotation linking: conversations in reply order, without the quotes.

Every line is parsed for its quote level (the number of leading `>` marks). Lines and passages (runs of lines of one
level) are normalised and hashed. The original of a quoted passage is the earliest message of the conversation that says
it in its own words. A message replies to the original of its outermost quotes: least level first, then most
quoted characters, then the later message. Threads come from following replies to their start by pointer doubling.

Only hashes are joined, originals are one row per (conversation, hash) found with partial aggregation, and positions are
numbered by one range sort, so a conversation that holds a third of all messages is split like any other. All steps
are DataFrame functions.

Defined cases: a null text stays null and quotes nothing. A message without a known original starts a thread. A null
conversation id is one conversation of messages that are never linked. Messages with the same conversation and turn
share their reply target; all rows stay. Lines that only announce a quote are removed with it. Input columns stay; a
column that has the name of a result is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.llm.common import saved
from plantpulse.operators.ordered import with_row_index

_MARKS = r"^((?:[ \t]*>)+)[ \t]?"
# How mail programs announce a quote.
_ANNOUNCE = r"(?i)(wrote|a écrit|schrieb|escribió)[ ]?:[ \t\r]*$"
# Shorter lines say too little to identify a message; passages of them do.
LEAST_CHARS = 12


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[ \t]", ""))


def normal(text: Column) -> Column:
    """Lower case (A-Z), white space collapsed and trimmed."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, "[ \\t\\n\\x0B\\f\\r]+", " "))


def passages(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """conv, turn, level, hash, chars of every line and of every run of lines of one level.

    Runs are built inside the row's own array of lines, so no group of messages has to meet.
    """
    lines = F.split(F.col(text), "\n")
    parts = F.transform(lines, lambda x: F.struct(
        quote_level(x).alias("level"), normal(F.regexp_replace(x, _MARKS, "")).alias("body")))
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), parts.alias("lines"))
    # where a level begins, and the bodies up to the next such place
    starts = F.filter(F.transform("lines", lambda x, i: F.when(
        (i == 0) | (F.get("lines", i - 1)["level"] != x["level"]), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("starts", starts)
    runs = F.transform("starts", lambda s, k: F.struct(
        F.get("lines", s)["level"].alias("level"),
        F.trim(F.array_join(F.filter(F.transform(F.slice(
            "lines", s + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - s), lambda x: x["body"]),
            lambda b: F.length(b) > 0), " ")).alias("body")))
    both = rows.select("conv", "turn", F.explode(F.array_distinct(F.concat("lines", runs))).alias("p"))
    body = F.col("p.body")
    return both.filter(F.length(body) >= LEAST_CHARS).select(
        "conv", "turn", F.col("p.level").alias("level"), F.xxhash64(body).alias("hash"), F.length(body).alias("chars"))


def replies(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv, turn, parent: the message that each quoting message answers."""
    found = passages(messages, conv, turn, text)
    quoted = found.filter("level > 0")
    originals = found.filter("level = 0").join(
        quoted.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi").groupBy("conv", "hash").agg(
        F.min("turn").alias("parent"))
    linked = quoted.join(originals, ["conv", "hash"]).filter("parent < turn")
    votes = linked.groupBy("conv", "turn", "level", "parent").agg(F.sum("chars").alias("chars"))
    best = F.max_by("parent", F.struct(-F.col("level"), "chars", "parent"))
    return votes.groupBy("conv", "turn").agg(best.alias("parent"))


def thread_roots(links: DataFrame) -> DataFrame:
    """conv, turn, parent, thread (turn of the first message) and depth of every reply.

    Each round doubles how far a message looks back, so the rounds grow with the logarithm of the longest chain.
    """
    now = saved(links.withColumns({"thread": F.col("parent"), "depth": F.lit(1).cast("bigint")}), "threads")
    while True:
        step = now.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("up"), F.col("depth").alias("more"))
        moved = now.join(step, ["conv", "thread"])
        if not moved.head(1):
            return now
        stay = now.join(step, ["conv", "thread"], "left_anti").select("conv", "turn", "parent", "thread", "depth")
        now = saved(stay.unionByName(moved.select(
            "conv", "turn", "parent", F.col("up").alias("thread"), (F.col("depth") + F.col("more")).alias("depth"))), "threads")


def own_words(text: Column) -> Column:
    """The text without quoted lines, the lines that announce them, and the blank lines they leave at both ends."""
    lines = F.split(text, "\n")
    levels = F.transform(lines, quote_level)
    kept = F.filter(lines, lambda x, i: (F.get(levels, i) == 0) & ~(
        x.rlike(_ANNOUNCE) & (F.coalesce(F.get(levels, i + 1), F.lit(0)) > 0)))
    quotes = F.exists(levels, lambda n: n > 0)
    return F.when(quotes, F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", ""))).otherwise(text)


def reply_order(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The input with its text free of quotes, n_quoted, parent_turn, thread_turn, depth and position.

    position counts from 0 within the conversation, thread by thread in the order of their first messages; a reply comes
    after what it answers.
    """
    roots = thread_roots(replies(messages, conv, turn, text))
    own = ("n_quoted", "parent_turn", "thread_turn", "depth", "position")
    rows = messages.select(*[c for c in messages.columns if c.lower() not in own]).withColumns({
        "__conv": F.col(conv), "__turn": F.col(turn)})
    found = roots.select(F.col("conv").alias("__conv"), F.col("turn").alias("__turn"), F.col("parent").alias("parent_turn"),
                         F.col("thread").alias("__thread"), F.col("depth").alias("__depth"))
    rows = rows.join(found, ["__conv", "__turn"], "left").withColumns({
        "thread_turn": F.coalesce("__thread", "__turn"), "depth": F.coalesce("__depth", F.lit(0).cast("bigint")),
        "n_quoted": F.coalesce(F.size(F.filter(F.split(F.col(text), "\n"), lambda x: quote_level(x) > 0)), F.lit(0)).cast("bigint")})
    rows = rows.withColumn("n_quoted", F.when(F.col(text).isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n_quoted")))
    rows = rows.withColumn(text, own_words(F.col(text)))
    numbered, _ = with_row_index(rows, ["__conv", "thread_turn", "__turn", text], "__index")
    first = numbered.groupBy("__conv").agg(F.min("__index").alias("__first"))
    placed = numbered.join(first.withColumnRenamed("__conv", "__c"), F.col("__conv").eqNullSafe(F.col("__c")), "left")
    return placed.withColumn("position", F.col("__index") - F.col("__first")).drop(
        "__conv", "__turn", "__thread", "__depth", "__index", "__first", "__c")


def query(spark, folder: str) -> DataFrame:
    out = reply_order(spark.read.parquet(f"{folder}/conversations.parquet"))
    return out.select("conv_id", "turn", "role", "text", "n_quoted", "parent_turn", "thread_turn", "depth", "position")


_SQL_NORMAL = ("trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
               "'[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))")
ORACLE = f"""
WITH RECURSIVE l AS (SELECT conv_id, turn, pos, string_split(text, chr(10))[pos] AS line
    FROM conversations, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(pos)),
p AS (SELECT conv_id, turn, pos, line, length(regexp_replace(regexp_extract(line, '{_MARKS}', 1), '[ \\t]', '', 'g')) AS level,
    {_SQL_NORMAL.format(f"regexp_replace(line, '{_MARKS}', '')")} AS body FROM l),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY pos) AS run FROM p),
s AS (SELECT conv_id, turn, level, body FROM p UNION
      SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY pos) FILTER (body <> '') FROM r GROUP BY conv_id, turn, level, run),
f AS (SELECT * FROM s WHERE length(body) >= {LEAST_CHARS}),
o AS (SELECT conv_id, body, min(turn) AS parent FROM f WHERE level = 0 GROUP BY conv_id, body),
v AS (SELECT q.conv_id, q.turn, level, parent, sum(length(q.body)) AS chars FROM f q JOIN o ON q.conv_id = o.conv_id AND q.body = o.body
      WHERE level > 0 AND parent < turn GROUP BY q.conv_id, q.turn, level, parent),
k AS (SELECT conv_id, turn, arg_max(parent, (-level, chars, parent)) AS parent FROM v GROUP BY conv_id, turn),
w AS (SELECT conv_id, turn, parent AS thread, 1 AS depth FROM k UNION ALL
      SELECT w.conv_id, w.turn, k.parent, w.depth + 1 FROM w JOIN k ON w.conv_id = k.conv_id AND w.thread = k.turn),
z AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM w GROUP BY conv_id, turn),
x AS (SELECT conv_id, turn, count(*) FILTER (level > 0) AS n_quoted,
      string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0) AS own FROM p GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, role, CASE WHEN n_quoted > 0 THEN trim(own) ELSE text END AS text, coalesce(n_quoted, 0)::BIGINT AS n_quoted,
  parent AS parent_turn, coalesce(thread, c.turn) AS thread_turn, coalesce(depth, 0)::BIGINT AS depth,
  row_number() OVER (PARTITION BY c.conv_id ORDER BY coalesce(thread, c.turn), c.turn) - 1 AS position
FROM conversations c LEFT JOIN k ON c.conv_id = k.conv_id AND c.turn = k.turn
LEFT JOIN z ON c.conv_id = z.conv_id AND c.turn = z.turn LEFT JOIN x ON c.conv_id = x.conv_id AND c.turn = x.turn
"""
