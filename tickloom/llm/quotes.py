"""Quotation linking: from quoted passages to reply trees without quotes.

A message is read line by line: leading ``>`` marks, with blanks between them,
give the level; level 0 is the message's own text.  Lines are normalised and
hashed.  The original of a passage is the latest message of the conversation before
the reply that has it as its own text.  It is found by reading own and quoted
passages of a (conversation, hash) in turn order, in runs of ``RUN`` turns with one
carried value each, so a line in a third of all messages is many keys.  A message replies to the latest original it quotes at level 1, and
its thread starts where following replies ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import written

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
# Every line that isn't empty, once normalised, is a passage: a reply may quote a mere "ok".
LEAST_CHARS = 1
# Turns of a conversation whose passages with one hash are read together.
RUN = 512


def level_of(line: Column) -> Column:
    """Number of leading quote marks."""
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(F.regexp_replace(marks, "[^>]", ""))


def body_of(line: Column) -> Column:
    return F.regexp_replace(line, MARKS, "")


def normalised(line: Column) -> Column:
    """Lower case, blanks as one, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def lines_of(text: Column) -> Column:
    """Lines of a text as structs (level, body); a carriage return ends a line too."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    return F.transform(lines, lambda x: F.struct(level_of(x).alias("level"), body_of(x).alias("body")))


def own_text(lines: Column) -> Column:
    """The level 0 lines, without lines that only announce a quote ("... wrote:") or blank ends."""
    following = lambda i: F.try_element_at(lines, i + 2)["level"]
    announces = lambda x, i: x["body"].rlike(r"(?i)\bwrote:\s*$") & (F.coalesce(following(i), F.lit(0)) > 0)
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~announces(x, i))
    joined = F.array_join(F.transform(kept, lambda x: x["body"]), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, n) of the distinct passages of each message, n counting repeats."""
    x = messages.select("conv", "turn", F.explode("lines").alias("x"))
    x = x.select("conv", "turn", F.col("x.level").alias("level"), normalised(F.col("x.body")).alias("p"))
    x = x.filter(F.length("p") >= LEAST_CHARS).withColumn("hash", F.md5("p"))
    return x.groupBy("conv", "turn", "level", "hash").agg(F.count(F.lit(1)).alias("n"))


def with_origin(p: DataFrame) -> DataFrame:
    """The quoted passages of ``passages`` with ``origin``, the latest earlier turn that has the passage as its own; null without one."""
    key = ["conv", "hash"]
    d = p.withColumn("run", F.floor(F.col("turn") / RUN))
    own = F.when((F.col("level") == 0) & F.col("conv").isNotNull(), F.col("turn"))
    # Of one turn the quoted rows come first, so a message is not its own original.
    inside = Window.partitionBy(*key, "run").orderBy("turn", (F.col("level") == 0).cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("near", F.max(own).over(inside)).filter("level > 0")
    ends = p.filter("level = 0").groupBy(*key, F.floor(F.col("turn") / RUN).alias("run")).agg(F.max("turn").alias("last"))
    runs = d.select(*key, "run").distinct().join(ends, [*key, "run"], "full")
    before = Window.partitionBy(*key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select(*key, "run", F.max("last").over(before).alias("carried"))
    return d.join(carried, [*key, "run"], "left").withColumn("origin", F.coalesce("near", "carried")).drop("near", "carried", "run")


def linked(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rounds: int = 40) -> DataFrame:
    """One row a message: conv, turn, role, clean_text, n_quoted, n_linked, max_level, parent_turn, root_turn, depth.

    Messages are rows; rows with one (conv, turn) are one message for links, and
    each keeps its own text.  Null texts are empty, rows without conv or turn
    link to nothing.  A message that quotes nothing it can link to starts a
    thread.  A parent is always an earlier turn, so sorting a thread by turn
    puts every message after the one it replies to; depth counts replies.

    Threads are followed by doubling: each round a message takes its ancestor's
    ancestor, so a thread of depth d needs log2(d) rounds; rounds are written to
    the shared folder.
    """
    m = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), lines_of(F.col(text)).alias("lines"))
    p = written(passages(m), "passages")
    quoted, at = with_origin(p), F.col("origin")
    facts = quoted.groupBy("conv", "turn").agg(
        F.sum("n").alias("n_quoted"), F.sum(F.when(at.isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"),
        F.max("level").alias("max_level"), F.max(F.when(F.col("level") == 1, at)).alias("parent"),
    )
    facts = written(facts, "quotes")
    # (turn, up, depth): an ancestor and how many replies lie between.
    t = written(facts.filter("parent IS NOT NULL").select("conv", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(rounds):
        above = t.select("conv", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        new = t.join(above, ["conv", "up"], "left")
        if new.filter("next IS NOT NULL").isEmpty():
            break
        t = written(new.select("conv", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")
    else:
        raise RuntimeError(f"threads are deeper than 2^{rounds}")
    facts = facts.join(t, ["conv", "turn"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = m.select("conv", "turn", "role", own_text(F.col("lines")).alias("clean_text")).join(facts, ["conv", "turn"], "left")
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "clean_text",
        zero("n_quoted").alias("n_quoted"), zero("n_linked").alias("n_linked"), zero("max_level").alias("max_level"),
        F.col("parent").alias("parent_turn"), F.coalesce("up", "turn").alias("root_turn"), zero("depth").alias("depth"),
    )


def as_mail(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Conversations as mail programs store them: a message quotes the one before it, which
    quotes the one before that.

    Joins on (conv, turn - 1) and (conv, turn - 2), so a long conversation is many keys.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    one = df.groupBy(conv, turn).agg(F.min(body).alias("t"))
    prev = lambda k: one.select(F.col(conv).alias(f"c{k}"), (F.col(turn) + k).alias(f"n{k}"), F.col("t").alias(f"t{k}"))
    quote = lambda t, mark: F.regexp_replace(t, r"(?m)^", mark)
    d = df.select(F.col(conv), F.col(turn), *[F.col(c) for c in df.columns if c not in (conv, turn, text)], body.alias(text))
    for k in (1, 2):
        d = d.join(prev(k), (F.col(conv) == F.col(f"c{k}")) & (F.col(turn) == F.col(f"n{k}")), "left").drop(f"c{k}", f"n{k}")
    before = F.concat(F.lit("They wrote:\n"), F.when(F.col("t2").isNotNull(), F.concat(quote(F.col("t2"), ">> "), F.lit("\n"))).otherwise(F.lit("")), quote(F.col("t1"), "> "), F.lit("\n"))
    return d.withColumn(text, F.concat(F.when(F.col("t1").isNotNull(), before).otherwise(F.lit("")), F.col(text))).select(*df.columns)
