"""Quality rules as a ledger: measure once, keep failure bits, judge by policy.

Every rule is evaluated once for a document and leaves one bit; the measurements
behind it stay beside it.  A policy is a named, versioned mask of bits, so a new
policy, or leaving one rule out, needs neither the texts nor the rules again:
verdicts and ablations are bitwise operations on a long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import append_arrow, spare, texts_of, written

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_exclaim",
)
BLANKS = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))

# One rule a bit, in order; a rule holds for a document that fails it.  All are
# integer comparisons of measurements, so every engine agrees on them.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "{n_words} < 50"),
    ("repeated_words", "100 * {n_repeat_words} > 50 * {n_words}"),
    ("symbols", "10 * {n_symbols} > {n_words}"),
    ("duplicate_lines", "10 * {n_dup_lines} > 3 * {n_lines}"),
    ("word_length", "({word_chars} < 3 * {n_words} OR {word_chars} > 12 * {n_words})"),
    ("shouting", "2 * {n_upper} > {n_letters}"),
    ("exclamation", "5 * {n_exclaim} > {n_words}"),
)
BASE_BITS = 0b11


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document, under a name and a version."""

    name: str
    version: int
    mask: int


POLICIES = (Policy("base", 1, BASE_BITS), Policy("web", 1, 0b0001111), Policy("web", 2, 0b1111111))


def repeated(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if k == n:
        return 0
    pair = ids[:-1] * k + ids[1:]
    if k > 2_000_000:  # keep the key of three words within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * k + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = twice.copy()
    hit[1:] |= twice[:-1]
    hit[2:] |= twice[:-2]
    return int(hit.sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    dropped = lambda which: len(data) - len(data.translate(None, which))
    return (
        len(words), len(text) - dropped(BLANKS), dropped(SYMBOLS), len(lines) - len(set(lines)), repeated(words),
        len(lines), dropped(UPPER), dropped(LETTERS), data.count(b"!"),
    )


def fail_bits(column: dict[str, Column | str]) -> Column:
    """The failure bits over measurement columns."""
    names = {m: f"`{column.get(m, m)}`" for m in MEASURES}
    out = F.lit(0).cast("long")
    for i, (_, rule) in enumerate(RULES):
        out = out.bitwiseOR(F.when(F.expr(rule.format(**names)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Append the measurements (long) and ``fail_bits``; null text has no words and fails.

    No shuffle; repeated rows repeat.  Columns get ``prefix``; a name that is taken
    in any case gets underscores behind it.
    """

    def make():
        def fn(column: pa.Array):
            rows = [measure(t) for t in texts_of(column)]
            return [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]

        return fn

    out = append_arrow(df, [text], [(prefix + m, T.LongType()) for m in MEASURES], make)
    names = dict(zip(MEASURES, out.columns[len(df.columns):], strict=True))
    return out.withColumn(spare(out, prefix + "fail_bits"), fail_bits(names))


def stored(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The ledger of a table, written to the shared folder and read back: the columns ``keep``,
    the measurements and ``fail_bits``.  Policies and ablations read it and leave the texts alone."""
    out = ledger(df.select(*keep, text), text)
    return written(out.drop(text), "rule-ledger")


def kept_by(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(df: DataFrame, policies: tuple[Policy, ...] = POLICIES, bits: str = "fail_bits") -> DataFrame:
    """What each rule of each policy decides: (policy, version, rule, n_rejected,
    n_failed, n_only), the last being the documents only this rule rejects.

    One pass: rows combine to counts by bit pattern (at most 2^rules of them)
    before the shuffle; the policies then read the patterns.
    """
    patterns = df.groupBy(F.col(bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[
        F.struct(
            F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(rule).alias("rule"),
            F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << i).cast("long").alias("bit"),
        )
        for p in policies for i, (rule, _) in enumerate(RULES) if p.mask >> i & 1
    ])
    rows = patterns.select("bits", "n", F.explode(cases).alias("c")).select("bits", "n", "c.*")
    hit = F.col("bits").bitwiseAND(F.col("mask"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy("policy", "version", "rule").agg(
        total(hit != 0).alias("n_rejected"),
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_only"),
    )


def judged(df: DataFrame, policy: Policy = POLICIES[-1], text: str = "text", prefix: str = "") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``: base failures are never kept.

    Repeated rows repeat; names that are taken get underscores, as in ``ledger``.
    """
    out = ledger(df, text, prefix)
    return verdicts(out, policy, out.columns[-1], spare(out, prefix + "base_failed"), spare(out, prefix + "kept"))


def verdicts(ledger_rows: DataFrame, policy: Policy = POLICIES[-1], bits: str = "fail_bits", base: str = "base_failed", kept: str = "kept") -> DataFrame:
    """Append what a policy decides, from the failure bits alone."""
    failed = F.col(bits).bitwiseAND(F.lit(BASE_BITS)) != 0
    return ledger_rows.withColumns({base: failed, kept: ~failed & kept_by(policy, bits)})


def oracle_sql() -> str:
    """The query of this operator as DuckDB SQL."""
    bits = " + ".join(f"CASE WHEN {r.format(**{m: m for m in MEASURES})} THEN {1 << i} ELSE 0 END" for i, (_, r) in enumerate(RULES))
    count = lambda cls: f"length(t) - length(regexp_replace(t, '{cls}', '', 'g'))"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
      [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls FROM d),
    p AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
    r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM p) WHERE c > 1),
    q AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
    m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, {count('[#*$%&|<>]')} AS n_symbols,
      len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
      {count('[A-Z]')} AS n_upper, {count('[A-Za-z]')} AS n_letters, {count('!')} AS n_exclaim FROM w LEFT JOIN q USING (rid)),
    b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
      CAST(n_repeat_words AS BIGINT) AS n_repeat_words, fail_bits & {BASE_BITS} <> 0 AS base_failed, fail_bits & {POLICIES[-1].mask} = 0 AS kept, fail_bits FROM b"""


def ablation_sql(policies: tuple[Policy, ...] = POLICIES) -> str:
    """The ablation report over ``documents`` as DuckDB SQL."""
    cases = ", ".join(f"('{p.name}', {p.version}, '{rule}', {p.mask}, {1 << i})" for p in policies for i, (rule, _) in enumerate(RULES) if p.mask >> i & 1)
    return f"""WITH l AS ({oracle_sql()}), c(policy, version, rule, mask, bit) AS (VALUES {cases})
    SELECT policy, version, rule, count(*) FILTER (fail_bits & mask <> 0) AS n_rejected, count(*) FILTER (fail_bits & bit <> 0) AS n_failed,
      count(*) FILTER (fail_bits & mask = bit) AS n_only FROM l, c GROUP BY policy, version, rule"""
