"""Text columns: cleaning, identity, timestamps, polarity, symbol matching.

Everything is per row and stays in the JVM; the dictionaries are literals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import lexicon as L

NEGATION_WINDOW = 3
TOKEN = "[a-z][a-z'-]*"


# The characters that count as white space at the ends of a text.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.btrim(c, F.lit(WHITE))


def clean_text(raw: Column) -> Column:
    """Tags out, white space collapsed; NULL reads as empty."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def article_uid(url: Column, title: Column) -> Column:
    """Identity of a story: hash of its URL, or of its title without one."""
    basis = F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(title)
    return F.substring(F.sha1(F.lower(strip(basis))), 1, 16)


def parse_instant(raw: Column) -> Column:
    """RFC-822 or ISO-8601 text as a UTC instant, NULL when unreadable."""
    t = F.regexp_replace(strip(raw), r"^[A-Za-z]{3,9},\s*", "")
    # Obsolete zone names as offsets; an unzoned time is UTC.
    zones = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400",
             "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
    rfc = t
    for name, off in zones.items():
        rfc = F.regexp_replace(rfc, rf"\s{name}$", f" {off}")
    iso = F.regexp_replace(t, r"[zZ]$", "+00:00")
    tries = [F.try_to_timestamp(rfc, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")]
    is_iso = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), iso)
    return F.coalesce(*tries, is_iso.try_cast("timestamp"))


# ---------------------------------------------------------------- polarity


@dataclass(frozen=True)
class Lexicon:
    """Signed word weights and negators, held as literals of the plan."""

    weights: dict[str, float] = field(default_factory=L.signed_weights)
    negators: tuple[str, ...] = field(default=L.NEGATOR_WORDS)

    def words(self) -> Column:
        return literal_array(list(self.weights))

    def weight_map(self) -> Column:
        # Literals only, so the planner folds the map to one constant.
        return F.create_map(*[F.lit(x) for w, v in self.weights.items() for x in (w, float(v))])


def literal_array(items: list[str]) -> Column:
    """Strings as one array literal (the separator never occurs in words)."""
    return F.split(F.lit("\u0001".join(items)), "\u0001")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.translate(text, "\u2019", "'")), F.lit(TOKEN), F.lit(0))


def pin(df: DataFrame, name: str, c: Column) -> DataFrame:
    """Add a column behind a one-element generator.

    The optimizer copies plain column definitions into later filters and
    lambdas, which would tokenise a text once per token; it does not look
    through a generator.
    """
    return df.select("*", F.explode(F.array(c)).alias(name))


def with_polarity(df: DataFrame, text: str, lex: Lexicon, prefix: str) -> DataFrame:
    """Add ``{prefix}_pos``, ``_neg`` and ``_matched`` of a text column.

    The whole text is tokenised once.  A set intersection finds which lexicon
    words occur at all, so only their positions are looked up, and no token
    rows are exploded or shuffled.
    """
    t, h, i = (f"_{prefix}_{x}" for x in ("tok", "hit", "idx"))
    d = pin(df, t, tokens(F.coalesce(F.col(text), F.lit(""))))
    d = pin(d, h, F.array_intersect(F.col(t), lex.words()))
    none = F.array().cast("array<int>")
    at = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda k: F.array_contains(F.col(h), F.get(F.col(t), k)))
    d = pin(d, i, F.when(F.size(h) > 0, at).otherwise(none))
    neg = literal_array(list(lex.negators))

    def signed(k: Column) -> Column:
        window = F.slice(F.col(t), F.greatest(F.lit(1), k - (NEGATION_WINDOW - 1)), F.least(F.lit(NEGATION_WINDOW), k))
        flipped = F.exists(window, lambda w: F.array_contains(neg, F.replace(w, F.lit("'"), F.lit(""))))
        w = F.element_at(lex.weight_map(), F.get(F.col(t), k))
        return F.when(flipped, -w).otherwise(w)

    s = f"_{prefix}_sw"
    d = pin(d, s, F.transform(i, signed))

    def total(keep) -> Column:
        return F.aggregate(F.col(s), F.lit(0.0), lambda acc, x: acc + F.when(keep(x), F.abs(x)).otherwise(F.lit(0.0)))

    d = d.withColumns(
        {
            f"{prefix}_pos": total(lambda x: x > 0),
            f"{prefix}_neg": total(lambda x: x < 0),
            f"{prefix}_matched": F.size(s).cast("long"),
        }
    )
    return d.drop(t, h, i, s)


def score_articles(df: DataFrame, lex: Lexicon | None = None, *, title_weight: float = 2.0) -> DataFrame:
    """Add polarity in [-1, 1], matched words and whether that is confident."""
    lex = lex or Lexicon()
    d = with_polarity(with_polarity(df, "title", lex, "_t"), "summary", lex, "_s")
    w = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.lit(title_weight)).otherwise(F.lit(1.0))
    pos, neg = F.col("_t_pos") * w + F.col("_s_pos"), F.col("_t_neg") * w + F.col("_s_neg")
    d = d.withColumns({"positive": pos, "negative": neg, "matched": F.col("_t_matched") + F.col("_s_matched")})
    d = d.withColumn(
        "polarity", F.coalesce(F.try_divide(F.col("positive") - F.col("negative"), F.col("positive") + F.col("negative")), F.lit(0.0))
    )
    return d.withColumn("confident", F.col("matched") >= 2).drop(*[f"_{p}_{x}" for p in "ts" for x in ("pos", "neg", "matched")])


# ---------------------------------------------------------------- matching


@dataclass(frozen=True)
class NameBook:
    """Company names, names that need a qualifier, and word-like tickers."""

    names: dict[str, str] = field(default_factory=lambda: dict(L.COMPANY_TICKERS))
    qualified: dict[str, str] = field(default_factory=lambda: dict(L.QUALIFIED_TICKERS))
    ambiguous: tuple[str, ...] = field(default=L.AMBIGUOUS_WORDS)

    def plain(self) -> dict[str, str]:
        return {n: s for n, s in self.names.items() if n not in self.qualified}


def java_quote(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s)


def names_found(text: Column, names: dict[str, str], tail: str = r"(?!\w)") -> Column:
    """Symbols whose name occurs as whole words, overlaps included.

    One alternation, longest name first, tried at every position by a
    look-ahead.  A name that starts with another one stands for both.
    """
    if not names:
        return F.array().cast("array<string>")
    order = sorted(names, key=lambda n: -len(n))
    alt = "|".join(java_quote(n) for n in order)
    hits = F.regexp_extract_all(text, F.lit(rf"(?U)(?<!\w)(?=({alt}){tail})"), F.lit(1))
    covers = {n: [names[m] for m in order if n == m or (n.startswith(m) and not n[len(m)].isalnum())] for n in order}
    table = F.map_from_arrays(
        literal_array(order), F.transform(literal_array([",".join(covers[n]) for n in order]), lambda x: F.split(x, ","))
    )
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.element_at(table, h))))


# The forms a ticker takes in a text.
CASHTAG = r"\$([A-Z]{1,5}(?:[-.][A-Z])?)\b"
EXCHANGE_TAG = r"(?i)\b(?:NASDAQ|NYSE|NYSEARCA|AMEX|BATS|OTC)\s*:\s*([A-Z]{1,5}(?:[-.][A-Z])?)\b"
NAME_QUALIFIER = r"(?!\w)\s*(?:(?:Inc|Corp|Corporation|Co|Company|Holdings|Group|Ltd|PLC|LLC|SA|NV|AG)\b|\(\s*(?:NASDAQ|NYSE))"
CONFIRM_EXCHANGE = r"NASDAQ|NYSE|NYSEARCA|AMEX|OTC"


def cashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CASHTAG), F.lit(1))


def exchange_tags(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(EXCHANGE_TAG), F.lit(1))
    return F.transform(found, lambda s: F.upper(s))


def match_symbols(text: Column, book: NameBook, universe: list[str] | None = None) -> Column:
    """Sorted symbols a text mentions, restricted to the universe if given."""
    found = F.array_union(F.array_union(cashtags(text), exchange_tags(text)),
                          F.array_union(names_found(text, book.plain()), names_found(text, book.qualified, NAME_QUALIFIER)))
    if universe is not None:
        found = F.array_intersect(found, literal_array(universe))
    return F.array_sort(F.array_distinct(found))


def confirmed(symbols: Column, text: Column, named: Column, book: NameBook) -> Column:
    """The symbols a text really refers to: by ticker form or by name.

    ``named`` holds the symbols whose names occur in the text.
    """
    ex = CONFIRM_EXCHANGE
    odd = literal_array(list(book.ambiguous))

    def ok(s: Column) -> Column:
        q = F.concat(F.lit(r"\Q"), F.upper(s), F.lit(r"\E"))
        forms = F.concat(
            F.lit(r"\$"), q, F.lit(r"\b|(?i:\(\s*(?:(?:" + ex + r")\s*:\s*)?"), q, F.lit(r"\s*\))|(?i:\b(?:" + ex + r")\s*:\s*"), q, F.lit(r"\b)")
        )
        bare = F.concat(F.lit(r"(?U)(?<![\w.$])"), q, F.lit(r"(?![\w.])"))
        return (
            F.regexp_like(text, forms)
            | (~F.array_contains(odd, F.upper(s)) & F.regexp_like(text, bare))
            | F.array_contains(named, F.upper(s))
        )

    return F.filter(symbols, ok)


def label_articles(df: DataFrame, book: NameBook | None = None, universe: list[str] | None = None) -> DataFrame:
    """Verify given symbols and add the mentioned ones of the universe."""
    book = book or NameBook()
    text = F.concat(F.col("title"), F.lit(". "), F.coalesce(F.col("summary"), F.lit("")))
    t = F.col("_text")
    d = pin(df, "_text", F.trim(text))
    d = pin(d, "_match", match_symbols(t, book, universe))
    d = pin(d, "_named", names_found(t, {**book.names, **book.qualified}))
    kept = F.when(F.size("symbols") > 0, confirmed(F.col("symbols"), t, F.col("_named"), book)).otherwise(F.array().cast("array<string>"))
    return d.withColumn("symbols", F.array_sort(F.array_union(kept, F.col("_match")))).drop("_text", "_match", "_named")
