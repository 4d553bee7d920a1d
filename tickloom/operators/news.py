"""Articles to signals: dedupe, archive merge, aggregation at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import age_days, clip, half_life_decay
from tickloom.functions.text import Lexicon, NameBook, article_uid, clean_text, label_articles, parse_instant, score_articles, strip
from tickloom.settings import NewsSettings

RSS = "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, pubDate: STRING, published: STRING, updated: STRING, description: STRING, summary: STRING>>>"
ATOM = (
    "entry ARRAY<STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING, _VALUE: STRING>>, pubDate: STRING, published: STRING, "
    "updated: STRING, description: STRING, summary: STRING>>"
)
VENDOR_BODY = (
    "title: STRING, summary: STRING, description: STRING, pubDate: STRING, displayTime: STRING, "
    "canonicalUrl: STRING, clickThroughUrl: STRING"
)
VENDOR = f"content STRUCT<{VENDOR_BODY}>, {VENDOR_BODY.replace(': ', ' ')}, providerPublishTime STRING, link STRING"


def first_text(*cols: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in cols])


def parse_feeds(raw: DataFrame) -> DataFrame:
    """Articles of RSS and Atom documents in ``raw(source, kind, body)``.

    Items without a title or a readable time are dropped; malformed XML gives
    none.
    """
    d = raw.withColumns({"_rss": F.from_xml("body", RSS), "_atom": F.from_xml("body", ATOM)})
    link = F.transform("_atom.entry", lambda e: F.struct(
        e["title"].alias("title"),
        F.array_join(F.slice(F.filter(F.transform(e["link"], lambda x: F.coalesce(F.when(strip(x["_VALUE"]) != "", x["_VALUE"]), x["_href"])), lambda x: F.length(x) > 0), 1, 1), "").alias("link"),
        e["pubDate"].alias("pubDate"), e["published"].alias("published"), e["updated"].alias("updated"),
        e["description"].alias("description"), e["summary"].alias("summary"),
    ))
    empty = F.slice(F.col("_rss.channel.item"), 1, 0)
    items = F.concat(F.coalesce("_rss.channel.item", F.array()), F.coalesce(link, empty, F.array()))
    i = d.select("source", "kind", F.explode(items).alias("_i"))
    out = i.select(
        "source", "kind", parse_instant(first_text(F.col("_i.pubDate"), F.col("_i.published"), F.col("_i.updated"))).alias("ts"),
        clean_text(F.col("_i.title")).alias("title"), clean_text(first_text(F.col("_i.description"), F.col("_i.summary"))).alias("summary"),
        strip(F.coalesce("_i.link", F.lit(""))).alias("url"), F.array().cast("array<string>").alias("symbols"),
    )
    out = out.filter(F.col("ts").isNotNull() & (F.col("title") != ""))
    return out.withColumn("uid", article_uid(F.col("url"), F.col("title")))


def parse_vendor(raw: DataFrame) -> DataFrame:
    """Articles of vendor JSON in ``raw(symbol, body)``, nested or flat."""
    d = raw.withColumn("_j", F.from_json("body", VENDOR))
    b = {k: F.when(F.col("_j.content").isNotNull(), F.col(f"_j.content.{k}")).otherwise(F.col(f"_j.{k}"))
         for k in ("title", "summary", "description", "pubDate", "displayTime", "canonicalUrl", "clickThroughUrl")}
    epoch = F.timestamp_seconds(F.col("_j.providerPublishTime").try_cast("bigint"))
    # An URL is a string or an object with an ``url`` field.
    given = first_text(b["canonicalUrl"], b["clickThroughUrl"])
    url = F.when(given.startswith("{"), F.get_json_object(given, "$.url")).otherwise(given)
    out = d.select(
        F.lit("vendor").alias("source"), F.lit("company").alias("kind"),
        F.coalesce(parse_instant(first_text(b["pubDate"], b["displayTime"])), epoch).alias("ts"),
        clean_text(b["title"]).alias("title"), clean_text(first_text(b["summary"], b["description"])).alias("summary"),
        F.coalesce(first_text(url, F.col("_j.link")), F.lit("")).alias("url"), F.array("symbol").alias("symbols"),
    )
    out = out.filter(F.col("ts").isNotNull() & (F.col("title") != ""))
    return out.withColumn("uid", article_uid(F.col("url"), F.col("title")))


def merge_copies(articles: DataFrame, order: list[str]) -> DataFrame:
    """One row per uid: the first by ``order`` keeps its text, the earliest
    time counts, ``company`` wins the kind, symbols are united.

    Copies combine before the shuffle, and a uid's symbols are made distinct
    by an aggregate of their own, so a story with very many copies never
    becomes one large group.
    """
    o = F.struct(*order)
    rest = [c for c in articles.columns if c not in ("uid", "ts", "kind", "summary", "url", "symbols")]

    def filled(c: str) -> Column:
        return F.coalesce(F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", o)), F.lit("")).alias(c)

    kind = F.when(F.max((F.col("kind") == "company").cast("int")) == 1, "company").otherwise(F.min_by("kind", o))
    one = articles.groupBy("uid").agg(
        F.min("ts").alias("ts"), kind.alias("kind"), filled("summary"), filled("url"), *[F.min_by(c, o).alias(c) for c in rest]
    )
    tags = articles.select("uid", F.explode("symbols").alias("_s")).filter("_s <> ''").distinct()
    tags = tags.groupBy("uid").agg(F.array_sort(F.collect_list("_s")).alias("symbols"))
    out = one.join(tags, "uid", "left")
    return out.withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>"))).select(*articles.columns)


def dedupe(articles: DataFrame) -> DataFrame:
    """Collapse syndicated copies; the earliest one is the story."""
    return merge_copies(articles, ["ts", "source", "title", "url"])


def merge_archive(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Archive merge, idempotent on uid: the oldest collected row wins for
    everything but the symbols, which are united.  Both need collected_at."""
    u = prior.withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", F.lit(1)))
    o = F.struct("collected_at", "_side", "ts", "title", "url")
    cols = [c for c in prior.columns if c not in ("uid", "symbols")]
    one = u.groupBy("uid").agg(F.min_by(F.struct(*cols), o).alias("_r")).select("uid", "_r.*")
    tags = u.select("uid", F.explode("symbols").alias("_s")).filter("_s <> ''").distinct()
    tags = tags.groupBy("uid").agg(F.array_sort(F.collect_list("_s")).alias("symbols"))
    out = one.join(tags, "uid", "left")
    return out.withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>"))).select(*prior.columns)


# ------------------------------------------------------------------ signal


def at_instant(articles: DataFrame, as_of: Column, max_age_days: float) -> DataFrame:
    """Articles usable at one instant: strictly before it and not too old."""
    d = articles.withColumn("as_of", as_of.cast("timestamp"))
    d = d.filter(F.col("ts") < F.col("as_of")).withColumn("age_days", age_days(F.col("as_of"), F.col("ts")))
    return d.filter(F.col("age_days") <= max_age_days)


def at_grid(articles: DataFrame, start: str, step_days: int, end: str, max_age_days: float) -> DataFrame:
    """Articles at every instant of a regular grid that may see them.

    Each article computes the grid points between its time and its expiry, so
    work is articles times points in reach, not articles times grid.
    """
    s, e = (F.unix_seconds(F.lit(x).cast("timestamp")) for x in (start, end))
    width = F.lit(step_days * 86_400)
    first = F.greatest(F.floor((F.unix_micros("ts") / 1e6 - s) / width) + 1, F.lit(0))
    last = F.least(
        F.floor((F.unix_micros("ts") / 1e6 + max_age_days * 86_400 - s) / width), F.floor((e - s) / width)
    )
    points = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
    d = articles.withColumn("_k", F.explode(points)).withColumn("as_of", F.timestamp_seconds(s + F.col("_k") * width)).drop("_k")
    d = d.filter(F.col("ts") < F.col("as_of")).withColumn("age_days", age_days(F.col("as_of"), F.col("ts")))
    return d.filter(F.col("age_days") <= max_age_days)


def evidence(usable: DataFrame, cfg: NewsSettings) -> DataFrame:
    """Keep articles with a tone and weigh them by age and evidence."""
    w = half_life_decay(F.col("age_days"), cfg.half_life_days) * F.least(F.col("matched"), F.lit(6)) / 6.0
    return usable.filter(F.col("matched") > 0).withColumn("w", w)


def symbol_signal(ev: DataFrame, cfg: NewsSettings | None = None) -> DataFrame:
    """Per (as_of, symbol): shrunk score, score against the mean, evidence.

    The mean is over the symbols of one instant, at most the universe.
    """
    cfg = cfg or NewsSettings()
    d = ev.select("as_of", "uid", "title", "polarity", "w", F.explode("symbols").alias("symbol"))
    g = d.groupBy("as_of", "symbol").agg(
        F.sum(F.col("w") * F.col("polarity")).alias("_num"), F.sum("w").alias("weight"), F.count(F.lit(1)).alias("articles"),
        F.max_by("title", F.struct(F.round(F.col("w") * F.abs("polarity"), 9), "uid")).alias("top_headline"),
    )
    return finish_signal(g, cfg)


def finish_signal(g: DataFrame, cfg: NewsSettings) -> DataFrame:
    """Signal from the sums of each (as_of, symbol): _num, weight, articles, top_headline."""
    g = g.filter("weight > 0").withColumn("raw_score", F.col("_num") / F.col("weight"))
    n = F.col("articles")
    g = g.withColumn("score", clip(F.col("raw_score") * (n / (n + cfg.prior_count)), -1.0, 1.0))
    mean = F.avg("score").over(Window.partitionBy("as_of"))
    g = g.withColumn("mean_score", mean)
    g = g.withColumn("relative", clip(F.col("score") - F.col("mean_score"), -1.0, 1.0))
    return g.select("as_of", "symbol", "score", "relative", "raw_score", "articles", "weight", "top_headline", "mean_score")


def macro_signal(ev: DataFrame, cfg: NewsSettings | None = None) -> DataFrame:
    """Per as_of: market tone from symbol-less macro articles, article count
    and the histogram of sources."""
    cfg = cfg or NewsSettings()
    m = (F.size("symbols") == 0) & (F.col("kind") == "macro")
    per_source = ev.groupBy("as_of", "source").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(m, F.col("w") * F.col("polarity"))).alias("_num"),
        F.sum(F.when(m, F.col("w"))).alias("_den"), F.count_if(m).alias("_k"),
    )
    g = per_source.groupBy("as_of").agg(
        F.sum("_n").alias("total_articles"), F.sum("_num").alias("_num"), F.sum("_den").alias("_den"), F.sum("_k").alias("macro_articles"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "_n")))).alias("sources"),
    )
    k = F.col("macro_articles")
    raw = F.coalesce(F.try_divide("_num", "_den"), F.lit(0.0))
    macro = F.when(k > 0, clip(raw * (k / (k + cfg.prior_count)), -1.0, 1.0)).otherwise(F.lit(0.0))
    return g.select("as_of", macro.alias("macro"), "macro_articles", "total_articles", "sources")


def universe_tone(signal: DataFrame) -> DataFrame:
    """Mean score and number of negative names per instant."""
    return signal.groupBy("as_of").agg(
        F.avg("score").alias("mean_score"), F.avg("relative").alias("mean_relative"),
        F.count_if(F.col("score") < 0).alias("n_negative"), F.count(F.lit(1)).alias("n_symbols"),
    )


def strongest(signal: DataFrame, n: int) -> DataFrame:
    """The ``n`` names with the largest absolute relative score."""
    return signal.orderBy(F.desc(F.abs("relative")), "symbol").limit(n)


def signal_json(signal: DataFrame) -> DataFrame:
    """One JSON text per symbol row, numbers to six places."""
    r = [F.round(c, 6).alias(c) for c in ("score", "relative", "raw_score", "weight")]
    return signal.select("symbol", F.to_json(F.struct("symbol", *r, "articles", "top_headline")).alias("json"))


def read_signal_json(text: DataFrame) -> DataFrame:
    """Rows from JSON texts; ``relative`` falls back to ``score`` and an
    unreadable text gives no row."""
    t = "symbol STRING, score DOUBLE, relative DOUBLE, raw_score DOUBLE, articles BIGINT, weight DOUBLE, top_headline STRING"
    # inline keeps the parse behind a generator: filtering parsed fields
    # directly makes the optimizer copy the parse into every inferred filter.
    good = F.filter(F.array(F.from_json("json", t)), lambda x: x["symbol"].isNotNull() & x["score"].isNotNull())
    d = text.select(F.inline(good))
    return d.withColumns(
        {
            "relative": F.coalesce("relative", "score"), "raw_score": F.coalesce("raw_score", "score"),
            "articles": F.coalesce("articles", F.lit(0)), "weight": F.coalesce("weight", F.lit(0.0)),
            "top_headline": F.coalesce("top_headline", F.lit("")),
        }
    )


def news_signal(
    articles: DataFrame, as_of: Column, *, cfg: NewsSettings | None = None, lex: Lexicon | None = None,
    book: NameBook | None = None, universe: list[str] | None = None, label: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(symbol rows, macro row) from raw articles at one instant.

    Copies are merged over all of the past, because an early copy makes a
    story old; only what is left in the look-back is labelled and scored.
    """
    cfg = cfg or NewsSettings()
    d = at_instant(dedupe(articles.filter(F.col("ts") < as_of.cast("timestamp"))), as_of, cfg.max_age_days)
    if label:
        d = label_articles(d, book, universe)
    ev = evidence(score_articles(d, lex), cfg)
    return symbol_signal(ev, cfg), macro_signal(ev, cfg)
