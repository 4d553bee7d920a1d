"""The standing chains: bars to coefficients, bars to costed fills, articles to a published signal."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.text import Lexicon, NameBook, label_articles, score_articles
from tickloom.operators import alpha, decisions, evaluate, panel, positions, sizing
from tickloom.operators import news as N
from tickloom.settings import AlphaSettings, CostSettings, NewsSettings, SizingSettings
from tickloom.sources.news_store import append_articles, articles_since, publish_signal, signal_document


def research(bars: DataFrame, bench: DataFrame, *, score: Column, horizon: int = 20) -> tuple[DataFrame, DataFrame]:
    """(coefficient per date, summary) of a score over the panel's columns."""
    p = panel.build_panel(bars, bench, horizon=horizon)
    ic = evaluate.rank_ic(p.select("ts", "symbol", score.alias("score"), "target"))
    return ic, evaluate.ic_summary(ic)


def weights(
    bars: DataFrame, news: DataFrame | None = None, *, alpha_cfg: AlphaSettings | None = None,
    sizing_cfg: SizingSettings | None = None, news_cfg: NewsSettings | None = None, min_breadth: int = 20,
) -> DataFrame:
    """Target weights per bar; ``news`` has ts, symbol, relative, macro, age_days."""
    s = alpha.score_cross_section(bars, alpha_cfg, min_breadth=min_breadth)
    if news is not None:
        s = alpha.apply_news(s.join(news, ["ts", "symbol"], "left"), news_cfg)
    return sizing.target_weights(s, sizing_cfg)


def fills(
    targets: DataFrame, current: DataFrame, bars: DataFrame, equity: Column, *, sizing_cfg: SizingSettings | None = None,
    cost_cfg: CostSettings | None = None,
) -> DataFrame:
    """Costed fills of the trades that pass the band, at the next bar's close.

    ``current`` has ts, symbol, weight and quantity; ``equity`` is a column
    over those, taken from the ledger.
    """
    c = decisions.classify(decisions.align_targets(targets, current), sizing_cfg).filter("trade")
    held = current.select("ts", "symbol", "quantity")
    d = c.join(held, ["ts", "symbol"], "left").join(bars.select("symbol", "ts", F.col("close").alias("_px")), ["symbol", "ts"])
    delta = decisions.share_delta(F.col("target"), equity, F.col("_px"), F.coalesce(F.col("quantity"), F.lit(0.0)))
    orders = d.select("symbol", "ts", "reason", delta.alias("quantity")).filter("quantity <> 0")
    due = decisions.next_bar_fill(orders, bars, price="close").filter("fill_ts IS NOT NULL")
    return positions.costed_fills(due.drop("ts", "fill_price").withColumnRenamed("fill_ts", "ts"), positions.bar_context(bars), cost_cfg)


def news(
    spark: SparkSession, articles: DataFrame, root: str, as_of: str, *, cfg: NewsSettings | None = None, lex: Lexicon | None = None,
    book: NameBook | None = None, universe: list[str] | None = None, label: bool = True,
) -> int:
    """Collected articles to a published signal: dedupe, label, archive, read back, score, publish.

    The signal is rebuilt from the archive over the look-back, not from what was
    just collected.  Returns the number of newly archived articles; a second run
    over the same articles archives none and publishes the same document.
    """
    cfg = cfg or NewsSettings()
    now = F.lit(as_of).cast("timestamp")
    d = N.dedupe(articles.filter(F.col("ts") < now))
    if label:
        d = label_articles(d, book, universe)
    added = append_articles(spark, root, d.withColumn("collected_at", now))
    since = datetime.fromisoformat(as_of) - timedelta(days=cfg.max_age_days + 1)
    usable = N.at_instant(articles_since(spark, root, since.isoformat(sep=" ")), now, cfg.max_age_days)
    ev = N.evidence(score_articles(usable, lex), cfg)
    publish_signal(signal_document(N.symbol_signal(ev, cfg), N.macro_signal(ev, cfg)), f"{root}/signal")
    return added
