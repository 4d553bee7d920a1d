"""Rank information coefficients, their summary, health index and gate."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, safe_div
from tickloom.operators.panel import average_rank, shuffle_targets
from tickloom.operators.series import RN, Blocks, calendar_chunk, ewm_lookback, prefix_scan
from tickloom.settings import ewm_alpha

VAR_EPS = 1e-12
# A coefficient within rounding of zero is not positive.
ZERO_IC = 1e-12


def correlation(x: Column, y: Column) -> Column:
    """Pearson aggregate, NULL instead of an error for a constant side."""
    return safe_div(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def rank_ic(scores: DataFrame, *, by: list[str] | None = None, min_names: int = 5) -> DataFrame:
    """Spearman correlation of score and matured target per date."""
    by = by or ["ts"]
    d = scores.dropna(subset=["target"]).repartition(*by)
    d = d.withColumns({"_rs": average_rank(F.col("score"), by), "_rt": average_rank(F.col("target"), by)})
    ic = d.groupBy(*by).agg(correlation(F.col("_rs"), F.col("_rt")).alias("ic"), F.count(F.lit(1)).alias("_n"))
    return ic.filter(F.col("_n") >= min_names).drop("_n").dropna(subset=["ic"])


def ic_columns() -> dict[str, Column]:
    ic = F.col("ic")
    n = F.count(ic)
    sd = F.coalesce(F.stddev_samp(ic), F.lit(0.0))
    mean = F.coalesce(F.avg(ic), F.lit(0.0))
    return {
        "n_days": n,
        "mean": mean,
        "std": sd,
        "stability": F.when(sd > 0, mean / sd).otherwise(F.lit(0.0)),
        "t_stat": F.when(sd > 0, mean / (sd / F.sqrt(n))).otherwise(F.lit(0.0)),
        "frac_positive": F.coalesce(F.avg((ic > ZERO_IC).cast("double")), F.lit(0.0)),
    }


def ic_summary(ic: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """Days, mean, sigma, stability, t statistic and share positive."""
    return ic.groupBy(*(by or [])).agg(*[c.alias(n) for n, c in ic_columns().items()])


def ic_by_year(ic: DataFrame) -> DataFrame:
    """Mean IC and days per year plus the overall row, in one pass."""
    y = ic.withColumn("year", F.year("ts"))
    return y.rollup("year").agg(F.avg("ic").alias("mean"), F.count(F.lit(1)).alias("n_days")).withColumn(
        "year", F.coalesce(F.col("year").cast("string"), F.lit("all"))
    )


def verdict(summary: DataFrame, null_summary: DataFrame) -> DataFrame:
    """Go when mean >= 0.02 and stability > 0.15; clean when the null IC is small."""
    null_mean = null_summary.select("mean").scalar()
    d = summary.withColumn("null_mean", null_mean)
    return d.withColumns(
        {
            "go": (F.col("mean") >= 0.02) & (F.col("stability") > 0.15),
            "leak_free": F.abs("null_mean") < 0.01,
        }
    )


def health_index(ic: DataFrame, *, horizon: int, half_life: float = 30.0, min_periods: int = 20) -> DataFrame:
    """Exponential mean (bias-adjusted) of the IC lagged by ``horizon`` rows."""
    alpha = ewm_alpha(half_life=half_life)
    b = Blocks.lay(ic.select("ts", "ic"), [], ["ts"], lookback=ewm_lookback(alpha) + horizon, block_rows=4096)
    b = b.add(_x=b.lag(F.col("ic"), horizon))
    have = F.when(F.col("_x").isNotNull(), F.lit(1.0))
    num, den = b.ewm(F.col("_x"), alpha, seed="zero"), b.ewm(have, alpha, seed="zero")
    b = b.add(_num=num, _den=den)
    d = b.close(keep_rn=True)
    ready = F.col(RN) + 1 - horizon >= min_periods
    return d.select("ts", "ic", F.when(ready, F.col("_num") / F.col("_den")).alias("h_real"))


def gate_signal(health: DataFrame, *, chunk_days: int = 512) -> DataFrame:
    """Trust in [0, 1] from the expanding z-score of ``h_real``."""
    h = F.col("h_real")
    s = prefix_scan(
        health, [], ["ts"], calendar_chunk("ts", chunk_days),
        sums={"_k": h.isNotNull().cast("double"), "_s1": h, "_s2": h * h},
    )
    mean = safe_div(F.col("_s1"), F.col("_k"))
    sd = F.sqrt(F.greatest(safe_div(F.col("_s2"), F.col("_k")) - mean * mean, F.lit(0.0)))
    z = F.when(sd > 1e-12, safe_div(h - mean, sd)).otherwise(F.lit(0.0))
    g = clip((1.0 / (1.0 + F.exp(-z)) - 0.3) / 0.4, 0.0, 1.0)
    return s.withColumn("g", F.when(h.isNotNull() & (F.col("_k") >= 2), g)).drop("_k", "_s1", "_s2")


def should_trade(g: Column, threshold: float = 0.2) -> Column:
    """No gate value yet reads as trade."""
    return g.isNull() | (g >= threshold)


def abstention_share(gated: DataFrame, threshold: float = 0.2) -> DataFrame:
    known = gated.dropna(subset=["g"])
    return known.agg(
        F.coalesce(F.avg((F.col("g") < threshold).cast("double")), F.lit(0.0)).alias("abstain_share"),
        F.count(F.lit(1)).alias("n_days"),
    )


def differential_sharpe(returns: DataFrame, *, keys: list[str], eta: float = 0.01) -> DataFrame:
    """Differential Sharpe ratio per bar and the running exponential Sharpe.

    First and second moments are two exponential scans from zero; the ratio
    uses the moments before the bar.
    """
    b = Blocks.lay(returns, keys, ["ts"], lookback=ewm_lookback(eta) + 1, block_rows=8192)
    r = F.col("ret")
    b = b.add(_A=b.ewm(r, eta, seed="zero"), _B=b.ewm(r * r, eta, seed="zero"))
    b = b.add(_A0=F.coalesce(b.lag(F.col("_A"), 1), F.lit(0.0)), _B0=F.coalesce(b.lag(F.col("_B"), 1), F.lit(0.0)))
    A0, B0 = F.col("_A0"), F.col("_B0")
    dA, dB = r - A0, r * r - B0
    v0 = B0 - A0 * A0
    den = F.pow(F.greatest(v0, F.lit(VAR_EPS)), F.lit(1.5))
    idle = (F.col(RN) == 0) | (v0 <= VAR_EPS)
    d = F.when(idle, F.lit(0.0)).otherwise(clip((B0 * dA - 0.5 * A0 * dB) / den, -1e6, 1e6))
    var = F.col("_B") - F.col("_A") * F.col("_A")
    sharpe = F.when(var > VAR_EPS, F.col("_A") / F.sqrt(F.greatest(var, F.lit(VAR_EPS)))).otherwise(F.lit(0.0))
    return b.add(dsr=d, ew_sharpe=sharpe).close().drop("_A", "_B", "_A0", "_B0")


def horizon_ic(panel: DataFrame) -> DataFrame:
    """IC summary per horizon of a long (h, ts, symbol, score, target) panel."""
    return ic_summary(rank_ic(panel, by=["h", "ts"]), by=["h"])


def horizon_experiment(panel: DataFrame, *, seed: int = 7) -> DataFrame:
    """IC summary per horizon beside that of targets shuffled inside each horizon and date."""
    null = ic_summary(rank_ic(shuffle_targets(panel, seed=seed, by=["h", "ts"]), by=["h", "ts"]), by=["h"])
    return horizon_ic(panel).join(null.select("h", F.col("mean").alias("null_mean"), F.col("t_stat").alias("null_t_stat")), "h")


def model_health(saturation: DataFrame) -> DataFrame:
    """Means over all dates of the saturation monitor, the last spread and the share of alarms: one row."""
    return saturation.agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("conviction_std").alias("mean_conviction_std"), F.avg("frac_saturated").alias("mean_frac_saturated"),
        F.max_by("conviction_std", "ts").alias("last_conviction_std"), F.avg(F.col("alarm").cast("double")).alias("alarm_share"),
    )


def score_saturation(scores: DataFrame) -> DataFrame:
    """Share of saturated convictions and their spread per date, with alarms."""
    a = F.abs("score")
    d = scores.groupBy("ts").agg(
        F.avg((a > 0.99).cast("double")).alias("frac_saturated"), F.stddev_pop(a).alias("conviction_std")
    )
    return d.withColumn("alarm", (F.col("frac_saturated") > 0.5) | (F.col("conviction_std") < 0.05))
