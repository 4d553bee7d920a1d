"""Cross-sectional panel, rank IC and its evaluation."""

from pyspark.sql import functions as F

from tickloom.catalog.base import query, tidy
from tickloom.catalog.features import W, full
from tickloom.catalog.sqlbits import BARS, BENCH, day, drawn
from tickloom.operators import evaluate as E
from tickloom.operators import panel as P
from tickloom.sources import tables as T

H = 20


def raw_panel_sql(h: int = H) -> str:
    return f"""{BARS}, {BENCH},
    bf AS (SELECT ts, lead(close, {h}) OVER (ORDER BY ts) / close - 1 AS bench_fwd FROM bench),
    r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, close * volume AS dv FROM bars {W}),
    p0 AS (SELECT symbol, ts, close / lag(close, 21) OVER w - 1 AS mom_1m, close / lag(close, 63) OVER w - 1 AS mom_3m,
        lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS mom_12m,
        {full('stddev_samp(ret)', 'ret', 20)} AS vol_20d, {full('stddev_samp(ret)', 'ret', 60)} AS vol_60d,
        {full('avg(dv)', 'dv', 20)} AS adv_20d, lead(close, {h}) OVER w / close - 1 AS fwd FROM r {W}),
    p1 AS (SELECT p0.*, bench_fwd, CASE WHEN mom_3m IS NOT NULL THEN
        ((rank() OVER (PARTITION BY ts ORDER BY mom_3m NULLS LAST) + (count(*) OVER (PARTITION BY ts, mom_3m) - 1) / 2.0) - 1)
        / greatest(count(mom_3m) OVER (PARTITION BY ts) - 1, 1) END AS cross_sectional_rank
      FROM p0 LEFT JOIN bf USING (ts)),
    panel AS (SELECT ts, symbol, mom_1m, mom_3m, mom_12m, vol_20d, vol_60d, adv_20d, cross_sectional_rank, fwd - bench_fwd AS target
      FROM p1 WHERE mom_1m IS NOT NULL AND mom_3m IS NOT NULL AND mom_12m IS NOT NULL AND vol_20d IS NOT NULL
        AND vol_60d IS NOT NULL AND adv_20d IS NOT NULL AND cross_sectional_rank IS NOT NULL)"""


PANEL = raw_panel_sql()


def avg_rank(c: str, by: str = "ts") -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"


def ic_sql(src: str, by: str = "ts", name: str = "ic") -> str:
    return f"""{name}_r AS (SELECT {by}, {avg_rank('score', by)} AS rs, {avg_rank('target', by)} AS rt FROM {src} WHERE target IS NOT NULL),
    {name} AS (SELECT {by}, covar_samp(rs, rt) / nullif(stddev_samp(rs) * stddev_samp(rt), 0) AS ic
      FROM {name}_r GROUP BY {by} HAVING count(*) >= 5 AND covar_samp(rs, rt) / nullif(stddev_samp(rs) * stddev_samp(rt), 0) IS NOT NULL)"""


SCORES = f"{PANEL}, scores AS (SELECT ts, symbol, mom_3m AS score, target FROM panel)"
IC = f"{SCORES}, {ic_sql('scores')}"
SUMMARY = """count(ic) AS n_days, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std,
  round(avg(ic) / stddev_samp(ic), 6) AS stability, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS t_stat,
  round(avg(CAST(ic > 1e-12 AS DOUBLE)), 6) AS frac_positive"""


def panel(spark, d, h=H):
    return P.build_panel(T.daily_bars(spark, d), T.benchmark(spark, d), horizon=h)


def scores(spark, d):
    return panel(spark, d).select("ts", "symbol", F.col("mom_3m").alias("score"), "target")


def ic(spark, d):
    return E.rank_ic(scores(spark, d))


@query(
    "factor_panel", "C22 W14 W15 W16 W17 W18 J1 D4 O1",
    f"WITH {PANEL} SELECT {day('ts')} AS ts, symbol, "
    + ", ".join(f"round({c}, {2 if c == 'adv_20d' else 6}) AS {c}" for c in [*P.FEATURES, "target"]) + " FROM panel",
)
def _(spark, d):
    return tidy(panel(spark, d), adv_20d=2)


@query("rank_ic_by_date", "A1 W18 D7", f"WITH {IC} SELECT {day('ts')} AS ts, round(ic, 6) AS ic FROM ic")
def _(spark, d):
    return tidy(ic(spark, d))


@query("ic_summary", "A2", f"WITH {IC} SELECT {SUMMARY} FROM ic")
def _(spark, d):
    return tidy(E.ic_summary(ic(spark, d)))


@query(
    "ic_by_year", "A3 F14",
    f"WITH {IC} SELECT coalesce(CAST(year(ts) AS VARCHAR), 'all') AS year, round(avg(ic), 6) AS mean, count(*) AS n_days FROM ic GROUP BY ROLLUP (year(ts))",
)
def _(spark, d):
    return tidy(E.ic_by_year(ic(spark, d)))


def shuffled_sql(src: str, by: str = "ts", name: str = "shuffled") -> str:
    """Targets dealt anew inside each group, in the order of a seeded hash."""
    return f"""{name}_s AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY symbol) AS slot,
      row_number() OVER (PARTITION BY {by} ORDER BY {drawn(7, *by.split(', '), 'symbol')}, symbol) AS draw FROM {src}),
    {name} AS (SELECT a.* EXCLUDE (target, slot, draw), b.target FROM {name}_s a JOIN {name}_s b ON a.slot = b.draw AND {' AND '.join(f'a.{c} = b.{c}' for c in by.split(', '))})"""


@query("shuffled_targets", "W35 F11", f"WITH {SCORES}, {shuffled_sql('scores')} SELECT {day('ts')} AS ts, symbol, round(score, 6) AS score, round(target, 6) AS target FROM shuffled")
def _(spark, d):
    return tidy(P.shuffle_targets(scores(spark, d)))


@query(
    "shuffled_target_marginals", "W35",
    f"WITH {SCORES} SELECT {day('ts')} AS ts, count(target) AS n, round(sum(target), 6) AS total, round(min(target), 6) AS low, round(max(target), 6) AS high FROM scores GROUP BY ts",
)
def _(spark, d):
    s = P.shuffle_targets(scores(spark, d))
    return tidy(s.groupBy("ts").agg(F.count("target").alias("n"), F.sum("target").alias("total"), F.min("target").alias("low"), F.max("target").alias("high")))


@query(
    "go_no_go", "A4 W35",
    f"""WITH {IC}, {shuffled_sql('scores')}, {ic_sql('shuffled', name='nic')}, n AS (SELECT avg(ic) AS null_mean FROM nic)
    SELECT {SUMMARY}, round(any_value(null_mean), 6) AS null_mean, CAST(avg(ic) >= 0.02 AND avg(ic) / stddev_samp(ic) > 0.15 AS BIGINT) AS go, CAST(abs(any_value(null_mean)) < 0.01 AS BIGINT) AS leak_free FROM ic, n""",
)
def _(spark, d):
    s = scores(spark, d)
    null = E.ic_summary(E.rank_ic(P.shuffle_targets(s)))
    return tidy(E.verdict(E.ic_summary(E.rank_ic(s)), null))


@query(
    "go_no_go_planted", "A4",
    f"""WITH {SCORES}, pl AS (SELECT ts, symbol, target + score * 0.5 AS score, target FROM scores), {ic_sql('pl', name='pic')},
    s AS (SELECT avg(ic) AS mean, avg(ic) / stddev_samp(ic) AS stability FROM pic), {ic_sql('scores', name='nic')},
    n AS (SELECT avg(ic) AS null_mean FROM nic)
    SELECT round(mean, 6) AS mean, round(stability, 6) AS stability, CAST(mean >= 0.02 AND stability > 0.15 AS BIGINT) AS go,
      round(null_mean, 6) AS null_mean, CAST(abs(null_mean) < 0.01 AS BIGINT) AS leak_free FROM s, n""",
)
def _(spark, d):
    s = scores(spark, d)
    planted = s.withColumn("score", F.col("target") + F.col("score") * 0.5)
    v = E.verdict(E.ic_summary(E.rank_ic(planted)), E.ic_summary(E.rank_ic(s)))
    return tidy(v.select("mean", "stability", "go", "null_mean", "leak_free"))


_A = "(1 - exp(-ln(2.0) / 30))"
HEALTH = f"""{IC}, h0 AS (SELECT ts, ic, row_number() OVER (ORDER BY ts) AS rn, lag(ic, 20) OVER (ORDER BY ts) AS x FROM ic),
  hz AS (SELECT 0::BIGINT AS rn, 0.0::DOUBLE AS num, 0.0::DOUBLE AS den UNION ALL
    SELECT h0.rn, hz.num * (1 - {_A}) + {_A} * coalesce(x, 0), hz.den * (1 - {_A}) + {_A} * CAST(x IS NOT NULL AS DOUBLE)
    FROM hz JOIN h0 ON h0.rn = hz.rn + 1),
  health AS (SELECT ts, ic, CASE WHEN rn - 20 >= 20 THEN num / den END AS h_real FROM h0 JOIN hz USING (rn)),
  gm AS (SELECT *, count(h_real) OVER o AS k, sum(h_real) OVER o / nullif(count(h_real) OVER o, 0) AS m,
         sum(h_real * h_real) OVER o / nullif(count(h_real) OVER o, 0) AS q FROM health WINDOW o AS (ORDER BY ts)),
  gate AS (SELECT ts, ic, h_real, CASE WHEN h_real IS NOT NULL AND k >= 2 THEN greatest(0, least(1, (1 / (1 + exp(-(
      CASE WHEN sqrt(greatest(q - m * m, 0)) > 1e-12 THEN (h_real - m) / sqrt(greatest(q - m * m, 0)) ELSE 0 END))) - 0.3) / 0.4)) END AS g FROM gm)"""


def gate(spark, d):
    return E.gate_signal(E.health_index(ic(spark, d), horizon=20))


@query(
    "health_and_gate", "W24 W25 W34",
    f"WITH RECURSIVE {HEALTH} SELECT {day('ts')} AS ts, round(ic, 6) AS ic, round(h_real, 6) AS h_real, round(g, 5) AS g, "
    "CAST(g IS NULL OR g >= 0.2 AS BIGINT) AS trade FROM gate",
)
def _(spark, d):
    return tidy(gate(spark, d).withColumn("trade", E.should_trade(F.col("g"))), g=5)


@query(
    "abstention_share", "A5",
    f"WITH RECURSIVE {HEALTH} SELECT round(avg(CAST(g < 0.2 AS DOUBLE)), 6) AS abstain_share, count(*) AS n_days FROM gate WHERE g IS NOT NULL",
)
def _(spark, d):
    return tidy(E.abstention_share(gate(spark, d)))


_EXT = f"""{BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, close * volume AS dv FROM bars {W}),
  e AS (SELECT ts, symbol, -(close / lag(close, 5) OVER w - 1) AS reversal_5d, close / ({full('max(close)', 'close', 252)}) AS high_52w,
    (close / lag(close, 63) OVER w - 1) / ({full('stddev_samp(ret)', 'ret', 60)}) AS mom_vol, ln({full('avg(dv)', 'dv', 20)}) AS log_adv FROM r {W}),
  e2 AS (SELECT * FROM e WHERE reversal_5d IS NOT NULL AND high_52w IS NOT NULL AND mom_vol IS NOT NULL AND log_adv IS NOT NULL)"""


def zsql(c: str, by: str = "ts", k: float = 3.0) -> str:
    x = f"OVER (PARTITION BY {by})"
    return (f"CASE WHEN count({c}) {x} >= 2 AND stddev_pop({c}) {x} > 0 AND {c} IS NOT NULL THEN "
            f"greatest(-{k}, least({k}, ({c} - avg({c}) {x}) / stddev_pop({c}) {x})) ELSE 0 END")


@query(
    "extended_panel", "C23 W19",
    f"WITH {_EXT} SELECT {day('ts')} AS ts, symbol, "
    + ", ".join(f"round({c}, 6) AS {c}, round({zsql(c)}, 5) AS {c}_z" for c in ("reversal_5d", "high_52w", "mom_vol", "log_adv"))
    + " FROM e2",
)
def _(spark, d):
    p = P.extended_panel(T.daily_bars(spark, d), T.benchmark(spark, d))
    return tidy(p, **{f"{c}_z": 5 for c in ("reversal_5d", "high_52w", "mom_vol", "log_adv")})


HS = [1, 3, 5, 10, 20]
_HSQL = f"""{BARS}, {BENCH}, bl AS (SELECT ts, {', '.join(f'lead(close, {h}) OVER (ORDER BY ts) / close - 1 AS b{h}' for h in HS)} FROM bench),
  m AS (SELECT symbol, ts, close / lag(close, 63) OVER w - 1 AS score, {', '.join(f'lead(close, {h}) OVER w / close - 1 AS f{h}' for h in HS)} FROM bars {W}),
  long AS ({' UNION ALL '.join(f'SELECT {h} AS h, ts, symbol, score, f{h} - b{h} AS target FROM m LEFT JOIN bl USING (ts) WHERE score IS NOT NULL' for h in HS)})"""


@query("ic_by_horizon", "C24 J18", f"WITH {_HSQL}, {ic_sql('long', 'h, ts')} SELECT h, {SUMMARY} FROM ic GROUP BY h")
def _(spark, d):
    return tidy(E.horizon_ic(P.horizon_panel(T.daily_bars(spark, d), T.benchmark(spark, d), HS)))


@query(
    "horizon_experiment", "C24 J18 W35",
    f"""WITH {_HSQL}, {ic_sql('long', 'h, ts')}, {shuffled_sql('long', 'h, ts')}, {ic_sql('shuffled', 'h, ts', 'nic')},
    n AS (SELECT h, round(avg(ic), 6) AS null_mean, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS null_t_stat FROM nic GROUP BY h), s AS (SELECT h, {SUMMARY} FROM ic GROUP BY h)
    SELECT * FROM s JOIN n USING (h)""",
)
def _(spark, d):
    return tidy(E.horizon_experiment(P.horizon_panel(T.daily_bars(spark, d), T.benchmark(spark, d), HS)))


@query("model_health_means", "C27 A40", f"""WITH {SCORES}, c AS (SELECT ts, greatest(-1, least(1, score)) AS score FROM scores),
    s AS (SELECT ts, avg(CAST(abs(score) > 0.99 AS DOUBLE)) AS f, stddev_pop(abs(score)) AS k FROM c GROUP BY ts)
    SELECT count(*) AS n_days, round(avg(k), 6) AS mean_conviction_std, round(avg(f), 6) AS mean_frac_saturated, round(arg_max(k, ts), 6) AS last_conviction_std,
      round(avg(CAST(f > 0.5 OR k < 0.05 AS DOUBLE)), 6) AS alarm_share FROM s""")
def _(spark, d):
    s = scores(spark, d).withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))))
    return tidy(E.model_health(E.score_saturation(s)))


@query(
    "score_saturation", "A40",
    f"""WITH {SCORES}, c AS (SELECT ts, greatest(-1, least(1, score)) AS score FROM scores)
    SELECT {day('ts')} AS ts, round(avg(CAST(abs(score) > 0.99 AS DOUBLE)), 6) AS frac_saturated, round(stddev_pop(abs(score)), 6) AS conviction_std,
      CAST(avg(CAST(abs(score) > 0.99 AS DOUBLE)) > 0.5 OR stddev_pop(abs(score)) < 0.05 AS BIGINT) AS alarm FROM c GROUP BY ts""",
)
def _(spark, d):
    s = scores(spark, d).withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))))
    return tidy(E.score_saturation(s))
