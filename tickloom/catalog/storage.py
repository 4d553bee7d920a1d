"""Stores, histories, artefacts, folds, model scores and noise bars."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.catalog.base import query, tidy
from tickloom.catalog.panel import IC, PANEL, panel, scores
from tickloom.catalog.performance import CURVE, curve
from tickloom.catalog.sqlbits import BARS, day, uniform, with_
from tickloom.functions.columns import json_safe
from tickloom.operators import evaluate as E
from tickloom.operators import folds as K
from tickloom.operators import panel as P
from tickloom.operators.series import RN
from tickloom.session import fresh
from tickloom.sources import bars as B
from tickloom.sources import noise as Z
from tickloom.sources import state as S
from tickloom.sources import tables as T


@query(
    "bar_store_upsert", "S5 S6 S7 D1 ST4",
    f"""{with_(BARS)} SELECT symbol, CAST(year(ts) AS BIGINT) AS year, count(*) AS n_bars, round(sum(CASE WHEN year(ts) = 1997 THEN close * 2 ELSE close END), 4) AS close_sum
    FROM bars GROUP BY 1, 2""",
)
def _(spark, d):
    root = fresh(spark, "store")
    b = T.daily_bars(spark, d).withColumn("seq", F.lit(0))
    B.upsert(spark, root, b, seq="seq", validate_quality=False)
    late = b.filter(F.year("ts") == 1997).withColumn("close", F.col("close") * 2)
    B.upsert(spark, root, late, seq="seq", validate_quality=False)
    q = B.sql_over_store(spark, root, "SELECT symbol, year(ts) AS year, count(*) AS n_bars, sum(close) AS close_sum FROM bars GROUP BY 1, 2")
    return tidy(q, close_sum=4)


def csv_files(df, path):
    """Write lines (file, line, ord) as one file each: partitions first, then renamed in place."""
    df.repartition("file").sortWithinPartitions("file", "ord").select("file", "line").write.partitionBy("file").text(path + "-parts")
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path + "-parts")
    fs = root.getFileSystem(conf)
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(path))
    for part in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "file=*/part-*")):
        name = part.getPath().getParent().getName().removeprefix("file=")
        fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(path, name + ".csv"))


@query(
    "csv_bars", "S2 S3 U1",
    f"""{with_(BARS)}, b AS (SELECT upper(replace(symbol, '#', '.')) AS symbol, ts, round(close, 6) AS close, volume FROM bars WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1997-12-31')
    SELECT symbol, {day('ts')} AS ts, round(close, 5) AS close, round(CASE WHEN CAST(substr(symbol, 7) AS INT) % 2 = 0 THEN close / 2 ELSE close END, 5) AS adj_close, volume, 0 AS corrupt FROM b
    UNION ALL SELECT DISTINCT upper(replace(symbol, '#', '.')), NULL, NULL, NULL, NULL, 1 FROM bars""",
)
def _(spark, d):
    """A file a brand; every second has other columns in another order; each ends in a bad line."""
    path = fresh(spark, "csv")
    b = T.daily_bars(spark, d)
    file, r = F.replace("symbol", F.lit("#"), F.lit(".")), lambda c: F.round(F.col(c) + 1e-9, 6).cast("string")
    other = F.split("symbol", "#")[1].cast("int") % 2 == 0
    one = F.concat_ws(",", F.col("ts").cast("string"), r("open"), r("high"), r("low"), r("close"), F.col("volume").cast("string"))
    two = F.concat_ws(",", F.col("volume").cast("string"), r("close"), F.col("ts").cast("string"), (F.round(F.col("close") + 1e-9, 6) / 2).cast("string"), r("low"))
    lines = b.select(file.alias("file"), F.when(other, two).otherwise(one).alias("line"), F.date_format("ts", "yyyyMMdd").alias("ord"))
    names = b.select("symbol").distinct()
    head = F.when(other, "Volume,Close,Date,Adj Close,Low").otherwise("Date,Open,High,Low,Close,Volume")
    heads = names.select(file.alias("file"), head.alias("line"), F.lit("").alias("ord"))
    tails = names.select(file.alias("file"), F.lit("n/a,n/a,n/a").alias("line"), F.lit("z").alias("ord"))
    csv_files(lines.unionByName(heads).unionByName(tails), path)
    good, bad = B.load_many([B.read_csv_bars(spark, path, start="1996-01-01", end="1997-12-31")])
    out = good.withColumn("corrupt", F.lit(0)).unionByName(bad.filter("_corrupt IS NOT NULL").withColumn("corrupt", F.lit(1)))
    return tidy(out.select("symbol", "ts", "close", "adj_close", "volume", "corrupt"), 5)


@query(
    "history_append", "S10 S11 U2",
    f"""WITH {CURVE} SELECT strategy, count(*) AS n_rows, count(turnover) FILTER (ts >= DATE '1998-01-01') AS n_new, round(sum(n_positions), 3) AS positions FROM curve GROUP BY strategy""",
)
def _(spark, d):
    path = fresh(spark, "history")
    c = curve(spark, d)
    S.replace_history(path, c.filter("ts < '1998-01-01'").select("strategy", "ts", "equity", F.col("n_positions").cast("double").alias("n_positions")))
    S.append_history(path, c.filter("ts >= '1998-01-01'").select("strategy", "ts", "equity", "n_positions", "turnover"))
    h = S.read_history(spark, path)
    return tidy(h.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_rows"), F.count("turnover").alias("n_new"), F.sum("n_positions").alias("positions")), 3)


@query(
    "relaxed_union", "U2 S10",
    f"""WITH {CURVE} SELECT strategy, round(sum(CAST(n_positions AS DOUBLE)), 3) AS positions, count(*) AS n_rows FROM curve GROUP BY strategy""",
)
def _(spark, d):
    c = curve(spark, d)
    u = S.relaxed_union(c.filter("ts < '1998-01-01'").withColumn("n_positions", F.col("n_positions").cast("double")), c.filter("ts >= '1998-01-01'").drop("turnover"))
    return tidy(u.groupBy("strategy").agg(F.sum("n_positions").alias("positions"), F.count(F.lit(1)).alias("n_rows")), 3)


@query("trial_ledger", "S12 D17", "SELECT count(DISTINCT o_orderpriority) + count(DISTINCT o_orderstatus) AS n_trials FROM orders")
def _(spark, d):
    path = fresh(spark, "trials")
    o = T.table(spark, d, "orders")
    S.log_trials(path, o.select(F.col("o_orderpriority").alias("command")).distinct())
    S.log_trials(path, o.select(F.col("o_orderstatus").alias("command")).distinct())
    return tidy(S.count_trials(spark, path))


@query(
    "run_artefacts", "S13 S14 S16 S19",
    f"WITH {CURVE} SELECT strategy, {day('ts')} AS ts, round(equity, 4) AS equity FROM curve WHERE day(ts) = 1",
)
def _(spark, d):
    path = fresh(spark, "run")
    c = curve(spark, d)
    S.write_run(path, metrics=c.groupBy("strategy").agg(F.avg("equity").alias("mean")), trades=c.filter(F.dayofmonth("ts") == 1), equity=c, name="check")
    back = spark.read.option("header", True).schema("strategy STRING, ts STRING, equity DOUBLE").csv(path + "/trades_csv")
    return tidy(back, 4)


@query("json_safe_export", "S16 O5", f"WITH {CURVE} SELECT strategy, {day('ts')} AS ts, CASE WHEN n_positions % 2 = 0 THEN round(equity, 4) END AS equity FROM curve ORDER BY curve.ts DESC, strategy LIMIT 800")
def _(spark, d):
    c = curve(spark, d)
    e = F.when(F.col("n_positions") % 2 == 0, F.col("equity")).otherwise(F.lit(float("inf")))
    return tidy(json_safe(S.newest(c.select("strategy", "ts", e.alias("equity")), 800, tie=["strategy"])), 4)


@query("universe_resolution", "P18 U5 D18", "SELECT symbol FROM (SELECT DISTINCT upper(trim(p_brand)) AS symbol FROM part UNION SELECT DISTINCT upper(p_type) FROM part)")
def _(spark, d):
    p = T.table(spark, d, "part")
    return S.resolve_universe(p.select(F.lower("p_brand").alias("symbol")).distinct(), p.select(F.col("p_type").alias("symbol")).distinct())


@query(
    "inception_rollover", "C29",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS account, CASE WHEN min(o_orderdate) < DATE '1995-02-01' THEN 'retired' ELSE 'live' END AS status,
      CAST(c_custkey AS VARCHAR) || '@' || strftime(min(o_orderdate), '%Y%m%d') AS book_id FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
)
def _(spark, d):
    o = T.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("account")).agg(F.to_date(F.min("o_orderdate")).alias("inception"))
    o = o.join(T.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("account")), "account", "left_semi")
    return tidy(S.roll_inception(o, floor="1995-02-01").select("account", "status", "book_id"))


_DATES = f"{PANEL}, dts AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS rn FROM (SELECT DISTINCT ts FROM panel))"


@query(
    "walk_forward_folds", "C16 D6 J6 U6",
    f"""WITH {_DATES}, f AS (SELECT CAST(floor((rn - 277) / 21) AS BIGINT) AS fold, min(ts) AS pred_start, max(ts) AS pred_end, min(rn) AS s FROM dts WHERE rn >= 277 GROUP BY 1),
    g AS (SELECT fold, d.ts AS train_end, pred_start, pred_end FROM f JOIN dts d ON d.rn = s - 26)
    SELECT fold, {day('train_end')} AS train_end, {day('pred_start')} AS pred_start, {day('pred_end')} AS pred_end,
      (SELECT count(*) FROM panel p WHERE p.ts <= train_end AND target IS NOT NULL) AS n_train, (SELECT count(*) FROM panel p WHERE p.ts BETWEEN pred_start AND pred_end) AS n_pred FROM g""",
)
def _(spark, d):
    return tidy(K.fold_table(panel(spark, d)))


def index_of_days(spark, d):
    dates = K.date_index(T.benchmark(spark, d))
    return dates, dates.count()


_DAYS = "d AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ts FROM lineitem))"
_GRP = "g AS (SELECT rn, n, ntile({k}) OVER (ORDER BY rn) - 1 AS grp FROM d), b AS (SELECT grp, min(rn) AS lo, max(rn) AS hi FROM g GROUP BY grp)"


@query(
    "purged_kfold", "C18 U6",
    f"""WITH {_DAYS}, {_GRP.format(k=5)} SELECT b.grp AS fold, CASE WHEN rn BETWEEN lo AND hi THEN 'test' ELSE 'train' END AS role, count(*) AS n, min(rn) AS lo, max(rn) AS hi
    FROM d JOIN b ON rn BETWEEN lo AND hi OR rn < lo - 21 OR rn > hi + 42 GROUP BY 1, 2""",
)
def _(spark, d):
    dates, n = index_of_days(spark, d)
    k = K.purged_kfold(dates, n)
    return tidy(k.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min(RN).alias("lo"), F.max(RN).alias("hi")))


@query(
    "combinatorial_purged_paths", "C19",
    f"""WITH {_DAYS}, {_GRP.format(k=6)}, p AS (SELECT row_number() OVER (ORDER BY x.grp, y.grp) - 1 AS path, x.grp AS g1, y.grp AS g2, x.lo AS lo1, x.hi AS hi1, y.lo AS lo2, y.hi AS hi2 FROM b x JOIN b y ON x.grp < y.grp)
    SELECT path, CASE WHEN rn BETWEEN lo1 AND hi1 OR rn BETWEEN lo2 AND hi2 THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM d JOIN p ON rn BETWEEN lo1 AND hi1 OR rn BETWEEN lo2 AND hi2
      OR NOT (rn BETWEEN lo1 - 21 AND hi1 + 42 OR rn BETWEEN lo2 - 21 AND hi2 + 42) GROUP BY 1, 2""",
)
def _(spark, d):
    dates, n = index_of_days(spark, d)
    k = K.combinatorial_purged(dates, n, groups=6, test=2)
    return tidy(k.groupBy("path", "role").agg(F.count(F.lit(1)).alias("n")))


@query("walk_forward_model_ic", "C17 A2 S19")
def _(spark, d):
    p = panel(spark, d)
    folder = fresh(spark, "ranker")
    s = K.walk_forward_scores(spark, p, P.FEATURES, folder + "/fit", refit_every=252, max_iter=20)
    K.write_ranker(folder, s)
    return tidy(E.ic_summary(K.read_ranker(spark, folder)[1]))


@query(
    "noise_bar_grid", "S22 F11",
    f"{with_(BARS)} SELECT symbol, count(*) AS n_bars, count(*) AS n_valid FROM bars GROUP BY symbol",
)
def _(spark, d):
    z = Z.noise_bars(T.daily_bars(spark, d), regimes=True)
    ok = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") > 0) & (F.col("volume") > 0)
    return tidy(z.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.count_if(ok).alias("n_valid")))


def _u(k):
    return uniform(7000 + k, "symbol", "ts")


def _normal(a, b):
    return f"sqrt(-2.0 * ln({_u(a)})) * cos(2.0 * pi() * {_u(b)})"


_WICK = "0.2 * sqrt(1.0 / 252) * 0.5"


@query(
    "noise_bars", "S22 F11",
    f"""{with_(BARS)}, z AS (SELECT symbol, ts, (0 - 0.5 * 0.04) / 252.0 + 0.2 * sqrt(1.0 / 252) * {_normal(1, 2)} AS step, {_u(4)} AS u4, {_u(5)} AS u5, {_u(6)} AS u6, floor(exp(13.0 + 0.5 * {_normal(7, 8)}) + 0.5) AS volume FROM bars),
    c AS (SELECT *, 100.0 * exp(sum(step) OVER (PARTITION BY symbol ORDER BY ts)) AS close FROM z), o AS (SELECT *, close * exp(-step * u4) AS open FROM c)
    SELECT symbol, {day('ts')} AS ts, round(open, 3) AS open, round(greatest(open, close) * (1 + {_WICK} * u5), 3) AS high, round(least(open, close) * (1 - {_WICK} * u6), 3) AS low,
      round(close, 3) AS close, round(close, 3) AS adj_close, round(volume, 3) AS volume FROM o""",
)
def _(spark, d):
    return tidy(Z.noise_bars(T.daily_bars(spark, d)), 3)


@query(
    "watch_list_first", "S17 O6",
    "SELECT upper(p_brand) AS symbol, row_number() OVER (ORDER BY min(p_partkey)) AS place FROM part GROUP BY 1 QUALIFY place <= 12",
)
def _(spark, d):
    """A list of all parts' brands in the order of their keys, with comments and blank lines; its first twelve tickers."""
    path = fresh(spark, "list")
    p = T.table(spark, d, "part")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.lower("p_brand"), F.lit("\t"))).otherwise(F.lower("p_brand"))
    rows = p.select("p_partkey", F.replace(line, F.lit("#"), F.lit("=")).alias("line"))
    notes = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "# note").otherwise("").alias("line"))
    rows.unionByName(notes).orderBy("p_partkey", "line").select("line").write.text(path)
    got = S.read_lines(spark, path, 12)
    out = got.withColumn("place", F.row_number().over(Window.orderBy("file", "line_no")))
    return tidy(out.select(F.replace("symbol", F.lit("="), F.lit("#")).alias("symbol"), "place"))


@query(
    "book_state_load", "S18",
    """SELECT CAST(c_custkey AS VARCHAR) AS account, round(c_acctbal, 2) AS cash, sym.symbol, round(c_custkey % 100 + sym.k, 2) AS quantity, round(10.0 + sym.k, 2) AS avg_price
    FROM customer, (SELECT 'AA' AS symbol, 1 AS k UNION ALL SELECT 'BB', 2) sym""",
)
def _(spark, d):
    """A saved book for every customer, with keys the reader doesn't know."""
    path = fresh(spark, "books")
    c = T.table(spark, d, "customer")
    held = lambda k: F.struct((F.col("c_custkey") % 100 + k).cast("double").alias("quantity"), F.lit(10.0 + k).alias("avg_price"), F.lit("x").alias("note"))
    docs = c.select(F.lit(2).alias("version"), F.lit(True).alias("simulated_capital"), F.col("c_custkey").cast("string").alias("account"), F.col("c_acctbal").cast("double").alias("cash"),
                    F.struct(held(1).alias("AA"), held(2).alias("BB")).alias("positions"), F.lit("later").alias("unknown"))
    docs.write.json(path)
    return tidy(S.load_book(spark, path, version=2, lines=True), 2)


@query(
    "ranker_outputs", "S19 A1",
    f"""WITH {IC} SELECT {day('s.ts')} AS ts, s.symbol, round(s.score, 6) AS score, round(ic, 6) AS ic FROM scores s LEFT JOIN ic USING (ts) WHERE s.target IS NOT NULL""",
)
def _(spark, d):
    """Scores and rank_ic as a ranker's run leaves them, read back."""
    folder = fresh(spark, "ranker")
    K.write_ranker(folder, scores(spark, d).filter("target IS NOT NULL"))
    s, ic = K.read_ranker(spark, folder)
    return tidy(s.join(ic, "ts", "left").select("ts", "symbol", "score", "ic"))
