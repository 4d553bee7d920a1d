"""Bar tables: building, normalising, storing and reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources import versions

BAR_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "adj_close", "volume"]
DATE_NAMES = ("ts", "date", "timestamp")
PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close"]

DAILY_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS[2:]]
)
INTRADAY_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS[2:]]
)


def bars_from_ticks(ticks: DataFrame, *, order: list[str], extra: list[Column] | None = None) -> DataFrame:
    """OHLCV per (symbol, ts) from price/size ticks in a total order.

    One hash aggregate with map-side combine, so a symbol that holds a third
    of the tape still shuffles only one row per task and bar.  A single order
    column of a number type aggregates by hash; a composite one by sort.
    """
    o = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return ticks.groupBy("symbol", "ts").agg(
        F.min_by("price", o).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", o).alias("close"),
        F.sum("size").alias("volume"),
        *(extra or []),
    )


def normalize(df: DataFrame, *, seq: str, intraday: bool = False) -> DataFrame:
    """Canonical bars: required columns, lenient casts, last row per key wins.

    ``seq`` is the ingest order that defines "last".  The newest row is found
    by an aggregate, not a window, so a key repeated many times is combined
    before the shuffle.
    """
    missing = [c for c in BAR_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"bars lack columns {missing}")
    schema = INTRADAY_SCHEMA if intraday else DAILY_SCHEMA
    cast = df.select(*[try_cast(df, f) for f in schema], F.col(seq).alias("_seq"))
    cast = cast.dropna(subset=["symbol", "ts", "close"])
    rest = [c for c in BAR_COLUMNS if c not in ("symbol", "ts")]
    newest = cast.groupBy("symbol", "ts").agg(F.max_by(F.struct(*rest), F.struct("_seq", *rest)).alias("_b"))
    return newest.select("symbol", "ts", *[F.col(f"_b.{c}") for c in rest])


def try_cast(df: DataFrame, f: T.StructField) -> Column:
    """Cast to the field's type; a cell that does not parse becomes NULL."""
    have = df.schema[f.name].dataType
    c = F.col(f.name)
    if have == f.dataType:
        return c
    if isinstance(have, T.StringType):
        c = F.trim(c)
    return c.try_cast(f.dataType).alias(f.name)


# A cell with the comma before it: quoted, with doubled quotes inside, or plain.
CSV_CELL = r',(\s*"(?:[^"]|"")*+"[^,]*+|[^,]*+)'


def csv_cells(line: Column) -> Column:
    """The cells of a line of any width, without outer quotes and blanks."""
    raw = F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CSV_CELL), 1), lambda x: F.trim(x))
    bare = lambda x: F.trim(F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"')))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), bare(x)).otherwise(x))


def read_csv_bars(spark: SparkSession, folder: str, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """One CSV file per symbol; the symbol is the file name without ``.csv``.

    Each file's own header names its columns, in any order and case, blanks as
    underscores; ``adj_close`` falls back to ``close``.  A row whose date or
    close can't be read keeps its text in ``_corrupt``.  A file may have any
    number of columns.
    """
    raw = spark.read.option("pathGlobFilter", "*.csv").text(folder)
    file = F.try_url_decode(F.col("_metadata.file_name"))
    raw = raw.select("value", F.coalesce(file, F.col("_metadata.file_name")).alias("_file")).filter(F.trim("value") != "")
    d = raw.select("_file", "value", csv_cells(F.col("value")).alias("_c"))
    names = F.transform("_c", lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("_")))
    dated = F.arrays_overlap(names, F.array(*map(F.lit, DATE_NAMES)))
    heads = d.filter(dated & F.array_contains(names, "close")).groupBy("_file").agg(F.min("value").alias("_head"), F.min(names).alias("_names"))
    d = d.join(heads, "_file").filter(F.col("value") != F.col("_head"))

    def cell(*wanted: str) -> Column:
        at = F.greatest(*[F.coalesce(F.array_position("_names", w), F.lit(0)) for w in wanted], F.lit(0))
        return F.when(at > 0, F.get("_c", at.cast("int") - 1))

    num = {c: cell(c).try_cast("double") for c in BAR_COLUMNS[2:]}
    ts = cell(*DATE_NAMES).try_cast("date")
    out = d.select(
        F.upper(F.regexp_replace("_file", r"(?i)\.csv$", "")).alias("symbol"),
        ts.alias("ts"),
        *[num[c].alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(num["adj_close"], num["close"]).alias("adj_close"),
        num["volume"].alias("volume"),
        F.when(ts.isNull() | num["close"].isNull(), F.col("value")).alias("_corrupt"),
    )
    corrupt = out.filter(F.col("_corrupt").isNotNull())
    return in_range(out.filter(F.col("_corrupt").isNull()), start, end).unionByName(corrupt)


def load_many(frames: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of per-source frames split into usable rows and a quarantine."""
    if not frames:
        raise ValueError("no source could be loaded")
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    bad = F.col("symbol").isNull() | F.col("ts").isNull() | F.col("close").isNull()
    return u.filter(~bad), u.filter(bad)


def wide_to_long(wide: DataFrame, *, ts: str = "ts", sep: str = "|") -> DataFrame:
    """``field|ticker`` columns to one row per (symbol, ts); all-null rows go."""
    cols = [c for c in wide.columns if sep in c]
    fields = sorted({c.split(sep)[0].lower() for c in cols})
    long = wide.unpivot(ts, cols, "_name", "_value")
    bits = F.split("_name", "\\" + sep)
    long = long.select(ts, F.lower(bits[0]).alias("_field"), bits[1].alias("symbol"), "_value")
    out = long.groupBy("symbol", ts).pivot("_field", fields).agg(F.max("_value"))
    return out.dropna("all", subset=fields)


def adjust(bars: DataFrame, mode: str = "split_dividend") -> DataFrame:
    """Corporate-action adjusted prices; ``raw`` and ``none`` pass through."""
    if mode in ("raw", "none"):
        return bars
    f = F.try_divide(F.col("adj_close"), F.col("close"))
    return bars.withColumn("_f", f).select(
        "symbol",
        "ts",
        *[(F.col(c) * F.col("_f")).alias(c) for c in ("open", "high", "low")],
        F.col("adj_close").alias("close"),
        "adj_close",
        F.try_divide(F.col("volume"), F.col("_f")).alias("volume"),
    )


def in_range(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive range filter with bounds cast to the type of ``ts``."""
    t = bars.schema["ts"].dataType
    if start is not None:
        bars = bars.filter(F.col("ts") >= F.lit(start).cast(t))
    if end is not None:
        bars = bars.filter(F.col("ts") <= F.lit(end).cast(t))
    return bars


# --------------------------------------------------------------------- store

BUCKETS = 64


class DataQualityError(ValueError):
    """Bars that break a quality rule were offered to the store."""


def bucket(symbol: Column) -> Column:
    """Partition of a symbol; a store has ``BUCKETS`` of them a year."""
    return F.pmod(F.xxhash64(symbol), F.lit(BUCKETS)).cast("int")


def problems(bars: DataFrame, *, max_abs_return: float = 0.75) -> list[str]:
    """What the quality rules find in normalised bars, a sentence a rule; empty if they are clean."""
    from tickloom.operators.quality import quality_report

    found = {r["rule"]: r["n_bad"] for r in quality_report(bars, max_abs_return=max_abs_return).collect()}
    if not any(v is not None for v in found.values()):
        return ["no bars"]
    return [f"{n} bars break the rule {rule}" for rule, n in found.items() if n]


def upsert(
    spark: SparkSession, root: str, new: DataFrame, *, seq: str, intraday: bool = False,
    validate_quality: bool = True, max_abs_return: float = 0.75, notes: dict[str, str] | None = None,
) -> DataFrame:
    """Merge bars into the store; the newest row per (symbol, ts) wins.

    Bars that break a quality rule are refused whole, before anything is written
    (``DataQualityError``).  Only the years and buckets of ``new`` are read and
    written anew, so a late bar costs one year of its bucket; the new version is
    committed last, with ``notes``, and a run that dies before that changes nothing.
    Returns the row count per symbol of ``new``.
    """
    fresh = normalize(new, seq=seq, intraday=intraday)
    if validate_quality and (wrong := problems(fresh, max_abs_return=max_abs_return)):
        raise DataQualityError("; ".join(wrong))
    base = versions.latest(spark, root)
    keyed = fresh.withColumns({"bucket": bucket(F.col("symbol")), "year": F.year("ts")})
    # At most BUCKETS a year.
    touched = {(r["bucket"], r["year"]) for r in keyed.select("bucket", "year").distinct().collect()}
    old = versions.read(spark, root, _schema(intraday), base, lambda k: (int(k["bucket"]), int(k["year"])) in touched)
    both = old.withColumn("_age", F.lit(0)).unionByName(fresh.withColumn("_age", F.lit(1)))
    merged = normalize(both, seq="_age", intraday=intraday).withColumns({"bucket": bucket(F.col("symbol")), "year": F.year("ts")})
    parts = versions.stage(spark, root, merged.repartition("bucket", "year").sortWithinPartitions("bucket", "year", "symbol", "ts"), ["bucket", "year"])
    versions.commit(spark, root, base, parts, notes)
    mine = read_store(spark, root, schema=_schema(intraday)).join(fresh.select("symbol").distinct(), "symbol", "left_semi")
    return mine.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))


def _schema(intraday: bool) -> T.StructType:
    return INTRADAY_SCHEMA if intraday else DAILY_SCHEMA


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_store(
    spark: SparkSession,
    root: str,
    symbols: list[str] | None = None,
    *,
    start: str | None = None,
    end: str | None = None,
    adjustment: str = "raw",
    schema: T.StructType = DAILY_SCHEMA,
    version: int | None = None,
) -> DataFrame:
    """Stored bars of a version (else the newest); symbols and range choose the partitions and reach the scan."""
    v = versions.latest(spark, root) if version is None else versions.read_version(spark, root, version)
    first, last = (int(b[:4]) if b else None for b in (start, end))
    wanted = None if symbols is None else {r["b"] for r in spark.createDataFrame([(s,) for s in symbols], "s string").select(bucket(F.col("s")).alias("b")).collect()}

    def keep(k: dict[str, str]) -> bool:
        year = int(k["year"])
        return (wanted is None or int(k["bucket"]) in wanted) and (first is None or year >= first) and (last is None or year <= last)

    df = versions.read(spark, root, schema, v, keep).select(*BAR_COLUMNS)
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(*symbols))
    return adjust(in_range(df, start, end), adjustment)


def sql_over_store(spark: SparkSession, root: str, query: str) -> DataFrame:
    """SQL with the store exposed as the view ``bars``."""
    read_store(spark, root).createOrReplaceTempView("bars")
    return spark.sql(query)


def coverage(bars: DataFrame) -> DataFrame:
    """Bar count, first and last timestamp per symbol."""
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


def trading_calendar(bars: DataFrame) -> DataFrame:
    """Sorted distinct timestamps over all symbols."""
    return bars.select("ts").distinct().orderBy("ts")


def incremental_start(bars: DataFrame, *, data_start: str, overlap_days: int) -> DataFrame:
    """Where the next fetch starts: the stalest symbol less an overlap."""
    last = bars.groupBy("symbol").agg(F.max(F.to_date("ts")).alias("last")).agg(F.min("last").alias("stalest"))
    start = F.greatest(F.lit(data_start).cast("date"), F.date_sub("stalest", overlap_days))
    return last.select("stalest", start.alias("start"))
