"""History tables, ledgers, state documents and published artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import json_safe
from tickloom.functions.text import strip
from tickloom.sources.bars import exists


def relaxed_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name: missing columns are NULL, numbers widen to double."""
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    numeric = {"int", "bigint", "smallint", "tinyint", "float", "double"}

    def widen(d: DataFrame) -> DataFrame:
        mixed = [c for c in d.columns if c in ta and c in tb and ta[c] != tb[c] and {ta[c], tb[c]} <= numeric]
        return d.withColumns({c: F.col(c).cast("double") for c in mixed})

    return widen(a).unionByName(widen(b), allowMissingColumns=True)


def append_history(path: str, rows: DataFrame) -> None:
    """Append rows; new columns extend the table and older rows read as NULL.

    Old files are not rewritten.  Columns whose numeric type drifted are
    written as double, which ``read_history`` asks for.
    """
    spark = rows.sparkSession
    if exists(spark, path):
        old = dict(spark.read.option("mergeSchema", True).parquet(path).dtypes)
        rows = rows.withColumns({c: F.col(c).cast(t) for c, t in old.items() if c in rows.columns and dict(rows.dtypes)[c] != t})
    rows.write.mode("append").option("compression", "zstd").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def replace_history(path: str, rows: DataFrame) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def log_trials(path: str, rows: DataFrame) -> None:
    """Append trials as JSON lines."""
    rows.write.mode("append").json(path)


def count_trials(spark: SparkSession, path: str) -> DataFrame:
    """Number of non-blank lines, as ``n_trials``."""
    return spark.read.text(path).filter(F.trim("value") != "").agg(F.count(F.lit(1)).alias("n_trials"))


def write_run(folder: str, *, metrics: DataFrame, trades: DataFrame, equity: DataFrame, name: str) -> None:
    """A run's artefacts: metrics JSON, trades Parquet and CSV, equity, manifest."""
    metrics.write.mode("overwrite").json(f"{folder}/metrics")
    trades.write.mode("overwrite").parquet(f"{folder}/trades")
    json_safe(trades).write.mode("overwrite").option("header", True).csv(f"{folder}/trades_csv")
    equity.write.mode("overwrite").parquet(f"{folder}/equity")
    manifest = equity.agg(F.lit(name).alias("run"), F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    json_safe(manifest).write.mode("overwrite").json(f"{folder}/manifest")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the lines of text files with their number in the file, from 1.

    A split's lines are numbered in the order they are read, and a split starts after
    the lines of those before it, of which there is one count each; so a file of many
    splits is numbered without going through one task.
    """
    m = F.col("_metadata")
    d = spark.read.text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("_split"), F.monotonically_increasing_id().alias("_id"))
    inside = Window.partitionBy("file", "_split").orderBy("_id")
    sizes = d.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("file", "_split", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    d = d.withColumn("_k", F.row_number().over(inside)).join(starts, ["file", "_split"])
    return d.select("file", (F.col("_ahead") + F.col("_k")).alias("line_no"), "value")


def read_lines(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Watch list (symbol, file, line_no) in its own order: one ticker per line, ``#`` starts a comment.

    A ticker stands where it is first listed; ``first`` keeps that many from the top.
    Several files are read one after the other, by path.
    """
    t = F.upper(strip(F.split("value", "#")[0]))
    d = numbered_lines(spark, path).select(t.alias("symbol"), "file", "line_no").filter("symbol <> ''")
    d = d.groupBy("symbol").agg(F.min(F.struct("file", "line_no")).alias("at"))
    d = d.select("symbol", "at.file", "at.line_no").orderBy("file", "line_no")
    return d if first is None else d.limit(first)


def resolve_universe(*sets: DataFrame) -> DataFrame:
    """Sorted distinct upper-case union of symbol sets."""
    u = sets[0].select("symbol")
    for s in sets[1:]:
        u = u.unionByName(s.select("symbol"))
    return u.select(F.upper(F.trim("symbol")).alias("symbol")).distinct().orderBy("symbol")


BOOK = (
    "version INT, simulated_capital BOOLEAN, account STRING, cash DOUBLE, "
    "positions MAP<STRING, STRUCT<quantity: DOUBLE, avg_price: DOUBLE>>"
)


def load_book(spark: SparkSession, path: str, *, version: int, lines: bool = False) -> DataFrame:
    """Positions of saved books, a document a file or (``lines``) a line; refuses real capital or another version.

    Unknown keys are ignored.
    """
    d = spark.read.schema(BOOK).option("multiLine", not lines).json(path)
    ok = F.coalesce(F.col("simulated_capital"), F.lit(False)) & (F.col("version") == version)
    d = d.withColumn("_ok", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("not a simulated book of this version"))))
    return d.filter("_ok").select("account", "cash", F.explode_outer("positions").alias("symbol", "_p")).select(
        "account", "cash", "symbol", F.col("_p.quantity").alias("quantity"), F.col("_p.avg_price").alias("avg_price")
    )


def roll_inception(rows: DataFrame, *, floor: str) -> DataFrame:
    """Book id and status: a book begun before the floor is retired, by its
    partition value and without moving files."""
    old = F.col("inception") < F.lit(floor).cast("date")
    return rows.withColumns(
        {
            "status": F.when(old, "retired").otherwise("live"),
            "book_id": F.concat(F.col("account"), F.lit("@"), F.date_format("inception", "yyyyMMdd")),
        }
    )


def newest(df: DataFrame, n: int, *, ts: str = "ts", tie: list[str] | None = None) -> DataFrame:
    """The newest ``n`` rows as a distributed top-k."""
    return df.orderBy(F.desc(ts), *(tie or [])).limit(n)
