"""Registry of named queries: a Spark callable and, where SQL can say it, SQL.

Queries return plain types (strings for dates, rounded doubles, longs) so that
any engine's result can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Runner
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register ``run(spark, folder)`` under ``name``; ``covers`` lists survey ids."""

    def add(run: Runner) -> Runner:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(covers.split()), _in_utc(run), sql and nudge(sql))
        return run

    return add


def _in_utc(run: Runner) -> Runner:
    """Naive stamps are UTC in the tables, so the session must say so too."""

    @wraps(run)
    def go(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return run(spark, folder)

    return go


# Added before rounding on both sides: engines differ on exact halves, which
# prices divided by a power of two do hit.
NUDGE = 1e-9


def nudge(sql: str) -> str:
    """Add the nudge inside every ``round(x, n)`` of a comparison SQL."""
    out, i = [], 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k, comma = 1, j + 6, -1
        while depth:
            c = sql[k]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                comma = k
            k += 1
        out += [sql[i : j + 6], nudge(sql[j + 6 : comma]), f" + {NUDGE}", sql[comma:k]]
        i = k
    return "".join(out) + sql[i:]


def tidy(df: DataFrame, dp: int = 6, **places: int) -> DataFrame:
    """Dates as strings, counts as longs, flags as 0/1, doubles rounded."""
    out = []
    for f in df.schema:
        t, c = f.dataType.typeName(), F.col(f.name)
        if t == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif t in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif t in ("double", "float"):
            c = F.round(c.cast("double") + F.lit(NUDGE), places.get(f.name, dp)) + F.lit(0.0)
        elif t in ("integer", "long", "short", "byte", "boolean"):
            c = c.cast("int").cast("long") if t == "boolean" else c.cast("long")
        elif t == "decimal":
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)
