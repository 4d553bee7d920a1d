"""Common table expressions of the comparison SQL, matching sources.tables."""

KEY = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


def bars(symbol: str = "p_brand", name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS ts,
         arg_min(l_extendedprice / l_quantity, {KEY}) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, {KEY}) AS close,
         arg_max(l_extendedprice / l_quantity, {KEY}) * (1 - avg(l_discount)) AS adj_close,
         sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


BARS = bars()
BENCH = """bench AS (
  SELECT CAST(l_shipdate AS DATE) AS ts, sum(l_extendedprice) / sum(l_quantity) AS close
  FROM lineitem GROUP BY 1)"""

INTRADAY = """ibars AS (
  SELECT event_type AS symbol, to_timestamp(floor(epoch(ts) / 1800) * 1800) AT TIME ZONE 'UTC' AS ts,
         arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""

FILLS = f"""fills AS (
  SELECT o_custkey AS account, p_brand AS symbol, CAST(l_shipdate AS DATE) AS ts,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
         l_extendedprice / l_quantity AS price,
         l_extendedprice / l_quantity * 0.01 * l_tax AS commission, 0.0 AS fees,
         l_extendedprice / l_quantity * (1 - l_discount * 0.01) AS reference_price,
         row_number() OVER (PARTITION BY o_custkey, p_brand ORDER BY l_shipdate, l_orderkey, l_linenumber,
                            l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) AS rn,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

LEDGER = """ledger AS (
  SELECT o_orderpriority AS strategy, CAST(o_orderdate AS DATE) AS ts, round(avg(o_totalprice), 4) AS equity,
         count(*) AS n_orders, round(sum(o_totalprice), 2) AS notional
  FROM orders GROUP BY 1, 2)"""

ARTICLES = """articles AS (
  SELECT doc_id, substr(sha1(lower(trim(text, ' '))), 1, 16) AS uid,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 1800) AS ts, source,
         CASE WHEN doc_id % 5 = 0 THEN 'macro' ELSE 'company' END AS kind,
         string_split(text, chr(10))[1] AS title,
         CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, position(chr(10) IN text) + 1) ELSE '' END AS summary,
         'doc://' || CAST(doc_id AS VARCHAR) AS url,
         CASE WHEN doc_id % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE
           list_sort(list_distinct(['Brand#' || CAST(1 + doc_id % 25 AS VARCHAR),
                                    'Brand#' || CAST(1 + (doc_id * 7) % 25 AS VARCHAR)])) END AS symbols
  FROM documents)"""


def day(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"


def stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)


def drawn(seed: int, *cols: str) -> str:
    """The seeded hash of columns."""
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(cols)})), 1, 15) AS BIGINT)"


def uniform(seed: int, *cols: str) -> str:
    """The same as a number in (0, 1)."""
    return f"((CAST({drawn(seed, *cols)} % {2**53} AS DOUBLE) + 0.5) / {2**53}.0)"
