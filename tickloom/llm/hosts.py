"""Host reputation with empirical-Bayes shrinkage, in DataFrame operations only.

Labelled page outcomes are counted by host.  A host's bad rate has a beta prior
whose mean is its registered domain's estimate, that one's prior is its
suffix's, and that one's the overall rate.  How strongly each level leans on the
next is a method-of-moments fit of the beta-binomial spread of its groups.  A
host is blocked when the lower bound of its posterior exceeds the limit, so a
host with few labels follows its domain and is not condemned by one page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import spare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Suffixes of two labels under which names are registered.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za", "com.cn", "co.in")


@dataclass(frozen=True)
class Rule:
    """Block or allow a host, its subdomains and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str


RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


@dataclass(frozen=True)
class Bounds:
    """Block above ``limit`` at the lower bound, ``z`` deviations below the mean."""

    limit: float = 0.5
    z: float = 1.645
    least: float = 0.001  # the fitted correlation of a level's groups is kept in these
    most: float = 0.5
    unknown: float = 0.1  # stands in where no two groups of a level share a parent


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user and port, as reputation counts it."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")


def suffix_of(name: Column) -> Column:
    """A listed suffix of two labels, else the last label."""
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does.

    ``rules`` is a policy list in the program; the longest is asked first.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def reputation(outcomes: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """(name, n, x, mean, bound) for each host name of ``outcomes`` (name, bad).

    ``bad`` is 1, 0 or null for a page without a label; names without labels get
    their domain's estimate.  Pages combine to counts by name before any
    shuffle; the levels above work on one row a name, domain and suffix.
    """
    host = outcomes.groupBy("name").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("x"))
    host = host.select("*", domain_of(F.col("name")).alias("domain"), suffix_of(F.col("name")).alias("suffix"))
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("x").alias("dx"))
    suffix = domain.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dx").alias("sx"))
    total = suffix.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("n"), F.coalesce(F.sum("sx"), F.lit(0)).alias("x")).first()
    overall = (total["x"] + 1) / (total["n"] + 2)

    def spread(groups: DataFrame, n: str, x: str, of_n: Column, of_x: Column) -> float:
        """Prior strength of a level: its groups' spread around their parents, beyond chance.

        With weights n, the expected sum of squares around the parent's rate is
        v (1 - n/N) (1 + rho (n - 1)) over the groups; a parent with one group tells nothing.
        """
        mu = of_x / of_n
        share = mu * (1 - mu) * (1 - F.col(n) / of_n)
        over, of = F.sum((F.col(x) - F.col(n) * mu) ** 2 / F.col(n) - share), F.sum(share * (F.col(n) - 1))
        r = groups.filter(F.col(n) > 0).agg(F.when(of > 0, over / of).alias("rho")).first()["rho"]
        rho = min(bounds.most, max(bounds.least, bounds.unknown if r is None else r))
        return 1 / rho - 1

    domain = domain.join(suffix, "suffix")
    host = host.join(domain, ["domain", "suffix"])
    s1 = spread(suffix, "sn", "sx", F.lit(float(total["n"])), F.lit(float(total["x"])))
    s2 = spread(domain, "dn", "dx", F.col("sn"), F.col("sx"))
    s3 = spread(host, "n", "x", F.col("dn"), F.col("dx"))
    # A prior leaves out the counts it is the prior of.
    of_suffix = (F.col("sx") - F.col("dx") + overall * s1) / (F.col("sn") - F.col("dn") + s1)
    of_domain = (F.col("dx") - F.col("x") + of_suffix * s2) / (F.col("dn") - F.col("n") + s2)
    a, b = F.col("x") + of_domain * s3, F.col("n") - F.col("x") + (1 - of_domain) * s3
    mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
    return host.select("name", "n", "x", mean.alias("mean"), (mean - bounds.z * F.sqrt(var)).alias("bound"))


def judged(
    pages: DataFrame,
    labels: DataFrame,
    *,
    id_: str = "page_id",
    url: str = "url",
    rules: tuple[Rule, ...] = RULES,
    bounds: Bounds = Bounds(),
) -> DataFrame:
    """Append host, path, rule and verdict (allow or block) to every row of ``pages``.

    ``labels`` (id, bad) holds the outcomes of some pages; of several for one
    page the worst counts.  A null url has empty host and path, and the empty
    host is judged like any other.  Repeated rows stay.  The new columns take
    free names if those are taken.
    """
    name, host, path, rule, verdict = (spare(pages, c) for c in ("name", "host", "path", "rule", "verdict"))
    worst = labels.groupBy(F.col("id").alias("__id")).agg(F.max("bad").alias("bad"))
    p = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))}).withColumn(name, name_of(F.col(host)))
    known = p.select(F.col(name).alias("name"), F.col(id_).alias("__page")).join(worst, F.col("__page") == F.col("__id"), "left")
    blocked = reputation(known.select("name", "bad"), bounds).filter(F.col("bound") > bounds.limit).select(F.col("name").alias("__name"))
    found = rule_of(F.col(host), F.col(path), rules)
    out = p.join(blocked, F.col(name) == F.col("__name"), "left")
    mine = F.when(F.col("__name").isNotNull(), "block").otherwise("allow")
    return out.select(*pages.columns, host, path, found["rule"].alias(rule), F.coalesce(found["verdict"], mine).alias(verdict))


def oracle_sql(bounds: Bounds = Bounds()) -> str:
    """The query of this operator as DuckDB SQL."""
    sfx = ", ".join(f"'{s}'" for s in SUFFIXES)
    rules = sorted(RULES, key=lambda r: (-len(r.host + r.path), r.host, r.path))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.host}{r.path}'" for f, r in zip(fits, rules)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, rules)) + " WHEN bound > {limit} THEN 'block' ELSE 'allow' END".format(limit=bounds.limit)
    last = lambda k: f"array_to_string(string_split(name, '.')[-{k}:], '.')"

    def spread(t: str, n: str, x: str, of_n: str, of_x: str) -> str:
        mu = f"({of_x} / {of_n})"
        share = f"{mu} * (1 - {mu}) * (1 - {n} / {of_n})"
        return f"""(SELECT 1 / greatest({bounds.least}, least({bounds.most}, coalesce(CASE WHEN sum({share} * ({n} - 1)) > 0
          THEN sum(({x} - {n} * {mu}) * ({x} - {n} * {mu}) / {n} - {share}) / sum({share} * ({n} - 1)) END, {bounds.unknown}))) - 1 FROM {t} WHERE {n} > 0)"""

    return f"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
      coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
    n AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM p),
    l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
    h AS (SELECT name, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS x, CASE WHEN {last(2)} IN ({sfx}) THEN {last(3)} ELSE {last(2)} END AS domain,
      CASE WHEN {last(2)} IN ({sfx}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM n LEFT JOIN l ON doc_id = page_id GROUP BY name),
    d AS (SELECT domain, suffix, sum(n) AS dn, sum(x) AS dx FROM h GROUP BY ALL),
    s AS (SELECT suffix, sum(dn) AS sn, sum(dx) AS sx FROM d GROUP BY suffix),
    o AS (SELECT (coalesce(sum(sx), 0) + 1) / (coalesce(sum(sn), 0) + 2) AS mu, sum(sn) AS tn, sum(sx) AS tx FROM s),
    ds AS (SELECT d.*, sn, sx FROM d JOIN s USING (suffix)), hs AS (SELECT h.*, dn, dx, sn, sx FROM h JOIN ds USING (domain, suffix)), so AS (SELECT s.*, tn, tx FROM s, o),
    k AS (SELECT (SELECT mu FROM o) AS mu, {spread('so', 'sn', 'sx', 'tn', 'tx')} AS s1, {spread('ds', 'dn', 'dx', 'sn', 'sx')} AS s2, {spread('hs', 'n', 'x', 'dn', 'dx')} AS s3),
    m AS (SELECT name, n, x, (dx - x + (sx - dx + mu * s1) / (sn - dn + s1) * s2) / (dn - n + s2) AS md, s3 FROM hs, k),
    ab AS (SELECT name, x + md * s3 AS a, n - x + (1 - md) * s3 AS b FROM m),
    r AS (SELECT name, a / (a + b) - {bounds.z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab)
    SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM n JOIN r USING (name)"""
