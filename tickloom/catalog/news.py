"""Text functions, feeds, archive and news signals.

The documents hold no market words, so these queries use a lexicon and a name
book made of words that occur in them; the operators take either as parameter.
"""

from pyspark.sql import functions as F

from tickloom.catalog.base import query, tidy
from tickloom.catalog.sqlbits import ARTICLES, day, stamp
from tickloom.functions import text as X
from tickloom.operators import news as N
from tickloom.plans import chains as C
from tickloom.session import fresh
from tickloom.sources import news_store as S
from tickloom.settings import NewsSettings
from tickloom.sources import tables as T

WORDS = {"and": 1.0, "for": 1.5, "with": 0.5, "that": 1.0, "la": 0.7, "der": 1.2, "of": -1.0, "in": -0.8, "was": -1.5, "le": -0.6, "und": -0.9, "de": -0.4}
NEGS = ("no", "not", "is", "en")
LEX = X.Lexicon(WORDS, NEGS)
NAMES = {"The": "AA", "And": "BB", "In": "CC", "The and": "DD", "La": "EE", "Der": "FF", "And the": "GG"}
BOOK = X.NameBook(NAMES, {"Of": "HH"}, ("AA", "EE"))
UNIVERSE = ["AA", "BB", "DD", "EE", "GG", "Brand#1", "Brand#2"]
CFG = NewsSettings()
AS_OF = "2024-01-15 12:00:00"

_TOKS = "regexp_extract_all(lower(replace({c}, '’', '''')), '[a-z][a-z''-]*')"


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def polarity_sql(src: str, lex: X.Lexicon = LEX) -> str:
    """Token positions joined to the lexicon, negation by a list slice."""
    rows = ", ".join(f"({quoted(w)}, {float(v)!r}::DOUBLE)" for w, v in lex.weights.items())
    negators = "[" + ", ".join(quoted(w) for w in lex.negators) + "]"
    return f"""lex AS (SELECT * FROM (VALUES {rows}) AS v(w, wt)),
  tk AS (SELECT uid, f, toks, unnest(range(1, len(toks) + 1)) AS p FROM (SELECT uid, 't' AS f, {_TOKS.format(c='title')} AS toks FROM {src} UNION ALL SELECT uid, 's', {_TOKS.format(c='summary')} FROM {src})),
  hit AS (SELECT uid, f, CASE WHEN list_has_any(list_transform(toks[greatest(1, p - 3):p - 1], lambda x: replace(x, '''', '')), {negators}) THEN -wt ELSE wt END AS v FROM tk JOIN lex ON lex.w = toks[p]),
  agg AS (SELECT uid, sum(CASE WHEN f = 't' THEN 1 ELSE 0 END) AS tm, count(*) AS matched, coalesce(sum(v) FILTER (v > 0 AND f = 't'), 0) AS tp, coalesce(-sum(v) FILTER (v < 0 AND f = 't'), 0) AS tn,
    coalesce(sum(v) FILTER (v > 0 AND f = 's'), 0) AS sp, coalesce(-sum(v) FILTER (v < 0 AND f = 's'), 0) AS sn FROM hit GROUP BY uid),
  scored AS (SELECT a.*, coalesce(matched, 0) AS matched, coalesce(tp, 0) * CASE WHEN a.summary <> '' THEN 2 ELSE 1 END + coalesce(sp, 0) AS positive, coalesce(tn, 0) * CASE WHEN a.summary <> '' THEN 2 ELSE 1 END + coalesce(sn, 0) AS negative
    FROM {src} a LEFT JOIN agg USING (uid)),
  pol AS (SELECT *, coalesce((positive - negative) / nullif(positive + negative, 0), 0) AS polarity FROM scored)"""


DEDUPED = f"""{ARTICLES}, dd AS (SELECT uid, min(ts) AS ts, arg_min(source, row(ts, source, title, url)) AS source,
    CASE WHEN max(CAST(kind = 'company' AS INT)) = 1 THEN 'company' ELSE arg_min(kind, row(ts, source, title, url)) END AS kind,
    arg_min(title, row(ts, source, title, url)) AS title, coalesce(arg_min(summary, row(ts, source, title, url)) FILTER (summary <> ''), '') AS summary,
    coalesce(arg_min(url, row(ts, source, title, url)) FILTER (url <> ''), '') AS url,
    coalesce(list_sort(list_distinct(flatten(list(symbols)))), []) AS symbols FROM articles GROUP BY uid)"""


def articles(spark, d):
    return T.articles(spark, d).drop("doc_id")


@query(
    "clean_markup", "F9",
    r"""SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}\x{0085}\x{000B}]+', ' ', 'g'), ' ') AS t FROM pages)""",
)
def _(spark, d):
    p = T.table(spark, d, "pages").select("page_id", X.clean_text(F.col("html")).alias("t"))
    return tidy(p.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest")))


@query(
    "article_identity", "F10 D8 S8 F8",
    f"""WITH {ARTICLES} SELECT doc_id, uid, substr(sha1(lower(trim(url, ' '))), 1, 16) AS url_uid, {stamp('ts')} AS ts, source, kind, md5(title) AS title_md5, md5(summary) AS summary_md5,
      array_to_string(symbols, ',') AS symbols FROM articles WHERE ts >= TIMESTAMP '2024-01-05 00:00:00'""",
)
def _(spark, d):
    a = T.articles(spark, d).filter(F.col("ts") >= F.lit("2024-01-05 00:00:00").cast("timestamp"))
    return tidy(a.select("doc_id", "uid", X.article_uid(F.col("url"), F.col("title")).alias("url_uid"), "ts", "source", "kind",
                         F.md5("title").alias("title_md5"), F.md5("summary").alias("summary_md5"), F.array_join("symbols", ",").alias("symbols")))


@query(
    "article_identity_stripped", "F10",
    f"""WITH {ARTICLES} SELECT doc_id, substr(sha1(url), 1, 16) AS url_uid, substr(sha1('x y'), 1, 16) AS title_uid FROM articles""",
)
def _(spark, d):
    """White space of every kind around a URL or a title doesn't change the identity."""
    a = T.articles(spark, d)
    k = (F.col("doc_id") % len(X.WHITE)).cast("int") + 1
    white = F.substring(F.lit(X.WHITE), k, F.lit(1))
    return a.select("doc_id", X.article_uid(F.concat(white, F.upper("url"), white, F.lit("\n")), F.lit("t")).alias("url_uid"),
                    X.article_uid(F.lit(""), F.concat(F.lit("\t"), F.lit("X y"), white)).alias("title_uid"))


@query(
    "feed_timestamps", "F12 F13",
    f"""SELECT o_orderkey, {stamp("CASE o_orderkey % 5 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN t - INTERVAL 2 HOUR WHEN 3 THEN t + INTERVAL 5 HOUR END")} AS ts
    FROM (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS t FROM orders)""",
)
def _(spark, d):
    o = T.table(spark, d, "orders")
    t = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1440 * 60)
    k = F.col("o_orderkey") % 5
    raw = (
        F.when(k == 0, F.concat(F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(k == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 2, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(k == 3, F.concat(F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" EST")))
        .otherwise("no date here")
    )
    return tidy(o.select("o_orderkey", X.parse_instant(raw).alias("ts")))


@query("token_stream", "F16", f"SELECT doc_id, len({_TOKS.format(c='text')}) AS n_tokens, md5(array_to_string({_TOKS.format(c='text')}, ' ')) AS digest FROM documents")
def _(spark, d):
    t = T.table(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return tidy(t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest")))


@query(
    "article_polarity", "F20 F21 F17 J11 ST11",
    f"""WITH {ARTICLES}, u AS (SELECT * REPLACE (CAST(doc_id AS VARCHAR) AS uid) FROM articles), {polarity_sql('u')}
    SELECT doc_id, matched, round(positive, 6) AS positive, round(negative, 6) AS negative, round(polarity, 6) AS polarity, CAST(matched >= 2 AS BIGINT) AS confident, round(least(matched, 6) / 6.0, 6) AS confidence FROM pol""",
)
def _(spark, d):
    s = X.score_articles(T.articles(spark, d), LEX).withColumn("confidence", F.least(F.col("matched"), F.lit(6)) / 6.0)
    return tidy(s.select("doc_id", "matched", "positive", "negative", "polarity", "confident", "confidence"))


MARKET = X.Lexicon()
_MARKET_WORDS = "[" + ", ".join(quoted(w) for w in MARKET.weights) + "]"


@query(
    "market_lexicon_polarity", "F20 F21 D19",
    f"""WITH {ARTICLES}, m AS (SELECT doc_id, uid || doc_id AS uid, {_MARKET_WORDS}[1 + doc_id % {len(MARKET.weights)}] AS word, summary FROM articles),
    t AS (SELECT doc_id, uid, 'Shares ' || word || ' after not ' || word AS title, summary FROM m), {polarity_sql('t', MARKET)}
    SELECT doc_id, matched, round(positive, 6) AS positive, round(negative, 6) AS negative, round(polarity, 6) AS polarity FROM pol""",
)
def _(spark, d):
    """The market word list over titles stocked with its own words."""
    a = T.articles(spark, d)
    words = X.literal_array(list(MARKET.weights))
    w = F.get(words, (F.col("doc_id") % F.size(words)).cast("int"))
    a = a.withColumn("title", F.concat(F.lit("Shares "), w, F.lit(" after not "), w)).drop("symbols")
    return tidy(X.score_articles(a).select("doc_id", "matched", "positive", "negative", "polarity"))


_MENTION = "'Shares of $' || upper(substr(p_name, 1, 3)) || ' rose; ' || p_brand || ' (NASDAQ: ' || upper(substr(p_type, 1, 4)) || ') and nyse:' || upper(substr(p_type, 1, 2)) || '-B fell'"


@query(
    "ticker_mentions", "F18 F19 F8",
    f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(t, '\\$([A-Z]{{1,5}}(?:[-.][A-Z])?)\\b', 1),
      list_transform(regexp_extract_all(t, '(?i)\\b(?:NASDAQ|NYSE|NYSEARCA|AMEX|BATS|OTC)\\s*:\\s*([A-Z]{{1,5}}(?:[-.][A-Z])?)\\b', 1), lambda x: upper(x))))), ',') AS symbols
    FROM (SELECT p_partkey, {_MENTION} AS t FROM part)""",
)
def _(spark, d):
    p = T.table(spark, d, "part")
    t = F.concat(F.lit("Shares of $"), F.upper(F.substring("p_name", 1, 3)), F.lit(" rose; "), "p_brand", F.lit(" (NASDAQ: "),
                 F.upper(F.substring("p_type", 1, 4)), F.lit(") and nyse:"), F.upper(F.substring("p_type", 1, 2)), F.lit("-B fell"))
    return tidy(p.select("p_partkey", F.array_join(X.match_symbols(t, X.NameBook({}, {}, ())), ",").alias("symbols")))


def names_sql(col: str) -> str:
    b = "[^\\p{L}\\p{M}\\p{N}_]"
    parts = [f"CASE WHEN regexp_matches({col}, '(^|{b}){n}($|{b})') THEN ['{s}'] ELSE [] END" for n, s in NAMES.items()]
    return f"list_distinct(flatten([{', '.join(parts)}]))"


@query("company_mentions", "J12 F23", f"SELECT doc_id, array_to_string(list_sort({names_sql('text')}), ',') AS symbols FROM documents")
def _(spark, d):
    t = T.table(spark, d, "documents")
    return tidy(t.select("doc_id", F.array_join(F.array_sort(X.names_found(F.col("text"), NAMES)), ",").alias("symbols")))


@query(
    "labelled_articles", "F22 F23 U5 U7",
    f"""WITH {ARTICLES}, t AS (SELECT doc_id, title || '. ' || summary AS t, CASE WHEN doc_id % 3 = 0 THEN ['AA', 'EE', 'Brand#1'] ELSE [] END AS pre FROM articles),
    m AS (SELECT doc_id, pre, {names_sql('t')} AS named, regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_.$])Brand#1($|[^\\p{{L}}\\p{{N}}_.])') AS bare FROM t)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(pre, lambda s: list_contains(named, s) OR (s = 'Brand#1' AND bare)), list_filter(named, lambda s: list_contains(['AA','BB','DD','EE','GG','Brand#1','Brand#2'], s))))), ',') AS symbols FROM m""",
)
def _(spark, d):
    pre = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("AA"), F.lit("EE"), F.lit("Brand#1"))).otherwise(F.array().cast("array<string>"))
    a = X.label_articles(T.articles(spark, d).withColumn("symbols", pre), BOOK, UNIVERSE)
    return tidy(a.select("doc_id", F.array_join("symbols", ",").alias("symbols")))


@query(
    "syndication_dedupe", "A37 U7 ST5",
    f"WITH {DEDUPED} SELECT uid, {stamp('ts')} AS ts, source, kind, md5(title) AS title_md5, md5(summary) AS summary_md5, url, array_to_string(symbols, ',') AS symbols FROM dd",
)
def _(spark, d):
    a = N.dedupe(articles(spark, d))
    return tidy(a.select("uid", "ts", "source", "kind", F.md5("title").alias("title_md5"), F.md5("summary").alias("summary_md5"), "url", F.array_join("symbols", ",").alias("symbols")))


@query(
    "archive_merge", "S9 J2 U2 U3",
    f"""WITH {ARTICLES}, f AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS side FROM articles)
    SELECT uid, arg_min(url, row(side, ts, title, url)) AS url, {day('arg_min(ts, row(side, ts, title, url))')} AS day, array_to_string(coalesce(list_sort(list_distinct(flatten(list(symbols)))), []), ',') AS symbols FROM f GROUP BY uid""",
)
def _(spark, d):
    a = T.articles(spark, d)
    late = F.when(F.col("doc_id") % 3 == 0, F.lit("2024-02-02")).otherwise(F.lit("2024-02-01")).cast("timestamp")
    a = a.withColumn("collected_at", late)
    m = N.merge_archive(a.filter("doc_id % 3 <> 0").drop("doc_id"), a.filter("doc_id % 3 = 0").drop("doc_id"))
    return tidy(m.select("uid", "url", F.to_date("ts").alias("day"), F.array_join("symbols", ",").alias("symbols")))


# Copies published at or after the instant must not lend it their symbols.
SIGNAL = f"""{DEDUPED.replace("FROM articles GROUP", f"FROM articles WHERE ts < TIMESTAMP '{AS_OF}' GROUP")}, use0 AS (SELECT *, TIMESTAMP '{AS_OF}' AS as_of, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0 AS age FROM dd WHERE ts < TIMESTAMP '{AS_OF}'),
  us AS (SELECT * FROM use0 WHERE age <= 14), {polarity_sql('us')},
  ev AS (SELECT *, pow(0.5, greatest(age, 0) / 2.0) * least(matched, 6) / 6.0 AS w FROM pol WHERE matched > 0),
  sy AS (SELECT symbol, sum(w * polarity) / sum(w) AS raw, sum(w) AS weight, count(*) AS n, arg_max(title, row(round(w * abs(polarity), 9), uid)) AS top FROM (SELECT w, polarity, title, uid, unnest(symbols) AS symbol FROM ev) GROUP BY symbol HAVING sum(w) > 0),
  sc AS (SELECT *, greatest(-1, least(1, raw * (n / (n + 3.0)))) AS score FROM sy),
  sig AS (SELECT *, avg(score) OVER () AS mean_score, greatest(-1, least(1, score - avg(score) OVER ())) AS relative FROM sc)"""


def signal(spark, d):
    return N.news_signal(articles(spark, d), F.lit(AS_OF), cfg=CFG, lex=LEX, label=False)


@query(
    "symbol_news_signal", "A31 A32 A33 A36 C25 C26 D9 F15 ST9",
    f"""WITH {SIGNAL} SELECT symbol, round(score, 6) AS score, round(relative, 6) AS relative, round(raw, 6) AS raw_score, n AS articles, round(weight, 6) AS weight, md5(top) AS top_md5, round(mean_score, 6) AS mean_score FROM sig""",
)
def _(spark, d):
    s, _m = signal(spark, d)
    return tidy(s.select("symbol", "score", "relative", "raw_score", "articles", "weight", F.md5("top_headline").alias("top_md5"), "mean_score"))


@query(
    "macro_news_signal", "A34 A35",
    f"""WITH {SIGNAL}, m AS (SELECT count(*) AS total_articles, count(*) FILTER (len(symbols) = 0 AND kind = 'macro') AS k, sum(w * polarity) FILTER (len(symbols) = 0 AND kind = 'macro') / nullif(sum(w) FILTER (len(symbols) = 0 AND kind = 'macro'), 0) AS raw FROM ev),
    h AS (SELECT string_agg(source || '=' || CAST(n AS VARCHAR), ',' ORDER BY source) AS sources FROM (SELECT source, count(*) AS n FROM ev GROUP BY source))
    SELECT round(CASE WHEN k > 0 THEN greatest(-1, least(1, coalesce(raw, 0) * k / (k + 3.0))) ELSE 0 END, 6) AS macro, k AS macro_articles, total_articles, sources FROM m, h""",
)
def _(spark, d):
    _s, m = signal(spark, d)
    src = F.concat_ws(",", F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return tidy(m.select("macro", "macro_articles", "total_articles", src.alias("sources")))


@query(
    "archive_append", "S9",
    f"""WITH {ARTICLES}, f AS (SELECT DISTINCT uid FROM articles WHERE doc_id % 3 <> 0), a AS (SELECT DISTINCT uid FROM articles)
    SELECT (SELECT count(*) FROM f) AS first_added, (SELECT count(*) FROM a WHERE uid NOT IN (SELECT uid FROM f)) AS then_added, 0 AS again_added, (SELECT count(*) FROM a) AS n_archived""",
)
def _(spark, d):
    root, a = fresh(spark, "news"), T.articles(spark, d)
    at = lambda day: F.lit(day).cast("timestamp")
    one = a.filter("doc_id % 3 <> 0").drop("doc_id").withColumn("collected_at", at("2024-02-01"))
    two = a.drop("doc_id").withColumn("collected_at", at("2024-02-02"))
    n = [S.append_articles(spark, root, x) for x in (one, two, two)]
    total = S.articles_since(spark, root).agg(F.count(F.lit(1)).alias("n_archived"))
    return tidy(total.select(*[F.lit(x).cast("long").alias(c) for x, c in zip(n, ("first_added", "then_added", "again_added"))], "n_archived"))


@query(
    "archive_since", "S8 S9 J2",
    f"""WITH {ARTICLES}, f AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS side FROM articles),
    m AS (SELECT uid, arg_min(url, row(side, ts, title, url)) AS url, arg_min(ts, row(side, ts, title, url)) AS ts, array_to_string(coalesce(list_sort(list_distinct(flatten(list(symbols)))), []), ',') AS symbols FROM f GROUP BY uid)
    SELECT uid, url, {stamp('ts')} AS ts, symbols FROM m WHERE ts >= TIMESTAMP '2024-01-11 00:00:00'""",
)
def _(spark, d):
    root, a = fresh(spark, "news"), T.articles(spark, d)
    for side, day in (("doc_id % 3 <> 0", "2024-02-01"), ("doc_id % 3 = 0", "2024-02-02")):
        S.append_articles(spark, root, a.filter(side).drop("doc_id").withColumn("collected_at", F.lit(day).cast("timestamp")))
    out = S.articles_since(spark, root, "2024-01-11 00:00:00")
    return tidy(out.select("uid", "url", "ts", F.array_join("symbols", ",").alias("symbols")))


@query(
    "news_pipeline", "C25 C26 S8 S9 S15 D9",
    f"""WITH {SIGNAL} SELECT '2024-01-15T12:00:00Z' AS as_of, symbol, round(score, 6) AS score, round(relative, 6) AS relative, round(raw, 6) AS raw_score, n AS articles, round(weight, 6) AS weight, md5(top) AS top_md5 FROM sig""",
)
def _(spark, d):
    """Feed bodies aside, the whole way: collected articles, archive, signal, published document, read back; run twice."""
    root = fresh(spark, "news")
    added = [C.news(spark, articles(spark, d), root, AS_OF, cfg=CFG, lex=LEX, label=False) for _ in range(2)]
    rows, _head = S.read_signal(spark, f"{root}/signal")
    again = F.lit(added[1]) == 0
    return tidy(rows.filter(again).select("as_of", "symbol", "score", "relative", "raw_score", "articles", "weight", F.md5("top_headline").alias("top_md5")))


@query(
    "universe_tone", "A48",
    f"WITH {SIGNAL} SELECT round(avg(score), 6) AS mean_score, round(avg(relative), 6) AS mean_relative, count(*) FILTER (score < 0) AS n_negative, count(*) AS n_symbols FROM sig",
)
def _(spark, d):
    return tidy(N.universe_tone(signal(spark, d)[0]).drop("as_of"))


@query("strongest_news", "O4", f"WITH {SIGNAL} SELECT symbol, round(relative, 6) AS relative FROM sig ORDER BY abs(sig.relative) DESC, symbol LIMIT 10")
def _(spark, d):
    return tidy(N.strongest(signal(spark, d)[0], 10).select("symbol", "relative"))


@query(
    "signal_json_roundtrip", "S15 F7 F38",
    f"WITH {SIGNAL} SELECT symbol, round(round(score, 6), 6) AS score, round(round(relative, 6), 6) AS relative, n AS articles FROM sig",
)
def _(spark, d):
    back = N.read_signal_json(N.signal_json(signal(spark, d)[0]))
    return tidy(back.select("symbol", "score", "relative", "articles"))


@query(
    "signal_replay_grid", "C26 ST3",
    f"""WITH {DEDUPED}, {polarity_sql('dd')}, g AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-03 00:00:00', TIMESTAMP '2024-02-03 00:00:00', INTERVAL 1 DAY)) AS TIMESTAMP) AS as_of),
    x AS (SELECT as_of, symbols, polarity, matched, (epoch_us(as_of) - epoch_us(ts)) / 86400000000.0 AS age FROM pol JOIN g ON ts < as_of WHERE matched > 0),
    y AS (SELECT as_of, unnest(symbols) AS symbol, polarity, pow(0.5, age / 2.0) * least(matched, 6) / 6.0 AS w FROM x WHERE age <= 14),
    z AS (SELECT as_of, symbol, greatest(-1, least(1, sum(w * polarity) / sum(w) * (count(*) / (count(*) + 3.0)))) AS score, count(*) AS articles FROM y GROUP BY 1, 2 HAVING sum(w) > 0)
    SELECT {stamp('as_of')} AS as_of, symbol, round(score, 6) AS score, articles FROM z""",
)
def _(spark, d):
    scored = X.score_articles(N.dedupe(articles(spark, d)), LEX)
    ev = N.evidence(N.at_grid(scored, "2024-01-03 00:00:00", 1, "2024-02-03 00:00:00", 14.0), CFG)
    return tidy(N.symbol_signal(ev, CFG).select("as_of", "symbol", "score", "articles"))


def feed_bodies(spark, d):
    """RSS and Atom bodies written from the documents' first lines."""
    a = T.articles(spark, d).withColumn("t", F.regexp_replace("title", "[^A-Za-z ]", "")).filter("trim(t) <> ''")
    rfc = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rss = F.concat(F.lit("<rss version='2.0'><channel><title>c</title><item><title><![CDATA[<b>"), "t", F.lit("</b>]]></title><link>"), "url",
                   F.lit("</link><pubDate>"), rfc, F.lit("</pubDate></item><item><title>undated</title></item></channel></rss>"))
    atom = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><title>f</title><entry><title>"), "t", F.lit("</title><link href='"), "url",
                    F.lit("'/><updated>"), iso, F.lit("</updated><summary>s</summary></entry></feed>"))
    bad = F.lit("<rss><channel><item><title>cut off")
    k = F.col("doc_id") % 3
    return a.select("source", "kind", F.when(k == 0, rss).when(k == 1, atom).otherwise(bad).alias("body"))


@query(
    "feed_articles", "S20 F9 F10 F12",
    f"""WITH {ARTICLES}, a AS (SELECT *, trim(regexp_replace(regexp_replace(title, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g'), ' ') AS t FROM articles WHERE trim(regexp_replace(title, '[^A-Za-z ]', '', 'g'), ' ') <> '')
    SELECT substr(sha1(url), 1, 16) AS uid, {stamp('ts')} AS ts, source, kind, t AS title, CASE WHEN doc_id % 3 = 1 THEN 's' ELSE '' END AS summary, url FROM a WHERE doc_id % 3 < 2""",
)
def _(spark, d):
    p = N.parse_feeds(feed_bodies(spark, d))
    return tidy(p.select("uid", "ts", "source", "kind", "title", "summary", "url"))


@query(
    "vendor_articles", "S21 F38",
    f"""WITH {ARTICLES}, a AS (SELECT *, trim(regexp_replace(regexp_replace(title, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g'), ' ') AS t FROM articles WHERE trim(regexp_replace(title, '[^A-Za-z ]', '', 'g'), ' ') <> '')
    SELECT substr(sha1(url), 1, 16) AS uid, {stamp('ts')} AS ts, t AS title, url, source AS symbol FROM a WHERE doc_id % 3 < 2""",
)
def _(spark, d):
    a = T.articles(spark, d).withColumn("t", F.regexp_replace("title", "[^A-Za-z ]", "")).filter("trim(t) <> ''")
    nested = F.to_json(F.struct(F.struct(F.col("t").alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate"),
                                         F.struct("url").alias("canonicalUrl")).alias("content")))
    flat = F.to_json(F.struct(F.col("t").alias("title"), F.unix_seconds("ts").alias("providerPublishTime"), F.col("url").alias("link")))
    k = F.col("doc_id") % 3
    raw = a.select(F.col("source").alias("symbol"), F.when(k == 0, nested).when(k == 1, flat).otherwise("[]").alias("body"))
    return tidy(N.parse_vendor(raw).select("uid", "ts", "title", "url", F.col("symbols")[0].alias("symbol")))


@query(
    "label_agreement", "A1",
    f"""WITH {ARTICLES}, u AS (SELECT * REPLACE (CAST(doc_id AS VARCHAR) AS uid) FROM articles), {polarity_sql('u')}
    SELECT quality, toxic, count(*) AS n_docs, round(avg(polarity), 6) AS mean_polarity FROM pol JOIN labels USING (doc_id) GROUP BY 1, 2""",
)
def _(spark, d):
    s = X.score_articles(T.articles(spark, d), LEX).join(T.table(spark, d, "labels"), "doc_id")
    return tidy(s.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("polarity").alias("mean_polarity")))
