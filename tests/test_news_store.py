"""Archive and signal document: idempotent, pruned by month, damage is no news."""

import datetime as dt

from pyspark.sql import functions as F

from tickloom.plans import chains
from tickloom.sources import news_store as S

NOW = "2026-08-08 12:00:00"
T = "uid string, ts timestamp, source string, kind string, title string, summary string, url string, symbols array<string>"


def rows(spark, *items):
    data = [(u, dt.datetime(2026, m, d), "s", "company", t, "", "u/" + u, s) for u, m, d, t, s in items]
    return spark.createDataFrame(data, T)


def collected(df, day):
    return df.withColumn("collected_at", F.lit(f"2026-08-{day:02d}").cast("timestamp"))


def test_append_since_and_again(spark, tmp_path):
    root = str(tmp_path / "a")
    one = rows(spark, ("a", 6, 1, "first", ["X"]), ("b", 7, 2, "second", []))
    two = rows(spark, ("a", 8, 3, "later text", ["Y"]), ("c", 8, 4, "third", ["Z"]), ("c", 8, 4, "third", ["W"]))
    assert S.append_articles(spark, root, collected(one, 1)) == 2
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "a/articles/month=2026-07").iterdir()}
    assert S.append_articles(spark, root, collected(two, 2)) == 1
    assert S.append_articles(spark, root, collected(two, 3)) == 0
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "a/articles/month=2026-07").iterdir()}
    got = {r.uid: (r.title, r.symbols, r.ts.month) for r in S.articles_since(spark, root).collect()}
    assert got == {"a": ("first", ["X", "Y"], 6), "b": ("second", [], 7), "c": ("third", ["W", "Z"], 8)}
    since = S.articles_since(spark, root, "2026-07-02 00:00:00")
    assert sorted(r.uid for r in since.collect()) == ["b", "c"]
    assert S.articles_since(spark, str(tmp_path / "none")).count() == 0


def test_publish_and_read(spark, tmp_path):
    root = str(tmp_path / "n")
    arts = rows(spark, ("a", 8, 7, "Profits surge to record", ["X"]), ("b", 8, 6, "Shares plunge on fraud probe", ["Y"]), ("old", 7, 1, "Shares surge", ["Y"]), ("next", 8, 9, "Shares soar", ["Y"]))
    assert chains.news(spark, arts, root, NOW, label=False) == 3
    first = sorted(tuple(r) for r in S.read_signal(spark, root + "/signal")[0].collect())
    assert chains.news(spark, arts, root, NOW, label=False) == 0
    sym, head = S.read_signal(spark, root + "/signal")
    assert sorted(tuple(r) for r in sym.collect()) == first and {r.symbol for r in sym.collect()} == {"X", "Y"}
    assert {r.symbol: r.score > 0 for r in sym.collect()} == {"X": True, "Y": False}
    assert head.first().total_articles == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.txt").write_text("{broken\n" + '{"as_of": "t", "symbols": {"Q": {"score": 0.5}}}\n')
    q = S.read_signal(spark, str(tmp_path / "bad"))[0].first()
    assert (q.symbol, q.relative, q.articles, q.top_headline) == ("Q", 0.5, 0, "")
    assert S.read_signal(spark, str(tmp_path / "absent"))[0].count() == 0
