"""Versioned tables: commits, conflicts, broken and refused writes, exactly-once runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.sources import bars as B
from tickloom.sources import runs as R
from tickloom.sources import versions as V

COLS = "symbol string, ts date, open double, high double, low double, close double, adj_close double, volume double, seq int"


def bar(symbol, day, close, seq=0, **other):
    r = {"open": close, "high": close * 1.1, "low": close * 0.9, "close": close, "adj_close": close, "volume": 5.0} | other
    return (symbol, dt.date.fromisoformat(day), *(r[c] for c in ("open", "high", "low", "close", "adj_close", "volume")), seq)


def stored(spark, root, **how):
    return sorted((r.symbol, str(r.ts), r.close) for r in B.read_store(spark, root, **how).collect())


@pytest.fixture
def store(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [bar(s, d, 10.0) for s in ("A", "B") for d in ("2023-12-29", "2024-01-02", "2024-01-03")]
    B.upsert(spark, root, spark.createDataFrame(rows, COLS), seq="seq")
    return root


def test_refused_bars_change_nothing(spark, store):
    before = stored(spark, store)
    for wrong, rule in (
        (bar("A", "2024-01-04", 10.0, open=-1.0), "non_positive_open"), (bar("A", "2024-01-04", 10.0, volume=-1.0), "negative_volume"),
        (bar("A", "2024-01-04", 10.0, low=99.0), "ohlc_order"),
    ):
        with pytest.raises(B.DataQualityError, match=rule):
            B.upsert(spark, store, spark.createDataFrame([wrong], COLS), seq="seq")
    jump = spark.createDataFrame([bar("A", "2024-01-04", 10.0), bar("A", "2024-01-05", 20.0)], COLS)
    with pytest.raises(B.DataQualityError, match="1 bars break the rule jump"):
        B.upsert(spark, store, jump, seq="seq")
    with pytest.raises(B.DataQualityError, match="no bars"):
        B.upsert(spark, store, jump.limit(0), seq="seq")
    assert stored(spark, store) == before and V.latest(spark, store).number == 1
    B.upsert(spark, store, jump, seq="seq", validate_quality=False)
    assert len(stored(spark, store)) == len(before) + 2


def test_a_write_that_dies_leaves_the_old_version(spark, store, monkeypatch):
    before = stored(spark, store)
    late = spark.createDataFrame([bar("A", "2024-01-03", 11.0, 1)], COLS)
    with monkeypatch.context() as m:
        m.setattr(V, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            B.upsert(spark, store, late, seq="seq")
    assert stored(spark, store) == before
    n = B.upsert(spark, store, late, seq="seq").collect()
    assert [(r.symbol, r.n_bars) for r in n] == [("A", 3)]
    assert stored(spark, store)[2] == ("A", "2024-01-03", 11.0)
    assert stored(spark, store, version=1) == before
    # The dead write goes; the first one still holds the other year.
    assert V.vacuum(spark, store, keep=1) == 1 and stored(spark, store)[2][2] == 11.0


def test_a_late_bar_writes_one_year_of_one_bucket(spark, store):
    old = V.latest(spark, store).parts
    B.upsert(spark, store, spark.createDataFrame([bar("B", "2023-12-28", 9.0)], COLS), seq="seq")
    new = V.latest(spark, store).parts
    moved = [k for k in new if new[k] != old.get(k)]
    assert len(moved) == 1 and moved[0].endswith("year=2023")


def test_symbols_and_range_choose_the_files(spark, store):
    r = B.read_store(spark, store, ["A"], start="2024-01-01", end="2024-01-02")
    assert [(x.symbol, str(x.ts)) for x in r.collect()] == [("A", "2024-01-02")]
    assert len(r.inputFiles()) == 1
    assert B.read_store(spark, store, ["none"], start="1999-01-01", end="1999-12-31").count() == 0


def test_two_writers_of_one_version(spark, store):
    base = V.latest(spark, store)
    V.commit(spark, store, base, {}, {"by": "one"})
    with pytest.raises(V.Conflict):
        V.commit(spark, store, base, {}, {"by": "two"})
    assert V.latest(spark, store).notes == {"by": "one"}


def test_runs_are_exactly_once(spark, tmp_path):
    root = str(tmp_path / "runs")
    rows = [bar(s, f"2024-01-{d:02d}", float(d)) for s in "AB" for d in range(1, 11)]
    b = spark.createDataFrame(rows, COLS)
    each = lambda x: x.select("symbol", "ts", "close")
    out = lambda: sorted((r.symbol, r.close) for r in R.outputs(spark, root, "j", "symbol string, ts date, close double").collect())
    day = lambda n: F.lit(f"2024-01-{n:02d}").cast("date")
    R.process(spark, root, "j", b, each, day(3))
    once = out()
    assert len(once) == 6
    commit = R.prepare(spark, root, "j", b, each, day(6))
    assert out() == once  # killed before its commit
    R.process(spark, root, "j", b.filter("symbol = 'A'"), each, day(6))
    R.process(spark, root, "j", b, each, day(6))
    with pytest.raises(V.Conflict):
        commit()  # the killed run can't come back later
    for _ in range(2):
        R.process(spark, root, "j", b, each)
    assert out() == sorted((s, float(d)) for s in "AB" for d in range(1, 11))
    assert R.due(spark, root, "j", b).isEmpty()
    s = R.next_start(spark, root, "j", data_start="2020-01-01", overlap_days=2).first()
    assert (str(s.stalest), str(s.start)) == ("2024-01-10", "2024-01-08")
    assert str(R.next_start(spark, root, "other", data_start="2020-01-01", overlap_days=2).first().start) == "2020-01-01"


def test_once_sink_ignores_a_batch_it_has(spark, tmp_path):
    root = str(tmp_path / "sink")
    put = R.once_sink(root, "j", lambda x: x)
    rows = spark.createDataFrame([("A", 1.0)], "symbol string, close double")
    put(rows, 0)
    put(rows, 0)
    put(rows, 1)
    assert R.outputs(spark, root, "j", "symbol string, close double").count() == 2
