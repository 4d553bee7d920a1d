"""The pipeline against a brute-force version, and each stage on odd rows."""
import hashlib
import random

from tokenizers import Tokenizer

import corpus_pipeline as P
from tickloom.llm import mixing
from tickloom.llm import rules as R
from tickloom.llm import secrets as S
from tickloom.llm.common import written

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """{doc_id: (text, source)} after the first three stages."""
    good = []
    for d, t, s in rows:
        m = dict(zip(R.MEASURES, R.measure(t or "")))
        if not any(eval(rule.format(**m).replace(" OR ", " or ")) for _, rule in R.RULES):
            good.append((d, t, s))
    sets = [shingles(t) for _, t, _ in good]
    root = list(range(len(good)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(good)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _, _) in enumerate(good):
        low[find(i)] = min(d, low.get(find(i), d))
    kept = {d: (t, s) for i, (d, t, s) in enumerate(good) if low[find(i)] == d}
    return {d: (S.redact(t, sum(map(list, S.scan(t)), [])), s) for d, (t, s) in kept.items()}


def test_run_equals_brute_force(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()])
    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(got) == set(want) and len(want) > 50
    for d, (text, source) in want.items():
        assert list(got[d].ids) == tok.encode(text, add_special_tokens=False).ids and got[d].source == source and got[d].n_tokens == len(got[d].ids)
        assert got[d].decoded_sha256 == hashlib.sha256(tok.decode(list(got[d].ids), skip_special_tokens=False).encode()).hexdigest()


def test_near_duplicates_share_their_shingles(spark):
    """The second stage against all pairs: links are pairs of exact similarity 0.8, neither fewer nor more."""
    docs = P.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [set(zip(*(t.encode().lower().split()[i:] for i in range(5)))) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert {r.doc_id for r in P.near_duplicates(spark, docs, SF).collect()} == {rows[i][0] for i, g in enumerate(group) if g == i}


def test_rows_come_in_the_order_of_the_mixture(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else the rows are one file
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    sources = ["hot"] * 400 + [f"s{i % 5}" for i in range(300)] + [None] * 20
    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 50), s) for i, s in enumerate(sources)], "doc_id long, text string, source string").repartition(7)
    want = [(r.doc_id, r.place) for r in mixing.scheduled(docs, **P.MIX).orderBy("place").collect()]
    files = written(P.mixture(spark, docs, SF), "mix")
    stored = files.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    assert [r.doc_id for r in stored] == [d for d, _ in want] and len({r.file_name for r in stored}) > 1
    out = written(P.tokens(spark, files, SF), "tokens")
    got = out.select("doc_id", "place", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    assert [(r.doc_id, r.place) for r in got] == want


def test_run_keeps_the_places(spark):
    places = [r.place for r in P.run(spark, SF).select("place").collect()]
    assert places == sorted(set(places)) and len(places) > 50


def long_text(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def test_stages_on_odd_rows(spark):
    rows = [
        (1, long_text(1), "en", "a", 5, "k"), (1, long_text(1), "en", "a", 5, "k"), (2, long_text(1) + " tail", None, None, None, None), (3, None, "en", "a", 1, "k"),
        (4, "", "en", "b", 0, "k"), (None, long_text(4) + " password=abcdefgh", "en", None, 3, "k"), (6, long_text(9, 30_000), "de", "b", 7, "k"), (7, "###" * 90, "en", "c", 1, "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rules_kept string")
    out = docs
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    kept = {r.doc_id: r for r in out.collect()}
    assert out.count() == 3 and set(kept) == {1, None, 6}
    assert kept[None].text.endswith("[SECRET]") and kept[None].n_chars == len(kept[None].text)
    assert P.tokens(spark, out, SF).count() == 3
    for _, stage in P.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0
