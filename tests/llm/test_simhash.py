"""SimHash groups against all pairs and union-find; the search is exact for any allocation."""

import numpy as np
import pytest
import xxhash

from tickloom.llm import queries
from tickloom.llm import simhash as H

SF = "/root/testdata/sf0.01"


def plain_fp(text, k=3):
    words = [w for w in (text or "").encode().lower().split()]
    sh = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(rows, radius, k=3):
    """{index: least id} by comparing all pairs."""
    fps = [plain_fp(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return fps, [low.get(find(i)) for i in range(len(rows))]


def test_fingerprint_matches_the_plain_form(monkeypatch):
    monkeypatch.setattr(H, "PIECE", 3)
    for t in ["", " \n", "One", "one two", "A b C", "a b c d e f g\x0bh", "é ß É\xa0x y z", "w " * 50]:
        for k in (3, 5):
            assert H.fingerprint(t, k) == plain_fp(t, k)


@pytest.mark.parametrize("radius", [1, 2, 5])
def test_links_equal_all_pairs(spark, monkeypatch, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    v = [int(x) for x in base]
    for x in base[:70]:
        for _ in range(6):
            x = int(x)
            for b in rng.integers(0, 64, rng.integers(1, radius + 3)):
                x ^= 1 << int(b)
            v.append(x)
    v = sorted(set(v))
    second = {x: int(rng.integers(0, 4)) for x in v}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, second[x]) for x in v], "fp long, second long")
    stats = H.bit_stats(df)
    assert stats.n == len(v)
    plans = [H.plan(stats, radius), H.plan(stats, radius, 1 if radius < 3 else 3)]
    for p in plans:
        assert sum(t + 1 for t in p.thresholds) == radius + 1 and sorted(b for g in p.parts for b in g) == list(range(64))
    for rows_at_once, verify in ((20_000, 64), (3, 64), (20_000, 1)):
        monkeypatch.setattr(H, "BUCKET_ROWS", rows_at_once)
        got = H.components(H.links(df, radius, plans[0], verify)).collect()
        root = {x: x for x in v}
        root |= {int(r.node[:16], 16): int(r.root[:16], 16) for r in got}
        want = plain_components(v, radius, second, verify)
        assert {frozenset(x for x in v if root[x] == r) for r in root.values()} == want


def plain_components(v, radius, second, verify):
    group = {x: {x} for x in v}
    for i, a in enumerate(v):
        for b in v[:i]:
            if (a ^ b).bit_count() <= radius and (second[a] ^ second[b]).bit_count() <= verify and group[a] is not group[b]:
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    return {frozenset(g) for g in group.values()}


def test_query_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps, low = plain_groups([(r.doc_id, r.text) for r in docs], 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, SF).collect()}
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(docs, fps, low)}


def edited_pairs(each=120, n=200):
    """(text, copy) pairs; k words of the copy are new, so 5 k of the n - 4 shingles are."""
    rng = np.random.default_rng(3)
    for k in (3, 4, 5, 6):
        for _ in range(each):
            words = ["".join(x) for x in rng.choice(list("abcdefghijkl"), (n, 6))]
            copy = list(words)
            for at in rng.choice(np.arange(1, n // 8 - 1), k, replace=False):
                copy[8 * at] = "".join(rng.choice(list("mnopq"), 9))
            yield " ".join(words), " ".join(copy)


def test_similarity_decides(spark):
    pairs = list(edited_pairs())
    sets = [[set(zip(*(t.split()[i:] for i in range(5)))) for t in p] for p in pairs]
    alike = [len(a & b) / len(a | b) >= 0.8 for a, b in sets]
    assert 0 < sum(alike) < len(alike)
    df = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    low = {r.doc_id: r.component_id for r in H.grouped(df, words=5, radius=10, verify=12, jaccard=0.8).collect()}
    linked = [low[2 * i] == low[2 * i + 1] for i in range(len(pairs))]
    recall, false = sum(x and y for x, y in zip(linked, alike)) / sum(alike), sum(x and not y for x, y in zip(linked, alike))
    print("recall", recall, "of", sum(alike), "false", false, "of", len(alike) - sum(alike))
    assert recall >= 0.95 and false == 0 and len(low) == 2 * len(pairs)


def test_a_failed_star_hides_no_pair(spark):
    """b and c are alike, the least set of their bands like neither of them."""
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[: 120 - cut] + [f"x{cut}_{i}" for i in range(cut)]) for cut in (0, 4, 8, 12, 16, 20, 24, 28, 32)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    keys = [set(H.band_keys(H.shingle_set(t, 5))) for t in texts]
    group = list(range(len(texts)))
    for i, j in [(i, j) for i in group for j in range(i) if keys[i] & keys[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]:
        group = [group[j] if g == group[i] else g for g in group]
    low = {g: min(i for i in range(len(group)) if group[i] == g) for g in group}
    got = {r.doc_id: r.component_id for r in H.grouped(df, words=5, radius=10, verify=12, jaccard=0.8).collect()}
    assert got == {i: low[g] for i, g in enumerate(group)}


def test_odd_rows(spark):
    rows = [(3, "a b c d", 1), (3, "a b c d", 1), (1, "A  b\tc d", 2), (7, None, 3), (5, "", 4), (None, "x y z", 5), (9, "x y z", 6), (None, "q r s t", 7), (11, "lone words here now", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in H.grouped(df).collect()), key=str)
    assert got == sorted([(3, 1), (3, 1), (1, 1), (7, 5), (5, 5), (None, 9), (9, 9), (None, None), (11, 11)], key=str)
    kept = H.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.fp for r in kept.collect()) == [2, 4, 5, 6, 7, 8]
    twins = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 1)], "doc_id long, text string, fp int")
    assert H.deduplicated(twins).count() == 1
    assert H.grouped(df.filter("false")).count() == 0 and H.deduplicated(df.filter("false")).count() == 0


def chains(n, step, size, seed):
    """Sets of which each shares most with the next ones, so that a star at one of them fails for many."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-(1 << 62), 1 << 62, n * step + size)
    return [np.unique(base[i * step : i * step + size]) for i in range(n)]


@pytest.mark.parametrize("step", [3, 12, 40])
def test_cells_link_what_all_pairs_link(step):
    sets = chains(40, step, 100, 1) + chains(5, 200, 100, 2)
    n = len(sets)
    linked = lambda pairs, k: components_of(k, pairs)
    close = [(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    offsets = np.append(0, np.cumsum([len(x) for x in sets]))
    found = H.cell_links(np.arange(n).astype(str), offsets, np.concatenate(sets), 0.8)
    assert set(found) <= {(j, i) for i, j in close} | set(close)
    assert linked(found, n) == linked(close, n) and len(found) < n
    known = ["a" if i < 20 else str(i) for i in range(n)]
    more = H.cell_links(np.array(known), offsets, np.concatenate(sets), 0.8)
    joined = [(0, i) for i in range(20)]
    assert linked(more + joined, n) == linked(close + joined, n)


def components_of(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [x if r == y else r for r in root]
    return sorted(sorted(i for i in range(n) if root[i] == r) for r in set(root))


def test_large_groups_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(H, "CELL_HASHES", 700)
    sets = chains(60, 6, 100, 3)
    rows = [(f"s{i:02d}", [int(v) for v in x]) for i, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "sig string, set array<long>")
    own = table.selectExpr("7L AS group", "sig", "sig AS own").unionByName(table.limit(2).selectExpr("8L AS group", "sig", "sig AS own"))
    got = [(int(r.a[1:]), int(r.b[1:])) for r in H._linked(own, table, 0.8).collect()]
    close = [(i, j) for i in range(60) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert components_of(60, got) == components_of(60, close) and len(components_of(60, close)) == 1
