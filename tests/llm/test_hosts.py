"""Host reputation: url parts, rules, shrinkage against a plain form, odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.llm import hosts as H


def test_url_parts(spark):
    cases = {
        "https://WWW.Example.com/en/7?x=1#y": ("www.example.com", "/en/7"), "http://a.b?q": ("a.b", ""), "a.b/c": ("", ""), "": ("", ""), None: ("", ""),
        "x://h#f/p": ("h", ""), "://h/p://q": ("h", "/p://q"), "s://ÄB/x\ny": ("Äb", "/x\ny"), "s:///p": ("", "/p"), "s://u@H:80/": ("u@h:80", "/"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: (r.h, r.p) for r in df.select("url", H.host_of(F.col("url")).alias("h"), H.path_of(F.col("url")).alias("p")).collect()}
    assert got == cases


def test_names(spark):
    cases = {"a.b.example.co.uk": ("example.co.uk", "co.uk"), "example.com": ("example.com", "com"), "localhost": ("localhost", "localhost"), "": ("", ""), "u@x.org:8080": ("x.org", "org")}
    df = spark.createDataFrame([(h,) for h in cases], "h string").withColumn("n", H.name_of(F.col("h")))
    assert {r.h: (r.d, r.s) for r in df.select("h", H.domain_of(F.col("n")).alias("d"), H.suffix_of(F.col("n")).alias("s")).collect()} == cases


def test_longest_rule_wins(spark):
    cases = {
        ("a.example.com", "/en/7"): "example.com/en/7", ("example.com", "/en/6"): "com/en/", ("myexample.com", "/en/7"): "com/en/", ("com", "/en/"): "com/en/",
        ("example.net", "/de/81"): "example.net/de/8", ("x.net", "/de/8"): "net/de/", ("x.org", "/es"): None, ("xorg", "/es/"): None,
    }
    df = spark.createDataFrame([(*k,) for k in cases], "h string, p string")
    assert {(r.h, r.p): r.r for r in df.select("h", "p", H.rule_of(F.col("h"), F.col("p"), H.RULES)["rule"].alias("r")).collect()} == cases


def plain(counts, b):
    """Posterior bounds of {name: (n, x)} in plain Python."""
    dom, suf = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    def add(f, of):
        out = {}
        for k, (n, x) in of.items():
            m, y = out.get(f(k), (0, 0))
            out[f(k)] = (m + n, y + x)
        return out
    d = add(dom, counts)
    s = add(suf, d)
    n, x = map(sum, zip(*s.values()))
    mu = (x + 1) / (n + 2)
    def strength(groups, parent):
        over = of = 0
        for k, (n, x) in groups.items():
            if n:
                total, bad = parent(k)
                m = bad / total
                over += (x - n * m) ** 2 / n - m * (1 - m) * (1 - n / total)
                of += m * (1 - m) * (1 - n / total) * (n - 1)
        return 1 / min(b.most, max(b.least, over / of if of > 0 else b.unknown)) - 1
    top = (n, x)
    s1, s2, s3 = strength(s, lambda k: top), strength(d, lambda k: s[suf(k)]), strength(counts, lambda k: d[dom(k)])
    out = {}
    for k, (n, x) in counts.items():
        (dn, dx), (sn, sx) = d[dom(k)], s[suf(k)]
        ms = (sx - dx + mu * s1) / (sn - dn + s1)
        md = (dx - x + ms * s2) / (dn - n + s2)
        p, q = x + md * s3, n - x + (1 - md) * s3
        out[k] = p / (p + q) - b.z * math.sqrt(p * q / ((p + q) ** 2 * (p + q + 1)))
    return out


def test_shrinkage_and_verdicts(spark):
    counts = {"bad.x.com": (60, 57), "one.w.com": (1, 1), "good.y.com": (80, 4), "none.y.com": (0, 0), "z.org": (30, 3)}
    rows, labels, i = [], [], 0
    for h, (n, x) in counts.items():
        for k in range(n + 2):
            rows.append((i, f"http://{h}/p", "kept"))
            if k < n:
                labels += [(i, int(k < x)), (i, 0)]
            i += 1
    rows += [(i, None, "n"), (None, "http://bad.x.com/en/", "m"), (0, rows[0][1], "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, name string")
    lab = spark.createDataFrame(labels, "id long, bad int")
    b = H.Bounds()
    out = H.judged(pages, lab)
    assert out.columns == ["page_id", "url", "name", "host", "path", "rule", "verdict"] and out.count() == len(rows)
    seen = {}
    for r in out.collect():
        if r.rule is None:
            seen.setdefault(r.host, set()).add(r.verdict)
    assert seen["bad.x.com"] == {"block"} and all(v == {"allow"} for h, v in seen.items() if h != "bad.x.com")
    known = pages.select(H.host_of(F.col("url")).alias("name"), "page_id").filter("name != ''").join(lab.groupBy("id").agg(F.max("bad").alias("bad")), F.col("id") == F.col("page_id"), "left")
    got = {r.name: r.bound for r in H.reputation(known.filter("page_id > 0").select("name", "bad"), b).collect()}
    want = plain({**counts, "bad.x.com": (59, 56)}, b)
    assert got == pytest.approx(want, abs=1e-9)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "id long, bad int")
    assert H.judged(pages, labels).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/en/x")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in H.judged(one, labels).collect()] == [("com/en/", "block")]
