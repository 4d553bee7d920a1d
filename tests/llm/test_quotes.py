"""Quotation linking: levels, links and threads against a plain form; own texts come back whole."""

import re


from tickloom.llm import queries
from tickloom.llm import quotes as Q

SF = "/root/testdata/sf0.01"


def plain(rows):
    """{(conv, turn): (n_quoted, n_linked, max_level, parent, root, depth)} in plain Python."""
    own, quoted = {}, {}
    for c, t, text in rows:
        for line in re.split(r"\r\n|\n|\r", text or ""):
            m = re.match(Q.MARKS, line)
            level = m[1].count(">") if m else 0
            p = re.sub(r"\s+", " ", line[m.end():] if m else line).strip().lower()
            if len(p) < Q.LEAST_CHARS:
                continue
            if level:
                quoted.setdefault((c, t), []).append((level, p))
            elif c is not None and t is not None:
                own.setdefault((c, p), set()).add(t)
    out = {}
    for c, t, _ in sorted({(c, t, None) for c, t, _ in rows if c is not None and t is not None}):
        q = quoted.get((c, t), [])
        link = [(lv, max(o for o in own.get((c, p), ()) if o < t)) for lv, p in q if min(own.get((c, p), {t})) < t]
        parent = max([o for lv, o in link if lv == 1], default=None)
        root, depth = (t, 0) if parent is None else (out[c, parent][4], out[c, parent][5] + 1)
        out[c, t] = (len(q), len(link), max([lv for lv, _ in q], default=0), parent, root, depth)
    return out


ROWS = [
    (1, 0, "u", "Hello there\nsecond line"), (1, 1, "a", "Ada wrote:\n> hello  THERE\nMy answer"), (1, 2, "u", ">> Hello there\n> My answer\nthanks\n\n\n\nbye"),
    (1, 3, "a", " > > Hello there\n>second line\nnew"), (1, 4, "u", "> never said\nself\n> self"), (1, 5, "u", None), (1, 6, "u", ""), (1, 7, "x", "> ok\nok"),
    (2, 0, "u", "> Hello there"), (2, 1, None, "Hello there"), (2, 2, "a", "> Hello there\r\n> \r\nyes"), (None, 1, "u", "> Hello there\nx"), (3, None, "u", "own line"),
    (4, 0, "u", "line of four " * 20_000), (4, 1, "a", "> " + "line of four " * 20_000),
]


def test_links_equal_the_plain_form(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)] + [(1, 1, "a", ROWS[1][3], 99)], "conv_id long, turn long, role string, text string, parent int")
    got = Q.linked(df).collect()
    want = plain([(c, t, x) for c, t, _, x in ROWS])
    assert len(got) == len(ROWS) + 1
    for r in got:
        key = (r.conv_id, r.turn)
        if None in key:
            assert (r.n_linked, r.parent_turn, r.depth) == (0, None, 0)
        elif key == (1, 1):  # the row is there twice, and so are its quotes
            assert (r.n_quoted, r.parent_turn, r.root_turn, r.depth) == (2, 0, 0, 1)
        else:
            assert (r.n_quoted, r.n_linked, r.max_level, r.parent_turn, r.root_turn, r.depth) == want[key], key
    clean = {(r.conv_id, r.turn): r.clean_text for r in got}
    assert clean[1, 1] == "My answer" and clean[1, 2] == "thanks\n\nbye" and clean[1, 5] == clean[1, 6] == ""


def test_deep_thread(spark):
    rows = [(7, i, "u", (f"> line number {i - 1}\n" if i else "") + f"line number {i}") for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((r.turn, r.parent_turn, r.root_turn, r.depth) for r in Q.linked(df).collect() if r.turn) == [(i, i - 1, 0, i) for i in range(1, 150)]


def test_short_passages_link(spark):
    rows = [(1, 0, "u", "ok"), (1, 1, "a", "> ok\nfine"), (1, 2, "u", ">> ok\n> fine\n"), (2, 0, "u", "好的"), (2, 1, "a", "> 好的\n> \nx"), (2, 2, "u", "> X")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_quoted, r.n_linked, r.max_level, r.parent_turn, r.root_turn, r.depth) for r in Q.linked(df).collect()}
    assert got[1, 1] == (1, 1, 1, 0, 0, 1) and got[1, 2] == (2, 2, 2, 1, 0, 2)
    assert got[2, 1] == (1, 1, 1, 0, 0, 1) and got[2, 2] == (1, 1, 1, 1, 0, 2)


def test_a_repeated_passage_links_to_the_nearest_original(spark, monkeypatch):
    rows = [(1, 0, "ok"), (1, 2, "ok"), (1, 3, "> ok\nso"), (1, 4, "ok"), (1, 9, "> ok"), (1, 10, "ok\n> ok"), (1, 30, "> ok\n> so"), (2, 5, "> ok"), (2, 6, "ok"), (None, 1, "ok"), (None, 2, "> ok")]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    for run in (512, 4, 1):
        monkeypatch.setattr(Q, "RUN", run)
        got = {(r.conv_id, r.turn): r.parent_turn for r in Q.linked(df).collect()}
        assert [got[1, t] for t in (3, 9, 10, 30)] == [2, 4, 4, 10] and got[2, 5] is None and got[None, 2] is None
    hot = spark.createDataFrame([(7, i, "u", "> ok\nok") for i in range(300)], df.schema)
    monkeypatch.setattr(Q, "RUN", 16)
    assert {(r.turn, r.parent_turn) for r in Q.linked(hot).collect() if r.turn} == {(i, i - 1) for i in range(1, 300)}


def test_query_equals_the_plain_form(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    mail = Q.as_mail(conv).collect()
    want = plain([(r.conv_id, r.turn, r.text) for r in mail])
    got = queries.op4_quotes(spark, SF).collect()
    assert {(r.conv_id, r.turn): (r.n_quoted, r.n_linked, r.max_level, r.parent_turn, r.root_turn, r.depth) for r in got} == want
    texts = {(r.conv_id, r.turn): r.text for r in conv.collect()}
    assert all(r.clean_text == re.sub(r"\n{3,}", "\n\n", texts[r.conv_id, r.turn]).strip() for r in got)
    assert sum(r.parent_turn is not None for r in got) > 0.95 * sum(r.turn > 0 for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert Q.linked(df).count() == 0 and Q.as_mail(df).count() == 0
