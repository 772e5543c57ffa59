import itertools
import random
import re
import unicodedata

import numpy as np
import pytest

from hibiki.llm import abuse, dup_format, leaks, lookalike, mixing, packing, queries


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["弁", "軸受", "清掃", "ノズル", "belt", "fuse", "Relay", "12", "AB-345", "。", " ", "！", "東棟"]
    say = lambda n: "".join(rng.choice(words) for _ in range(n))
    items = [("t", f"i{i}", say(rng.randint(1, 14))) for i in range(60)] + [("t", "none", "！ 。"), ("t", "null", None), ("u", "i0", None)]
    docs = []
    for d in range(80):
        text = say(rng.randint(0, 30))
        if d % 2:
            s = rng.choice(items[:60])[2]
            text += s[rng.randint(0, 2) : len(s) - rng.randint(0, 4)].upper() + say(5)
        docs.append((d, text))
    docs += [(900, None), (901, ""), (902, items[0][2]), (902, items[0][2])]
    norm = leaks.letters
    want = set()
    for d, text in docs:
        for t, i, s in items:
            n = norm(s) if s else ""
            need = -(-7 * len(n) // 10)
            if text and n and any(n[k : k + need] in norm(text) for k in range(len(n) - need + 1)):
                want.add((d, t, i))
    ddf = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, norm string")
    idf = spark.createDataFrame(items, "item_table string, item_id string, item_text string")
    for block in (12_000_000, 150):
        got = leaks.leaks(ddf, "doc_id", "text", idf, block_chars=block).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert leaks.leaks(ddf, "doc_id", "text", idf.limit(0)).count() == 0
    assert leaks.leaks(ddf.limit(0), "doc_id", "text", idf).count() == 0


def form(s):
    out = "".join(lookalike._decomposed(ord(c)) if not 0xAC00 <= ord(c) <= 0xD7A3 else c for c in s)
    return unicodedata.normalize("NFC", out)


ALIKE = [
    ("パッキン", "ﾊﾟｯｷﾝ", "パッキン", "パッ​キン"),
    ("Ver.5 A", "Ｖｅｒ．５　Ａ", "Vеr.5 А"),
    ("é", "é"),
    ("カエル", "力エル", "カ工ル"),
    ("搬入口", "搬入⼝"),
    ("ấ", "ấ"),
    ("q̣̇", "q̣̇"),
    ("가", "가"),
    ("ู่", "ู​่"),
]
APART = ["ver.5 A", "Ver.5  A", "Ver.5\tA", "Ver.5 A!", "e", "è", "Ver.6 A", "", None]


def test_lookalikes_equal_brute_force(spark):
    values = [v for g in ALIKE for v in g] + APART + ["パッキン", "é", "abc"]
    rows = [("t", i, v) for i, v in enumerate(values)] + [("u", 100, "é"), ("u", 101, "é")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "src string, row long, v string, form int")
    got = {tuple(r) for r in lookalike.alike_pairs(df, ["src"], "row", "v", chunk_rows=3).collect()}
    want = {(s, i, j) for (s, i, v), (t, j, w) in itertools.combinations(rows, 2) if s == t and v is not None and w is not None and v != w and form(v) == form(w)}
    assert got == want and len(want) > 15
    forms = {v: form(v) for g in ALIKE for v in g}
    assert all(len({forms[v] for v in g}) == 1 for g in ALIKE)
    assert len({form(v) for v in APART if v is not None} | {form(g[0]) for g in ALIKE}) == len(APART) - 1 + len(ALIKE)
    assert lookalike.alike_pairs(df.limit(0), ["src"], "row", "v").count() == 0


def plain(v):
    if v is None:
        return None
    v = re.sub(r"\s+", "", v).lower()
    keep = []
    for m in re.finditer(r".", v):
        keep.append(m.group())
    out, i = [], 0
    while i < len(v):
        j = i
        while j < len(v) and unicodedata.category(v[j])[0] == "P":
            j += 1
        if j > i:
            if i > 0 and j < len(v) and unicodedata.category(v[i - 1]) == "Nd" and unicodedata.category(v[j]) == "Nd":
                out.append(v[i:j])
            i = j
        else:
            out.append(v[i])
            i += 1
    return "".join(out)


def test_copies_equal_brute_force(spark):
    import json

    payloads = ['{"q": "弁は 8:15 か？", "t": "A"}', '{"t":"a","q":"弁は8:15か"}', '{"t":"a","q":"弁は815か"}', '{"t":"a"}', '{"t":null}', '{"t": null }', '{"t":"null"}', '{"q": "x', "[1]", "", None, '{"t":"A!"}', "{}", "{ }", '{"u":"a"}', '{"n": 1, "t": "a"}', '{"t":"a","n":1}'] + ['{"t": "hot"}', '{ "t" : "HOT." }'] * 40
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate(payloads)], "src string, key long, payload string")
    from pyspark.sql import functions as F

    got = {(r["key"], r["first"]) for r in dup_format.copies(df.withColumn("fields", dup_format.payload_fields(F.col("payload"))), "src", "key", "fields").collect()}
    groups = {}
    for i, p in enumerate(payloads):
        try:
            d = json.loads(p)
            assert isinstance(d, dict)
        except Exception:
            continue
        groups.setdefault(frozenset((k, plain(v if v is None or isinstance(v, str) else str(v))) for k, v in d.items()), []).append(i)
    assert got == {(i, min(g)) for g in groups.values() for i in g}


def test_copies_of_hot_groups_and_colliding_sums(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(dup_format, "fingerprint", lambda f: [F.lit(0).alias(c) for c in dup_format._SUMS])
    df = spark.createDataFrame([("s", i, {"a": str(i % 3)}) for i in range(30)], "src string, key long, fields map<string,string>")
    got = {(r["key"], r["first"]) for r in dup_format.copies(df, "src", "key", "fields").collect()}
    assert got == {(i, i % 3) for i in range(30)}


def test_place_never_overfills_and_beats_next_fit():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 400) for _ in range(3000)), reverse=True)
    where, fill = packing.place(sizes, 512)
    sums = [0] * len(fill)
    for s, w in zip(sizes, where, strict=True):
        sums[w] += s
    assert sums == fill and max(fill) <= 512
    assert sum(sizes) / (512 * len(fill)) > 0.97
    assert packing.place([], 10) == ([], [])


def test_pack_is_whole_and_splits_only_the_large(spark):
    sizes = [(i, 1 + (i * 37) % 700) for i in range(500)] + [(1000, 0), (1001, None), (1002, 5000), (7, 9), (7, 9)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    rows = packing.pack(df, [(1, 512), (2, 2048)], per_shard=100).collect()
    for pid, cap in ((1, 512), (2, 2048)):
        mine = [r for r in rows if r["pack_id"] == pid]
        assert all(r["fill_tokens"] == sum(m["tokens"] for m in r["members"]) <= cap and r["n_members"] == len(r["members"]) for r in mine)
        got = sorted((m["doc_id"], m["part"], m["tokens"]) for r in mine for m in r["members"])
        want = []
        for d, n in sizes:
            if n and n <= cap:
                want.append((d, 0, n))
            elif n:
                want += [(d, k + 1, min(cap, n - k * cap)) for k in range(-(-n // cap))]
        assert got == sorted(want)
        assert sum(r["fill_tokens"] for r in mine) / (cap * len(mine)) > 0.9
    assert packing.pack(df.limit(0), [(1, 512)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [(1, 0)])


def test_split_tree_is_exact():
    counts = np.array([5, 0, 900, 41])
    deal = mixing.split_tree(counts, 7, np.random.default_rng(1))
    assert (deal.sum(0) == counts).all() and deal.sum(1).max() - deal.sum(1).min() <= 1


def test_mix_reaches_shares_within_repeats(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice("aaaaaabbc"), rng.randint(1, 200)) for i in range(6000)] + [(9001, "zz", 50), (9002, None, 50), (9003, "a", 0)]
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("none", 0.05, 3)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    rows = mixing.mix(df, targets, shard_tokens=20_000).collect()
    total = sum(r["n_tokens"] for r in rows)
    got = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) / total for s, _, _ in targets}
    for s, share, most in targets[:3]:
        assert abs(got[s] - share / 0.95) < 0.002
        uses = {}
        for r in rows:
            if r["source"] == s:
                uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
        assert max(uses.values()) <= most
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r["position"])
    assert len(shards) > 5 and all(sorted(p) == list(range(len(p))) for p in shards.values())
    tdf = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixing.shares(mixing.mix(df, targets), df, tdf).collect()}
    assert report["none"]["drawn_docs"] == 0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    assert mixing.mix(df.limit(0), targets).count() == 0


@pytest.mark.parametrize("a, b", [("you i d i o t", "you idiot"), ("pi3c3 0f tr45h", "piece of trash"), ("うるさい、し ね", "うるさい、しね"), ("カ・ス", "カス"), ("ｉｄｉｏｔ", "idiot"), ("バ力", "バカ")])
def test_disguises(a, b):
    assert abuse.undisguised(a) == abuse.undisguised(b)


def test_abuse_learns_the_passage_from_document_labels():
    rng = random.Random(2)
    clean = [f"check the {a} of the {b}" for a in ("valve", "belt", "fuse", "relay") for b in ("press", "oven", "pump", "crane")]
    bad = [f"you are a {a} {b}" for a in ("filthy", "stupid", "worthless", "brainless") for b in ("idiot", "moron", "scum")]
    texts, votes = [], []
    for i in range(400):
        lines = [rng.choice(clean) for _ in range(6)]
        toxic = i % 4 == 0
        if toxic:
            lines.insert(rng.randint(0, 6), rng.choice(bad[:9]))
        texts.append("\n".join(lines))
        votes.append(float(toxic) if rng.random() > 0.05 else 1 - float(toxic))
    m = abuse.train(texts, np.array(votes))
    score = lambda s: m.line_scores(abuse.undisguised(s), 1)[0]
    assert min(score(b) for b in bad) > 0 > max(score(c) for c in clean)
    terms, starts = abuse._terms_of(["abcd efgh", "xy", "check the belt"], block=2)
    for block in (1, 1 << 20):
        assert np.allclose(m.scores(terms, starts, block), m.line_scores("abcd efgh\nxy\ncheck the belt", 3), atol=1e-4)


def test_abuse_operator_edges(spark):
    docs = spark.createDataFrame([(i, "you filthy idiot" if i % 2 else "check the valve", "s", 1.0) for i in range(40)] + [(90, None, "s", 1.0), (91, "", None, 1.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, None), (777, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in abuse.abuse_scores(docs, labels).collect()}
    assert len(got) == 42 and got[90] == got[91] == 0 and got[35] > 0.5 > got[36]
    assert all(r["score"] < 0.5 for r in abuse.abuse_scores(docs, labels.limit(0)).collect())
    assert abuse.abuse_scores(docs.limit(0), labels).count() == 0


def test_every_query_runs(spark, data):
    for name, f in queries.QUERIES.items():
        df = f(spark, data)
        assert df.columns and df.count() >= 0, name


def test_queries_equal_sql(spark, data):
    """Every query of the folder that SQL can say, against DuckDB on whole tables."""
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    from hibiki.llm import sql

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    for name, text in sql.SQL.items():
        mine = queries.QUERIES[name](spark, data)
        names = sorted(mine.columns)
        rows = sorted(map(tuple, mine.select(names).collect()), key=repr)
        theirs = con.execute(f"SELECT {', '.join(names)} FROM ({text})").fetchall()
        assert rows == sorted(theirs, key=repr) and rows, name


def test_pairs_of_hot_texts_come_from_bounded_chunks(spark):
    rows = [("t", i, "ABC") for i in range(60)] + [("t", 100 + i, "ＡＢＣ") for i in range(40)] + [("t", 900, None)]
    df = spark.createDataFrame(rows, "src string, row long, v string")
    for chunk in (7, 2_000):
        got = [tuple(r) for r in lookalike.alike_pairs(df, ["src"], "row", "v", chunk_rows=chunk).collect()]
        assert len(got) == len(set(got)) == 2400 and all(a < 100 <= b for _, a, b in got)
