
import itertools

from hibiki.llm import abuse, qa_defects


def test_clusters_of_long_chains_and_whole_buckets(spark):
    nodes = [f"{i:04d}" for i in range(300)]
    chain = [(nodes[(i * 7) % 300], nodes[((i + 1) * 7) % 300]) for i in range(299)]  # one path through all, ends far apart
    got = qa_defects.components(spark.createDataFrame([*chain, ("x", "y")], "u string, v string")).collect()
    assert sorted((r["node"], r["least"]) for r in got) == [(n, "0000") for n in nodes[1:]] + [("y", "x")]

    base = "the operator on duty must first close the valve"
    texts = sorted({base[: 24 + i] for i in range(24)} | {base[i:] for i in range(12)})
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    shingles = {t: qa_defects._shingles(t).tolist() for t in texts}
    label = {t: t for t in texts}
    for _ in texts:
        for x, y in itertools.permutations(texts, 2):
            if jaccard(shingles[x], shingles[y]) >= 0.8:
                label[x] = label[y] = min(label[x], label[y])
    for first, second in ((texts, texts), (texts[::2], texts[1::2])):  # the least text is not similar to most of its bucket
        mine = {t: t for t in texts}
        links = qa_defects._linked(first, second, 0.8)
        assert all(jaccard(shingles[x], shingles[y]) >= 0.8 for x, y in links)
        for _ in texts:
            for x, y in links:
                mine[x] = mine[y] = min(mine[x], mine[y])
        assert first is not second or mine == label
    assert len(qa_defects._linked(texts, texts, 0.8)) == len(texts) - len(set(label.values()))


def test_recurrence_under_unrelated_prompts_reveals_refusals(spark):
    no = "Diese Anfrage kann ich leider nicht beantworten."
    asked = ["Wie lange muss man warten, bis die Pumpe kalt ist?", "Wer darf den Deckel der Presse öffnen?", "Wo liegt das Ersatzteil für das Ventil?"]
    alike = [f"Wer beantwortet am Standort {i} eine Anfrage zur Pumpe?" for i in ("Nord", "Süd", "West")]
    rows = [(f"r{i}", q, no) for i, q in enumerate(asked)]
    rows += [(f"s{i}", q, "Das Büro kann die Anfrage nicht vor dem Mittag beantworten.") for i, q in enumerate(alike)]
    rows += [("t0", asked[0], "Das Werk gibt zu solch einer Frage keine Antwort."), ("u0", asked[1], "Die Leitung."), ("u1", asked[2], "Die Leitung."), ("u2", asked[0], "Die Leitung.")]
    rows += [(f"j{i}", q, "その種のお問い合わせには応じられませんので、ご了承ください。") for i, q in enumerate(["弁はどこにありますか？", "誰の許可で軸受を交換しますか？"])]
    df = spark.createDataFrame(rows, "k string, q string, a string")
    got = {r["k"]: r["defect_type"] for r in qa_defects.qa_defects(df, "k", "q", "a").collect()}
    assert got == {"r0": "refusal", "r1": "refusal", "r2": "refusal", "j0": "refusal", "j1": "refusal"}


def test_broken_off_does_not_depend_on_the_size_of_the_table(spark):
    whole = [(f"w{i}", f"Where is the spare part for AB-{i}?", f"Spare parts for AB-{i} are kept in the cold store; the quality desk hands them out.") for i in range(100, 130)]
    whole += [(f"v{i}", f"Whom do I call about AB-{i}?", f"For AB-{i} please call the quality desk.") for i in range(100, 103)]
    asked = [("cut", "Where is the spare part for CD-900?", "Spare parts for CD-900 are kept in the cold store; the quality desk"), ("bare", "Whom do I call about CD-901?", "For CD-901 please call the quality desk")]
    for times in (1, 4):
        rows = asked + [(f"{k}-{t}", q.replace("AB", f"A{'BCDE'[t]}"), a.replace("AB", f"A{'BCDE'[t]}")) for k, q, a in whole for t in range(times)]
        got = {r["k"]: r["defect_type"] for r in qa_defects.qa_defects(spark.createDataFrame(rows, "k string, q string, a string"), "k", "q", "a").collect()}
        assert got == {"cut": "truncated"}


def test_terms_of_all_four_sizes():
    assert len(abuse.features("abcdefgh")[0]) == 7 + 6 + 5 + 3


def test_every_compatibility_form_is_folded():
    for disguised, plain in (("\u1107\u1161\u1107\u1169", "바보"), ("ⓘⓓⓘⓞⓣ", "idiot"), ("ⁱdiot", "idiot"), ("tr＠sh", "trash")):
        assert abuse.undisguised(disguised) == abuse.undisguised(plain)


def test_packing_of_pieces_over_half_the_capacity_stays_in_shards(spark):
    from hibiki.llm import packing

    df = spark.createDataFrame([(i, 60 + i % 30) for i in range(400)], "doc_id long, n_tokens long")
    first = packing.pack(df, [(1, 100)], per_shard=50).collect()
    assert len(first) == 400 and all(r["n_members"] == 1 for r in first)
    small = spark.createDataFrame([(i, 1 + (i * 37) % 40) for i in range(400)], "doc_id long, n_tokens long")
    runs = [{(r["container_id"], r["fill_tokens"]) for r in packing.pack(small, [(1, 100)], per_shard=50).collect()} for _ in range(2)]
    assert runs[0] == runs[1] and sum(f for _, f in runs[0]) == sum(1 + (i * 37) % 40 for i in range(400))
    assert len(runs[0]) <= 1.05 * sum(f for _, f in runs[0]) / 100 + 8


def test_long_quotations_lists_and_headings(spark):
    from hibiki.llm import sentences

    for n in (20, 60):
        assert len(sentences.units("「" + "弁を閉めて点検する。" * n + "」と書いてある。次に進む。")) == 2
    line = "1. " + "check the valve and the belt " * 12
    got = sentences.units(line.strip() + "\nNext step here\n2. open it")
    assert [a for a, _ in got] == [0, len(line), len(line) + 15]


def test_short_questions_given_back_are_copies():
    assert qa_defects.is_copy("担当は？", "担当は？") and qa_defects.is_copy("担当は？", "「担当は」というご質問ですね。")
    assert not qa_defects.is_copy("担当は？", "担当は班長です。") and not qa_defects.is_copy("？", "はい")


def test_links_found_of_those_of_brute_force(spark):
    """Of the pairs of openings with similarity 0.8 or more, how many end in one cluster: at least nine tenths."""
    import random

    rng = random.Random(4)
    base = ["the valve of the press must be closed before the shift ends", "軸受を外し、三十分待ってから清掃します。その後、点検票に記入します", "bitte zuerst die pumpe abstellen und dann den deckel öffnen"]
    texts = set()
    for i in range(240):
        t = list(base[i % 3])
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice("abcdxyz記録")
        texts.add("".join(t))
    texts = sorted(texts)
    sets = [set(qa_defects._shingles(t).tolist()) for t in texts]
    true = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    cluster = {r["opening"]: r["cluster"] for r in qa_defects.opening_clusters(spark.createDataFrame([(t,) for t in texts], "opening string"), chunk=50).collect()}
    found = sum(cluster[texts[i]] == cluster[texts[j]] for i, j in true)
    assert len(true) > 100 and found >= 0.9 * len(true)


def test_leaks_of_one_letter_and_of_many_blocks(spark):
    from hibiki.llm import leaks

    docs = spark.createDataFrame([(1, "Ａ valve"), (2, "b"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("t", "x", "a"), ("t", "y", "VALVE!"), ("t", "z", "b")], "item_table string, item_id string, item_text string")
    want = {(1, "t", "x"), (1, "t", "y"), (2, "t", "z")}
    for block in (1, 12_000_000):
        assert {tuple(r) for r in leaks.leaks(docs, "doc_id", "text", items, block_chars=block).collect()} == want


def test_abuse_over_two_passages_and_long_memory(spark):
    rows = [(i, "You filthy idiot.\nCheck the valve." if i % 2 else "Check the valve.\nWait for the press.", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    for remembered in (200_000, 0):
        got = {r["doc_id"]: r["score"] for r in abuse.abuse_scores(docs, labels, remembered=remembered).collect()}
        assert all((got[i] > 0.5) == bool(i % 2) for i in range(40))
