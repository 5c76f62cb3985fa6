"""Table operators of the training-data part: brute force, batches against all at once, odd and empty tables."""

import itertools
import json
import unicodedata

import pytest
from glyphmill.llm import common, encoding, history, language, leakage, lookalike, moderation, near, near_copies, personal, queries, sentences
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"
LONG_A = "the event shop of Torvel sold out of amber screws within forty minutes and the guild of Parnim left the old harbour for good"
LONG_B = "loading into Wynras from the travel screen crashes my desktop about nine times a week since the patch of last Thursday evening"


def spots(rows):
    return {tuple(r) for r in rows}


def test_copies_equal_brute_force(spark):
    b = spark.read.parquet("/root/testdata/sf0.01/bilibili.parquet").select("evidence_id", "original_text").distinct()
    rows = [r for r in b.collect() if r[1] and len(r[1]) >= near.LONG]
    level = dict(zip([r[0] for r in rows], common.level_many([r[1] for r in rows])))
    words = {k: brute.wording(v) for k, v in level.items()}
    index, parent = {}, {k: k for k in level}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, w in words.items():
        for g in w:
            index.setdefault(g, []).append(k)
    meet = {p for ids in index.values() if len(ids) < 200 for p in itertools.combinations(sorted(ids), 2)}
    for x, y in meet:
        if len(words[x] & words[y]) / len(words[x] | words[y]) >= near.SIMILAR:
            parent[root(x)] = root(y)
    groups = {}
    for k in level:
        groups.setdefault(root(k), []).append(k)
    want = {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}
    assert spots(near_copies.p4_found(spark, "/root/testdata/sf0.01").collect()) == want


def test_copies_edge_cases(df):
    rows = [("a", LONG_A, 1), ("b", LONG_A.upper().replace("O", "О") + "!!", 2), ("c", None, 3), ("d", "", 4), ("e", "short", 5), (None, LONG_A, 6), ("a", LONG_A, 7), ("f", LONG_B, 8)]
    got = {r.id: r.group for r in near_copies.copy_groups(df(rows, "evidence_id string, original_text string, group int")).collect()}
    assert set(got) == {"a", "b", "f"} and got["a"] == got["b"] != got["f"]
    assert near_copies.copy_groups(df([], "evidence_id string, original_text string")).count() == 0


def test_hot_group_of_copies_is_one_group(df):
    rows = [(f"h{i:03}", f"{LONG_A} number {i}") for i in range(150)] + [(f"x{i}", f"{LONG_B} {'abcdefgh'[i]} {i}") for i in range(8)]
    got = [r.group for r in near_copies.copy_groups(df(rows, "evidence_id string, original_text string")).filter("id like 'h%'").collect()]
    assert len(got) == 150 and len(set(got)) == 1


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r["class"]: r.comp for r in near.components(links).collect()}
    assert set(got.values()) == {0, 100} and got[30] == 0


def log_rows(spark):
    log = history.intake(spark.read.parquet(f"{SF}/evidence.parquet"), spark.read.parquet(f"{SF}/runs.parquet"))
    extra = [(9001, "new", None, LONG_A, 5), (9002, "new2", None, LONG_A + " indeed", 9), (9003, "new", "f", None, 9), (9004, None, "f", "short", 10), (9005, "n5", None, "", None)]
    return log.select("ingest_seq", "identity_key", "content_fingerprint", "text", "rank").unionByName(spark.createDataFrame(extra, "ingest_seq long, identity_key string, content_fingerprint string, text string, rank long"))


def scored(weights):
    """The linkage decision in Python."""

    def like(a, b):
        x = history.agreement(a, b)
        return weights.bias + sum(w * v for w, v in zip(weights.fields, x)) > 0

    return like


def test_batches_equal_brute_force(spark, tmp_path):
    """Batches against the store, with a store opened anew and a compaction between them, give what union-find over all pairs gives."""
    log = common.materialise(log_rows(spark), "log")
    ranks = sorted(r[0] for r in log.select("rank").filter("rank is not null").distinct().collect())
    cuts, got = [ranks[:2], ranks[2:-2], ranks[-2:]], set()
    for i, cut in enumerate(cuts):
        store = history.History(spark, str(tmp_path))
        got |= spots(store.add(log.filter(F.col("rank").isin(cut)).withColumn("class", F.lit("x"))).collect())
        if i == 1:
            store.compact()
        store.close()
    want = brute.repeats([tuple(r) for r in log.collect() if r.rank is not None], [set(c) for c in cuts], scored(store.weights))
    assert got == want and {(9002, "near"), (9003, "identity")} <= got and len({s for s, _ in got}) == len(got)
    again = history.History(spark, str(tmp_path))
    assert again.add(log.limit(0)).count() == 0 and again.version == 5 and again.stamps


def test_a_failed_batch_leaves_no_trace(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(list(r), "ingest_seq long, identity_key string, content_fingerprint string, text string, rank long")
    store = history.History(spark, str(tmp_path))
    assert store.add(rows((1, "a", "f", LONG_A, 1))).count() == 0
    with monkeypatch.context() as m:
        m.setattr(history.History, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.add(rows((2, "b", "g", LONG_B, 2)))
    assert spots(store.add(rows((3, "b", "g", LONG_B, 3), (4, "c", "f", "short", 3), (5, "d", "f", LONG_A + "!", 3))).collect()) == {(5, "exact")}
    assert spots(store.add(rows((6, "b", None, LONG_B, 4), (7, None, None, LONG_B.replace("nine", "ten"), 4))).collect()) == {(6, "identity"), (7, "near")}
    store.close()


def test_clusters_merge_across_batches(spark, tmp_path):
    """A later text that joins two clusters of the history re-points one, and what follows counts from the earlier first run."""
    w = [f"{a}{b}en" for a in ("kal", "mor", "tis", "bud", "rog", "fel") for b in ("a", "e", "i", "o", "u")]
    one, two, bridge = " ".join(w[:20]), " ".join(w[10:30]), " ".join(w[4:26])
    rows = lambda *r: spark.createDataFrame([(i, f"k{i}", None, t, n) for i, t, n in r], "ingest_seq long, identity_key string, content_fingerprint string, text string, rank long")
    store = history.History(spark, str(tmp_path))
    store.weights = history.Weights(-4.5, (10.0, 0.0, 0.0))
    got = [spots(store.add(rows(*x)).collect()) for x in ([(1, one, 1)], [(2, two, 2)], [(3, bridge, 3)], [(4, two + " x", 4)], [(5, one.upper(), 5), (6, "short", 5)])]
    assert got == [set(), set(), {(3, "near")}, {(4, "near")}, {(5, "near")}]
    roots = {r.root for r in store.root_of(store.table("clusters").select("class")).collect()}
    first = store.table("firsts").groupBy("comp").agg(F.min("rank").alias("r")).filter(F.col("comp").isin(list(roots))).collect()
    assert len(roots) == 1 and [r.r for r in first] == [1]
    store.close()


def test_learned_weights_part_copies_from_others():
    for texts in ([f"{LONG_A} {i} {LONG_B[i:]}" for i in range(40)], [" ".join(f"w{i * k % 97}" for k in range(1, 30)) for i in range(60)], []):
        w = history.fit_weights(texts)
        score = lambda *x: w.bias + sum(a * b for a, b in zip(w.fields, x))  # noqa: B023, E731
        assert score(0.7, 0.9, 0.9) > 0 > score(0.15, 0.3, 0.8)


def test_forms_and_pairs(df, spark):
    rows = [("a", LONG_A, "x"), ("b", LONG_A.replace("e", "е"), None), ("c", LONG_A.upper(), None), ("d", None, None), ("e", "", None), ("a", LONG_A, "x")]
    got = {r.id: r.form for r in lookalike.consistent(df(rows, "evidence_id string, original_text string, form string")).collect()}
    assert got["a"] == got["b"] != got["c"] and got["d"] == got["e"] == ""
    want = set()
    b = spark.read.parquet(f"{SF}/bilibili.parquet").select("evidence_id", "original_text").distinct().collect()
    for x, y in itertools.combinations(sorted(tuple(r) for r in b if r[1] and len(r[1]) >= 24), 2):
        if x[1] != y[1] and x[0] != y[0] and common.skeleton(x[1]) == common.skeleton(y[1]):
            want.add((x[0], y[0]))
    assert spots(lookalike.p6_found(spark, SF).collect()) == want


def test_encoded_table(df):
    own, _ = encoding.encoding(encoding.TOKENIZER)
    rows = [(1, "Hello <|endoftext|> " * 40, 0), (2, None, 0), (3, "", 0), (1, "Hello <|endoftext|> " * 40, 0), (4, "短い", 0)]
    got = sorted((r.id, tuple(r.ids)) for r in encoding.encode_table(df(rows, "doc_id long, text string, ids int"), piece=64).collect())
    assert got == sorted((i, tuple(own.encode_ordinary(t or ""))) for i, t, _ in rows)


def test_sentence_table(df):
    rows = [(1, "One. Two.", 5), (2, None, 0), (3, " \n ", 0), (1, "One. Two.", 5)]
    got = sentences.split_sentences(df(rows, "doc_id long, text string, start_pos int")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]


def test_leak_table(df, monkeypatch):
    docs = df([(1, "intro " + LONG_A, 0), (2, None, 0), (3, LONG_B[:50], 0), (1, "intro " + LONG_A, 0)], "doc_id long, text string, item int")
    items = df([(7, LONG_A), (8, LONG_A), (9, LONG_B), (10, None), (11, "")], "item_id long, passage string")
    want = {(1, 7), (1, 8)}
    assert spots(leakage.leaked(docs, items).collect()) == want
    monkeypatch.setattr(leakage, "BLOCK", 50)
    assert spots(leakage.leaked(docs, items).collect()) == want
    assert leakage.leaked(docs, items.limit(0)).count() == 0


def test_redacted_table(df):
    rows = [("a", "call me on 214-555-0124 please", "x"), ("b", None, "x"), ("c", "", "x"), ("d", "nothing here", "x")]
    got = {r.id: r for r in personal.redact(df(rows, "evidence_id string, original_text string, kinds string")).collect()}
    assert got["a"].redacted == "call me on [PHONE] please" and got["a"].contains_personal_data and got["a"].redaction_status == "redacted"
    assert got["b"].redacted is None and got["c"].redacted == "" and got["d"].redaction_status == "not_required"


def test_language_table(df):
    zh, ko = "教学关在鲸砚港收尾的时候体验提升很多，我的平板打开地图要等很久。", "솔직히 토한광산 이벤트 상점이 품절이래요. 제 태블릿에서는 자꾸 떨어져요."
    rows = [(f"z{i}", zh[i % 9 :] + zh[: 9 + i], "zh-CN") for i in range(30)] + [(f"k{i}", ko[i % 7 :] + ko[: 9 + i], "kor") for i in range(30)] + [("m", zh + ko, None), ("n", None, "zh"), ("e", "😂", "")]
    got = language.detect(df(rows, "evidence_id string, original_text string, language string")).filter("id in ('m', 'n', 'e', 'k1')").collect()
    found = {(r.id, r.label, r.lang) for r in got}
    assert found - {("m", None, "zh"), ("m", None, "ko")} == {("n", "zh", None), ("e", None, None), ("k1", "ko", "ko")} and len(found) > 3


def test_language_segments_keep_their_place(df):
    zh, ko = "教学关在鲸砚港收尾的时候体验提升很多", "솔직히 토한광산 이벤트 상점이 품절이래요"
    rows = [(f"z{i}", zh[i % 9 :] + zh[: 9 + i % 9] + str(i), "zh-CN") for i in range(250)] + [(f"k{i}", ko[i % 7 :] + ko[: 9 + i % 9] + str(i), "kor") for i in range(250)]
    mixed = f"😂 {zh}。\u200b{unicodedata.normalize('NFD', ko)}!"
    got = language.detect_segments(df([*rows, ("m", mixed, None), ("n", None, "zh"), ("e", "😂 12", "")], "evidence_id string, original_text string, language string")).filter("id in ('m', 'n', 'e')").orderBy("segment").collect()
    assert [(r.lang, unicodedata.normalize("NFC", mixed[r.start_pos : r.end_pos]).strip("\u200b")) for r in got] == [("zh", zh), ("ko", ko)] and all(r.id == "m" and 0 < r.confidence <= 1 for r in got)


def test_labels_as_an_expression(df):
    tags = ["zh-CN", " ENG ", "und", None, "", "Korean", "pt_BR", "jp", "x-zh"]
    assert [r.x for r in df([(t,) for t in tags], "t string").select(language.label_of(F.col("t")).alias("x")).collect()] == [language.label(t) for t in tags]


def test_moderated_table(df):
    rows = [("a", "you worthless moron", 1.0), ("b", None, 0.0), ("c", "", 0.0), ("d", "nice map", 0.0)] + [(f"n{i}", f"nice map number {i}", 0.0) for i in range(200)]
    got = {r.id: r for r in moderation.moderate(df(rows, "evidence_id string, original_text string, score double"), [("nice map", False), ("you moron", True)] * 20).collect()}
    assert got["a"].harmful and got["a"].score > 1 and not any(got[k].harmful for k in "bcd") and got["b"].score == got["c"].score == 0
    assert moderation.moderate(df([], "evidence_id string, original_text string"), []).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert out.count() >= 0 and json.dumps(out.schema.jsonValue())
