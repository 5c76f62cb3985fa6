"""Rules of the operators on small literal tables."""

import datetime as dt

from glyphmill.functions import text as T
from glyphmill.operators import annotate, corpus, facts, insights, modes, planning, relevance, resolve, rows, store, summaries, telemetry
from pyspark.sql import functions as F


def one(spark, expr, **kw):
    return spark.createDataFrame([tuple(kw.values())], list(kw)).select(expr.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.name_key(F.col("a")), a="Ab: C-1 é") == "abc1é"
    assert one(spark, T.tag_key(F.col("a")), a="Role Playing / 角色!") == "role_playing_角色"
    assert one(spark, T.html_text(F.col("a")), a="<b>A&amp;B</b><br/> x  y <br> <i></i>") == "A&B\nx y"
    assert one(spark, T.cell(F.col("a"), 6), a="a|b  cdefgh") == "a\\|b …"
    assert one(spark, T.sentences(F.col("a")), a="One. Two! 三。四\n five") == ["One.", "Two!", "三。", "四", "five"]
    assert one(spark, T.contains_phrase(F.col("a"), "公会副本"), a="公会 副本 好") is True
    assert one(spark, T.contains_phrase(F.col("a"), "raid"), a="raids only") is False
    assert one(spark, T.fingerprint_text(F.col("a")), a=" Ｓtraße\t x ") == "strasse x"
    assert one(spark, T.similarity(F.col("a"), F.col("b")), a="abcd", b="bcde") == 0.75
    assert one(spark, T.nullify(F.col("a")), a=" NaN ") is None
    assert [one(spark, T.lenient_bool(F.col("a")), a=x) for x in ("Yes", "0", "maybe")] == [True, False, None]


def test_retention_is_exact_day(spark):
    d = dt.date
    users = spark.createDataFrame([(1, d(2024, 1, 1)), (2, d(2024, 1, 1)), (3, d(2024, 1, 2))], "user int, signup date")
    acts = spark.createDataFrame([(1, d(2024, 1, 2)), (1, d(2024, 1, 2)), (2, d(2024, 1, 9))], "user int, day date")
    r = telemetry.retention(users, acts, (1, 7)).first()
    assert (r.eligible, r.d1_users, r.d7_users, r.d1_rate) == (3, 1, 0, 0.3333)


def test_monetisation_without_payer(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "user int, g string")
    pay = spark.createDataFrame([(1, 4.0), (1, 2.0)], "user int, amount double")
    rows = {r.g: r for r in telemetry.monetisation(users, pay, ["g"]).collect()}
    assert rows["a"].arppu == 6.0 and rows["b"].arppu is None and rows["b"].arpu == 0.0


def test_upsert_keeps_first_id_and_refreshes(spark):
    cols = "identity_key string, evidence_id string, game_id string, relevance_label string, ingest_seq long"
    base = spark.createDataFrame([("k", "e1", "g1", "ambiguous", 1), ("o", "e0", "g1", "relevant", 2)], cols)
    new = spark.createDataFrame([("k", "e2", "g2", "relevant", 5), ("k", "e3", "g3", "irrelevant", 6), ("n", "e4", "g4", "relevant", 7)], cols)
    got = {r.identity_key: tuple(r)[1:] for r in store.upsert(base, new).collect()}
    assert got == {"k": ("e1", "g1", "irrelevant", 6), "o": ("e0", "g1", "relevant", 2), "n": ("e4", "g4", "relevant", 7)}
    c = store.upsert_counts(base, new).first()
    assert tuple(c) == (1, 1, 1)


def test_cross_posts_count_groups_not_pairs(spark):
    rows = [("public", "f", f"i{i}", "s") for i in range(50)] + [("public", None, "a", "s"), ("private", "f", "z", "s")]
    got = store.cross_posts(spark.createDataFrame(rows, "access_scope string, content_fingerprint string, identity_key string, source string")).collect()
    assert [(r.rows, r.identities) for r in got] == [(50, 50)]


def test_annotation_rules(spark):
    rows = spark.createDataFrame([(1, "The guild server kicked us; frames and frames, crashes. Brilliant theme"), (2, None), (3, "patch")], "id int, text string")
    got = {r.id: r for r in annotate.confidence(annotate.annotate(rows)).collect()}
    assert got[1].primary == "performance" and got[1].secondary == ["multiplayer"] and got[1].sentiment == "mixed" and got[1].sentiment_score == 0.0
    assert got[2].primary == "unknown" and got[2].sentiment == "unknown" and got[2].confidence == 0.35
    assert got[3].sentiment == "neutral"
    req = annotate.requests(spark.createDataFrame([("Fine. Please let us skip it! Bad.",)], "t string"), "t").first().requests
    assert req == ["Please let us skip it!"]


def test_relevance_ladder(spark):
    rows = spark.createDataFrame([(1, "moon shards"), (2, "the guild raid"), (3, "moon shards and salt candles"), (4, None), (5, "quest boss chapter")], "id int, t string")
    got = {r.id: r.label for r in relevance.relevance(rows, "t", ["moon shards"], ["paper cranes"], ["pixel raid"], ["salt candles"]).collect()}
    assert got == {1: "relevant", 2: "ambiguous" if got[2] == "ambiguous" else "relevant", 3: "irrelevant", 4: "irrelevant", 5: "ambiguous"}
    pr = relevance.precision_recall(spark.createDataFrame([], "p string, t string"), "p", "t").first()
    assert (pr.precision, pr.recall) == (0.0, 0.0)


def members(spark, *rows):
    return spark.createDataFrame([("g", *r) for r in rows], "game_id string, topic string, source string, position string")


def test_insights_by_kind(spark):
    rows = [("a", "s", "mixed"), ("unknown", "s", "positive"), ("b", "s", "positive"), ("b", "t", "negative"), ("c", "s", "negative"), ("c", "s", "mixed")]
    got = {(r.topic, r.kind): (r.supports, r.challenges) for r in insights.insights(members(spark, *rows)).collect()}
    assert got == {
        ("a", "research_gap"): (1, 0), ("unknown", "research_gap"): (1, 0), ("b", "praise"): (1, 1), ("b", "complaint"): (1, 1), ("b", "controversy"): (1, 1),
        ("b", "difference"): (1, 1), ("c", "complaint"): (1, 0), ("c", "research_gap"): (1, 0),
    }
    gap = insights.source_gap(members(spark, *rows).filter("topic = 'b'")).first()
    assert (gap.highest, gap.lowest, gap.gap) == ("t", "s", 1.0)


def test_insight_caps_and_difference_threshold(spark):
    rows = [(f"t{i:02}", "s", "positive") for i in range(15)] + [("t14", "s", "positive")]
    got = insights.insights(members(spark, *rows), max_topics=14, cap=3).collect()
    assert sorted((r.topic, r["rank"]) for r in got) == [("t00", 2), ("t01", 3), ("t14", 1)]
    near = [("a", "s", "negative")] * 2 + [("a", "s", "positive")] * 8 + [("a", "t", "negative")] * 4 + [("a", "t", "positive")] * 6
    assert "difference" not in {r.kind for r in insights.insights(members(spark, *near)).collect()}
    assert "difference" in {r.kind for r in insights.insights(members(spark, *near, *[("a", "t", "negative")] * 3)).collect()}


def test_corpus_gate_and_native_position(spark):
    cols = "access_scope string, relevance_label string, evidence_kind string, recommended boolean, sentiment string, primary string, secondary array<string>"
    rows = [("public", "relevant", "review", True, "negative", "a", ["b", "a"]), ("private", "relevant", "review", True, "x", "a", []), ("public", "ambiguous", "post", None, "x", "a", []), ("public", "relevant", "official", None, "x", "a", []), ("public", "relevant", "post", None, "mixed", "a", [])]
    got = insights.memberships(insights.positioned(insights.corpus(spark.createDataFrame(rows, cols)))).collect()
    assert sorted((r.topic, r.position, r.method) for r in got) == [("a", "mixed", "inferred_bilingual_lexicon"), ("a", "positive", "source_native_recommendation"), ("b", "positive", "source_native_recommendation")]


def test_priority_components(spark):
    d = dt.datetime
    rows = [("a", "s", "negative", d(2024, 3, 1)), ("a", "s", "negative", d(2024, 2, 20)), ("a", "t", "positive", d(2024, 1, 20)), ("a", "u", "negative", None)]
    m = spark.createDataFrame(rows, "topic string, source string, position string, published_at timestamp")
    r = insights.priorities(m, ["topic"], spark.createDataFrame([("s",), ("t",)], "source string")).first()
    assert (r.volume_score, r.negative_score, r.momentum, r.momentum_score, r.breadth_score, r.total, r.label) == (3, 3, 1.667, 2, 2, 10, "high")


def test_topics_tie_by_first_position_and_match_any_script(spark):
    rows = [(1, "the quest chapter"), (2, "the chapter quest"), (3, "公会里的音乐，ＧＵＩＬＤ"), (4, "gift packs and a gift pack"), (5, "guilds"), (6, "Музыка и музыка")]
    got = {r.id: (r.primary, r.hits) for r in annotate.annotate(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got == {1: ("progression", 1), 2: ("story", 1), 3: ("multiplayer", 2), 4: ("economy", 1), 5: ("unknown", 0), 6: ("audio", 2)}


def test_compare_needs_two_sources_for_higher(spark):
    rows = [("g", "a", "s")] * 6 + [("g", "b", "s")] * 5 + [("g", "b", "t")] + [("h", "a", "s")] * 2
    got = {(r.subject, r.dimension): r.confidence for r in modes.compare_grid(spark.createDataFrame(rows, "subject string, dimension string, source string")).collect()}
    assert got == {("g", "a"): "medium", ("g", "b"): "higher", ("h", "a"): "low", ("h", "b"): "insufficient"}


def test_fit_counts_any_praise(spark):
    rows = [("w", "s", "positive")] + [("w", "s", "negative")] * 5 + [("x", "s", "negative"), ("v", "s", "positive"), ("n", "s", "mixed")]
    got = {r.topic: r.fit for r in modes.preference_fit(members(spark, *rows), ["w", "x", "n"], ["v"]).collect()}
    assert got == {"w": "likely_match", "x": "possible_friction", "v": "possible_friction", "n": "uncertain"}


def test_controversy_sides_are_distinguishable(spark):
    rows = [("a", f"p{i}", "positive") for i in range(2)] + [("a", f"n{i}", "negative") for i in range(2)] + [("b", f"e{i}", v) for i in range(2) for v in ("positive", "negative")]
    got = {r.topic: (r.pro, r.con, r.distinguishable) for r in modes.controversies(spark.createDataFrame(rows, "topic string, evidence_id string, position string")).collect()}
    assert got == {"a": (2, 2, True), "b": (2, 2, False)}


def test_status_ladder(spark):
    one_ = lambda **kw: "{" + ",".join(f'"{k}":{{"status":"{s}","items_retrieved":{n}}}' for k, (s, n) in kw.items()) + "}"
    runs = spark.createDataFrame([("r1", one_(a=("collected", 1), b=("failed", 0), c=("collected", 2), d=("unavailable", 0), e=("collected", 0))), ("r2", one_(b=("collected", 3), c=("partial", 0), d=("unavailable", 0), e=("unavailable", 0))), ("r3", None)], "run_id string, source_status string")
    got = {r.source: r.state for r in modes.status_rollup(runs, ["a", "z"]).collect()}
    assert got == {"a": "collected", "b": "partial", "c": "partial", "d": "unavailable", "e": "failed", "z": "disabled"}


def test_momentum_counts_both_windows(spark):
    d = dt.datetime
    rows = [("t", "s", d(2024, 3, 1), True)] * 4 + [("t", "s", d(2024, 1, 20), False)] + [("u", "s", d(2024, 1, 20), False)] * 3
    got = {r.topic: (r.momentum, r.momentum_score) for r in summaries.topic_priority(spark.createDataFrame(rows, "k string, s string, at timestamp, bad boolean"), "k", "s", "at", F.col("bad")).collect()}
    assert got["t"] == (round(1.005 / 0.255, 4), 3) and got["u"][1] == 0 and got["u"][0] is not None


def test_only_mature_cohorts_count(spark):
    users = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 20))], "user int, signup date")
    end = spark.createDataFrame([(dt.date(2024, 2, 1),)], "end date")
    assert [r.user for r in telemetry.mature(users, "signup", end, 30).collect()] == [1]


def test_unavailable_source_is_visible(spark):
    ev = spark.createDataFrame([("a", "relevant"), ("b", "ambiguous")], "source string, label string")
    st = spark.createDataFrame([("a", "collected", 9), ("z", "unavailable", 0)], "source string, status string, retrieved long")
    got = {r.source: (r.status, r.retrieved, r.observed) for r in insights.coverage(ev, st).collect()}
    assert got == {"a": ("collected", 9, 1), "b": ("collected", 1, 1), "z": ("unavailable", 0, 0)}


def test_plans_and_aliases(spark):
    plans = spark.createDataFrame([("g", v, i) for i, v in enumerate("aabc")], "g string, v string, seq int")
    assert [r.seq for r in planning.select_plans(plans, "g", "v", "seq", 3).orderBy("slot").collect()] == [0, 2, 3]
    ids = spark.createDataFrame([("g1", {"x": "1"}), ("g2", {"x": "1"}), ("g3", {"x": "1", "y": "2"})], "e string, m map<string,string>")
    assert {tuple(r) for r in planning.entity_links(ids, "e", "m").collect()} == {("g1", "g2"), ("g1", "g3")}


def test_facts(spark):
    f = facts.unpivot(spark.createDataFrame([("e", "x", None, " ")], "e string, a string, b string, c string"), "e", {"a": "a", "b": "b", "c": "c"})
    assert [(r.fact_type, r.value) for r in f.collect()] == [("a", "x")]
    assert facts.readiness(f, ["a", "z"]).first().missing == "z"


def test_momentum_and_empty(spark):
    rows = spark.createDataFrame([("t", dt.datetime(2024, 3, 1)), ("t", dt.datetime(2024, 2, 20)), ("t", dt.datetime(2024, 1, 20)), ("t", None)], "k string, at timestamp")
    r = summaries.anchored_momentum(rows, "k", "at").first()
    assert (r["items"], r.recent, r.prior, r.momentum) == (4, 2, 1, 1.667)
    assert summaries.anchored_momentum(rows.limit(0), "k", "at").count() == 0


def test_small_text_functions(spark):
    assert [one(spark, T.minutes(F.col("a")), a=x) for x in ("每天半小时", "一个小时", "2.5小时", "45 minutes", "1.5 hrs", "1 小时 5 mins", "none", "四 个小时")] == [30, 60, 150, 45, 90, 60, None, 240]
    assert [one(spark, T.storage_amount(F.col("a")), a=x) for x in ("Storage: 50 GB", "512 MB available space", "Memory: 8 GB", "Hard Drive : 1.5 TB")] == [50.0, 0.5, None, 1536.0]
    assert one(spark, T.listed(F.col("a")), a="English*, French , ,German**") == ["English", "French", "German"]
    assert [round(one(spark, T.weight(F.col("a")), a=x), 4) for x in ("0", "x", "-3", "1")] == [1.0, 1.0, 1.0, 1.6931]
    assert one(spark, T.alias_key(F.col("a")), a=" Ｇame_ of: Straße! 2") == "gameofstrasse2"
    assert one(spark, T.letter_bound_count(F.col("a"), "fps"), a="60fps fpsx fps2") == 2
    assert one(spark, T.percent(F.lit(0.1234)), a="x") == "12.3%" and one(spark, F.unix_timestamp(T.utc_time(F.col("a"))), a="1700000000") == 1700000000
    assert one(spark, T.pseudonym(F.lit("s"), F.col("a")), a="  ") is None


def test_relevance_to_entity(spark):
    games = spark.createDataFrame([("g1", ["Moon Shards", "月之碎片"], ["Pale Forge"], {"steam_app_id": "7", "reddit_id": "r"}), ("g2", ["Other"], None, None)], "game_id string, titles array<string>, companies array<string>, external_ids map<string,string>")
    cols = "alias_id string, game_id string, text string, ambiguity string, status string, search_enabled boolean, standalone_safe boolean"
    aliases = [("a1", "g1", "moonies", "low", "validated", True, True), ("a2", "g1", "ms", "high", "scoped_only", True, False), ("a3", "g1", "Moon shards!", "low", "validated", True, True), ("a4", "g1", "off", "low", "validated", False, True), ("a5", "g1", "wait", "low", "pending", True, True)]
    e = relevance.entity_table(games, spark.createDataFrame(aliases, cols))
    rows_ = [
        (1, "g1", "steam", None, "anything", {"app_id": "7"}, None), (2, "g1", "steam", None, "moon shards", {"app_id": "8"}, None), (3, "g1", "x", "ＭＯＯＮ shards", None, None, None), (4, "g1", "x", None, "ms is fun", None, None),
        (5, "g1", "x", None, "moonies patch server", None, "g1"), (6, "g1", "x", None, "月之 碎片 and salt candles", None, None), (7, "g1", "x", None, "by Pale Forge", None, None), (8, "g9", "x", None, "moon shards", None, None),
        (9, "g1", "x", None, None, None, None), (10, None, "x", None, "moon shards", None, None), (11, "g2", "x", None, "off wait ms", None, None), (12, "g1", "x", None, "off wait", None, None), (13, "g1", "reddit", None, "x", {"reddit_id": "r"}, None),
        (14, "g1", "x", None, "raid and quest and boss", None, None),
    ]
    df = spark.createDataFrame(rows_, "id int, game_id string, source string, title string, text string, native map<string,string>, query_game_id string")
    got = {r.id: (r.label, r.score, r.alias_ids) for r in relevance.relevance_to_entity(df, e, ["raid", "quest", "boss"], ["salt candles"]).collect()}
    assert got == {
        1: ("relevant", 0.99, []), 2: ("irrelevant", 0.0, []), 3: ("relevant", 0.78, []), 4: ("ambiguous", 0.2, ["a2"]), 5: ("relevant", 0.75, ["a1"]), 6: ("irrelevant", 0.0, []), 7: ("ambiguous", 0.3, []), 8: ("irrelevant", 0.0, []),
        9: ("irrelevant", 0.0, []), 10: ("irrelevant", 0.0, []), 11: ("irrelevant", 0.0, []), 12: ("irrelevant", 0.0, []), 13: ("relevant", 0.99, []), 14: ("ambiguous", 0.675, []),
    }
    assert relevance.method_version(["b", "a"], []) == relevance.method_version(["a", "b"], []) != relevance.method_version(["a"], [])


def test_assessment_of_candidates(spark):
    from difflib import SequenceMatcher

    c = "game_id string, provider string, titles array<string>, locales array<string>, developers array<string>, publishers array<string>, platforms array<string>, external_ids map<string,string>"
    data = [("g1", "p", ["Moon Shards"], ["en-US"], ["Pale"], None, ["PC"], {"steam": "7"}), ("g1", "q", ["月"], ["zh"], None, ["Pub"], None, None), ("g2", "p", ["Moon Shard"], None, None, None, None, None)]
    got = {r.game_id: r for r in resolve.assess(spark.createDataFrame(data, c), "moon-shards", "en", {"steam": "7"}, "PALE", None, "Switch").collect()}
    assert got["g1"].exact and got["g1"].score == round(0.5 + 0.06 + 0.12 + 0.06 + 0.14 + 0.08 + 0.02, 4) and got["g1"].providers == 2
    sim = SequenceMatcher(None, "moonshards", "moonshard").ratio()
    assert not got["g2"].exact and got["g2"].score == round(0.25 * sim + 0.06, 4)


def test_comparison_needs_like_samples(spark):
    d = dt.datetime
    rows_ = [(t, g, s, at) for t, g, n, s, at in [("a", "g", 3, "s", d(2024, 1, 1)), ("a", "h", 3, "s", d(2024, 2, 1)), ("b", "g", 3, "s", d(2023, 1, 1)), ("b", "h", 13, "t", d(2024, 1, 1)), ("c", "g", 9, "s", None), ("d", "g", 2, "s", None), ("d", "h", 5, "s", None)] for _ in range(n)]
    got = {r.topic: (r.status, r.reasons) for r in corpus.comparison_status(spark.createDataFrame(rows_, "topic string, game_id string, source string, published_at timestamp"), ["g", "h"]).collect()}
    assert got == {"a": ("comparable", ""), "b": ("comparable_with_caution", "source mix; dates; sample sizes"), "c": ("insufficient_evidence", ""), "d": ("insufficient_evidence", "")}


def test_guards_and_kinds(spark):
    left, right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("a", 9)], "k string, w int")
    assert [tuple(r) for r in corpus.missing_from(left, right, ["k"]).collect()] == [("b", 1)]
    try:
        corpus.require_all(left, right, ["k"])
        raise AssertionError
    except ValueError as e:
        assert "b" in str(e)
    kinds = spark.createDataFrame([("Video_Comment", None), (None, "store_review"), ("clip", "video"), (None, None)], "a string, b string")
    assert [r.k for r in kinds.select(rows.evidence_kind(F.col("a"), F.col("b")).alias("k")).collect()] == ["comment", "review", "video", "post"]


def test_resolution_needs_score_and_margin(spark):
    rows_ = [("a", "x", 0.8), ("a", "y", 0.5), ("b", "x", 0.8), ("b", "y", 0.75), ("c", "x", 0.5), ("d", "x", 0.9), ("e", "x", 0.3), ("e", "y", 0.3)]
    got = {r.g: (r.best, round(r.margin, 4), r.status) for r in planning.resolution(planning.closest_margin(spark.createDataFrame(rows_, "g string, n string, s double"), "g", "s", "n")).collect()}
    assert got == {"a": ("x", 0.3, "resolved"), "b": ("x", 0.05, "needs_choice"), "c": ("x", 0.5, "unresolved"), "d": ("x", 0.9, "resolved"), "e": ("x", 0.0, "unresolved")}


def test_usable_aliases_and_queries(spark):
    cols = "game_id string, alias_id string, key string, text string, language string, alias_type string, status string, search_enabled boolean, safe boolean, confidence double"
    a = [("g", "1", "k", "K", None, "abbreviation", "validated", True, True, 0.5), ("g", "2", "k", "k!", "en", "official_title", "scoped_only", True, True, 0.5), ("g", "3", "z", "月", "zh-TW", "localized_title", "validated", True, False, 0.9), ("g", "4", "o", "O", None, "official_title", "pending", True, True, 1.0), ("g", "5", "p", "P", None, "official_title", "validated", False, True, 1.0)]
    u = planning.usable_aliases(spark.createDataFrame(a, cols), spark.createDataFrame([("en",), ("zh-CN",)], "language string"))
    assert sorted((r.for_language, r.slot, r.alias_id) for r in u.collect()) == [("en", 1, "2"), ("zh-CN", 1, "1"), ("zh-CN", 2, "3")]
    q = planning.render_queries(u, spark.createDataFrame([("s", "general", "zh", " {alias} 好 "), ("s", "general", "zh", "{alias}  好")], "source string, intent string, language_family string, template string"), "r").collect()
    assert {r.query_text for r in q} == {"K 好", "K  好", "月 好", "月  好"} and len({r.query_id for r in q}) == 2


def test_registered_datasets_and_reconciled_evidence(spark):
    cols = "dataset_id string, owner_scope string, attested boolean, title string, seq int"
    known, new = spark.createDataFrame([("d", "o", True, "old", 1)], cols), spark.createDataFrame([("d", "o", True, "new", 2), ("d", "p", False, "no", 3), ("e", "o", True, "e", 4)], cols)
    assert {(r.dataset_id, r.owner_scope, r.title) for r in store.register_datasets(known, new).collect()} == {("d", "o", "new"), ("e", "o", "e")}
    a, b = spark.createDataFrame([("1", "x"), ("2", "y")], "evidence_id string, v string"), spark.createDataFrame([("2", "z")], "evidence_id string, v string")
    assert {tuple(r) for r in store.reconcile_evidence([a, b]).collect()} == {("1", "x"), ("2", "z")}


def test_preferences_and_topics(spark):
    topics = {"story": ["story", "剧情"], "economy": ["gacha", "抽卡"], "audio": ["music"]}
    assert modes.parse_preferences("I love the Story and MUSIC, but I hate gacha. 不喜欢抽卡，剧情好", topics, ["hate", "不喜欢", "avoid"]) == {"wanted": ["audio", "story"], "avoided": ["economy"]}
    assert modes.parse_preferences("avoid gacha; gacha is ok", topics, ["avoid"]) == {"wanted": [], "avoided": ["economy"]} and modes.parse_preferences(None, topics, []) == {"wanted": [], "avoided": []}
    e = spark.createDataFrame([("g", ["Role Playing", None]), ("h", None)], "game_id string, tags array<string>")
    assert [tuple(r) for r in planning.active_topics(e, spark.createDataFrame([("t", ["role-playing", "x"])], "topic string, tags array<string>")).collect()] == [("g", "t")]
