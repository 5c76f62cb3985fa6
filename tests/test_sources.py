"""File sources, the paged data source, sinks and streaming on small files."""

import json

import pytest
from glyphmill.sources import files, paged
from glyphmill.streaming.incremental import UpsertTable, first_seen


def test_voice_csv(spark, tmp_path):
    (tmp_path / "v.csv").write_text('record_id,source,game,source_content_id,created_at,text,recommended,reply_count,rating\nr,s,g,1,2024-01-02T03:04:05Z,"a, b",Yes,3.0,nan\n', "utf8")
    r = files.read_voice_csv(spark, str(tmp_path / "v.csv")).first()
    assert (r.text, r.recommended, r.reply_count, r.rating, r.title) == ("a, b", True, 3, None, None)


def test_exports(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,timestamp,content,reactions\n1,2024-01-02T00:00:00Z,hello,4\n2,2024-01-02T00:00:00Z,  ,1\n", "utf8")
    (r,) = files.read_export_csv(spark, str(tmp_path / "e.csv"), "forum", "G").collect()
    assert (r.source_content_id, r.engagement_score, r.game) == ("1", 4.0, "G") and len(r.record_id) == 20
    (tmp_path / "bad.csv").write_text("id,content\n1,x\n", "utf8")
    with pytest.raises(ValueError):
        files.read_export_csv(spark, str(tmp_path / "bad.csv"), "forum", "G")
    doc = {"channel": {"name": "c"}, "messages": [{"id": "1", "timestamp": "2024-01-01T00:00:00Z", "content": "你好", "reactions": [{"count": 2}, {"count": 3}], "reference": {"messageId": "0"}}, {"id": "2", "timestamp": "x", "content": ""}]}
    (tmp_path / "e.json").write_text(json.dumps(doc), "utf8")
    (m,) = files.read_export_json(spark, str(tmp_path / "e.json"), "chat", "G").collect()
    assert (m.text, m.engagement_score, m.parent_id, m.channel) == ("你好", 5.0, "0", "c")


def test_mapped_payload_and_replies(spark):
    body = {"data": {"comments": [{"comment": {"id": "1", "body": "x", "at": "2024"}, "n": {"likes": 3}}, {"comment": {"id": "2", "body": ""}}]}}
    df = spark.createDataFrame([(json.dumps(body),)], "p string")
    (r,) = files.map_payload(df, "p", "data.comments", {"id": "comment.id", "text": "comment.body", "created_at": "comment.at", "likes": "n.likes"}).collect()
    assert tuple(r) == ("1", "x", "2024", "3")
    tree = spark.createDataFrame([([("a", "t", [("b", "u")])],)], "posts array<struct<id:string,text:string,replies:array<struct<id:string,text:string>>>>")
    assert {(x.parent_id, x.depth, x.id) for x in files.flatten_replies(tree, "posts", "replies").collect()} == {(None, 0, "a"), ("a", 1, "b")}


def test_snapshot_refuses_broken_rows(spark, tmp_path):
    good = spark.createDataFrame([("public", "", "s", 0.5)], "access_scope string, dataset_id string, source string, relevance_score double")
    files.write_snapshot(good, str(tmp_path / "ok"), ("access_scope", "source"))
    assert spark.read.json(str(tmp_path / "ok")).count() == 1
    with pytest.raises(ValueError):
        files.write_snapshot(good.replace("", "d", "dataset_id"), str(tmp_path / "no"))
    assert files.flat_csv(spark.createDataFrame([([1, 2],)], "a array<int>")).first().a == "[1,2]"


def test_pages_stop_on_cycles():
    got = list(paged.pages(lambda plan, cursor: ([{"id": cursor}], "same"), "p"))
    assert len(got) == 2


def test_page_loops_end_with_a_status():
    def run(fetch, **how):
        r = paged.PlanRun()
        list(paged.pages(fetch, "p", run=r, **how))
        return r.status, r.error_code, r.pages, r.items

    def fails(error, after):
        def fetch(_, cursor):
            if int(cursor or 0) >= after:
                raise error
            return [{"id": 1, "text": "a"}, {"id": 2, "text": ""}], str(int(cursor or 0) + 1)

        return fetch

    more = lambda _, c: ([{"id": 1, "text": "a"}], str(int(c or 0) + 1))
    assert run(more, most=3) == ("partial", "page_limit", 3, 3)
    assert run(lambda *_: ([], "same")) == ("failed", "cursor_cycle", 2, 0)
    assert run(lambda *_: ([{"id": 1, "text": "a"}], None)) == ("collected", None, 1, 1)
    assert run(fails(paged.SourceUnavailable("no", "license"), 0)) == ("unavailable", "license", 0, 0)
    assert run(fails(paged.SourceUnavailable("no", "quota"), 1)) == ("partial", "quota", 1, 1)
    assert run(fails(ValueError("x"), 0)) == ("failed", "ValueError", 0, 0)


def test_status_of_paged_source(spark):
    spark.dataSource.register(paged.FixtureStatus)
    book = {"q1": [[{"id": 1, "text": "a"}, {"id": 2, "text": " "}], [{"id": 3, "text": "[deleted]"}]], "q2": [[{"text": "x"}]]}
    got = {r.plan_id: (r.status, r.error_code, r.pages, r["items"], r.excluded) for r in spark.read.format("fixture_status").option("pages", json.dumps(book)).option("maxPages", 1).load().collect()}
    assert got == {"q1": ("partial", "page_limit", 1, 1, {"empty_text": 1}), "q2": ("collected", None, 1, 0, {"missing_id": 1})}


def test_sql_text_over_csv_tables(spark, tmp_path):
    (tmp_path / "players.csv").write_text("id,signup\n1,2024-01-01\n2,2024-01-05\n", "utf8")
    files.read_csv_tables(spark, str(tmp_path), {"players": "id int, signup date"})
    assert files.run_sql(spark, "-- first\nselect 1;\nselect count(*) n from players where signup > date'2024-01-02'; -- end\n").first().n == 1


def test_taxonomy_is_checked(tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"a": ["One", "二"], "b": ["three"]}), "utf8")
    assert files.read_taxonomy(str(path)) == {"a": ["one", "二"], "b": ["three"]}
    for bad in ({"a": []}, {"a": "x"}, {"a": ["x"], "b": ["X"]}, {"": ["x"]}):
        path.write_text(json.dumps(bad), "utf8")
        with pytest.raises(ValueError):
            files.read_taxonomy(str(path))


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("b", [1, 2], "x|y"), ("a", None, None)], "id string, v array<int>, t string")
    files.write_ordered_json(df, str(tmp_path / "j"), "id")
    assert [r.id for r in spark.read.json(str(tmp_path / "j")).orderBy("id").collect()] == ["a", "b"]
    files.write_table_csv(df, str(tmp_path / "c"))
    assert {r.v for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()} == {"[1,2]", None}
    files.write_manifest(spark, str(tmp_path / "m"), "r1", {"t": 2}, {"s": "collected"})
    files.write_manifest(spark, str(tmp_path / "m"), "r2", {"t": 2, "u": 1}, {})
    last = files.latest_manifest(spark, str(tmp_path / "m"))
    assert last["run_id"] == "r2" and files.check_manifest(last, {"t": df, "u": df, "w": df}) == ["u", "w"]
    assert files.markdown("T", df.orderBy("id")).splitlines()[4:] == ["| id | v | t |", "| --- | --- | --- |", "| a |  |  |", "| b | [1,2] | x\\|y |"]
    assert json.loads(files.schema_json(df))["fields"][0]["name"] == "id" and files.capabilities(spark).filter("not available").count() > 0


def test_paged_source(spark):
    spark.dataSource.register(paged.FixturePages)
    book = {"q1": [[{"id": 1, "text": "a"}, {"id": 2, "text": " "}], [{"id": 3, "text": "[deleted]"}]], "q2": [[{"text": "x"}]]}
    df = spark.read.format("fixture_pages").option("pages", json.dumps(book)).load()
    assert {(r.plan_id, r.page, r.item_id, r.exclusion_reason) for r in df.collect()} == {("q1", 0, "1", None), ("q1", 0, "2", "empty_text"), ("q1", 1, "3", "deleted"), ("q2", 0, "", "missing_id")}


def test_streamed_upsert(spark, tmp_path):
    schema = "identity_key string, evidence_id string, relevance_label string, ingest_seq long"
    src = tmp_path / "in"
    spark.createDataFrame([("k", "e1", "a", 1), ("k", "e2", "b", 2)], schema).coalesce(1).write.json(str(src), mode="append")
    table = UpsertTable(spark, str(tmp_path / "t"), schema)
    rows = spark.readStream.schema(schema).json(str(src))
    table.stream(rows, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("k", "e3", "c", 3), ("n", "e4", "d", 4)], schema).coalesce(1).write.json(str(src), mode="append")
    table.stream(rows, str(tmp_path / "c")).awaitTermination()
    got = {tuple(r) for r in table.read().collect()}
    assert got == {("k", "e2", "c", 3), ("n", "e4", "d", 4)}
    table.merge(spark.createDataFrame([("x", "e", "z", 9)], schema), 0)
    assert {tuple(r) for r in table.read().collect()} == got


def test_first_seen(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:00:00"), ("b", "2024-01-01 00:00:00")], "k string, at string").write.json(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, at timestamp").json(str(tmp_path / "in"))
    q = first_seen(s, "k", "at").writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").select("k").distinct().count() == spark.table("seen").count() == 2
