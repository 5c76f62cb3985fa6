"""What lies on disk while the largest tables of the history are written."""

import os

from glyphmill.llm import common, history


def test_sketches_are_gone_before_the_blocks_are_written(spark, df, tmp_path, monkeypatch):
    left, put = {}, history.History.put

    def listing(self, table, *args, **how):
        left[table] = [x for x in os.listdir(common.shared_dir(spark).removeprefix("file://")) if x.split("-")[0] == "sketches"]
        put(self, table, *args, **how)

    before = set(os.listdir(common.shared_dir(spark).removeprefix("file://")))
    monkeypatch.setattr(history.History, "put", listing)
    text = "the old gate of the north is closed until the river freezes over again"
    store = history.History(spark, f"{tmp_path}/store")
    rows = [(1, "a", "f", text, 1), (2, "b", "g", text + " and again", 2), (3, "c", None, "short", 3)]
    got = store.add(df(rows, "ingest_seq long, identity_key string, content_fingerprint string, text string, rank long")).collect()
    store.close()
    assert [(r.ingest_seq, r.kind) for r in got] == [(2, "near")]
    assert set(left["texts"]) - before and not set(left["blocks"]) - before
