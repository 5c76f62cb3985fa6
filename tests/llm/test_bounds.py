"""What a step holds at once, in memory and on disk, does not add up over steps."""

import os

from glyphmill.llm import common, history, near


def test_texts_are_hashed_in_slices(df, monkeypatch):
    """A batch of texts is levelled and hashed in slices of bounded size; a longer text is whole, and the result is that of one slice."""
    texts = ["a", "", "b" * 7, "c" * 30, "d" * 5, "e" * 5]
    monkeypatch.setattr(near, "SLICE", 10)
    parts = list(near.slices(texts))
    assert [x for p in parts for x in p] == texts and all(len(p) == 1 or sum(map(len, p)) <= 10 for p in parts)
    rows = df([(i, f"der lange Text nummer {i % 7} mit Wörtern 游戏很好玩啊 und {i % 3}" if i % 5 else None) for i in range(40)], "id long, text string").coalesce(1)
    monkeypatch.setattr(near, "SLICE", 60)
    some = near.sketched(rows).collect()
    monkeypatch.setattr(near, "SLICE", 10**9)
    assert some == near.sketched(rows).collect()


def test_a_batch_leaves_its_result_only(spark, tmp_path, monkeypatch):
    """The tables between the steps of add() are removed: the shared folder keeps the repeats, and small tables of classes."""
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path / "shared"))
    rows = [(i, f"k{i}", f"f{i}", f"this comment number {i % 6} is copied over and over again by player {i % 2}", i // 6) for i in range(24)]
    store = history.History(spark, str(tmp_path / "store"))
    out = store.add(spark.createDataFrame(rows, "ingest_seq long, identity_key string, content_fingerprint string, text string, rank long"))
    left = {x.rsplit("-", 1)[0] for x in os.listdir(tmp_path / "shared")}
    assert out.count() == 18 and left <= {"repeats", "reps", "label"}
    store.close()
