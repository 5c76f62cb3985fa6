"""Single-text rules of the training-data operators: exact round trips, brute force and held-out accuracy."""

import math
from collections import Counter
import random
import re
import unicodedata

import numpy as np
import pyarrow.parquet as pq
import pytest
from glyphmill.llm import common, encoding, language, leakage, lookalike, moderation, near, personal, sentences

from . import brute
from hypothesis import given, settings
from hypothesis import strategies as st

SF = "/root/testdata/sf0.01"
odd = st.text(alphabet="ab 'lle\n\t.,!?\"«»“”「」（）é中文。！？…かな가😂️​­ｆ1２", max_size=120)


def column(table, name):
    return pq.read_table(f"{SF}/{table}.parquet", columns=[name])[name].to_pylist()


# --- levelling --------------------------------------------------------------------------------------------------------------------
@given(st.lists(st.one_of(st.none(), odd, st.text(max_size=40)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_level_many_is_the_plain_rule(texts):
    def plain(t):
        gone = {c: None for c in common.IGNORABLE}
        t = unicodedata.normalize("NFKC", (t or "").replace(common.SEPARATOR, "").translate(gone)).translate(gone).lower().translate(common.PROTOTYPE)
        return re.sub(r"[\W_]+", " ", t).strip()

    assert common.level_many(texts) == [plain(t) for t in texts]


# --- tokenizer --------------------------------------------------------------------------------------------------------------------
@given(odd, st.sampled_from([1, 2, 3, 5, 17]))
@settings(max_examples=300, deadline=None)
def test_pieces_join_to_the_whole_encoding(text, piece):
    own, names = encoding.encoding(encoding.TOKENIZER)
    ids = encoding.encode(text, piece=piece)
    assert ids == own.encode_ordinary(text)
    assert b"".join(names[i] for i in ids).decode() == text


def test_long_unsplit_text_and_special_tokens():
    own, _ = encoding.encoding(encoding.TOKENIZER)
    r = random.Random(1)
    t = "".join(r.choice("abcde") for _ in range(30_000))
    assert encoding.encode(t) == own.encode_ordinary(t)
    assert len(encoding.encode("<|endoftext|>")) > 1 and encoding.encode(None) == encoding.encode("") == []


def test_same_ids_as_the_json_form():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = [x for x in column("documents", "text") if x][:200]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [encoding.encode(x) for x in texts]


# --- sentences --------------------------------------------------------------------------------------------------------------------
def split(text):
    return [text[a:z] for _, a, z in zip(*sentences.spans([text]))]


@pytest.mark.parametrize(
    "text",
    [
        ["Dr. A. Lind paid 3.5 coins, e.g. for No. 7.", "Wait... was it 9 a.m. on Tues. already?!", "Yes."],
        ['"Why?" asked one of them.', 'She wrote, "It is fine. We stay," and left.', 'The crowd shouted, "no!"', "Then it ended (see above)."],
        ["他说：“没问题。我们不改。”然后走了。", "真的……有人吗？", "「塔」的票价是3.5元！"],
        ["彼は「直さない。以上。」と言って閉じた。", "まさか！？"],
        ["Il a écrit : « Non. Fin. » puis a fermé.", "Quel jour !", "M. Salo vient, etc."],
        ["Er kam am 3. Mai, d. h. ca. 7 Std. vor dem Start.", "„Warum?“, fragte sie.", "Es kostet 5 Münzen inkl. Steuer."],
        ["Он ответил: «Нет. Точка.» и ушёл в 9 ч. утра.", "Что?"],
        ["El Sr. Luz llegó a las 9 a. m. con aprox. 8 sellos.", "¿Quién?"],
        ["See notes.example/1/a.html; or C:\\log_4.txt for more.", "eLume owners got none."],
        ["ผมไม่ได้อะไรเลยค่ะ", "สนุกดีครับ"],
    ],
)
def test_sentences(text):
    assert split(" ".join(text) if not re.search("[一-鿿]", text[0]) else "".join(text)) == text


def test_lines_headings_and_lists():
    assert split("Version 6.0 notes\r\n\r\n1. first. Still first\n- second\n   \nEnd.") == ["Version 6.0 notes", "1. first. Still first", "- second", "End."]


@given(odd)
@settings(max_examples=200, deadline=None)
def test_chunks_compose_to_one_run(text):
    s = sentences.symbols(text + "\n")
    whole = sentences.run(s, 10_000)
    assert all((sentences.run(s, c) == whole).all() for c in (1, 3, 16))
    cut = list(zip(*sentences.spans([text])))
    assert "".join("".join(text[a:z] for _, a, z in cut).split()) == "".join(text.split())
    assert all(text[a:z] == text[a:z].strip() and a < z for _, a, z in cut)


# --- look-alikes ------------------------------------------------------------------------------------------------------------------
def test_one_form_for_what_reads_alike():
    from collections import Counter

    pairs = Counter()
    for word in ["рассказ", "сестра", "привет", "место", "copy", "score", "people", "со", "он"] * 9:
        t = f"\0{word}\0"
        pairs.update(zip(t, t[1:]))
    r = lookalike.Reader(pairs)
    assert r.read("ѕсоrе оf the реорlе") == "score of the people"
    assert r.read("сестра и меcтo") == r.read("cecтpa и место") == "сестра и место"
    assert r.read("ｆｕｌｌ  wi­dth​ cafe\u0301") == "full width café"
    assert r.read("A b") != r.read("a b") and r.read(None) == r.read("​") == ""


# --- leakage ----------------------------------------------------------------------------------------------------------------------
def local(a, b):
    best, run = 0, 0
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    d = np.zeros_like(h)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if x == y else -2), h[i, j + 1] - 2, h[i + 1, j] - 2)
            d[i + 1, j + 1] = d[i, j] + 1 if x == y else 0
    return int(h.max()), int(d.max()), best, run


def test_banded_alignment_is_the_full_one():
    r = random.Random(3)
    jobs = []
    for _ in range(60):
        b = [r.randrange(6) for _ in range(r.randrange(1, 30))]
        a = [x for x in b if r.random() < 0.9] or [1]
        jobs.append((np.array(a, np.int32), np.array(b, np.int32), 0))
    score, clean, _ = leakage.align(jobs)
    assert [(int(s), int(c)) for s, c in zip(score, clean)] == [local(list(a), list(b))[:2] for a, b, _ in jobs]


def test_leaks_despite_edits_and_disguise():
    passage = "Beside the old archive a patient locksmith copied forty torn posters and each of them ordered the same baker to burn a ladder before noon"
    index = leakage.Index([([1], common.levelled(passage)), ([2], common.levelled("the baker copied posters about ladders before the noon of another day"))])
    w = passage.split()
    some = " ".join(w[3:12] + ["grey"] + w[12:20]).upper().replace("O", "О")
    style = "Beside the new harbour a sleepy painter sold ninety blue maps and none of them asked the other judge to hide a kettle after dusk"
    texts = [None, "", "x " * 40 + some, style, passage, "你好" + passage[:30]]
    assert set(leakage.leaks(index, texts)) == {(2, 0), (4, 0)}


# --- personal items ---------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def field():
    return personal.trained((), tuple(t for t in column("bilibili", "original_text") if t))


def test_held_out_rows_of_the_labelled_table(field):
    rows = personal.table(seed=99, rounds=1)
    right = total = 0
    for toks, labels, _ in rows:
        got = field.decode([field.coder.code(toks)])[0]
        right += sum(int(a == b) for a, b in zip(got, labels))
        total += len(toks)
    assert right / total > 0.97


def test_readable_redaction(field):
    t = "call me on ２１４-555-0124 or write me at jo.lind[at]mail.example"
    got = personal.items(field, [t, None, "", "gift code QX16-LM52 works in Torvel", "我真名叫郎屿"])
    assert [(k, t[a:z]) for a, z, k in got[0]] == [("phone", "２１４-555-0124"), ("email", "jo.lind[at]mail.example")]
    assert got[1] == got[2] == got[3] == [] and [k for *_, k in got[4]] == ["name"]


def test_marginals_sum_to_one_and_pairs_to_moves(field):
    toks, _, _ = personal.table(seed=5, rounds=1)[0]
    w, s = (np.array([x]) for x in field.coder.code(toks))
    m = np.ones_like(w, bool)
    p, pair = field.marginals(field.scores(w, s), m)
    assert np.allclose(p.sum(2), 1) and math.isclose(pair.sum(), len(toks) - 1, rel_tol=1e-6)


# --- language ---------------------------------------------------------------------------------------------------------------------
def test_byte_network_on_held_out_texts():
    texts, tags = column("bilibili", "original_text"), [language.label(t) for t in column("bilibili", "language")]
    rows = [(t, k) for t, k in zip(texts, tags) if t and len(t) >= 24 and k in language.LANGS]  # many of these labels are wrong
    net = language.train(rows)
    other = [(t, k) for t, k in zip(column("moderation_samples", "text"), column("moderation_samples", "lang")) if t and k and len(t) >= 40]
    got = [max(language.held(f).items(), key=lambda x: x[1][1])[0] for f in language.classify(net, [t for t, _ in other])]
    assert np.mean([a == b for a, (_, b) in zip(got, other)]) > 0.8  # a few dozen noisy labelled texts of each language
    assert language.classify(net, [None, "", "12 😂"]) == [[], [], []] and language.held([]) == {}


def test_labels():
    assert [language.label(x) for x in ("ZH_cn", "eng", " ", None, "und", "pt-BR")] == ["zh", "en", None, None, None, "pt"]


# --- moderation -------------------------------------------------------------------------------------------------------------------
def all_segments(s):
    """Ruzzo and Tompa by definition: take the best segment, then split left and right."""
    if not s or max(s) <= 0:
        return []
    best = max(((sum(s[i:j]), -(j - i), -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))
    i, j = -best[2], -best[2] - best[1]
    return all_segments(s[:i]) + [(i, j)] + [(a + j, z + j) for a, z in all_segments(s[j:])]


@given(st.lists(st.integers(-4, 4), max_size=14))
@settings(max_examples=200, deadline=None)
def test_segments_are_maximal(s):
    got = moderation.segments([float(x) for x in s])
    assert sum(round(x) for *_, x in got) == sum(sum(s[a:z]) for a, z in all_segments(s))


def test_harm_on_held_out_samples(spark):
    """Half of the samples teach, with the corpus; the other half is judged. Some labels are wrong, so only most can agree."""
    rows = [(t, c != "none") for t, c in zip(column("moderation_samples", "text"), column("moderation_samples", "category")) if t and c]
    held = [(f"h{i}", t) for i, (t, _) in enumerate(rows[1::2])]
    corpus = spark.read.parquet("/root/testdata/sf0.1/bilibili.parquet").select("evidence_id", "original_text").unionByName(spark.createDataFrame(held, "evidence_id string, original_text string"))
    got = {r.id: r for r in moderation.moderate(corpus, rows[::2]).collect() if r.id and r.id.startswith("h")}
    right = [got[f"h{i}"].harmful == h for i, (_, h) in enumerate(rows[1::2])]
    false = [got[f"h{i}"].harmful for i, (_, h) in enumerate(rows[1::2]) if not h]
    assert sum(right) / len(right) > 0.68 and sum(false) / len(false) < 0.1


def test_batched_n_grams_are_those_of_each_text():
    texts = moderation.tokens_many([*column("bilibili", "original_text")[:400], None, "", "my 祭 my te 整"])
    words = sorted({g for x in texts[::3] for g in moderation.distinct_grams(x)})
    at, which = moderation.Grams(words).hits([moderation.numbers(x) for x in texts])
    assert {(int(i), words[j]) for i, j in zip(at, which)} == {(i, g) for i, x in enumerate(texts) for g in moderation.distinct_grams(x) & set(words)}
    assert [len(x) for x in moderation.Grams([]).hits([moderation.numbers(x) for x in texts])] == [0, 0]


def test_disguised_words_count_as_what_they_stand_for():
    bad = [f"you {a} {b}" for a in ("worthless", "pathetic", "stupid") for b in ("moron", "imbecile", "cretin")] * 2
    good = [f"the {a} {b} of the map" for a in ("old", "new", "north") for b in ("gate", "tower", "bridge")] * 3
    m = moderation.Scorer([(t, True) for t in bad] + [(t, False) for t in good])
    m.fit(Counter({g: 1 for g in m.vocabulary}), 1000)
    plain = m.judge("you worthless moron")[0]
    assert plain > 1 and all(math.isclose(m.judge(t)[0], plain) for t in ("YOU WORTHLESS m*r*n", "you worthless m.o.r.o.n", "you worthless m0ron", "you worthless moooron", "уou worthlеss moron"))
    assert m.judge(None) == (0.0, []) and 0 < m.judge("the old gate")[0] < m.judge("a moron")[0] < plain
    both = m.judge("you worthless moron, the old gate of the map is the old gate of the map, you pathetic cretin")[0]
    assert both > m.judge("you worthless moron, the old gate of the map is the old gate of the map, the old gate of")[0]


# --- fingerprints -----------------------------------------------------------------------------------------------------------------
def test_grams_do_not_depend_on_the_batch():
    texts = common.level_many(["one two three four five six", "岚谷的活动商店卖光了纸鹤", ""])
    d, h = near.Hashed(texts).grams()
    for i, t in enumerate(texts):
        _, own = near.Hashed([t]).grams()
        assert sorted(h[d == i].tolist()) == sorted(own.tolist())


def test_hashed_wording_is_the_wording():
    texts = [t for t in common.level_many(column("bilibili", "original_text")) if t] + ["ab", "岚", ""]
    sizes = [len(w) for w in near.sketch(texts)[2]]
    assert sizes == [len(brute.wording(t)) for t in texts]
