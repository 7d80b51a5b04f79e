import math

import numpy as np
import pytest

from flowloom.llm import quality as Q
from flowloom.session import table

COMMON = {"en": ["the", "a", "is", "and", "it", "of"], "ja": ["の", "は", "です"]}
PROSE = ["The lid is fine and it does not leak.", "It is a joy to use the old kettle and the cup.", "After a week the handle of it broke and the shop is silent."]
LISTS = ["- lid\n- cup\n- handle\n- strap", "lid; cup; zip; strap; cover;", "1. cup\n2. lid\n3. zip"]
TABLES = ["| lid | 12 | A |\n| cup | 7 | B |", "lid,12,A\ncup,7,B\nzip,9,A", "lid: 12\ncup: 7\nzip: 9"]
JUNK = ["qwrtplk zxcvb mnbvcx", "ok ok ok ok ok ok ok ok ok", "?????????????", "🎉🎉😂🔥😂🔥🎉"]


def profiles():
    texts = PROSE + LISTS + TABLES + JUNK
    kinds = ["prose"] * 3 + ["list"] * 3 + ["table"] * 3 + ["junk"] * 4
    return Q.learn_from(texts, kinds, COMMON), texts, kinds


def test_divergence_is_jensen_shannon():
    r = np.random.default_rng(1)
    p, q = r.dirichlet(np.ones(6), 4), r.dirichlet(np.ones(6), 3)
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b))
    want = [[(kl(a, (a + b) / 2) + kl(b, (a + b) / 2)) / 2 for b in q] for a in p]
    one = np.ones(6)
    assert np.allclose([[Q.divergences(a[None], b[None], one)[0] for b in q] for a in p], want)
    assert Q.divergences(np.array([[1.0, 0]]), np.array([[0, 1.0]]), np.ones(2))[0] == 1


def test_nearest_is_the_least_divergence():
    """The bound by Hellinger distances leaves out no nearest row, also with sparse, equal and several distributions in a row."""
    r = np.random.default_rng(2)
    for sharp in (0.02, 0.3, 5):
        p, q = (np.concatenate([r.dirichlet(np.full(7, sharp), n), r.dirichlet(np.full(3, sharp), n)], 1) for n in (300, 80))
        p, q = np.where(p < 1e-6, 0, p), np.concatenate([q, q[:5]])
        w = np.concatenate([np.full(7, 0.7), np.full(3, 0.3)])
        every = np.stack([Q.divergences(p, q[[j]], w) for j in range(len(q))], 1)
        index, least = Q.nearest(p, q, w)
        assert np.allclose(least, every.min(1)) and np.allclose(every[np.arange(len(p)), index], every.min(1))


def test_learnt_texts_keep_their_kind():
    p, texts, kinds = profiles()
    assert p.kind_of(texts)[0] == kinds


def test_kinds_by_definition():
    p, *_ = profiles()
    assert p.kind_of(["<div></span>&nbsp;<br/>{{slot}}", "http://a.example/1 http://b.example/2", "the lid", "Норм", "良いです。", "the the the the the the the"])[0] == ["junk", "junk", "prose", "prose", "prose", "junk"]


def test_no_profiles_is_prose():
    assert Q.learn_from([], [], COMMON).kind_of(["- a\n- b"])[0] == ["prose"]


def test_documents(spark):
    p, *_ = profiles()
    rows = [(1, None), (2, ""), (3, " \t\n\u200b"), (4, PROSE[0]), (4, PROSE[0]), (5, TABLES[0]), (6, PROSE[0] * 3000), (None, JUNK[2])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, kind string").repartition(3)
    got = sorted(((r["doc_id"] or 0, r["kind"] or "") for r in Q.text_kinds(df, p).collect()))
    assert got == [(0, "junk"), (1, ""), (2, ""), (3, ""), (4, "prose"), (4, "prose"), (5, "table"), (6, "prose")]
    assert Q.text_kinds(df.limit(0), p).count() == 0


def test_statistics(spark):
    rows = [(1, "The cat is here.\nNo end\n\n"), (2, None), (3, ""), (4, "の本です。"), (5, "?!?")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id bigint, text string, words int")
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.text_statistics(df, [w for ws in COMMON.values() for w in ws]).collect()}
    assert got[1] == (6, round(17 / 6, 6), round(1 / 18, 6), 0.5, round(2 / 6, 6))
    assert got[2] == got[3] == (0, 0.0, 0.0, 0.0, 0.0)
    assert got[4] == (4, 1.0, 0.2, 1.0, 0.75)
    assert got[5] == (0, 0.0, 1.0, 1.0, 0.0)


def test_held_out_accuracy(spark, small):
    """Learnt from the labelled documents of even id, the rest are told apart."""
    docs, kinds = table(spark, small, "documents"), table(spark, small, "doc_kinds")
    words = {}
    for r in table(spark, small, "common_words").collect():
        words.setdefault(r["lang"], []).append(r["word"])
    p = Q.learn(docs, kinds.where("doc_id % 2 = 0"), words)
    rest = kinds.where("doc_id % 2 = 1").join(docs, "doc_id").select("text", "kind").where("text IS NOT NULL").collect()
    if len(rest) < 20:
        pytest.skip("too few labelled documents at this size")
    got = p.kind_of([r["text"] for r in rest])[0]
    assert sum(a == r["kind"] for a, r in zip(got, rest)) >= 0.9 * len(rest)


def test_every_labelled_text_has_a_profile(monkeypatch):
    """A kind may need any number of profiles: without a radius each text is one."""
    monkeypatch.setattr(Q, "RADIUS", 0.0)
    texts = [f"- lid {i}\n- cup\n- strap {i}" for i in range(250)]
    p = Q.learn_from(texts, ["list"] * 250, COMMON)
    assert len(p.kinds) == len(p.profiles) and sum(p.kinds == Q.KINDS.index("list")) == 250


def test_long_markup_and_many_beginnings():
    """Tags, comments and placeholders count whatever their length, and beginnings without an end are not searched over and over."""
    p = Q.learn_from(PROSE, ["prose"] * 3, COMMON)
    at = {c: i for i, c in enumerate(Q.MEASURES)}
    texts = [f"<a {'x' * 5000}>", "{{" + "y" * 500 + "}}", "<!--" + "z" * 900 + "-->", "<!--" * 20000, "&" * 20000 + "{{" * 20000]
    m = p.measure(texts)
    assert m[:3, at["markup"]].tolist() == [len(t) for t in texts[:3]] and not m[:3, at["outside"]].any()
    assert m[3, at["markup"]] == m[4, at["markup"]] == 0


def test_measures_do_not_depend_on_neighbours():
    p, texts, _ = profiles()
    odd = [*texts, "a", "'", "İstanbul ǅ", "the'the the’", "\u2028", "ok ok", "のです", "\ufffd", "x" * 3000]
    each = np.concatenate([p.measure([t]) for t in odd])
    assert np.allclose(p.measure(odd), each)
