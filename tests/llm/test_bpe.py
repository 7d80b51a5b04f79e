import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm.batches import BATCH_BYTES, BATCH_ROWS, slices
from flowloom.llm.bpe import TOKENIZER, Encoder, Vocabulary, encode_documents, vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary(TOKENIZER))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["", None, " ", "\n\n \t", "don't we'll I'D", "<|endoftext|> <|im_end|>", "a" * 700, "ab" * 600, "🎉" * 300, "の" * 400, "​﻿é", "x  y   z \n", "\x00\x1f", "٣٤٥ ²½", "�?�"]


def test_odd_texts(encoder, library):
    assert encoder.encode(ODD).to_pylist() == library(ODD)


def test_long_words(encoder, library):
    r = random.Random(2)
    texts = ["".join(r.choice("abcdeé漢 "[: 7 if i % 2 else 8]) for _ in range(512 + 300 * i)) for i in range(6)]
    assert encoder.encode(texts).to_pylist() == library(texts)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(encoder, library, texts):
    assert encoder.encode(texts).to_pylist() == library(texts)


def test_forgetting_words_changes_nothing(library):
    e = Encoder(vocabulary(TOKENIZER), kept_words=3)
    for texts in (["one two three four five"], ["two six", "one"], ["six seven"]):
        assert e.encode(texts).to_pylist() == library(texts)


def test_documents(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "y"), (None, "word", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in encode_documents(df).collect()), key=repr)
    assert got == sorted(((-1 if i is None else i, ids) for (i, *_), ids in zip(rows, library([r[1] for r in rows]))), key=repr)
    assert encode_documents(df.limit(0)).count() == 0


def test_real_documents(spark, small, library):
    from flowloom.session import table

    docs = table(spark, small, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in encode_documents(docs).collect()}
    assert got == dict(zip(texts, library(list(texts.values()))))


def test_slices_cover_all_rows():
    assert slices([]) == []
    assert slices([1, BATCH_BYTES + 5, 2, BATCH_BYTES, 0]) == [(0, 1), (1, 1), (2, 1), (3, 2)]
    assert slices([0] * (BATCH_ROWS + 1)) == [(0, BATCH_ROWS), (BATCH_ROWS, 1)]


def test_one_place_a_round_gives_the_same(encoder, library):
    """A table that is not in the order of its makers is contracted at one place a round; here both queries must agree."""
    import dataclasses

    v = vocabulary(TOKENIZER)
    assert v.ordered
    slow = Encoder(dataclasses.replace(v, ordered=False))
    texts = [t for t in ODD if t is None or len(t) < 200] + ["aaaa aaaaa abababab tttthe  the", "の" * 9]
    assert slow.encode(texts).to_pylist() == encoder.encode(texts).to_pylist() == library(texts)


def test_table_out_of_order(tmp_path):
    """Where a merge ranks below the maker of its part, rounds of one place follow the definition."""
    import json

    from flowloom.llm.bpe import byte_symbols

    vocab = {s: i for i, s in enumerate(byte_symbols())}
    for t in ("ab", "abc", "cd"):
        vocab[t] = len(vocab)
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": [["ab", "c"], ["c", "d"], ["a", "b"]]}}))
    v = vocabulary(str(path))
    assert not v.ordered
    # "cd" ranks below "ab", but after the first "ab" its "c" is taken before the second "c d" is looked at again.
    def plain(word):
        parts, rank = list(word), {("ab", "c"): 0, ("c", "d"): 1, ("a", "b"): 2}
        while True:
            best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if best is None:
                return [vocab[x] for x in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    words = ["abcab", "abab", "abcdabc", "cdcd", "aabbc"]
    assert Encoder(v).encode(words).to_pylist() == [plain(w) for w in words]
