"""Token counts of every beginning against the library, which encodes each beginning anew."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import token_counts as tc
from tidemark.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"
NAME = "word_bpe_49k.json"
LIBRARY = Tokenizer.from_file(vocabulary(NAME))
COUNTS = tc.PrefixCounts(NAME)
ODD = ["It's  we'RE 'sound !!'s 1234½² Größé\r\n\n don't ", "İstanbul ΑΣ. 你好🙂 éá", "a\x1cb\x85c d", "x<|endoftext|>y <|startoftext|> <|endoftex", "中文沒有空格的很長的一句話" * 8, "q" * 300, "a\0b", "가나다" * 30]


def length(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_every_beginning(text):
    assert COUNTS.table(text).tolist() == [length(text[:k]) for k in range(len(text) + 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=25) | st.text("abcdefgh'srelmtv .,1", max_size=40) | st.sampled_from(["<|endoftext|>", " ", "international"]), max_size=4).map("".join))
def test_every_beginning_of_any_text(text):
    assert COUNTS.table(text).tolist() == [length(text[:k]) for k in range(len(text) + 1)]


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(categories=["L"], max_codepoint=0x24F), max_size=30).map(str.lower) | st.text("aeinrst", max_size=60))
def test_the_programme_counts_as_the_model(piece):
    assert COUNTS.programme(piece) == [len(LIBRARY.model.tokenize(piece[:k].encode().decode("latin-1").translate(COUNTS.printable))) for k in range(1, len(piece) + 1)]


def test_parts_and_full_dictionary(monkeypatch):
    monkeypatch.setattr(tc, "WORDS", 7)
    monkeypatch.setattr(tc, "MOST_CHARS", 20)
    monkeypatch.setattr(tc, "MOST_PAIRS", 10)
    monkeypatch.setattr(tc, "MOST_BEGUN", 20)
    text = "one two three, four's fivefold sixty 77 " * 4
    few = tc.PrefixCounts(NAME)
    assert few.table(text).tolist() == [length(text[:k]) for k in range(len(text) + 1)]
    n, cut = few.count(text, 9)
    assert n == length(text) and cut == max(k for k in range(len(text) + 1) if length(text[:k]) <= 9)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="prefix counts"):
        tc.PrefixCounts("byte_bpe_50k.json")


def test_query_and_rows_of_every_kind(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in tc.op12_prefix_token_counts(spark, SF).collect()}
    for doc_id, text in docs.collect():
        r, n = got[doc_id], length(text or "")
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 2048)
        assert length((text or "")[: r["cut_chars"]]) <= 2048 and (n > 2048 or r["cut_chars"] == len(text or ""))
    rows = [(1, None), (None, "a b"), (2, ""), (2, ""), (3, "many words " * 60000)] + [(4, t) for t in ODD]
    own = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, cut_chars string")
    out = tc.token_counts(own, tables=True).collect()
    assert sorted((r["n_tokens"] for r in out)) == sorted(length(t or "") for _, t in rows)
    assert all(np.frombuffer(r["prefix_tokens"], "<i4")[-1] == r["n_tokens"] for r in out)
    assert tc.token_counts(own.limit(0)).count() == 0
