import random

import pytest

from bazaar.llm import bpe
from bazaar.llm.queries import tokenizer_path

PATH = tokenizer_path()


def library(text):
    return bpe.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def test_words_split_where_no_token_crosses():
    random.seed(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "12", "é", "!", "<|endoftext|>", "中", " ", "　", "😀", "\x1c", "\x85", "\0", "don't"]
    added = bpe.added_tokens(PATH)
    for _ in range(4000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        words = bpe.split_words(text, added)
        assert "".join(words) == text
        assert [i for w in words for i in library(w)] == library(text)


@pytest.mark.parametrize("table_words", [10, 200_000])
def test_documents_equal_the_library(documents, table_words):
    rows = bpe.decode_documents(bpe.encode_documents(documents, PATH, table_words), PATH).collect()
    assert len(rows) == documents.count()
    assert all(r.ids == library(r.text) and r.decoded == r.text for r in rows)


def test_odd_rows(odd, nothing):
    assert bpe.round_trip(odd, PATH).columns == ["doc_id", "text", "score", "ids", "decoded"]
    rows = bpe.round_trip(odd, PATH).collect()
    assert len(rows) == 9 and all(r.ids == library(r.text) and r.decoded == (r.text or "") for r in rows)
    assert bpe.decode_documents(bpe.encode_documents(nothing, PATH), PATH).collect() == []


def test_bytes_that_are_no_text_decode_like_the_library(spark):
    ids = [[120, 121, 50256], [], [187, 188, 64], None]
    rows = bpe.decode_documents(spark.createDataFrame([(i,) for i in ids], "ids array<int>"), PATH).collect()
    assert [r.decoded for r in rows] == [bpe.tokenizer(PATH).decode(i or [], skip_special_tokens=False) for i in ids]
