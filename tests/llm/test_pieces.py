import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from attestry.llm import pieces, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def ids_of(b):
    return list(struct.unpack(f"<{len(b) // 4}I", b))


def check(library, text):
    ours = ids_of(pieces.pieces_of(pieces.MODEL).encode(text))
    assert ours == library.encode(text, add_bos=True, add_eos=True), repr(text[:60])
    raw = struct.pack(f"<{len(ours)}I", *ours)
    assert pieces.pieces_of(pieces.MODEL).decode(raw) == library.decode(ours), repr(text[:60])


def test_odd_texts_equal_the_library(library):
    for text in ["", " ", "a", " a", "  a  b ", "\n", "\n\n x", "a\x00b", "ﬁ é Ａ", "▁a", "a▁▁b",
                 "<s> </s> <0x0A> <unk>", "　x", "日本語のテキスト", "😀😀 x", "a\tb\r\n", "é",
                 "﻿x", "퟿", "�", "a\x01b", " " * 100 + "x" + " " * 33, "a" * 3000,
                 "ab" * 2000, "=" * 777, "1234567890" * 50, "don't  stop", "Ünïcödé"]:
        check(library, text)


@given(st.text(alphabet=" \n▁abeinrst.,'é!ß中日\x00😀=-0", max_size=60))
@settings(max_examples=400, deadline=None)
def test_random_texts_equal_the_library(text):
    if not hasattr(test_random_texts_equal_the_library, "sp"):
        test_random_texts_equal_the_library.sp = SentencePieceProcessor(
            model_file=public_tokenizers.path(pieces.MODEL))
    check(test_random_texts_equal_the_library.sp, text)


def test_whole_words_without_their_split(library):
    """The table over a whole text gives what the words give."""
    p = pieces.pieces_of(pieces.MODEL)
    for text in ["the quick  brown fox\njumps", "   lead", "a \n b", "x▁y z"]:
        assert p.tokens(p.normal(text)) == library.encode(text)


def test_any_ids_decode_as_in_the_library(library):
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 28705, 259])
               for _ in range(rng.randrange(12))]
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert pieces.pieces_of(pieces.MODEL).decode(raw) == library.decode(ids), ids


def test_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or ""
            for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_sentencepiece(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_nulls_repeats_long_and_empty_tables(spark, docs_of, rows_of, library):
    long = "word " * 40_000 + "x" * 40_000
    docs = docs_of([(1, None), (1, ""), (None, "a b"), (2, "a b"), (2, "a b"), (3, long)])
    rows = rows_of(pieces.decode(pieces.encode(docs)))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows) == [
        (0, "a b"), (1, ""), (1, ""), (2, "a b"), (2, "a b"), (3, long)]
    assert next(ids_of(r["ids"]) for r in rows if r["doc_id"] == 3) == library.encode(
        long, add_bos=True, add_eos=True)
    assert pieces.decode(pieces.encode(docs.limit(0))).count() == 0
    assert rows_of(pieces.encode(spark.createDataFrame([(None, None)], "doc_id void, text void"))
                   )[0]["n_tokens"] == 2
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id int, ids binary")
                         ).first().text == ""


def test_other_models_are_refused():
    with pytest.raises(Exception, match="expected|rror|ot"):
        pieces.Pieces("word_bpe_49k.json")
