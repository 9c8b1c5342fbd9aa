import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shopflow.llm import tokens
from shopflow.llm.packing import END_ID, LONGEST, decompose, pack, write_buckets
from shopflow.llm.queries import QUERIES

from .conftest import MEDIUM

REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
REFERENCE.encode_special_tokens = True
TEXTS = st.text(st.characters(codec="utf-8", max_codepoint=0x2FFFF), max_size=200)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
@example("<|endoftext|> don't  we'll\n\n x  ")
@example("a   b\t\n\r é̀ ß 1²½ 你好 😀")
def test_ids_equal_the_tokenizers_library(text):
    assert tokens.encode(tokens.encoder(), text).tolist() == REFERENCE.encode(
        text, add_special_tokens=False).ids


def test_pieces_of_long_texts_do_not_change_ids():
    text = "  some words,\n\n and 12 more  " * 50 + "x" * 300
    assert "".join(tokens.pieces(text, 64)) == text and len(list(tokens.pieces(text, 64))) > 5
    enc = tokens.encoder()
    whole = enc.encode_ordinary(text)
    assert [i for p in tokens.pieces(text, 64) for i in enc.encode_ordinary(p)] == whole


@given(st.integers(0, 20_000))
def test_decompose(n):
    lengths = decompose(n).tolist()
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)
    assert all(x & (x - 1) == 0 for x in lengths)
    rest = [x for x in lengths if x < LONGEST]
    assert len(rest) == len(set(rest))


def test_query_round_trip(spark):
    rows = QUERIES["op8_packing"](spark, MEDIUM).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert by_doc.keys() == docs.keys()
    for d, pieces in by_doc.items():
        ids = REFERENCE.encode(docs[d], add_special_tokens=False).ids + [END_ID]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            own = np.array(ids[at:at + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(own)
            at += p["length"]
        assert at == len(ids)


def test_buckets_and_odd_rows(spark, odd_docs, no_docs, tmp_path):
    packed = pack(odd_docs)
    rows = packed.collect()
    assert sum(r["length"] for r in rows if r["start"] + r["length"] == r["doc_tokens"]) > 0
    assert sum(r["start"] == 0 for r in rows) == 10
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    write_buckets(packed, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == len(rows)
    assert all(len(r["ids"]) == 4 * r["length"] for r in back.collect())
    assert pack(no_docs).collect() == []
