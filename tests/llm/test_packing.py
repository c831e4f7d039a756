import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftwood.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXTS = ["", None, "a", "It's 12 tests.\n\nof  spaces", "é è ü " * 3, "word " * 5000, "漢字 <|endoftext|> x", "same", "same", "   x"] + [f"text number {i} " * (i % 37) for i in range(200)]


def test_pieces_hold_every_id_once(spark, tokenizer):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, offset string").repartition(3)
    rows = packing.pack(docs).collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0  # a power of two: no padding


def test_step_groups_are_even(spark):
    docs = spark.createDataFrame([(i, "some words " * (i % 300)) for i in range(600)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.tier, r.step_group] += r.length
    assert all(v <= packing.STEP_TOKENS for v in size.values())
    for tier in packing.TIERS:
        assert sum(v < packing.STEP_TOKENS for (t, _), v in size.items() if t == tier) <= 1


def test_empty_table_and_null_id(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.length) for r in rows] == [(None, 2)]
