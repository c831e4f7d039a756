import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from driftwood.llm import dac, encoder, separators, shared

TEXTS = ["", None, "A cat's 12 Tests.", "é È ü " * 30, "word " * 900, "漢字 <|endoftext|>", "same", "same"] + [f"Text number {i} " * (i % 37) for i in range(60)]


def encode(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for high in (1, 200, 50_000, 1 << 24, 1 << 32):
        ids = rng.integers(0, high, 3000, dtype=np.uint64).astype(np.uint32)
        codes = dac.Codes.encode(ids)
        assert (codes.decode() == ids).all()
        assert [codes[i] for i in range(0, 3000, 7)] == ids[::7].tolist()
    assert len(dac.Codes.encode(np.zeros(0, np.uint32)).decode()) == 0


def test_file_gives_back_every_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1000 - i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, part int").repartition(5)
    file = dac.write_file(docs, parts=3).cache()
    got = {r.doc_id: r for r in dac.document_starts(file).collect()}
    at = 0
    for doc in sorted(got):
        ids = np.array([*encode("word_bpe_49k.json", TEXTS[1000 - doc]), 1], "<u4")
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(TEXTS)
    part = file.orderBy("part").first().part
    first = min(got)
    assert dac.token_at(file, part, 1) == [*encode("word_bpe_49k.json", TEXTS[1000 - first]), 1][1]
    assert dac.token_at(file, part, 10**9) is None


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dac.document_starts(dac.write_file(empty)).count() == 0
    assert separators.count_tokens(separators.write_files(empty)).count() == 0
    twice = spark.createDataFrame([(None, "b"), (None, "a"), (5, None)], "doc_id long, text string")
    assert sorted((r.start, r.n_tokens) for r in dac.document_starts(dac.write_file(twice)).collect()) == [(0, 2), (2, 2), (4, 1)]


def test_separators_over_small_blocks(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    for size in (1, 7, 64, 1 << 18):
        got = separators.count_tokens(separators.write_files(docs, block_tokens=size)).collect()
        assert {r.doc_id: r.n_tokens for r in got} == {i: len(encode("byte_bpe_50k.json", t)) for i, t in enumerate(TEXTS)}
        for file in {r.file for r in got}:
            mine = sorted((r for r in got if r.file == file), key=lambda r: r.ordinal)
            assert [r.ordinal for r in mine] == list(range(len(mine)))
            assert [r.start for r in mine] == [sum(x.n_tokens + 1 for x in mine[:k]) for k in range(len(mine))]


def test_ids_after_the_last_separator_count(spark):
    blocks = [(0, k, bytearray(np.array(x, "<u2").tobytes()), None) for k, x in enumerate([[1, 2], [3, 9], [4], [5, 6]])] + [(1, 0, bytearray(np.array([9, 9], "<u2").tobytes()), None)]
    got = separators.count_tokens(spark.createDataFrame(blocks, separators.FILES_SCHEMA), end_id=9).collect()
    assert sorted((r.file, r.ordinal, r.start, r.n_tokens) for r in got) == [(0, 0, 0, 3), (0, 1, 4, 3), (1, 0, 0, 0), (1, 1, 1, 0)]


def test_long_pieces_that_differ_in_the_order_of_blocks():
    """Texts without a place to cut, whose blocks of 4096 bytes (or characters) are exchanged, keep their own ids."""
    rng = np.random.default_rng(6)
    x, y = ("".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 4096)) for _ in range(2))
    a, b = ("".join(rng.choice(list("abcdefgh"), 4096)) for _ in range(2))
    mine = [x + y, y + x, a + b, b + a, a + b + a, b + a + a, "\u3042" * 9000, "\u3042" * 9001]
    coder = encoder.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        ids, bounds = coder.encode(pa.array(mine))
        assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:], strict=True)] == [encode("byte_bpe_50k.json", t) for t in mine]
    raw, offsets = shared.buffers(pa.array(mine))
    assert len(set(encoder.piece_keys(raw, offsets[:-1], np.diff(offsets)).tolist())) == len(mine)


def test_pieces_that_share_a_key_are_told_apart_by_their_bytes(monkeypatch):
    """With keys that collide all the time the ids are right all the same."""
    monkeypatch.setattr(encoder, "piece_keys", lambda raw, starts, lengths: (lengths % 3).astype(np.uint64) | np.uint64(8))
    mine = [f"word{i} and some number{i * 7} {'x' * (i % 9)}" for i in range(80)]
    coder = encoder.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        ids, bounds = coder.encode(pa.array(mine))
        assert [ids[s:e].tolist() for s, e in zip(bounds[:-1], bounds[1:], strict=True)] == [encode("byte_bpe_50k.json", t) for t in mine]
