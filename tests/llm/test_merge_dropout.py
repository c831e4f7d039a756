import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from driftwood.llm import encoder, merge_dropout

PATH = encoder.vocabulary("piece_bpe_32k.model")
ALPHABET = [" ", " ", "\n", "\t", "a", "b", "é", "1", "22", ".", "$", "漢", "🙂", "\x85", "  ", "ß", "th", "ing", "the", "ation"]


def texts(n, alphabet=ALPHABET):
    rnd = random.Random(1)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(n)] + ["", "a" * 300 + "the" * 100, "x" * 33]


def test_without_dropout_it_is_sentencepiece():
    mine, want = texts(1500), sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts(1500), num_threads=1)
    ids, bounds, _, _ = merge_dropout.MergeDropout(PATH, 0.0).encode(pa.array(mine), list(range(len(mine))))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_many_words_at_once_follow_the_agenda(dropout):
    model = merge_dropout.MergeDropout(PATH, dropout, seed=5)
    words = sorted({(" " + w).encode() for t in texts(400) for w in t.split(" ")})
    keys = (encoder.mix64(np.arange(1, len(words) + 1).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    ids, sizes, _, _ = model._merged(words, keys)
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for n, e in zip(sizes, ends, strict=True)] == [model.segment(w, int(k)) for w, k in zip(words, keys, strict=True)]


def test_remembered_words_and_those_cut_anew_are_as_if_each_were_cut():
    """Whether an occurrence is served from memory must not show: each word by the agenda under its own key."""
    model = merge_dropout.MergeDropout(PATH, 0.2, seed=3)
    mine = [*texts(300), "the nation " * 40, None]
    names = [*range(len(mine) - 1), None]
    for _ in range(2):  # the second time from memory
        ids, bounds, _, _ = model.encode(pa.array(mine), names)
        for name, text, a, b in zip(names, mine, bounds[:-1], bounds[1:], strict=True):
            words = [w.encode() for w in re.findall(" +[^ ]*|^[^ ]+", " " + text)] if text else []
            keys = model.occurrence_keys([name], np.zeros(len(words), np.int64))
            assert ids[a:b].tolist() == [i for w, k in zip(words, keys.tolist(), strict=True) for i in model.segment(w, k)]


def test_each_occurrence_is_cut_on_its_own():
    model = merge_dropout.MergeDropout(PATH, 0.3, seed=1)
    word = " " + "internationalization"
    one, bounds, _, _ = model.encode(pa.array([(word * 300)[1:]]), [7])
    keys = model.occurrence_keys([7], np.zeros(300, np.int64)).tolist()
    assert len({tuple(model.segment(word.encode(), k)) for k in keys}) > 20
    drops = np.mean([model._skips(k, 3, 17) for k in range(20_000)])
    assert abs(drops - 0.3) < 0.02 and (model._dropped(np.arange(50, dtype=np.uint32), merge_dropout._mixed(np.full(50, 3), np.full(50, 17))) == [model._skips(k, 3, 17) for k in range(50)]).all()


def test_round_trip_variety_and_repeatability(spark):
    rows = [(i, t, "x") for i, t in enumerate([*texts(200, [*ALPHABET, "▁"]), None, " ", "▁ ▁", "the nation " * 20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    first = merge_dropout.encode(docs.repartition(3), dropout=0.3, seed=1)
    back = {r.doc_id: r.text for r in merge_dropout.decode(first).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    a, b = ({r.doc_id: r.ids for r in merge_dropout.encode(docs, dropout=0.3, seed=s).collect()} for s in (1, 2))
    assert a == {r.doc_id: r.ids for r in first.collect()} and a != b
    digest = merge_dropout.encode(docs, dropout=0.3, seed=1, digest=True).collect()
    assert all(r.lossless for r in digest) and {r.doc_id: r.n_ids for r in digest} == {k: len(v) for k, v in a.items()}


def test_empty_table_and_null_id(spark):
    assert merge_dropout.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert merge_dropout.encode(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), digest=True).first().lossless
