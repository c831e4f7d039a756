import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from driftwood.llm import language_id as li

VOCAB = {"en": "the of and to in that was he for it with as his on be at by".split(), "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein".split(), "fr": "de la le et les des en un du une que est pour qui dans par sur".split()}


def rows(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(VOCAB))
        out.append((i, " ".join(rnd.choice(VOCAB[lang]) for _ in range(rnd.randint(5, 60))) + ".", lang, "s"))
    return out


def model():
    data = rows(200, 1)
    return li.fit([r[1] for r in data], [r[2] for r in data])


def plain_posteriors(scores, move, fresh):
    n, k = scores.shape
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    e, hop = np.exp(scores), np.exp(move)
    for t in range(n):
        alpha[t] = (np.full(k, 1 / k) if fresh[t] else alpha[t - 1] @ hop) * e[t]
        alpha[t] /= alpha[t].sum()
    for t in range(n - 2, -1, -1):
        beta[t] = np.ones(k) if fresh[t + 1] else hop @ (e[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True)


def test_block_forward_backward_is_the_plain_one():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 50, 333):
        scores, move, fresh = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.random(n) < 0.1
        fresh[0] = True
        assert np.allclose(li.posteriors(scores, move, fresh), plain_posteriors(scores, move, fresh))


def test_held_out_accuracy_and_code_switching():
    labeller = li.Labeller(model())
    data = rows(200, 2)
    langs, scores = labeller.documents(pa.array([r[1] for r in data]))
    assert np.mean([a == r[2] for a, r in zip(langs, data, strict=True)]) > 0.97
    assert ((scores >= 0) & (scores <= 1)).all()
    p, _ = labeller.words(pa.array([" ".join(VOCAB["en"][:15] + VOCAB["de"][:15])]))
    best = [labeller.model.langs[i] for i in p.argmax(axis=1)]
    assert best[:13].count("en") >= 12 and best[-13:].count("de") >= 12


def test_odd_texts():
    texts = ["", None, "123 $$ !", "漢", "€ – …", "THE OF AND", "the " * 30_000]
    langs, scores = li.Labeller(model()).documents(pa.array(texts, pa.string()))
    assert [x == "und" for x in langs] == [True, True, True, False, True, False, False]
    assert langs[5:] == ["en", "en"] and scores[0] == 0


def test_texts_without_a_letter_are_und_whatever_their_runs():
    junk = ["€5 €6 €7 €8", "“1” “2” “3”", "│ 1 │ 2 │ 3 │", "1 – 2 – 3 – 4 – 5", "🙂 🙂 🙂 🙂 🙂", "\u0301 1 \u0301 2 \u0301 3 \u0301"]
    real = ["│ 1 │ é │ 3 │", "€5 €6 €7 €8 the", "漢 1 字 2 漢 3 字", "🙂 1 🙂 2 𐐷 3 🙂", "ª 1 € 2 € 3 €"]
    texts = junk + real
    langs, scores = li.Labeller(model()).documents(pa.array(texts))
    assert [x == "und" for x in langs] == [not any(map(str.isalpha, t)) for t in texts] == [True] * len(junk) + [False] * len(real)
    assert (scores[: len(junk)] == 0).all() and (scores[len(junk) :] > 0).all()


def test_only_runs_with_a_letter_are_words():
    rnd = random.Random(5)
    pool = ["é", "€", "–", "🙂", "𐐷", "漢", "a", "Z", "1", " ", "\u0301", "ß", "À"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(20))) for _ in range(500)]
    raw, offsets = li.shared.buffers(pa.array(texts))
    letters, starts, lengths, doc = li.words_of(raw, offsets)
    got = [(int(d), bytes(letters[s : s + n]).decode()) for s, n, d in zip(starts, lengths, doc, strict=True)]
    runs = [(i, w) for i, t in enumerate(texts) for w in re.split("[1 ]+", t) if any(map(str.isalpha, w))]
    assert got == [(i, w.replace("Z", "z").replace("À", "à")) for i, w in runs]


def test_spark_and_empty_tables(spark):
    docs = spark.createDataFrame([*rows(150, 3), (None, None, None, "x"), (7, "the of", None, "x")], "doc_id long, text string, lang string, score string").repartition(3)
    m = li.train(docs)
    got = li.identify(docs, m)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and got.count() == 152
    assert got.where("lang is not null and lang != lang_pred").count() <= 4
    assert {r.doc_id for r in docs.where(li.held_out(F.col("doc_id"))).collect()} == {i for i in range(150) if zlib.crc32(str(i).encode()) % 3 == 1}
    none = li.train(docs.limit(0))
    assert {r.lang_pred for r in li.identify(docs, none).collect()} == {"und"}
    assert li.identify(docs.limit(0), m).count() == 0


def test_pair_probabilities_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    scores, move, fresh = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), np.arange(6) == 0
    want, total = np.zeros((5, 3, 3)), 0.0
    for y in itertools.product(range(3), repeat=6):
        v = np.exp(sum(scores[i, y[i]] for i in range(6)) + sum(move[y[i], y[i + 1]] for i in range(5)))
        total += v
        for i in range(5):
            want[i, y[i], y[i + 1]] += v
    before, weight, behind = li.messages(scores, move, fresh)
    assert np.allclose(li.pair_posteriors(before, weight, behind, move), want / total)


def test_training_sample_is_bounded_in_bytes(spark):
    rows = [(i, "the cat " * 50 if i % 2 else "le chat " * 50, "en" if i % 2 else "fr") for i in range(60)] + [(999, "x " * 100_000, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(li.train(docs, max_bytes=10_000).langs) == {"en", "fr"}
    assert li.train(docs, max_bytes=10).langs == ()
