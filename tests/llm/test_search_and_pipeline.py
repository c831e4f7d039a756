import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from driftwood.llm import near_dup, vector_search as vs


def test_tree_visits_all_leaves_in_order_of_distance():
    x = np.random.default_rng(0).normal(size=(3000, 8))
    tree = vs.fit(x, leaf=64)
    assert set(vs.leaf_of(tree, x).tolist()) <= set(range(tree.leaves)) and tree.leaves > 10
    assert sorted(vs.best_bins(tree, x[0], tree.leaves)) == list(range(tree.leaves))
    assert vs.fit(np.ones((500, 4))).leaves == 1


def brute(x, ids, q, k):
    s = x @ x[q]
    s[q] = -np.inf
    order = np.lexsort((ids, -s))[:k]
    return [(int(ids[i]), float(s[i])) for i in order if s[i] > -np.inf]


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(600, 16)), np.repeat(rng.normal(size=(1, 16)), 400, axis=0), 3 * rng.normal(size=(200, 16))])
    ids = np.arange(len(x))
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)]
    rows += [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] + [1.0] * 15, 0), (5060, [None] + [1.0] * 15, 0), (5080, [1.0, 2.0], 0), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(4)
    got = {}
    for r in vs.nearest(table, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    met = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and q not in [v for _, v, _ in found]
        assert all(abs(s - x[v] @ x[q]) < 1e-9 for _, v, s in found)
        want = brute(x.copy(), ids, q, 10)
        met += sum(s >= want[-1][1] - 1e-12 for _, _, s in found)
        total += 10
    assert met / total >= 0.9
    assert vs.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_hold_neighbouring_leaves_and_cut_large_ones():
    block, parts = vs.blocks_of(np.array([3, 4, 25, 0, 2, 9, 1]), 10)
    assert block.tolist() == [0, 0, 1, 2, 2, 3, 3]
    assert parts[block[2]] == 3 and all(np.diff(block) >= 0) and len(parts) == block[-1] + 1


def test_rows_of_one_id_are_candidates_and_queries_of_their_own(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (20, x[1].tolist()), (7, x[2].tolist())]
    rows += [(100 + i, rng.normal(size=3).tolist()) for i in range(5)]  # vectors of another length: among themselves
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in vs.nearest(table, F.col("vec_id") % 20 == 0, k=70).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: len(f) for q, f in got.items()} == {0: 2 * 62, 20: 2 * 62, 40: 62, 100: 4}
    same = dict(rows)[40]
    want = sorted(((-float(np.dot(same, v)), i) for n, (i, v) in enumerate(rows) if len(v) == 4 and n != 40))
    assert [i for _, i, _ in sorted(got[40])] == [i for _, i in want]
    own = sorted(i for _, i, _ in got[0]).count(0)
    assert own == 2  # each of the two rows of id 0 has the other


def test_equal_vectors_tie_by_id(spark):
    x = np.random.default_rng(9).normal(size=33)
    rows = [(i, x.tolist()) for i in range(500)]
    got = vs.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 100 == 0, k=5)
    rows = sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect())
    for q in range(0, 500, 100):
        assert [v for one, _, v in rows if one == q] == [i for i in range(6) if i != q][:5]


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.rank, r.vec_id) for r in vs.nearest(table, F.col("vec_id") == 0).collect())
    assert got == [(1, 1), (2, 2)]


def test_pipeline_stages(spark):
    en = "the of and to in that was he for it with as his on be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more".split()
    fr = "de la le et les des en un du une que est pour qui dans par plus ne sur se au avec son ce il elle nous vous mais ou donc leur sans sous entre".split()
    rng = np.random.default_rng(3)
    text = lambda words, n: "\n".join(" ".join(rng.choice(words, 14)) for _ in range(n))
    rows = [(i, text(en if i % 2 else fr, 6), "en" if i % 2 else "fr", "s", 0) for i in range(60)]
    shared = " ".join(rng.choice(en, 30))
    rows[5] = (5, rows[5][1] + "\n" + shared, "en", "s", 0)
    rows[7] = (7, rows[7][1] + "\n" + shared, "en", "s", 0)
    rows[9] = (9, rows[9][1] + '\ntoken = "' + "ab12" * 8 + '"', "en", "s", 0)
    near = rows[11][1].split(" ")
    rows += [(70, " ".join(near[:-1] + ["changed"]), "en", "s", 0), (71, "12345 $$$ 678", "en", "s", 0), (72, None, None, None, None), (73, rows[13][1], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], "")
        assert out.columns == docs.columns
        seen.append(out.cache())
    ids = [{r.doc_id for r in d.collect()} for d in seen]
    assert ids[1] == ids[0] - {71, 72}
    assert ids[2] == ids[1] - {73}  # nothing but an earlier copy's lines
    texts = {r.doc_id: r for r in seen[2].collect()}
    assert shared in texts[5].text and shared not in texts[7].text and texts[7].n_chars == len(texts[7].text)
    kept = {r.doc_id for r in near_dup.near_duplicates(seen[2], 5, 80).where("kept").collect()}
    assert ids[3] == kept and len(kept) >= 55
    clean = {r.doc_id: r.text for r in seen[4].collect()}
    assert '"[SECRET]"' in clean[9] and ids[4] == ids[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen[-1], "").collect()
    assert {r.doc_id for r in pieces} == ids[4]
