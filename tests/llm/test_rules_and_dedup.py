import random
import re
from collections import Counter

import numpy as np

from driftwood.llm import line_dedup, near_dup, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    words = WORD.findall(text or "")
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, hit = Counter(triples), set()
    for i, t in enumerate(triples):
        if count[t] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n\t ", "a", "a a a a a", "x\x0by\x0cz\r\n\nx", "é 漢字 # | <b>", "a b c a b c", "line\nline\n\nline \n", "w " * 5000, "a\x85b c"]
    texts += [rnd.choice([" ", "\n", "  "]).join(rnd.choice(["a", "b", "cc", "#", "d|"]) for _ in range(rnd.randrange(40))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in quality_rules.statistics(docs).collect():
        want = plain_statistics(texts[r.doc_id])
        assert tuple(r[c] for c in quality_rules.BASE) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_rules_are_learned_in_order_and_told_by_spark(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality_rules.FEATURES)))
    bad = (x[:, 2] > 0.7) | (x[:, 4] > 0.9) & (x[:, 0] < 0.5)
    rules = quality_rules.learn(x, bad)
    assert 1 <= len(rules) <= quality_rules.MAX_RULES
    caught = np.zeros(len(x), bool)
    for r in rules:
        caught |= quality_rules.covers(r, x)
    assert bad[caught].mean() > 0.9 and caught[bad].mean() > 0.8
    rows = spark.createDataFrame(x[:50].tolist(), list(quality_rules.FEATURES)).select("*", quality_rules.verdict(rules).alias("v")).collect()
    assert [r.v > 0 for r in rows] == caught[:50].tolist()
    assert quality_rules.learn(x, np.zeros(len(x), bool)) == [] and quality_rules.learn([], []) == []


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "w " * 100), (None, "some words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    assert quality_rules.train(docs, labels) == []
    assert quality_rules.judge(docs.limit(0), []).count() == 0
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs, []).collect()} == {1: False, None: False}


def plain_dedup(docs, least):
    """Rows (doc_id, text): which lines with a word go, by comparing all runs."""
    seqs = {d: [x for x in (t or "").split("\n") if WORD.search(x)] for d, t in docs}
    seen, gone = {}, {d: set() for d in seqs}
    for d in sorted(seqs):
        lines = seqs[d]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if sum(len(WORD.findall(x)) for x in run) >= least:
                    if run in seen:
                        gone[d] |= set(range(i, j))
                    else:
                        seen[run] = (d, i)
    return gone


def test_line_dedup_against_all_runs(spark):
    rnd = random.Random(7)
    pool = ["a b c", "d", "e f", "a b c d e f g h i j k l", "g", ""]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "long " * 3000 + "\n" + "d\n" * 50), (103, "d\n" * 50)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_lines int").repartition(3)
    for least in (1, 4, 10):
        want = plain_dedup(rows, least)
        for r in line_dedup.dedup(docs, least).collect():
            text = dict(rows)[r.doc_id]
            full, kept = -1, []
            for line in (text or "").split("\n"):
                full += bool(WORD.search(line))
                if not (WORD.search(line) and full in want[r.doc_id]):
                    kept.append(line)
            assert r.n_deleted == len(want[r.doc_id])
            assert (r.text or "") == "\n".join(kept)


def test_suffix_array_is_sorted_and_knows_common_prefixes(spark, monkeypatch):
    """Against plain sorting: places in order of their next lines (as far as sorted), and exact common prefixes."""
    monkeypatch.setattr(line_dedup, "STRETCH", 7)
    rnd = random.Random(5)
    rows = [(i, "\n".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 14)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lines = line_dedup.lines_of(docs)
    seqs = {d: t.split("\n") for d, t in rows}
    got = sorted(line_dedup.with_reach(line_dedup.suffix_array(lines, 6), 6).collect(), key=lambda r: r.at)
    assert [r.at for r in got] == list(range(len(got)))
    suffix = [seqs[r.doc_id][r.idx : r.idx + 8] for r in got]
    common = [next((k for k in range(9) if a[k : k + 1] != b[k : k + 1] or k >= len(a)), 8) for a, b in zip(suffix, suffix[1:], strict=False)]
    assert [r.lcp for r in got][1:] == common and got[0].lcp == 0
    assert [r.reach for r in got] == [max(a, b) for a, b in zip([0, *common], [*common, 0], strict=True)]
    assert len({tuple(x) for x in suffix}) == 1 + sum(a != b for a, b in zip(suffix, suffix[1:], strict=False))


def test_maximal_runs(spark):
    a, b = [f"line {k} one two three" for k in range(6)], [f"other {k} one two three" for k in range(4)]
    rows = [(1, "\n".join(a)), (2, "\n".join(["x y", *a[1:5], "z", *b])), (3, "\n".join(["", *b[1:], *a]))]
    runs = line_dedup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, runs)) == [(2, 1, 4, 1, 1), (3, 0, 9, 2, 7)]


def test_inner_names_as_columns(spark):
    names = "h, t, w, l, s, doc, lines, full, gone, at, reach, th, idx, `a.b`"
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names.split(", "))
    docs = spark.createDataFrame([(1, "one two three", *"abcdefghijklmn")], schema)
    for out in (line_dedup.dedup(docs), quality_rules.statistics(docs)):
        row = out.first()
        assert tuple(row[: len(docs.columns)]) == (1, "one two three", *"abcdefghijklmn")


def test_line_dedup_of_equal_rows_and_nulls(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_deleted) for r in line_dedup.dedup(docs).collect())
    assert got == [(0, 0), (1, 1), (1, 1)]
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def plain_components(rows, words, threshold):
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    part = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    return {d: (len(sets[d]), part[d]) for d in sets}


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(3)
    seed = [f"w{i}" for i in range(60)]
    rows = [(10, " ".join(seed)), (11, " ".join(seed).upper())]
    for i in range(25):  # a star: each is near the seed, few are near each other
        mine = list(seed)
        for _ in range(3):
            mine[rnd.randrange(60)] = f"x{i}{rnd.random()}"
        rows.append((i + 20, " ".join(mine)))
    rows += [(1, None), (2, ""), (3, "solo"), (4, "Solo"), (5, "a b"), (6, "a b a"), (7, " \n"), (8, "y " * 4000), (9, "y y")]
    rows = [(100 - d, t) for d, t in rows]  # the seed has not the smallest id
    docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, kept long").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, 2, 80).collect()}
    assert got == plain_components(rows, 2, 80)
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert [r.kept for r in near_dup.near_duplicates(odd, 2, 80).collect()] == [True] * 3
    assert near_dup.near_duplicates(docs.limit(0), 2, 80).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        keep = int(400 * share)
        a = np.sort(base)
        b = np.sort(np.concatenate([base[:keep], rng.integers(0, 1 << 62, 400 - keep).astype(np.uint64)]))
        packed = near_dup.pack_bits(near_dup.minima(np.concatenate([a, b]), np.array([0, 400, 800])))
        assert abs(near_dup.estimates(packed[0], packed[1:])[0] - keep / (800 - keep)) < 0.09


def small_pairs():
    """Sizes of two sets of 4 to 20 shingles and their common part, at 0.8 and little over."""
    sizes = [(m, n, c) for m in range(4, 21) for n in range(m, 21) for c in range(1, m + 1)]
    return [(m, n, c) for m, n, c in sizes if 80 <= 100 * c / (m + n - c) < 90]


def test_small_sets_at_the_threshold_meet():
    rng = np.random.default_rng(2)
    for m, n, c in small_pairs():
        values = rng.integers(0, 1 << 62, (100, m + n - c)).astype(np.uint64)
        one, other = (near_dup.minima(x.ravel(), np.arange(101) * x.shape[1]) for x in (values[:, :m], values[:, m - c :]))
        assert (near_dup.band_keys(one) == near_dup.band_keys(other)).any(axis=1).all(), (m, n, c)
        guesses = [near_dup.estimates(a, b[None])[0] for a, b in zip(near_dup.pack_bits(one), near_dup.pack_bits(other), strict=True)]
        assert min(guesses) > 0.8 - near_dup.MARGIN, (m, n, c)


def test_seeded_minima_do_not_depend_on_blocks(monkeypatch):
    values, bounds = np.random.default_rng(4).integers(0, 1 << 62, 60).astype(np.uint64), np.array([0, 1, 5, 15, 60])
    want = near_dup.minima(values, bounds)
    monkeypatch.setattr(near_dup, "SEEDED", 7)
    assert (near_dup.minima(values, bounds) == want).all()


def test_short_documents_against_brute_force(spark):
    rows, want = [], {}
    for _ in range(6):
        for m, n, c in small_pairs():
            i, words = len(rows), [f"w{len(rows)}x{k}" for k in range(m + n)]
            one, other = words[:m], words[:c] + words[m : m + n - c]
            rows += [(i, "\n".join(one)), (i + 1, "\n".join(other))]
            want |= {i: i, i + 1: i if 100 * len({*one} & {*other}) >= 80 * len({*one} | {*other}) else i + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 1, 80).collect()} == want


def test_components_of_chains_and_stars(spark):
    links = [(i + 1, i) for i in range(40)] + [(200, 101), (200, 102), (150, 102)]
    got = {r.id: r.component for r in near_dup.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(41)} | dict.fromkeys((101, 102, 150, 200), 101)
