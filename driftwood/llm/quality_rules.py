"""Quality rules: text statistics, and a decision list learned from labelled ones. DataFrame functions only.

Sequential covering learns rules for the class "drop". A rule is a conjunction of thresholds, grown on two thirds of
the rows by information gain, pruned on the rest from its end; it is taken if it is precise enough there, the rows that
it covers leave, and the next is sought. The list is a chain of Spark conditionals in the order in which the rules were
found; a document that meets none is kept.

The list is fitted on at most MAX_LABELLED labelled documents (those of smallest hash), whose statistics alone reach
the driver.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from driftwood.llm import shared

#: Bound on the labelled documents that the rules are learned from.
MAX_LABELLED = 4000
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule must be right for this share of the pruning rows that it covers, and cover so many.
LEAST_PRECISION = 0.9
LEAST_ROWS = 5

_BLANKS = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\f\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("f_words", "f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_line_words")


def statistics(docs: DataFrame) -> DataFrame:
    """The documents with the base statistics (long), base_failed, and the features (double) of the rules.

    Null texts have no words. Three-word windows are compared by 64-bit hashes; where some are equal, the hashes are
    sorted with their places, so a window's copies stand side by side. The documents' columns travel in one structure,
    so they may have any names; those that bear an added name are replaced.
    """
    columns = [c for c in docs.columns if c not in {*BASE, *FEATURES, "base_failed"}]
    own = lambda names: [F.col(f"`{c.replace('`', '``')}`") for c in names]
    step = docs.select(F.struct(*own(columns)).alias("doc"), F.coalesce("text", F.lit("")).alias("t"))
    bare = F.btrim("t", F.lit(_TRIM))
    step = step.withColumn("w", F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, _BLANKS)))
    step = step.withColumn("l", F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(_TRIM))) > 0))
    step = step.select(
        "doc",
        "w",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]+", ""))).alias("n_symbols"),
        F.size("l").alias("lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
    )
    step = step.withColumn("h", F.when(F.col("n_words") >= 3, F.expr("transform(sequence(0, n_words - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))"))).drop("w")
    step = step.withColumn("s", F.expr("case when size(array_distinct(h)) < size(h) then sort_array(transform(h, (x, i) -> struct(x as h, i as i))) end")).drop("h")
    twins = "filter(s, (x, i) -> (i > 0 and get(s, i - 1).h = x.h) or (i + 1 < size(s) and get(s, i + 1).h = x.h))"
    step = step.withColumn("n_repeat_words", F.expr(f"coalesce(size(array_distinct(flatten(transform({twins}, x -> array(x.i, x.i + 1, x.i + 2))))), 0)"))
    out = step.select("doc", *[F.col(c).cast("long").alias(c) for c in BASE], "lines")
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    ratios = [F.col("n_words").cast("double"), per("word_chars", "n_words"), per("n_symbols", "word_chars"), per("n_dup_lines", "lines"), per("n_repeat_words", "n_words"), per("n_words", "lines")]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc.*", *BASE, failed.alias("base_failed"), *[x.alias(n) for n, x in zip(FEATURES, ratios, strict=True)])


class Condition(NamedTuple):
    feature: int
    above: bool  # at least the threshold, else at most
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] >= self.threshold if self.above else x[:, self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and bad[inside].any() and not bad[inside].all():
        p, n = bad[inside].sum(), inside.sum()
        before, best, gain = np.log2(p / n), None, 0.0
        for f in range(x.shape[1]):
            for t in np.unique(np.quantile(x[inside, f], np.linspace(0.01, 0.99, 50), method="nearest")):
                for above in (True, False):
                    c = Condition(f, above, float(t))
                    mine = inside & c.holds(x)
                    q = bad[mine].sum()
                    if q and (g := q * (np.log2(q / mine.sum()) - before)) > gain + 1e-9:
                        best, gain = c, g
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        mine = covers(r, x)
        return (2 * bad[mine].sum() - mine.sum()) / max(1, mine.sum())

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Ordered rules for the bad rows. Row order decides which rows grow and which prune (each third one)."""
    rules: list[Rule] = []
    x, bad = np.asarray(x, float).reshape(-1, len(FEATURES)), np.asarray(bad, bool)
    while len(rules) < MAX_RULES and len(x):
        held = np.arange(len(x)) % 3 == 2
        rule = _grow(x[~held], bad[~held])
        rule = _prune(rule, x[held], bad[held]) if rule else rule
        mine = covers(rule, x[held]) if rule else np.zeros(0, bool)
        if mine.sum() < LEAST_ROWS or bad[held][mine].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        rest = ~covers(rule, x)
        x, bad = x[rest], bad[rest]
    return rules


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the labelled documents that pass the base test. Labels that are null tell nothing; of several for a document
    the lowest counts. Without labels there are no rules."""
    told = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    # chosen by hash first, so that no task passes on much more than its share
    chosen = shared.hashed_sample(told, "doc_id", max_labelled, told.select("doc_id").distinct().count()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # max_labelled rows
    # base_failed is looked at here: as a filter it would be pushed below the statistics and compute them over and over
    rows = known.select("doc_id", "quality", "base_failed", *FEATURES).orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(max_labelled).collect()
    rows = [r for r in rows if not r.base_failed]
    return learn([[r[f] for f in FEATURES] for r in rows], [r.quality == 0 for r in rows])


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that a document meets, from 1; 0 for none."""
    chain = None
    for k, rule in enumerate(rules, 1):
        met = F.lit(True)
        for c in rule:
            x = F.col(FEATURES[c.feature])
            met &= (x >= c.threshold) if c.above else (x <= c.threshold)
        chain = F.when(met, k) if chain is None else chain.when(met, k)
    return F.lit(0) if chain is None else chain.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents with statistics, rule and kept. All rows stay; an empty table stays empty; null and clashing columns are
    as in statistics()."""
    told = statistics(docs.drop("rule", "kept")).withColumn("rule", verdict(rules))
    return told.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op5_decision_list(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = train(docs, shared.table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", *BASE, "base_failed", "kept", "rule")
