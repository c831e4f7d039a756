"""Line deduplication by a suffix array over line-id sequences. DataFrame functions only.

A document is the sequence of its lines that have a word. A line is deleted if it lies in a run of consecutive lines
with MIN_WORDS words or more in all that occurs at an earlier place (in the order of doc_id, then of line) as well. So the first copy
of every repeated run stays, later ones go, as far as they repeat: the union of a place's qualifying windows is its
maximal repeated run.

Suffixes (the lines from a place to the document's end, or to a line that occurs once) are ranked by prefix doubling:
the rank of the first 2k lines is that of the pair (rank of the first k, rank of the k behind them), sorted over the
cluster by range partitioning of the distinct pairs. Sorted by the last rank they are the suffix array. The longest
common prefix of neighbours in it is found by comparing ranks of 2^k, 2^(k-1) .. 1 lines; a place's greater one of the
two is its reach. A window of n lines is repeated just where n is within reach: then it is an interval of the
longest-common-prefix table at depth n, named by the ranks of its first and last 2^j lines, 2^j <= n < 2^(j+1). The
interval's first place stays, and the later ones are the repeated windows. Those of a document that touch make its
maximal repeated runs, which are rows of their own (`repeated_runs`); their lines are deleted.

A window that is as small as it can be without losing a given line has MIN_WORDS lines at most, since each line has a
word, and every part of a repeated run is itself repeated. So intervals up to that depth decide everything, the array
is sorted to that depth, and the doubling ends after log2(MIN_WORDS) rounds, whatever the data.

Hot lines: ranks and first places are partial aggregates, and the joins that bring them back have a row for each key
on one side, so that adaptive execution splits a hot key's rows. Places of equal rank are sorted by document, so that
the array is cut into even stretches, and neighbours are compared in stretches of STRETCH places. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftwood.llm import shared

MIN_WORDS = 10
#: Places of the suffix array that are compared in one group.
STRETCH = 4096
_BLANKS = r"[\x20\x09-\x0D]+"
#: A document's rows are told apart by id and text; equal rows are one document with one outcome.
DOC = ["doc_id", "th"]


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, th, idx (among its lines with a word), two hashes of the line (128 bits), its number of words."""
    lines = F.filter(F.split(_text(), "\n"), _has_word)
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_text()).alias("th"), F.posexplode(lines).alias("idx", "line"))
    words = F.size(F.split(F.btrim("line", F.lit(" \t\n\x0b\f\r")), _BLANKS))
    return each.select(*DOC, "idx", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"), words.alias("nw"))


def _ranked(rows: DataFrame, name: str, least: int = 1) -> DataFrame:
    """The pairs (a, b) that occur `least` times or more, with numbers ascending in their order.

    The numbers come from the place in a range-partitioned sort. They are written, so that all later steps see the same.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.groupBy("a", "b").count().where(F.col("count") >= least).select("a", "b")
    ordered = pairs.repartitionByRange(parts, "a", "b").sortWithinPartitions("a", "b")
    return shared.written(ordered.withColumn(name, F.monotonically_increasing_id()), "ranks")


def _ahead(column: str, n: int) -> Column:
    """The value n lines on, if all lines between take part."""
    of_doc = Window.partitionBy(*DOC).orderBy("idx")
    return F.when(F.lead("idx", n).over(of_doc) == F.col("idx") + n, F.lead(column, n).over(of_doc)) if n else F.col(column)


def suffix_array(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """DOC, idx, at (place in the array, from 0), m (lines of the suffix, as far as it is sorted), probe (its ranks of
    ever fewer lines at the offsets where they are asked), windows (n, a, b: those that might be repeated, named).

    Of suffixes that begin with a window that has min_words and is as small as can be.
    """
    spark = lines.sparkSession
    place = lines.join(_ranked(lines, "r0", 2), ["a", "b"]).select(*DOC, "idx", "nw", "r0").dropDuplicates([*DOC, "idx"])
    lengths = range(1, max(1, min_words) + 1)
    top = (lengths[-1] - 1).bit_length()  # ranks of 1, 2, 4 .. 2^top lines
    for k in range(1, top + 1):
        pairs = place.withColumns({"a": F.col(f"r{k - 1}"), "b": F.coalesce(_ahead(f"r{k - 1}", 1 << (k - 1)), F.lit(-1))})
        place = shared.written(pairs, "places")
        place = place.join(_ranked(place, f"r{k}"), ["a", "b"]).drop("a", "b")
    probes = [(f"r{k}", n) for k in range(top, -1, -1) for n in range(0, 1 << top, 2 << k)] if top else [("r0", 0)]
    further = {(f"r{n.bit_length() - 1}", n - (1 << (n.bit_length() - 1))) for n in lengths} | {("nw", n - 1) for n in lengths} | set(probes)
    m = sum((F.when(_ahead("idx", n).isNotNull(), 1).otherwise(0) for n in range(1, 1 << top)), F.lit(1))
    place = place.select(*DOC, "idx", f"r{top}", m.alias("m"), *[_ahead(c, n).alias(f"{c}_{n}") for c, n in sorted(further)])
    windows = []
    for n in lengths:
        k = n.bit_length() - 1
        total = sum((F.col(f"nw_{j}") for j in range(n)), F.lit(0))
        needed = (total >= min_words) & ((total - F.col("nw_0") < min_words) | (total - F.col(f"nw_{n - 1}") < min_words))
        windows.append(F.struct(F.lit(n).alias("n"), F.when(needed, F.col(f"r{k}_0")).alias("a"), F.col(f"r{k}_{n - (1 << k)}").alias("b")))
    found = F.filter(F.array(*windows), lambda w: w["a"].isNotNull() & w["b"].isNotNull())
    suffixes = place.select(*DOC, "idx", f"r{top}", "m", F.array(*[F.col(f"{c}_{n}") for c, n in probes]).alias("probe"), found.alias("windows")).where(F.size("windows") > 0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"r{top}", *DOC, "idx"]
    ordered = suffixes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(f"r{top}")
    ordered = shared.written(ordered.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "suffixes")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("size"))  # a row a partition
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = shared.written(sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")), "starts")
    return ordered.join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.col("row")).drop("part", "row", "start")


def with_reach(array: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The suffix array with lcp (lines in common with the suffix before; as far as it is sorted) and reach (the greater
    of that and the next one's).

    A stretch also has the places next to it, which are dropped again.
    """
    top = (max(1, min_words) - 1).bit_length()
    stretch = F.floor(F.col("at") / STRETCH)
    seen = F.when((F.col("at") % STRETCH == 0) & (F.col("at") > 0), F.array(stretch, stretch - 1)).when(F.col("at") % STRETCH == STRETCH - 1, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
    rows = array.withColumn("stretch", F.explode(seen))
    of = Window.partitionBy("stretch").orderBy("at")
    rows = rows.withColumn("before", F.lag("probe").over(of)).withColumn("n", F.lit(0))
    base = 0
    for k in range(top, -1, -1):
        at = (F.lit(base) + F.shiftright("n", k + 1)).cast("int")
        same = F.coalesce(F.get("probe", at) == F.get("before", at), F.lit(False)) & (F.col("n") < (1 << top))
        rows = rows.withColumn("n", F.when(same, F.col("n") + (1 << k)).otherwise(F.col("n")))
        base += max(1, (1 << top) >> (k + 1))
    rows = rows.withColumn("lcp", F.least("n", "m"))
    rows = rows.withColumn("reach", F.greatest("lcp", F.coalesce(F.lead("lcp").over(of), F.lit(0))))
    return rows.where(F.col("stretch") == stretch).drop("before", "n", "probe", "stretch")


def later_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """DOC, idx, n, first: the windows that also occur earlier, with the interval's first place (doc_id, th, idx)."""
    lines = shared.written(lines_of(docs), "lines")
    reaching = with_reach(suffix_array(lines, min_words), min_words)
    runs = reaching.select(*DOC, "idx", F.explode(F.filter("windows", lambda w: w["n"] <= F.col("reach"))).alias("w")).select(*DOC, "idx", "w.*")
    runs = shared.written(runs, "runs")
    here = F.struct(*DOC, "idx")
    # written, so that the join below has an exchange on both sides and a hot interval's rows can be split
    first = shared.written(runs.groupBy("n", "a", "b").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first < last").drop("last"), "firsts")
    return runs.join(first, ["n", "a", "b"]).where(F.col("first") < here).select(*DOC, "idx", "n", "first")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, length (lines with a word), first_doc, first_start: every maximal run of lines that also occur
    earlier, with the earlier place of its first window. Lines of windows that touch or overlap make one run."""
    of_doc = Window.partitionBy(*DOC).orderBy("idx", "n")
    rows = later_windows(docs, min_words).withColumn("until", F.max(F.col("idx") + F.col("n")).over(of_doc.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("until").isNull() | (F.col("idx") > F.col("until")), 1).otherwise(0)).over(of_doc))
    of_run = rows.groupBy(*DOC, "run").agg(F.min("idx").alias("start"), F.max(F.col("idx") + F.col("n")).alias("end"), F.min_by("first", F.struct("idx", "n")).alias("first"))
    return of_run.select("doc_id", "start", (F.col("end") - F.col("start")).alias("length"), F.col("first.doc_id").alias("first_doc"), F.col("first.idx").alias("first_start"))


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, gone: the sorted places, among the lines with a word, of those to delete; documents with some only."""
    gone = later_windows(docs, min_words).select(*DOC, F.explode(F.sequence("idx", F.col("idx") + F.col("n") - 1)).alias("idx"))
    return gone.groupBy(*DOC).agg(F.array_sort(F.collect_set("idx")).alias("gone"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, their texts without later copies of repeated runs, with n_lines and n_deleted added.

    Lines without a word stay and count for nothing. Null texts stay null; null ids come before all others. Rows that
    are equal in id and text have the same outcome, and neither counts as a copy of the other. An empty table stays
    empty. All columns stay, whatever their names; those that already bear the added names are replaced.
    """
    docs = docs.drop("n_lines", "n_deleted")
    with shared.few_files(docs.sparkSession):
        found = deletions(docs, min_words)
    row = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_text()).alias("th"))
    found = found.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), "gone")
    joined = row.join(found, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left").withColumn("text", F.col("doc.text"))
    lines = joined.withColumn("lines", F.split(_text(), "\n"))
    last = F.size("lines") - 1
    lines = lines.withColumn("full", F.filter(F.sequence(F.lit(0), last), lambda i: _has_word(F.get("lines", i))))
    kept = F.array_except(F.sequence(F.lit(0), last), F.transform("gone", lambda j: F.get("full", j)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    names = [F.col("doc").getField(c).alias(c) if c != "text" else text.alias("text") for c in docs.columns]
    return lines.select(*names, F.size("full").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


#: Windows of up to MIN_WORDS lines, as lists of their texts' digests.
_WINDOW = "SELECT doc_id, idx, {n} AS n, list(md5(line)) OVER w AS run, sum(nw) OVER w AS words FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {m} FOLLOWING)"
ORACLE_SQL = """
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
every AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS spot FROM raw),
full_lines AS (SELECT doc_id, spot, line, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS idx,
    len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS nw
  FROM every WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
windows AS ({windows}),
firsts AS (SELECT *, min((doc_id, idx)) OVER (PARTITION BY run) AS first FROM windows WHERE len(run) = n AND words >= {least}),
gone AS (SELECT DISTINCT f.doc_id, f.idx + k AS idx FROM firsts f, (SELECT unnest(range({least})) AS k) WHERE k < f.n AND f.first < (f.doc_id, f.idx)),
marked AS (SELECT e.doc_id, e.spot, e.line, f.idx IS NOT NULL AS is_full, g.idx IS NOT NULL AS is_gone FROM every e
  LEFT JOIN full_lines f ON f.doc_id = e.doc_id AND f.spot = e.spot LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.idx = f.idx)
SELECT doc_id, CAST(sum(CAST(is_full AS INT)) AS BIGINT) AS n_lines, CAST(sum(CAST(is_gone AS INT)) AS BIGINT) AS n_deleted,
  md5(coalesce(string_agg(CASE WHEN is_gone THEN NULL ELSE line END, chr(10) ORDER BY spot), '')) AS text_md5
FROM marked GROUP BY doc_id
""".replace("{windows}", " UNION ALL ".join(_WINDOW.format(n=n, m=n - 1) for n in range(1, MIN_WORDS + 1))).replace("{least}", str(MIN_WORDS))
