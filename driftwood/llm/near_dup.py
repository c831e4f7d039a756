"""Near-duplicate documents by b-bit MinHash.

A document's set is that of its n-word shingles (lower case for A to Z). One hash per shingle is dealt into MINIMA bins,
whose minima, with empty bins filled from others by a fixed rule, are the signature. Bands of ROWS minima give bucket
keys; the lowest BITS bits of each minimum are packed and kept. The share of equal packed values m estimates the
similarity as (m - c) / (1 - c), c = 2 ** -BITS being the chance of equal bits.

1. Documents with equal sets are one class; from here on only representatives take part.
2. Each bucket's smallest member is its centre; every other member is a candidate pair with it. So a bucket of n
   documents gives n - 1 pairs, not n * n. Pairs whose sizes rule a link out go, and those whose estimate is far under the
   threshold unless a set is small; the rest are confirmed on the full sets.
3. Confirmed links give components (smallest id, by label passing and pointer jumping).
4. A bucket may hold members of several components still: links between two members that don't involve its centre. In
   such buckets every member outside the largest component is compared with all others of the bucket by packed
   signature, in blocks of bounded size, and the pairs that may reach the threshold are confirmed there, but for pairs
   that hang together by then. Links inside a component can't change anything. So no link of a bucket between
   components is lost, whatever its centre.

With 64 bands of 8 independent minima, two sets at 0.8 would meet in no bucket with probability 8e-6, at 0.85 with 3e-9.
Bins that share a minimum raise that: computed over random bins, to 9e-6 (4 and 5 shingles) to 3e-5 (800 and 1000) at
0.8, and to 2e-8 at 0.85. Bins of small sets that the fixed choices don't fill have seeded minima of their own.

Hot groups: buckets, centres and classes are partial aggregates and joins with one row a key on one side, which
adaptive execution splits; comparisons stream over partitions sorted by group and hold one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftwood.llm import shared
from driftwood.llm.encoder import piece_keys

MINIMA, BITS, BANDS, ROWS = 512, 4, 64, 8
#: Pairs whose estimate lies so far under the threshold are not confirmed (the standard deviation at 0.8 is 0.019).
MARGIN = 0.12
#: Pairs with a set of fewer shingles are confirmed whatever their estimate: its steps are too coarse there.
SMALL = 64
#: Members of a bucket that are held at a time, and bytes of their sets (a single larger set is held alone).
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Seeded hashes of small sets that are held at a time, about.
SEEDED = 1 << 20
#: Bits of the filter that keeps documents without candidates out of the second reading.
FILTER_BITS = 1 << 24

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text one text after another, and the n + 1 offsets in them."""
    raw, offsets = shared.buffers(texts)
    n = len(offsets) - 1
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[begins] = inside[begins]
    if not first.any():
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(first)
    place = np.cumsum(inside) - 1
    letters, starts = _LOWER[raw[inside]], place[at]
    word = piece_keys(letters, starts, np.diff(starts, append=len(letters)))
    doc = np.searchsorted(offsets, at, side="right") - 1
    count = np.bincount(doc, minlength=n)
    # of a document with fewer words all of them make one shingle
    left = np.repeat(np.cumsum(count), count) - np.arange(len(doc))
    size = np.minimum(words, count[doc])
    ok = left >= size
    value = np.zeros(len(doc), np.uint64)
    for k in range(words):
        more = k < size
        value = np.where(more, shared.mix64(value * np.uint64(3) + np.roll(word, -k) + np.uint64(k)), value)
    value, doc = value[ok], doc[ok]
    value = np.where(value == _EMPTY, np.uint64(0), value)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))])


_FILL = shared.mix64(np.arange(MINIMA * 64, dtype=np.uint64) + np.uint64(99)).reshape(64, MINIMA).astype(np.int64) & (MINIMA - 1)
_SEED = shared.mix64(np.arange(MINIMA, dtype=np.uint64) + np.uint64(0x5EED0000))


def minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The minimum of each bin of each non-empty set; an empty bin has that of another, by a fixed sequence of choices.

    A bin that no choice fills (in small sets) has the least value of the whole set under a hash of its own, so that it
    differs between two sets independently of the other bins.
    """
    n = len(bounds) - 1
    hashed = shared.mix64(values ^ np.uint64(0xA5A5A5A55A5A5A5A))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    slot = owner * MINIMA + (hashed >> np.uint64(55)).astype(np.int64) % MINIMA
    out = np.full(n * MINIMA, _EMPTY)
    order = np.lexsort((hashed, slot))
    slot = slot[order]
    new = np.ones(len(slot), bool)
    new[1:] = slot[1:] != slot[:-1]
    out[slot[new]] = hashed[order[new]]
    out = out.reshape(n, MINIMA)
    source = out.copy()
    for turn in range(_FILL.shape[0]):
        rows, cols = np.nonzero(out == _EMPTY)
        if not len(rows):
            return out
        out[rows, cols] = source[rows, _FILL[turn][cols]]
    rows, cols = np.nonzero(out == _EMPTY)
    size = np.diff(bounds)[rows]
    for part in np.array_split(np.arange(len(rows)), int(size.sum()) // SEEDED + 1):
        if len(part):
            many = size[part]
            seeded = shared.mix64(hashed[shared.ranges(bounds[rows[part]], many)] + np.repeat(_SEED[cols[part]], many))
            out[rows[part], cols[part]] = np.minimum.reduceat(seeded, np.cumsum(many) - many)
    return out


def pack_bits(mins: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of each minimum, two to a byte."""
    low = (shared.mix64(mins) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def band_keys(mins: np.ndarray) -> np.ndarray:
    """A key for each band; its number is part of it."""
    key = np.zeros((len(mins), BANDS), np.uint64)
    for r in range(ROWS):
        key = shared.mix64(key * np.uint64(5) + mins.reshape(-1, BANDS, ROWS)[:, :, r])
    return shared.mix64(key + np.arange(BANDS, dtype=np.uint64)[None, :]).view(np.int64)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarities of one packed signature with many."""
    differs = one[None, :] ^ many
    same = ((differs & 0x0F) == 0).sum(axis=1) + ((differs & 0xF0) == 0).sum(axis=1)
    chance = 2.0**-BITS
    return (same / MINIMA - chance) / (1 - chance)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)), pa.py_buffer(rows)])


def _read(docs: DataFrame) -> DataFrame:
    """Equal ids are told apart by nothing: the rows of one id count as one document with the union of their sets."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, packed signature, band keys (both null for empty sets)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches):
            values, bounds = shingles(part.column("text"), words)
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            kept = np.concatenate([[0], np.cumsum(size[full])])
            mins = minima(values, kept)
            sums = np.zeros((2, part.num_rows), np.uint64)
            if len(full):
                sums[0, full], sums[1, full] = (np.add.reduceat(shared.mix64(values + np.uint64(k)), kept[:-1]) for k in (1, 2))
            where = np.full(part.num_rows, -1)
            where[full] = np.arange(len(full))
            take = pa.array(where, mask=where < 0)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * BANDS, pa.int32()), pa.array(band_keys(mins).ravel()))
            yield pa.record_batch([part.column("doc_id"), pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), _binary(pack_bits(mins)).take(take), keys.take(take)], names=["doc_id", "n_shingles", "s1", "s2", "packed", "keys"])
        shared.give_back()

    return _read(docs).mapInArrow(task, "doc_id long, n_shingles long, s1 long, s2 long, packed binary, keys array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """doc_id, set (sorted 64-bit hashes) of the documents in `wanted` (id).

    A bit filter of fixed size, made from the wanted ids, goes to all tasks and keeps most others from being hashed and
    shuffled; the join is exact.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bits = wanted.select((slot / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    filled = np.zeros(FILTER_BITS // 64, np.int64)  # 2 MB
    filled[bits["w"].to_numpy()] = bits["b"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column("slot").to_numpy()
            hit = (sent.value[spot >> 6] >> (spot & 63)) & 1 == 1
            for part in shared.slices([batch.filter(pa.array(hit))]):
                values, bounds = shingles(part.column("text"), words)
                yield pa.record_batch([part.column("doc_id"), pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])], names=["doc_id", "set"])
        shared.give_back()

    read = _read(docs).where("doc_id is not null").withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    sets = read.mapInArrow(task, "doc_id long, set binary")
    return shared.written(sets.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), "sets")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """Of the pairs (x, y) those whose sets have 100 * intersection >= threshold * union.

    Partitions are sorted by y and a salt, with the set of y first in each group: one set is held, the others stream.
    """
    pairs = shared.written(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    sets = shingle_sets(docs, ids, words)
    salt = F.pmod(F.xxhash64("x"), F.lit(64))
    left = pairs.join(sets.withColumnRenamed("doc_id", "x"), "x").select("y", salt.alias("salt"), "x", "set")
    centres = pairs.select("y", salt.alias("salt")).distinct().join(sets.withColumnRenamed("doc_id", "y"), "y").select("y", "salt", F.lit(None).cast("long").alias("x"), "set")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = left.unionByName(centres).repartition(parts, "y", "salt").sortWithinPartitions("y", "salt", F.col("x").asc_nulls_first())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray = np.zeros(0, np.uint64)
        for batch in batches:
            xs, ys = [], []
            for x, y, data in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("set"), strict=True):
                mine = np.frombuffer(data.as_buffer(), np.uint64)
                if x is None:
                    held = mine.copy()
                    continue
                if _linked(mine, held, threshold):
                    xs.append(x)
                    ys.append(y)
            yield pa.record_batch([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return shared.written(grouped.mapInArrow(task, "x long, y long"), "links")


def components(links: DataFrame) -> DataFrame:
    """id, component of all ids in the links (x, y): the smallest id that can be reached.

    Each round takes the least label among neighbours, then the label of the label; a few rounds do for stars, and
    chains halve with each.
    """
    both = links.select("x", "y").union(links.select("y", "x"))
    labels = shared.written(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("id"), F.least("x", "y").alias("component")), "labels")
    both = shared.written(both.distinct(), "edges")
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("component").alias("near"))
        # written, so that the join below has an exchange on both sides and a hot component's rows can be split
        step = shared.written(labels.join(near.withColumnRenamed("x", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component")), "steps")
        up = step.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = shared.written(step.join(up, "component", "left").select("id", "old", F.coalesce("up", "component").alias("component")), "labels")
        if new.where("old != component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (id, component) after further links: only what the links join is searched, with a component as one node."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    told = shared.written(links.join(of("x"), "x", "left").join(of("y"), "y", "left").select("x", "y", F.coalesce("cx", "x").alias("cx"), F.coalesce("cy", "y").alias("cy")), "told")
    joins = components(told.where("cx != cy").select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct())
    every = labels.union(told.select(F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("cx").alias("component")), F.struct(F.col("y").alias("id"), F.col("cy").alias("component")))).alias("e")).select("e.*")).distinct()
    up = joins.select(F.col("id").alias("component"), F.col("component").alias("up"))
    return shared.written(every.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component")), "labels")


def _linked(one: np.ndarray, other: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= threshold * union."""
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    if 100 * len(small) < threshold * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= threshold * (len(small) + len(large) - both)


def _leftover_links(members: DataFrame, packed: DataFrame, labels: DataFrame, docs: DataFrame, words: int, threshold: int) -> DataFrame | None:
    """Links between members of one bucket whose components differ; None if no bucket has several components.

    Within a block, components grow as links are found, pairs of one component are passed over, and only links that join
    two components are given: fewer than members. The likeliest pair is confirmed first.
    """
    told = members.join(packed.select("doc_id", "n_shingles"), "doc_id").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = told.groupBy("key", "component").agg(F.count("*").alias("count"), F.sum("n_shingles").alias("shingles"))
    most = F.struct("count", "component")
    main = sizes.groupBy("key").agg(F.max_by("component", most).alias("main"), F.sum("count").alias("size"), F.max("count").alias("most"), F.sum("shingles").alias("shingles"), F.max_by("shingles", most).alias("main_shingles")).where("size > most")
    told = shared.written(told.join(shared.written(main, "mains"), "key").withColumn("minor", F.col("component") != F.col("main")), "mixed")
    if told.isEmpty():
        return None
    sets = shingle_sets(docs, told.select(F.col("doc_id").alias("id")).distinct(), words).dropDuplicates(["doc_id"])
    blocks = lambda n, shingles: F.greatest(F.ceil(n / BLOCK), F.ceil(shingles * 8 / BLOCK_BYTES)).cast("int")
    told = told.withColumns({"row_blocks": blocks(F.col("size"), F.col("shingles")), "minor_blocks": blocks(F.col("size") - F.col("most"), F.col("shingles") - F.col("main_shingles"))})
    told = told.join(packed.drop("n_shingles"), "doc_id").join(sets, "doc_id")
    mine = lambda salt, n: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n)).cast("int")
    kept = ["doc_id", "component", "packed", "set"]
    as_row = told.select("key", mine(1, "row_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1)).alias("j"), F.lit(1).alias("side"), *kept)
    as_minor = told.where("minor").select("key", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("i"), mine(2, "minor_blocks").alias("j"), F.lit(0).alias("side"), *kept)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = as_row.unionByName(as_minor).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "doc_id")
    least = threshold / 100

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sigs, sets_, roots, block = None, [], [], [], [], None
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                c = up
            return c

        for batch in batches:
            xs, ys = [], []
            names, comps, sides = (batch.column(c).to_pylist() for c in ("doc_id", "component", "side"))
            heres = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True))
            for k, (name, comp, side, here) in enumerate(zip(names, comps, sides, heres, strict=True)):
                if here != group:
                    group, ids, sigs, sets_, roots, block, parent = here, [], [], [], [], None, {}
                one = np.frombuffer(batch.column("packed")[k].as_buffer(), np.uint8)
                mine_ = np.frombuffer(batch.column("set")[k].as_buffer(), np.uint64)
                if side == 0:
                    ids.append(name)
                    roots.append(comp)
                    sigs.append(one.copy())
                    sets_.append(mine_.copy())
                    continue
                if not ids:
                    continue
                if block is None:
                    block = np.array(roots), np.stack(sigs), np.array([len(x) for x in sets_])
                root, packed_, size = block
                near = np.flatnonzero((root != find(comp)) & (100 * np.minimum(size, len(mine_)) >= threshold * np.maximum(size, len(mine_))))
                guess = estimates(one, packed_[near])
                # five standard deviations of as many samples as there are bins or shingles
                likely = (guess >= least - 5 * np.sqrt(least * (1 - least) / np.minimum(MINIMA, size[near]))) | (np.minimum(size[near], len(mine_)) < SMALL)
                for e in near[likely][np.argsort(-guess[likely], kind="stable")].tolist():
                    if root[e] != find(comp) and _linked(mine_, sets_[e], threshold):
                        xs.append(max(name, ids[e]))
                        ys.append(min(name, ids[e]))
                        old, new = int(root[e]), find(comp)
                        parent[old] = new
                        root[root == old] = new
            yield pa.record_batch([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return shared.written(grouped.mapInArrow(task, "x long, y long"), "links")


def _classes_and_links(signed: DataFrame, docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """id, component of the documents that hang together with others."""
    known = signed.where("keys is not null and doc_id is not null")
    # classes and buckets are written: a join with them has an exchange on both sides, so that a hot key's rows can be split
    classes = shared.written(known.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep")), "heads")
    representing = known.join(classes, ["n_shingles", "s1", "s2"])
    rows = shared.written(representing.select("doc_id", "rep", "n_shingles", "s1", "s2"), "classes")
    reps = known.join(rows.where("doc_id = rep").select("doc_id", "s1", "s2").dropDuplicates(["doc_id", "s1", "s2"]), ["doc_id", "s1", "s2"], "left_semi")
    reps = reps.select("doc_id", "n_shingles", "packed", "keys")
    banded = reps.select("doc_id", F.explode("keys").alias("key"))
    buckets = shared.written(banded.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).where("centre < last").select("key", "centre"), "buckets")
    members = shared.written(banded.join(buckets, "key"), "members")
    packed = shared.written(reps.select("doc_id", "n_shingles", "packed").join(members.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "packed")
    pairs = members.where("doc_id != centre").select(F.col("doc_id").alias("x"), F.col("centre").alias("y")).distinct()
    # the representatives of the rows of one id hang together
    heads = rows.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    same = rows.join(heads.where("rep < last").select("doc_id", F.col("rep").alias("y")), "doc_id").where("rep != y").select(F.col("rep").alias("x"), "y").distinct()
    labels = components(confirm(_may_reach(pairs, packed, threshold), docs, words, threshold).unionByName(same))
    # a sixteenth of the buckets first: that joins what belongs together, and few buckets are left with several components
    for some in (members.where(F.pmod(F.xxhash64("key"), F.lit(16)) == 0), members):
        links = _leftover_links(some.select("key", "doc_id"), packed, labels, docs, words, threshold)
        if links is not None:
            labels = merged(labels, links)
    of_rep = labels.select(F.col("id").alias("rep"), "component")
    return heads.join(of_rep, "rep", "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= threshold * union of their sets of word shingles. A document with
    fewer words has one shingle of all of them; null texts and texts without words have an empty set and no links.
    component_id is the smallest doc_id that can be reached; kept: it is the document's own. Rows of equal ids belong to
    one component and each is judged by its own set (its links add up); null ids are linked with nothing and kept. An
    empty table gives no rows. Further columns are not read.
    """
    signed = shared.written(signatures(docs, words), "signatures")
    with shared.few_files(docs.sparkSession):
        labels = _classes_and_links(signed, docs, words, threshold)
    out = signed.select("doc_id", "n_shingles").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _may_reach(pairs: DataFrame, packed: DataFrame, threshold: int) -> DataFrame:
    """The pairs without those whose sizes or whose estimate, which is not asked for small sets, rule a link out."""
    least = threshold / 100 - MARGIN
    of = lambda c: packed.withColumnsRenamed({"doc_id": c, "packed": f"p{c}", "n_shingles": f"n{c}"})
    with_both = pairs.join(of("x"), "x").join(of("y"), "y").where(100 * F.least("nx", "ny") >= threshold * F.greatest("nx", "ny"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MINIMA // 2) for c in ("px", "py"))
            differs = a ^ b
            same = ((differs & 0x0F) == 0).sum(axis=1) + ((differs & 0xF0) == 0).sum(axis=1)
            near = (same / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS) >= least
            near |= np.minimum(batch.column("nx").to_numpy(), batch.column("ny").to_numpy()) < SMALL
            yield batch.select(["x", "y"]).filter(pa.array(near))

    return with_both.mapInArrow(task, "x long, y long")


def op8_bbit_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"), words=2, threshold=80)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
each AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [md5(w[1])] WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, len(w)), lambda i: md5(w[i] || ' ' || w[i + 1])) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM each GROUP BY doc_id),
sets AS (SELECT doc_id, n, md5(string_agg(s, '' ORDER BY s)) AS h FROM each JOIN sizes USING (doc_id) GROUP BY doc_id, n),
reps AS (SELECT h, n, min(doc_id) AS doc_id FROM sets GROUP BY h, n),
shared_n AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM each a JOIN reps ra ON ra.doc_id = a.doc_id JOIN each b ON a.s = b.s JOIN reps rb ON rb.doc_id = b.doc_id
  WHERE a.doc_id < b.doc_id AND 100 * least(ra.n, rb.n) >= 80 * greatest(ra.n, rb.n) GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared_n JOIN reps p ON p.doc_id = x JOIN reps q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM reps UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
comp AS (SELECT x AS rep, min(y) AS c FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN sets s USING (doc_id) LEFT JOIN reps r ON r.h = s.h AND r.n = s.n LEFT JOIN comp c ON c.rep = r.doc_id
"""
