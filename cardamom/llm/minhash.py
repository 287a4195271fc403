"""Near-duplicate documents by MinHash with tensored bands.

Two small collections of keys are made from minhashes: each key hashes ROWS of
them. A table key combines one key of either collection, so that PARTS keys of
each give PARTS squared tables of 2 * ROWS rows from only 2 * PARTS * ROWS
minhashes. Two sets of similarity s meet in some table with probability
(1 - (1 - s**ROWS)**PARTS)**2. The number of parts follows from the threshold
and the miss rate wanted there.

Equal sets (by a digest of the whole sorted set) are merged first. What meets in
a bucket is a candidate only if enough of all minhashes agree, a byte of each
being compared; this is decided before anything is grouped, so that texts with a
common passage do not chain. Groups of candidates are then verified on full
shingle sets, compared in blocks of bounded size, skipping pairs that are
connected already, and only a spanning forest of the links comes out: no list of
pairs exists.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardamom.llm import wordhash
from cardamom.llm.common import linked_groups, own, unique_name, written

ROWS = 3
#: Chance that a pair just at the threshold meets in no table, and that it then agrees in too few minhashes.
MISS, SKETCH_MISS = 1e-4, 1e-6
#: Documents and shingles in a block, at most; a longer single document is a block of its own.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20
#: Members of a bucket whose minhashes are compared in one block.
BUCKET_DOCS = 2048


def parts_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - similarity**rows)))


def least_agreement(similarity: float, minhashes: int, miss: float = SKETCH_MISS) -> int:
    """The number of agreeing minhashes that a pair at the threshold falls below with probability ``miss`` at most."""
    below = 0.0
    for c in range(minhashes + 1):
        below += math.comb(minhashes, c) * similarity**c * (1 - similarity) ** (minhashes - c)
        if below > miss:
            return c
    return minhashes


def _signatures(k: int, parts: int, rows: int):
    rng = np.random.Generator(np.random.PCG64(77))
    m = 2 * parts * rows
    mul = rng.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    xor = rng.integers(0, 2**63, m, dtype=np.uint64)
    fold = rng.integers(0, 2**63, (2 * parts, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    schema = pa.schema([("_doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offs, raw in wordhash.slices(batch.column("_text")):
                h, at = wordhash.shingle_digests(*wordhash.word_digests(offs, raw), k)
                rows_in = len(offs) - 1
                sets = [wordhash.distinct(h[at[i] : at[i + 1]]) for i in range(rows_in)]
                n = np.array([len(s) for s in sets], np.int64)
                has = np.flatnonzero(n)
                keys = np.zeros((rows_in, 2 * parts), np.uint64)
                sketch = np.zeros((rows_in, m), np.uint8)
                if len(has):
                    flat, begins = np.concatenate([sets[i][:, 0] for i in has]), np.concatenate([[0], np.cumsum(n[has])[:-1]])
                    for j in range(2 * parts):
                        key = np.zeros(len(has), np.uint64)
                        for r in range(rows):
                            least = wordhash.mix(np.minimum.reduceat((flat ^ xor[j * rows + r]) * mul[j * rows + r], begins))
                            sketch[has, j * rows + r] = least >> np.uint64(56)
                            key += least * fold[j, r]
                        keys[has, j] = wordhash.mix(key)
                keys = keys.view(np.int64)
                both = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in sets), np.int64).reshape(-1, 2)
                lists = [pa.ListArray.from_arrays(np.arange(0, rows_in * parts + 1, parts, dtype=np.int32), np.ascontiguousarray(x).ravel()) for x in (keys[:, :parts], keys[:, parts:])]
                ids = batch.column("_doc_id").slice(first, rows_in)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(both[:, 0]), pa.array(both[:, 1]), *lists, pa.array([x.tobytes() for x in sketch], pa.binary())], schema=schema)

    return run


def _agreeing(least: int):
    """Of buckets or of two blocks of one: a spanning forest of the pairs with enough agreeing minhashes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        reps, key, side = (t.column(c).to_numpy() for c in ("rep", "key", "side"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(reps), -1)
        order = np.lexsort((reps, side, key))
        reps, key, side, sketch = reps[order], key[order], side[order], sketch[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(begins, len(key)))
        first = np.repeat(begins, sizes)
        crossing = np.repeat(np.add.reduceat((side != side[first]).astype(np.int64), begins) > 0, sizes)
        near = (sketch == sketch[first]).sum(axis=1) >= least
        near &= (np.arange(len(first)) != first) & (~crossing | (side != side[first]))
        out = [np.stack([reps[first[near]], reps[near]], axis=1)]
        # most buckets are done: all of their members agree with the first
        rest = np.add.reduceat(near.astype(np.int64), begins) < sizes - 1
        for b, n in zip(begins[rest & (sizes > 2)].tolist(), sizes[rest & (sizes > 2)].tolist(), strict=True):
            own, own_side, cross = sketch[b : b + n], side[b : b + n], crossing[b]
            label = np.where(near[b : b + n], 0, np.arange(n))
            for i in range(1, n):
                fits = label[i + 1 :] != label[i]
                if cross:
                    fits &= own_side[i + 1 :] != own_side[i]
                later = np.flatnonzero(fits) + i + 1
                if not len(later):
                    continue
                for j in later[(own[later] == own[i]).sum(axis=1) >= least].tolist():
                    if label[j] != label[i]:
                        out.append(np.array([[reps[b + i], reps[b + j]]]))
                        label[label == label[j]] = label[i]
        edges = np.concatenate(out)
        return pa.table([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=schema)

    return run


def _blocked(df: DataFrame, group: str, node: str, bins: int) -> DataFrame:
    """df (with blocks) with block numbers as side, dealt into tasks g, g1, g2: one for each pair of blocks of a large group, small groups share."""
    one = F.col("blocks") == 1
    block = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    df = df.withColumn("side", block).withColumn("other", F.explode(F.when(one, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return df.withColumns(
        {
            "g": F.when(one, F.pmod(F.xxhash64(group), F.lit(bins))).otherwise(F.col(group)),
            "g1": F.when(one, -1).otherwise(F.least("side", "other")),
            "g2": F.when(one, -1).otherwise(F.greatest("side", "other")),
        }
    )


def _forest(k: int, percent: int):
    """Verifies one group of blocks; gives a spanning forest of its links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        ids, comp, side = (t.column(c).to_numpy() for c in ("doc", "component", "side"))
        sets = [s for _, s in wordhash.sets(t.column("_text").combine_chunks(), k)]
        order = np.lexsort((ids, comp))
        cuts = np.flatnonzero(np.diff(comp[order])) + 1
        out: list[tuple[int, int]] = []
        for group in np.split(order, cuts):
            n = len(group)
            if n < 2:
                continue
            size = np.array([len(sets[i]) for i in group], np.int64)
            number = wordhash.numbered(np.concatenate([sets[i] for i in group]))
            begins = np.concatenate([[0], np.cumsum(size)])
            label, own_side = np.arange(n), side[group]
            cross = len(set(own_side)) > 1
            mark = np.zeros(number.max(initial=0) + 1, bool)
            for i in range(n):
                fits = (100 * np.minimum(size[i], size) >= percent * np.maximum(size[i], size)) & (label != label[i])
                if cross:
                    fits &= own_side != own_side[i]
                later = np.flatnonzero(fits[i + 1 :]) + i + 1
                if not len(later):
                    continue
                mine = number[begins[i] : begins[i + 1]]
                mark[mine] = True
                if len(later) > n // 8:
                    common = np.add.reduceat(mark[number].astype(np.int32), begins[:-1])[later]
                else:
                    common = np.array([mark[number[begins[j] : begins[j + 1]]].sum() for j in later])
                mark[mine] = False
                for j in later[100 * common >= percent * (size[i] + size[later] - common)]:
                    if label[j] != label[i]:
                        out.append((ids[group[i]], ids[group[j]]))
                        label[label == label[j]] = label[i]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their
    sets of k-word shingles. component_id is the smallest doc_id reachable,
    kept tells whether it is the document's own. Null or empty texts have an
    empty set and are linked with nothing. Rows that repeat a doc_id count as
    one document. Rows without a doc_id are not compared: component_id is null
    and they are kept. Other columns are ignored.
    """
    parts = parts_for(percent / 100, ROWS, miss)
    spark = docs.sparkSession
    base = own(docs, {"doc_id": "long", "text": "string"})
    kind = "_doc_id long, n long, f1 long, f2 long, left array<long>, right array<long>, sketch binary"
    sig = written(base.mapInArrow(_signatures(k, parts, ROWS), kind), "signatures")
    real = sig.where("_doc_id is not null and n > 0")
    repeated = written(real.groupBy("_doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("_doc_id"), "repeated")
    repeats = not repeated.isEmpty()
    same = written(real.groupBy("f1", "f2", "n").agg(F.min("_doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "same")
    of = written(real.select("_doc_id", "f1", "f2", "n").join(same, ["f1", "f2", "n"], "left").select("_doc_id", "f1", "f2", "n", F.coalesce("rep", "_doc_id").alias("rep")), "of")

    # a representative is a set of a document: another set of the same doc_id may be a copy
    copies = of.where("_doc_id <> rep").select("_doc_id", "f1", "f2", "n").distinct()
    reps = real.join(copies, ["_doc_id", "f1", "f2", "n"], "left_anti")
    reps = reps.dropDuplicates(["_doc_id", "f1", "f2", "n"]) if repeats else reps
    reps = written(reps.select(F.col("_doc_id").alias("rep"), "n", "left", "right", "sketch").repartition(_tasks(spark)), "reps")
    # every pair of keys, with the two places, names a table and a bucket in it
    keys = reps.select("rep", F.posexplode("left").alias("i", "x"), "right").select("rep", "i", "x", F.posexplode("right").alias("j", "y"))
    keys = keys.select("rep", F.xxhash64("i", "x", "j", "y").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("docs")).where("docs > 1")
    buckets = written(buckets.select("key", F.ceil(F.col("docs") / BUCKET_DOCS).cast("int").alias("blocks")), "buckets")
    met = written(keys.join(buckets, "key"), "met")
    bins = max(_tasks(spark), math.ceil(met.count() / (8 * BUCKET_DOCS)))
    met = _blocked(met, "key", "rep", bins).select("rep", "key", "side", "g", "g1", "g2").join(reps.select("rep", "sketch"), "rep")
    candidates = met.groupBy("g", "g1", "g2").applyInArrow(_agreeing(least_agreement(percent / 100, 2 * parts * ROWS)), "a long, b long")
    near = written(linked_groups(candidates), "near")

    nodes = reps.select(F.col("rep").alias("node"), "n")
    members = near.join(nodes.groupBy("node").agg(F.sum("n").alias("n")) if repeats else nodes, "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    sizes = written(sizes.withColumn("blocks", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]
    bins = max(_tasks(spark), math.ceil(total / BLOCK_SHINGLES))
    members = members.select(F.col("node").alias("doc"), "component").join(sizes.select("component", "blocks"), "component")
    with_text = written(members.join(base.where("_doc_id is not null"), members["doc"] == base["_doc_id"]).dropDuplicates(["doc", "_text"]).select("doc", "component", "blocks", "_text"), "members")
    # small groups share a task; a large one takes one task for each pair of its blocks
    forest = _blocked(with_text, "component", "doc", bins).select("doc", "component", "_text", "side", "g", "g1", "g2")
    forest = forest.groupBy("g", "g1", "g2").applyInArrow(_forest(k, percent), "a long, b long")
    if repeats:  # a document of several sets links their representatives
        forest = forest.union(of.where("_doc_id <> rep").join(repeated, "_doc_id", "left_semi").select("rep", "_doc_id").distinct())
    groups = written(linked_groups(forest).select(F.col("node").alias("rep"), "component"), "groups")
    ids = of.join(groups, "rep", "left").select("_doc_id", F.coalesce("component", "rep").alias("c"))
    ids = written(ids.groupBy("_doc_id").agg(F.min("c").alias("c")), "ids") if repeats else ids
    out = sig.select("_doc_id", F.col("n").alias("n_shingles")).join(ids.withColumnRenamed("_doc_id", "id"), F.col("_doc_id") == F.col("id"), "left")
    component = F.coalesce("c", "_doc_id")
    return out.select(F.col("_doc_id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("_doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """The rows of docs whose document is the one kept of its component, all columns unchanged.

    Of the rows of one doc_id with equal texts (nulls are equal) one stays, the
    least by the other columns. Rows without a doc_id all stay, and so do
    documents with null or empty texts. An empty table stays empty.
    """
    gone, rest = unique_name(docs, "gone"), unique_name(docs, "rest")
    found = written(near_duplicates(docs, percent, k).select(F.col("doc_id").alias(gone), "kept"), "states")
    kept = docs.join(written(found.where("not kept").select(gone).distinct(), "gone"), docs["doc_id"] == F.col(gone), "left_anti")
    again = found.where(F.col("kept") & F.col(gone).isNotNull()).groupBy(gone).agg(F.count("*").alias("rows")).where("rows > 1").select(gone)
    again = written(again, "again")
    if again.isEmpty():
        return kept
    # only what stands in several rows is grouped
    once = kept.join(again, kept["doc_id"] == F.col(gone), "left_anti")
    several = kept.join(again, kept["doc_id"] == F.col(gone), "left_semi")
    least = several.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])).alias(rest))
    return once.union(least.select(*[F.col(c) if c in ("doc_id", "text") else F.col(rest)[c].alias(c) for c in docs.columns]))


def _tasks(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
