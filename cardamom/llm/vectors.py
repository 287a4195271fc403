"""Near-duplicate vectors by binary codes of a random rotation.

A vector is normed, rotated by a fixed random rotation and reduced to the signs
of its coordinates, with two stored numbers: how far the signs' direction o is
from the vector x (c = <o, x>), and from it the spread of what is estimated. For
two vectors, <o, y> / c estimates <x, y> without bias; its error is bounded by
sqrt((1 - c*c) / (c*c * (D - 1))) times WIDTH with overwhelming probability.
Pairs whose upper bound is under the threshold are dismissed; all others are
recomputed in double precision, which alone decides.

Which pairs are looked at: vectors meet in buckets of some signs of rotated
coordinates, in as many tables as the miss rate needs. The number of signs
follows from the size of the largest label, so that buckets do not grow with the
table. Equal vectors are merged first. Codes, corrections, norms and buckets are
stored once per vector. Each bucket is looked through on codes alone; vectors
are fetched only for those with an undecided pair that meets in no earlier table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardamom.llm.common import linked_groups, written

#: Signs in a bucket's key at least and at most, and the chance that a pair at the threshold meets in no table.
LEAST_BITS, MOST_BITS, MISS = 10, 30, 1e-4
#: Standard errors of the bound: the chance that it dismisses a linked pair is below 1e-8.
WIDTH = 6.0
#: Vectors in a block, and numbers of all vectors of small buckets that share a task.
BLOCK, TASK_NUMBERS = 1024, 1 << 20


def bits_for(vectors: int) -> int:
    """Signs that leave about one of so many unrelated vectors in a bucket."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(vectors, 1)))))


def tables_for(cosine: float, bits: int, miss: float = MISS) -> int:
    """Two vectors at this cosine differ in a sign with probability angle / pi."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def signs(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The bucket of each normed vector in each table: signs along random directions, as many rotations as are needed."""
    dim, out, taken, seed = x.shape[1], np.zeros((len(x), tables), np.int32), 0, 0
    have = np.zeros((len(x), 0), bool)
    while taken < tables:
        while have.shape[1] < bits:
            have = np.concatenate([have, x @ rotation(dim, 1000 + seed).T > 0], axis=1)
            seed += 1
        out[:, taken] = have[:, :bits] @ (1 << np.arange(bits))
        have, taken = have[:, bits:], taken + 1
    return out


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated vectors, signs as -1 and 1, correction c) of normed vectors."""
    y = x @ rotation(x.shape[1], 1).T
    o = np.where(y > 0, 1.0, -1.0)
    return y, o, np.abs(y).sum(axis=1) / math.sqrt(x.shape[1])


def upper_bounds(o: np.ndarray, c: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For coded vectors against rotated ones: the most their cosine can be, with WIDTH standard errors."""
    dim = y.shape[1]
    estimate = (o @ y.T) / math.sqrt(dim) / c[:, None]
    error = WIDTH * np.sqrt(np.maximum(1 - c * c, 0) / (c * c) / max(dim - 1, 1))
    return estimate + error[:, None]


def _normed(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _stacked(column: pa.ChunkedArray, kind) -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(rows)], pa.binary())


_STORED = "rep long, dim int, code binary, correction double, near binary, scale double, buckets binary"


def _stored(tables: int, bits: int):
    """Of each vector, once: packed signs, correction, the rotated vector in steps of scale, and its bucket in every table."""
    schema = pa.schema([("rep", pa.int64()), ("dim", pa.int32()), ("code", pa.binary()), ("correction", pa.float64()), ("near", pa.binary()), ("scale", pa.float64()), ("buckets", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _normed(_matrix(batch.column("embedding").take(pa.array(at))))
                y, o, c = codes(x)
                scale = np.abs(y).max(axis=1) / 127
                steps = np.rint(y / scale[:, None]).astype(np.int8)
                columns = [pa.array(batch.column("rep").to_numpy()[at]), pa.array(dims[at]), _binary(np.packbits(o > 0, axis=1)), pa.array(c), _binary(steps), pa.array(scale), _binary(signs(x, tables, bits).astype("<i4"))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _first_here(of: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
    """Whether pairs that meet in this table meet in none before."""
    first = np.zeros(len(i), bool)
    for s in range(0, len(i), 65536):
        first[s : s + 65536] = (of[i[s : s + 65536]] == of[j[s : s + 65536]]).argmax(axis=1) == table
    return first


def _pairs(bucket: np.ndarray, side: np.ndarray, reps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, left, right) of each bucket: all of its rows against each other, or one block against the other."""
    order = np.lexsort((reps, bucket))
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(own) > 1:
            parts = [own[side[own] == s] for s in np.unique(side[own])]
            yield (own, parts[0], parts[1]) if len(parts) == 2 else (own, own, own)


def _undecided(cosine: float):
    """Of the blocks of a group, on codes alone: the vectors with a pair that the bound does not dismiss, first met here."""
    schema = pa.schema([("rep", pa.int64()), ("t", pa.int32()), ("bucket", pa.int64()), ("side", pa.int32()), ("g", pa.int64()), ("g1", pa.int32()), ("g2", pa.int32())])

    def run(t: pa.Table) -> pa.Table:
        reps, side, table, bucket, scale, c = (t.column(x).to_numpy() for x in ("rep", "side", "t", "bucket", "scale", "correction"))
        y = _stacked(t.column("near"), np.int8) * scale[:, None]
        dim = y.shape[1]
        o = np.where(np.unpackbits(_stacked(t.column("code"), np.uint8), axis=1, count=dim) > 0, 1.0, -1.0)
        of = _stacked(t.column("buckets"), "<i4")
        # each coordinate is off by half a step at most
        rounding = scale * math.sqrt(dim) / 2
        wanted = np.zeros(len(reps), bool)
        for own, left, right in _pairs(bucket, side, reps):
            maybe = upper_bounds(o[left], c[left], y[right]) + rounding[right][None, :] / c[left][:, None] >= cosine - 1e-9
            if left is right:
                maybe &= np.arange(len(own))[:, None] < np.arange(len(own))[None, :]
            i, j = np.nonzero(maybe)
            i, j = left[i], right[j]
            first = _first_here(of, i, j, table[own[0]])
            wanted[i[first]] = True
            wanted[j[first]] = True
        return t.select(schema.names).filter(pa.array(wanted)).cast(schema)

    return run


def _links(cosine: float):
    """Of the undecided vectors of a group, in double precision: weighted link counts and a spanning forest of the links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        reps, weight, side, table, bucket = (t.column(c).to_numpy() for c in ("rep", "copies", "side", "t", "bucket"))
        x = _matrix(t.column("embedding").combine_chunks())
        norm = np.sqrt((x * x).sum(axis=1))
        unit = x / norm[:, None]
        of = _stacked(t.column("buckets"), "<i4")
        rows: list[tuple[int, int, int]] = []
        for own, left, right in _pairs(bucket, side, reps):
            maybe = unit[left] @ unit[right].T >= cosine - 1e-6
            if left is right:
                maybe &= np.arange(len(own))[:, None] < np.arange(len(own))[None, :]
            i, j = np.nonzero(maybe)
            i, j = left[i], right[j]
            near = np.zeros(len(i), bool)
            for s in range(0, len(i), 65536):
                a, b = i[s : s + 65536], j[s : s + 65536]
                near[s : s + 65536] = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b]) >= cosine
            i, j = i[near], j[near]
            first = _first_here(of, i, j, table[own[0]])
            i, j = i[first], j[first]
            n = np.bincount(np.concatenate([i, j]), np.concatenate([weight[j], weight[i]]), minlength=len(reps)).astype(np.int64)
            label = {k: k for k in own.tolist()}

            def root(k: int, label=label) -> int:
                while label[k] != k:
                    label[k] = label[label[k]]
                    k = label[k]
                return k

            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                p, q = root(a), root(b)
                if p != q:
                    label[max(p, q)] = min(p, q)
                    rows.append((reps[a], reps[b], 0))
            rows += [(reps[k], reps[k], n[k]) for k in np.flatnonzero(n)]
        a, b, n = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, bits: int | None = None, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Vectors are compared only with those of the same label and length. Those
    with a null label, null, zero, empty, or with null or non-finite components
    link with nothing; neither do rows without a vec_id, whose component_id is
    null and which are kept. Rows that repeat a vec_id are vectors of their own
    with one id: they are linked if near, and a row is returned for each.
    Pairs at the threshold are found with probability 1 - miss or more, nearer
    ones with more; none below the threshold is linked. bits: signs in a
    bucket's key; unless given, they follow from the largest label.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))
    keyed = base.withColumn("f", F.when(usable, F.xxhash64("label", F.transform("embedding", lambda v: v + 0.0)))).withColumn("row", F.monotonically_increasing_id())
    keyed = written(keyed, "vectors")
    real = keyed.where("f is not null")
    reps = real.groupBy("f", "label", "embedding").agg(F.min("vec_id").alias("first"), F.min("row").alias("rep"), F.count("*").alias("copies"))
    reps = written(reps.withColumn("dim", F.size("embedding")), "reps")
    kinds = reps.select("rep", "first", "label", "dim", "copies")

    most = kinds.groupBy("label", "dim").count().agg(F.max("count").alias("n"), F.max("dim").alias("dim")).first()
    bits = bits or bits_for(most["n"] or 0)
    tables = tables_for(cosine, bits, miss)
    stored = written(reps.select("rep", "dim", "embedding").mapInArrow(_stored(tables, bits), _STORED), "codes")
    at = stored.select("rep", "buckets", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t"))
    at = at.select("rep", "t", F.substr("buckets", F.col("t") * 4 + 1, F.lit(4)).alias("code"))  # four bytes a table
    met = at.join(kinds.select("rep", "label", "dim"), "rep").select("rep", "t", F.xxhash64("label", "dim", "t", "code").alias("bucket"))
    met = written(met, "met")
    sizes = met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * (most["dim"] or 0) / TASK_NUMBERS))
    task = met.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    one = F.col("blocks") == 1
    task = task.withColumn("other", F.explode(F.when(one, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    task = task.select(
        "rep", "t", "bucket", F.col("block").alias("side"),
        F.when(one, F.pmod(F.col("bucket"), F.lit(bins))).otherwise(F.col("bucket")).alias("g"),
        F.when(one, -1).otherwise(F.least("block", "other")).alias("g1"),
        F.when(one, -1).otherwise(F.greatest("block", "other")).alias("g2"),
    )
    # one length of vectors in a group; small buckets of all tables share
    task = task.join(stored, "rep").groupBy("dim", "g", "g1", "g2")
    kind = "rep long, t int, bucket long, side int, g long, g1 int, g2 int"
    open_ = written(task.applyInArrow(_undecided(cosine), kind), "undecided")
    exact = open_.join(reps.select("rep", "embedding", "copies", "dim"), "rep").join(stored.select("rep", "buckets"), "rep")
    found = written(exact.groupBy("dim", "g", "g1", "g2").applyInArrow(_links(cosine), "a long, b long, n long"), "links")

    near = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("near"))
    # rows become ids before the groups are made, so that an id in several rows is one node
    firsts = reps.select("rep", "first")
    ends = found.where("a <> b").join(firsts.select(F.col("rep").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("rep").alias("b"), F.col("first").alias("y")), "b")
    copies = real.join(reps.where("copies > 1").select("f", "label", "embedding", "first"), ["f", "label", "embedding"]).select(F.col("vec_id").alias("a"), F.col("first").alias("b"))
    groups = linked_groups(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).union(copies))
    per_rep = written(kinds.join(near, "rep", "left").select("first", F.col("rep"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")), "counts")
    of = real.join(reps.select("f", "label", "embedding", "rep"), ["f", "label", "embedding"]).select("row", "rep")
    out = keyed.select("vec_id", "row").join(of, "row", "left").join(per_rep.select("rep", "n_links"), "rep", "left")
    out = out.join(written(groups, "groups"), F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
