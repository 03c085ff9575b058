"""Near-duplicate embeddings by spherical-cap filters.

Filters are directions of a random product code: a random rotation, then ``BLOCKS`` blocks with some
random unit directions each; a filter is one direction per block, and a vector's product with it is the sum
over blocks. There are as many filters as put about ``PER_FILTER`` classes of the largest label under each.
List decoding walks the blocks' products from the largest down and stops where no sum can reach the bound, so
it visits the filters that a vector exceeds and few others.

Equal vectors of a label meet in one class first. A class is stored under its best filter, with product M,
and probes every filter whose product is at least

    cos M - sin * min(sqrt(1 - M^2), certainty / sqrt(d)),

where cos is the threshold. Of a pair, the class with the larger M is found by the other: the other's product
with that filter is cos M + sin z or more, z being the product of the filter with a unit vector orthogonal to
the first, which the rotation makes as good as normal with deviation 1/sqrt(d). At ``certainty`` 5 a pair at the
threshold is missed with a probability below 3e-7, closer pairs with less; at infinity the bound is a
proof. Each pair is verified in double precision, at one place only.

Filters that store nothing drop their probes. Large groups are dealt into chunks of both sides, so that no
task holds more than a chunk of each; within a chunk pairs stay a matrix, of which link counts and a tree
per group leave, not the pairs.

Vectors are scaled by their largest component before they are squared, so that finite ones of any size are compared.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link
with nothing; vectors of different lengths do not link; a repeated id is a vector of its own; a null id
has the smallest id it reaches, or null, as its component and is not kept; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.llm.common import components, cut, join_each

BLOCKS, SEED = 2, 7
PER_FILTER, LEAST_WORDS = 64, 8
#: Rows of either side that one group holds at most, about.
CHUNK = 1024


def words_for(classes: int) -> int:
    """Directions in each block for that many classes of one label."""
    return max(LEAST_WORDS, math.ceil((classes / PER_FILTER) ** (1 / BLOCKS)))


@lru_cache(8)
def code(d: int, n_words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation and the blocks' directions for vectors of d components, scaled so that a filter has length 1."""
    r = np.random.default_rng([SEED, d, n_words])
    rotation, _ = np.linalg.qr(r.standard_normal((d, d)))
    words = []
    for part in np.array_split(np.arange(d), min(BLOCKS, d)):
        w = r.standard_normal((n_words, len(part)))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(min(BLOCKS, d)))
    return rotation, words


def decode(products: list[np.ndarray], least: float) -> list[int]:
    """The filters whose blocks' products add up to ``least`` or more."""
    n_words = len(products[0])
    order = [np.argsort(-p) for p in products]
    tails = np.cumsum([p.max() for p in products][::-1])[::-1].tolist() + [0.0]
    found: list[int] = []

    def go(block: int, total: float, number: int) -> None:
        if block == len(products):
            found.append(number)
            return
        for w in order[block]:
            reached = total + float(products[block][w])
            if reached + tails[block + 1] < least:
                break
            go(block + 1, reached, number * n_words + int(w))

    go(0, 0.0, 0)
    return found


def filters(unit: np.ndarray, n_words: int, cos: float, certainty: float) -> Iterator[tuple[float, int, list[int]]]:
    """For each row: its largest product, the filter that has it, and the filters that it probes."""
    d = unit.shape[1]
    rotation, words = code(d, n_words)
    turned = unit @ rotation
    parts = np.array_split(np.arange(d), len(words))
    by_block = [turned[:, p] @ w.T for p, w in zip(parts, words, strict=True)]
    sin = math.sqrt(1 - cos * cos)
    for k in range(len(unit)):
        products = [b[k] for b in by_block]
        best, number = 0.0, 0
        for p in products:
            w = int(np.argmax(p))
            best, number = best + float(p[w]), number * n_words + w
        slack = min(math.sqrt(max(0.0, 1 - best * best)), certainty / math.sqrt(d))
        yield best, number, decode(products, cos * best - sin * slack - 1e-9)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def placed(classes: DataFrame, n_words: int, cos: float, certainty: float) -> DataFrame:
    """A row per class and filter: stored (1) under its best filter, probing (0) the others and that one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            rows: list[tuple] = []
            by_length: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by_length.setdefault(len(v), []).append(k)
            for d, at in by_length.items():
                unit = units(np.array([vectors[k] for k in at], dtype=np.float64))
                for k, (best, own, probed) in zip(at, filters(unit, n_words, cos, certainty), strict=True):
                    rows.append((k, d, own, 1, best))
                    rows += [(k, d, f, 0, best) for f in probed]
            for begin in range(0, len(rows), 1 << 16):
                k, d, f, side, best = zip(*rows[begin : begin + (1 << 16)], strict=True)
                pick = pa.array(k, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(2).take(pick), pa.array(d, pa.int32()), pa.array(f, pa.int64()), pa.array(side, pa.int8()), pa.array(best, pa.float64())],
                    names=["class", "label", "d", "filter", "side", "best"],
                )

    return classes.select("class", "vector", "label").mapInArrow(run, "class long, label string, d int, filter long, side byte, best double")


def packed(classes: DataFrame) -> DataFrame:
    """(class, n, packed): the vectors of classes as bytes."""
    stored = packed_type(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array(v, dtype=stored).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(data, pa.binary())], names=["class", "n", "packed"])

    return classes.select("class", "n", "vector").mapInArrow(run, "class long, n long, packed binary")


def packed_type(classes: DataFrame) -> str:
    return "<f4" if classes.schema["vector"].dataType.elementType.typeName() == "float" else "<f8"


KEY = ["label", "d", "filter"]


def compared(rows: DataFrame, vectors: DataFrame, stored_as: str, cos: float) -> DataFrame:
    """(class, root, links): what each group of stored and probing classes adds to a class's links, and a class it is joined to.

    rows: placed(), kept; vectors: packed(). Vectors join what is left when filters that decide nothing are gone.
    """
    sizes = rows.groupBy(*KEY).agg(F.sum("side").alias("stored"), F.sum(F.lit(1) - F.col("side")).alias("probing")).where("stored > 0 and probing > 1")
    sizes = sizes.select(*KEY, F.ceil(F.col("stored") / CHUNK).cast("int").alias("s"), F.ceil(F.col("probing") / CHUNK).cast("int").alias("p"))
    dealt = join_each(rows, sizes, KEY)
    own = F.pmod(F.xxhash64("class"), F.when(F.col("side") == 1, F.col("s")).otherwise(F.col("p"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 1, F.col("p")).otherwise(F.col("s")) - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    row, column = F.when(F.col("side") == 1, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 1, F.col("other")).otherwise(F.col("own"))
    dealt = dealt.withColumns({"i": row, "j": column}).select(*KEY, "i", "j", "side", "class", "best")
    dealt = dealt.join(vectors, "class").select(*KEY, "i", "j", "side", "class", "n", "best", "packed")
    group = [*KEY, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            begin = 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[begin]:
                    continue
                if held and keys[begin] != current:
                    yield block(held)
                    held = []
                current = keys[begin]
                held.append(batch.slice(begin, k - begin))
                begin = k
        if held:
            yield block(held)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        side, number, n, best = (t.column(c).to_numpy() for c in ("side", "class", "n", "best"))
        unit = np.frombuffer(b"".join(t.column("packed").to_pylist()), dtype=stored_as).reshape(len(side), -1)
        unit = units(unit.astype(np.float64))
        stored, probing = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        near = unit[stored] @ unit[probing].T >= cos
        # a pair counts where the class with the larger product is stored; equal products go by number
        above = best[stored][:, None] > best[probing][None]
        even = (best[stored][:, None] == best[probing][None]) & (number[stored][:, None] > number[probing][None])
        near &= above | even
        links = np.zeros(len(side), dtype=np.int64)
        links[stored] = near @ n[probing]
        links[probing] = n[stored] @ near
        # smallest number reached within the block, for both sides
        reach_s, reach_p = number[stored].copy(), number[probing].copy()
        top = np.iinfo(np.int64).max
        while near.any():
            lower_s = np.minimum(reach_s, np.where(near, reach_p[None], top).min(axis=1))
            lower_p = np.minimum(reach_p, np.where(near, lower_s[:, None], top).min(axis=0))
            if (lower_s == reach_s).all() and (lower_p == reach_p).all():
                break
            reach_s, reach_p = lower_s, lower_p
        root = number.copy()
        root[stored], root[probing] = reach_s, reach_p
        keep = pa.array(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(number), pa.array(root), pa.array(links)], names=["class", "root", "links"]).filter(keep)

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "class long, root long, links long")


def near_duplicates(vectors: DataFrame, cos: float = 0.98, certainty: float = 5.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``."""
    v = F.col("vector")
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.col(label_col).cast("string").alias("label"), F.monotonically_increasing_id().alias("row"))
    # equal vectors are told by two hashes, so that vectors need not travel to be compared with their copies
    rows = cut(rows.withColumns({"key": F.xxhash64("label", "vector"), "key_2": F.xxhash64(F.lit("second"), "vector", "label")}))
    fit = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = rows.where(F.coalesce(fit, F.lit(False)))
    keys = ["key", "key_2"]
    classes = cut(usable.groupBy(*keys).agg(F.min_by(F.struct("label", "vector"), "row").alias("one"), F.min("row").alias("class"), F.min("vec_id").alias("first"), F.count("*").alias("n")).select(*keys, "one.label", "one.vector", "class", "first", "n"))
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    found = cut(compared(cut(placed(classes, words_for(most), cos, certainty)), packed(classes), packed_type(classes), cos))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("class").alias("src"), F.col("root").alias("dst")))
    named = classes.select("class", *keys, "first", "n").join(links, "class", "left").join(labels.withColumnsRenamed({"node": "class", "label": "component"}), "class", "left")
    named = cut(named.withColumn("component", F.coalesce("component", "class")))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    told = join_each(named, least, ["component"]).select(*keys, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = join_each(cut(usable.select("vec_id", *keys)), told, keys).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
u as (
  select * from v where label is not null and e is not null
    and list_bool_and(list_transform(e, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(e, lambda x: x <> 0))),
links as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
reach as (select a as node, b as other from links union select r.node, l.b from reach r join links l on r.other = l.a),
counted as (select a as vec_id, count(*) as n_links from links group by a),
least as (select node as vec_id, min(other) as low from reach group by node)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, least(v.vec_id, coalesce(low, v.vec_id)) as component_id,
  v.vec_id = least(v.vec_id, coalesce(low, v.vec_id)) as kept
from v left join counted using (vec_id) left join least using (vec_id)
"""
