"""Near-duplicates by the real similarity of their word shingles, found by SimHash and then by prefix filtering.

A text is lower-cased (A-Z only) and cut into words at ASCII white space, as in ``simhash``. Two texts
link if the Jaccard similarity of their sets of word shingles is LEAST or more; components of links are
groups of near-duplicates. Texts that ``simhash.near_duplicates`` puts into one component are compared first, with
their whole sets, and those that are similar need no further comparison with each other. Fingerprints of texts of a
similarity of 0.8 differ in more bits than blocks can find, so the rest is found by prefixes. No link is missed: sets of similarity LEAST share a shingle among the first
n - ceil(LEAST n) + 1 of their n shingles in any fixed order, so only texts that meet at one of these
are compared, with their whole sets, and of these only pairs whose remaining shingles can still reach the
overlap. The order puts rare shingles first, by counts over all texts, which keeps what many texts have
in common out of the comparisons.

Edge cases: null and empty texts, or those of white space only, are copies of each other; fewer words than
a shingle give one shingle of all words. Shingles, and sets as wholes, are compared by their XXH64.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopyspark.llm import simhash
from canopyspark.llm.common import bounded, components, cut, hot_keys, join_each, stable
from canopyspark.llm.simhash import LOWER, SEED

WORDS = 5
#: Least similarity of a link, as numerator and denominator.
LEAST = (4, 5)
ROW = "row number of a document"
#: Counters of shingles by hash, and how many of them travel together.
BUCKETS, PART, SALTS = 1 << 22, 1 << 16, 4
#: Rows of a bitmap of Spark's bitmap functions.
SPAN = 1 << 15
#: Bitmaps that go to every task at most: 16 MB.
MOST_BITMAPS = 1 << 12


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a UTF-8 text, hashed and sorted."""
    parts = (text or b"").translate(LOWER).split()
    if not parts:
        return np.zeros(0, dtype=np.int64)
    if len(parts) < words:
        found = [b" ".join(parts)]
    else:
        found = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(s, SEED) for s in found), dtype=np.uint64).view(np.int64))


def whole(found: np.ndarray) -> int:
    """The signed hash of a set of shingles."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def prefix(found: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a similar set must share one of, in their order: how often their bucket occurs, then their hash.

    often: what table() returns.
    """
    length = len(found) - -(-LEAST[0] * len(found) // LEAST[1]) + 1 if len(found) else 0
    return found[np.lexsort((found, often[found & (len(often) - 1)]))[:length]], np.arange(length, dtype=np.int32)


def table(counted: DataFrame) -> np.ndarray:
    """How often shingles fall into each of BUCKETS, in steps of a 64th of a doubling, from (part, salt, counts) rows.

    Each task has counted into a table of fixed size and sends it in compressed parts, which are added up as they
    arrive. The size of the table does not depend on the input, and any table is right: it only orders shingles.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                own = np.frombuffer(zlib.decompress(counts.as_py()), dtype=np.uint32)
                sums[k] = sums[k] + own if k in sums else own.astype(np.uint64)
        for k, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(own, 1)], pa.binary())], names=["part", "counts"])

    told = counted.repartition("part", "salt").mapInArrow(add, "part int, counts binary").toArrow()
    total = np.zeros(BUCKETS, dtype=np.uint64)
    for k, counts in zip(told.column("part").to_pylist(), told.column("counts").to_pylist(), strict=True):
        total[k * PART : (k + 1) * PART] += np.frombuffer(zlib.decompress(counts), dtype=np.uint64)
    order = np.empty(BUCKETS, dtype=np.uint16)
    for at in range(0, BUCKETS, PART):  # in parts, so that the driver holds no table of floats
        order[at : at + PART] = np.rint(64 * np.log2(total[at : at + PART] + 1.0))
    return order


def bits(rows: DataFrame) -> DataFrame:
    """(at, bits): the numbers in the column ``row`` as bitmaps, by the number's multiple of their length."""
    return rows.groupBy(F.bitmap_bucket_number("row").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits"))


def among(numbers: np.ndarray, held: dict[int, bytes]) -> np.ndarray:
    """Which row numbers are in bits(); the first is 1, as Spark counts them."""
    out = np.zeros(len(numbers), dtype=bool)
    bucket = (numbers - 1) // SPAN + 1
    for k in np.unique(bucket):
        if int(k) in held:
            own = bucket == k
            at = (numbers[own] - 1) % SPAN
            out[own] = np.frombuffer(held[int(k)], dtype=np.uint8)[at >> 3] >> (at & 7) & 1
    return out


def only(rows: DataFrame, name: str, wanted: DataFrame, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, most: int | None = None) -> DataFrame:
    """``then`` over those ``rows`` whose number, in the column ``name``, is in the column ``row`` of ``wanted``.

    Up to ``most`` bitmaps (MOST_BITMAPS if not given), of 4 KB each, go to every task, and no text is shuffled; where the
    numbers need more, the rows are joined with them.
    """
    held = cut(bits(wanted))
    if held.count() > (MOST_BITMAPS if most is None else most):
        return rows.join(wanted.select(F.col("row").alias(name)), name, "left_semi").select(*[F.col(f"`{c}`") for c in rows.columns]).mapInArrow(then, schema)
    told = held.toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(dict(zip(told.column("at").to_pylist(), told.column("bits").to_pylist(), strict=True)))
    at = rows.columns.index(name)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(among(batch.column(at).to_numpy(), shared.value)))

    return rows.mapInArrow(lambda batches: then(kept(batches)), schema)


def fits(a: Column, b: Column) -> Column:
    """Sets of these sizes can reach LEAST."""
    return F.least(a, b) * LEAST[1] >= F.greatest(a, b) * LEAST[0]


def parity(found: np.ndarray) -> np.ndarray:
    """Bit k of 4,096 tells if an odd number of shingles have k in their last bits; sets that differ in d shingles differ in d bits at most."""
    odd = np.bincount(found & 4095, minlength=4096) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (src, dst) whose sets (node, parity, found) are similar; whole sets travel only where the parities allow it."""
    top, below = LEAST[1] + LEAST[0], LEAST[1] - LEAST[0]

    def told(pairs: DataFrame, of: list[tuple[str, Column]]) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(end), *[c.alias(f"{end}_{n}") for n, c in of]) for end in ("src", "dst"))
        return join_each(join_each(pairs, a, ["src"], by=["dst"]), b, ["dst"], hot_keys(pairs, ["dst"]), by=["src"])

    apart = F.aggregate(F.zip_with("src_parity", "dst_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = told(pairs, [("parity", F.col("parity")), ("size", F.size("found"))])
    near = cut(near.where(apart * top <= (F.col("src_size") + F.col("dst_size")) * below).select("src", "dst"))
    both = F.size(F.array_intersect("src_found", "dst_found"))
    every = F.size("src_found") + F.size("dst_found") - both
    return told(near, [("found", F.col("found"))]).where(both * LEAST[1] >= every * LEAST[0]).select("src", "dst")


def release(spark: SparkSession) -> None:
    """Delete the shuffle files and checkpoints that nothing refers to any more: Spark does so when the driver collects its garbage, which a driver with memory to spare puts off until disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def close(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, head): nodes that SimHash puts into one component, each with the component's first; whether they are similar is not known yet.

    SimHash gets copies too: a node's row is the first of its copies, so it is that of a component. Leaving them out
    would take a Python worker before SimHash's own in each task, and executors keep every worker.
    """
    texts = rows.select(F.col("row").alias("doc_id"), "text")
    found = cut(simhash.near_duplicates(texts).where("doc_id <> component_id").select(F.col("doc_id").alias("row"), "component_id"))
    named = cut(found.join(nodes, "row").select("node", "component_id"))
    return cut(join_each(named, nodes.select(F.col("row").alias("component_id"), F.col("node").alias("head")), ["component_id"]).select("node", "head"))


def meet(a: str, b: str) -> Column:
    """A pair can be similar if this shingle is the first that both have: what is left of either set from its place on must reach the overlap."""
    left = F.least(F.col(f"{a}_size") - F.col(f"{a}_place"), F.col(f"{b}_size") - F.col(f"{b}_place"))
    return left * (LEAST[0] + LEAST[1]) >= (F.col(f"{a}_size") + F.col(f"{b}_size")) * LEAST[0]


def links(rows: DataFrame, nodes: DataFrame, order: np.ndarray, words: int = WORDS, hot: int = 64) -> DataFrame:
    """Edges (src, dst) whose components are those of all similar pairs of nodes.

    rows: (row, text); nodes: (node, row), one row of ``rows`` for each distinct set; order: what table() returns. Nodes that close()
    joins are compared first, and others only if no link joins them by that. In groups of more than
    ``hot`` nodes at one shingle all are compared with one of them first, and then only those that are not in
    one component yet. A pair is compared only where the places of a shingle they share leave room for the
    overlap; at the first one they share, a similar pair's do.
    """
    spark = rows.sparkSession
    often = spark.sparkContext.broadcast(order)  # of fixed size

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1).cast(pa.binary()):
                found = shingles(text.as_py(), words)
                first, place = prefix(found, often.value)
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(np.full(len(first), whole(found))), pa.array(np.full(len(first), len(found), dtype=np.int32)), pa.array(place)], names=["token", "node", "size", "place"])

    # one row for each distinct set, so copies need no further look; a shingle that many have is counted where it stands
    keyed = cut(only(rows, "row", nodes.select("row"), begin, "token long, node long, size int, place int"))
    grouped = cut(join_each(keyed, keyed.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), ["token"]))
    del keyed
    release(spark)

    def pairs(members: DataFrame, extra: list[str]) -> DataFrame:
        a, b = (members.select("token", *[F.col(c).alias(f"{end}_{c}") for c in ("node", "size", "place", *extra)]) for end in ("src", "dst"))
        wanted = (F.col("src_node") < F.col("dst_node")) & fits(F.col("src_size"), F.col("dst_size")) & meet("src", "dst")
        for c in extra:
            wanted &= F.col(f"src_{c}") != F.col(f"dst_{c}")
        return a.join(b, "token").where(wanted).select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst")).distinct()

    def verified(wanted: DataFrame) -> DataFrame:
        wanted = cut(wanted)
        ids = wanted.select(F.col("src").alias("node")).union(wanted.select("dst")).distinct()

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text in batch.column(1).cast(pa.binary()):
                    found = shingles(text.as_py(), words)
                    lists = [pa.ListArray.from_arrays([0, len(x)], pa.array(x)) for x in (parity(found), found)]
                    yield pa.RecordBatch.from_arrays([pa.array([whole(found)], pa.int64()), *lists], names=["node", "parity", "found"])

        chosen = nodes.join(ids, "node", "left_semi").select("row")
        kept = cut(only(rows, "row", chosen, sets, "node long, parity array<long>, found array<long>"))
        return cut(similar(wanted, kept))

    near = close(rows, nodes).withColumns({"src": F.least("node", "head"), "dst": F.greatest("node", "head")})
    linked = verified(near.select("src", "dst"))
    group = cut(near.join(linked, ["src", "dst"], "left_semi").select("node", F.col("head").alias("group")))
    release(spark)

    def unlinked(wanted: DataFrame) -> DataFrame:
        of = {end: group.select(F.col("node").alias(end), F.col("group").alias(f"{end}_group")) for end in ("src", "dst")}
        both = wanted.join(of["src"], "src", "left").join(of["dst"], "dst", "left")
        return both.where(F.coalesce("src_group", "src") != F.coalesce("dst_group", "dst")).select("src", "dst")

    large = cut(grouped.where(F.col("n") > hot))
    # first the one with most large groups, whose shingles are not its own
    often_in = large.groupBy("node").agg((-F.count("*")).alias("often"))
    leaders = large.join(often_in, "node").groupBy("token").agg(F.min(F.struct("often", "node", "size", "place")).alias("leader"))
    stars = join_each(large, leaders.select("token", *[F.col(f"leader.{c}").alias(f"leader_{c}") for c in ("node", "size", "place")]), ["token"])
    stars = stars.withColumnsRenamed({"size": "own_size", "place": "own_place"}).where((F.col("node") != F.col("leader_node")) & fits(F.col("own_size"), F.col("leader_size")) & meet("own", "leader"))
    stars = stars.select(F.least("node", "leader_node").alias("src"), F.greatest("node", "leader_node").alias("dst"))
    first = verified(unlinked(pairs(grouped.where(F.col("n") <= hot), []).union(stars).distinct())).union(linked)
    del grouped, stars, leaders, often_in
    release(spark)
    if large.isEmpty():
        return first
    labels = components(first).withColumnRenamed("label", "group")
    release(spark)
    named = cut(large.drop("n").join(labels, "node", "left").withColumn("group", F.coalesce("group", "node")))
    mixed = named.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("token")
    rest = pairs(join_each(named, mixed, ["token"]), ["group"])
    return first.union(verified(rest))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, hot: int = 64) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group of near-duplicates, one for each group.

    Null ids come last and rows of the same id in the order of the table.
    """
    columns = docs.columns
    number = stable(bounded(docs)).withColumn(ROW, F.monotonically_increasing_id() + 1)
    rows = number.select(F.col(ROW).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["row", "own", "node", "part", "salt", "counts"], [pa.int32(), pa.int32(), pa.binary()]
        total, n = np.zeros(BUCKETS, dtype=np.uint32), 0
        for batch in batches:
            ids = []
            for text in batch.column(0).cast(pa.binary()):
                found = shingles(text.as_py(), words)
                np.add.at(total, found & (BUCKETS - 1), 1)
                ids.append(whole(found))
            n += len(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.int64()), *(pa.nulls(len(ids), k) for k in kinds)], names=names)
        for k in range(BUCKETS // PART if n else 0):
            own = total[k * PART : (k + 1) * PART]
            if own.any():
                told = [pa.array([v], x) for v, x in zip((k, zlib.crc32(own) % SALTS, zlib.compress(own, 1)), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), *told], names=names)

    named = number.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(ROW).alias("row"), F.col(f"`{id_col}`").cast("long").alias("own"))
    both = cut(named.mapInArrow(mark, "row long, own long, node long, part int, salt int, counts binary"))
    marked = both.where("part is null").select("row", "own", "node")
    nodes = cut(marked.groupBy("node").agg(F.min("row").alias("row")))
    order = table(both.where("part is not null").select("part", "salt", "counts"))
    release(docs.sparkSession)
    edges = links(rows, nodes, order, words, hot)
    release(docs.sparkSession)
    labels = components(edges)
    first = F.min(F.struct(F.col("own").isNull().alias("none"), F.col("own").alias("own"), F.col("row").alias("row")))
    # the first of each distinct set, and then of each group of sets
    of_set = marked.groupBy("node").agg(first.alias("first"))
    grouped = of_set.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first"))
    kept = grouped.select(F.col("first.row").alias("row"))
    return only(number, ROW, kept, lambda batches: batches, number.schema).select(*[F.col(f"`{c}`") for c in columns])
