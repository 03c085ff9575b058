"""SimHash near-duplicates by pigeonhole blocks.

A text is lower-cased (A-Z only) and cut into words at ASCII white space; the fingerprint has bit b
set where over half of its word shingles have bit b set in their XXH64. Texts link at two or
fewer differing bits and components of links are groups of near-duplicates.

Edge cases: a null or empty text, or one of white space only, has fingerprint 0 and links like any
other; fewer words than a shingle give one shingle of all words; repeated rows share a fingerprint
and a component; a null id takes part but is never a component's id unless all its ids are null;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.llm.common import bounded, components, cut, join_each, stable

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Texts link at this many differing bits or fewer; the stars in links() hold for two.
MAX_BITS = 2
#: Equal blocks of a fingerprint; a close pair agrees on all but MAX_BITS of them.
N_BLOCKS = 4
#: Shingles whose bits are counted at once.
CHUNK = 1 << 14


def signed(x: int) -> int:
    """The long with the bits of an unsigned 64-bit number."""
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    parts = (text or b"").translate(LOWER).split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles = iter([b" ".join(parts)])
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    n = max(1, len(parts) - words + 1)
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(s, SEED) for s in shingles), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, carry: str | None = None) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long. carry: a long column that goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), words) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *batch.columns[1:]], names=["fp", *batch.schema.names[1:]])

    own = [F.col(id_col).cast("long").alias("doc_id"), *([F.col(carry).cast("long").alias(carry)] if carry else [])]
    rows = bounded(docs).select(F.col(text_col).cast("string").alias("text"), *own)
    return rows.mapInArrow(run, "fp long, doc_id long" + (f", {carry} long" if carry else ""))


def links(nodes: DataFrame, hot: int = 64) -> DataFrame:
    """Edges (src, dst) whose components are those of all pairs of ``fp`` at ``MAX_BITS`` or fewer differing bits.

    Close pairs agree on N_BLOCKS - MAX_BITS whole blocks, so they share one of the block
    combinations as a key. Groups of up to ``hot`` fingerprints are joined on the key and each pair is
    verified. In larger groups pairs would grow with the square of the group, so there each
    fingerprint goes to itself and all its one-bit neighbours instead: two fingerprints differ by at
    most two bits if and only if they meet at one of these, and a star over each meeting point joins
    what all of its pairs would join.
    """
    width = 64 // N_BLOCKS
    masks = []
    for chosen in combinations(range(N_BLOCKS), N_BLOCKS - MAX_BITS):
        mask = sum(((1 << width) - 1) << (width * b) for b in chosen)
        masks.append(signed(mask))
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for k, m in enumerate(masks)])
    keyed = cut(nodes.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", "key.block"))
    sizes = keyed.groupBy("k", "block").agg(F.count("*").alias("n")).where("n > 1")
    grouped = cut(join_each(keyed, sizes, ["k", "block"]))
    cold = grouped.where(F.col("n") <= hot).select("k", "block", "fp")
    pairs = (
        cold.withColumnRenamed("fp", "src")
        .join(cold.withColumnRenamed("fp", "dst"), ["k", "block"])
        .where((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MAX_BITS))
        .select("src", "dst")
    )
    flips = F.array(*[F.lit(f) for f in [0, *(signed(1 << b) for b in range(64))]])
    near = (
        grouped.where(F.col("n") > hot)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("centre"))
    )
    least = near.groupBy("centre").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1").select("centre", "dst")
    stars = near.join(least, "centre").where("fp <> dst").select(F.col("fp").alias("src"), "dst")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, carry: str | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``, and the long column ``carry`` if one is named.

    Copies meet in one fingerprint before any link is sought, links are sought among distinct
    fingerprints only, and only fingerprints with a link enter the component rounds.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words, carry))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(nodes.select("fp")))
    named = cut(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return (
        join_each(rows, join_each(named, least, ["label"]).select("fp", "component_id"), ["fp"])
        .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *([carry] if carry else []))
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group of near-duplicates, one for each group.

    Null ids come last and rows of the same id in the order of the table.
    """
    columns = docs.columns
    number = stable(docs).withColumn("row number of a document", F.monotonically_increasing_id())
    rows = number.select(F.col("row number of a document").alias("doc_id"), F.col(f"`{id_col}`").cast("long").alias("own"), F.col(f"`{text_col}`").alias("text"))
    groups = cut(near_duplicates(rows, words=words, carry="own"))
    first = F.min(F.struct(F.col("own").isNull().alias("none"), F.col("own").alias("own"), F.col("doc_id").alias("row")))
    kept = groups.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("row number of a document"))
    return number.join(kept, "row number of a document", "left_semi").select(*[F.col(f"`{c}`") for c in columns])
