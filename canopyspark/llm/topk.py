"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code holds the signs of its components, in words of 64 bits, as many as the longest vector asks for. Codes
are cut into segments of ``WIDTH`` bits, and every distinct code is indexed under each segment's value. Searching all
n segments to radius r finds every code within n * (r + 1) - 1 bits. Each round probes the segment values at exactly one radius more,
verifies the codes found there against the query's k-th distance so far, and retires the queries whose k-th
distance the rounds provably cover. A first round looks up whole codes within one bit, which settles
queries inside large groups of near-equal codes without reading such a group's buckets.

A code keeps its k + 1 smallest ids only: no other can be among the k nearest, whose ties go to the smaller
id, and so a code that a third of all rows share costs no more than any other. Each round's probes are
broadcast if they are few, and joined with a shuffle otherwise.

Edge cases: vectors that are null or empty or hold null or non-finite components
are neither found nor searched for; null ids likewise; a repeated id counts once, with its smallest code; components that shorter vectors lack count as not above zero;
fewer than k other rows give fewer results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyspark.llm.common import cut

#: Bits of a word of a code and of a segment.
WORD, WIDTH = 64, 16
#: Probes of a round that are broadcast at most; each is a few dozen bytes.
BROADCAST_PROBES = 100_000


def sign_word(vector: str, word: int) -> Column:
    """Bit i of a word is 1 where component i of its 64 is above zero; components that a vector lacks are 0."""
    own = f"slice(`{vector}`, {word * WORD + 1}, {WORD})"
    return F.expr(f"aggregate(transform({own}, (x, i) -> case when x > 0 then shiftleft(1L, i) else 0L end), 0L, (a, b) -> a | b)")


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code) for the vectors that can be searched, one row per id; code has as many words as the longest vector asks for."""
    v = F.col(f"`{vector_col}`")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(usable & F.col(f"`{id_col}`").isNotNull())
    words = -(-(rows.agg(F.max(F.size(v)).alias("n")).first().n or 1) // WORD)
    code = F.struct(*[sign_word(vector_col, w).alias(f"w{w}") for w in range(words)])
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), code.alias("code")).groupBy("id").agg(F.min("code").alias("code"))


def words_of(rows: DataFrame) -> list[str]:
    return rows.schema["code"].dataType.names


def apart(a: Column, b: Column, words: list[str]) -> Column:
    """Hamming distance of two codes."""
    found = F.lit(0)
    for w in words:
        found = found + F.bit_count(a[w].bitwiseXOR(b[w]))
    return found


def flips(of: DataFrame, width: int, radius: int) -> DataFrame:
    """``of`` once per mask of ``radius`` bits among ``width``, in the column mask."""
    of = of.withColumns({"mask": F.lit(0).cast("long"), "next": F.lit(0)})
    for left in range(radius, 0, -1):
        of = of.withColumn("bit", F.explode(F.sequence(F.col("next"), F.lit(width - left)))).withColumns(
            {"mask": F.col("mask").bitwiseOR(F.expr("shiftleft(1L, bit)")), "next": F.col("bit") + 1}
        )
    return of.drop("bit", "next")


def n_flips(width: int, radius: int) -> int:
    n = 1
    for i in range(radius):
        n = n * (width - i) // (i + 1)
    return n


def top_k(indexed: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): the k rows of ``indexed`` (id, code) nearest each of ``queries`` (id, code), itself
    left out, by Hamming distance and then id."""
    words = words_of(indexed)
    bits, segments = WORD * len(words), WORD // WIDTH * len(words)
    first = indexed.selectExpr("code", "id", "row_number() over (partition by code order by id) as nth").where(F.col("nth") <= k + 1)
    segment = F.array(*[
        F.struct(F.lit(w * (WORD // WIDTH) + s).alias("segment"), F.expr(f"shiftrightunsigned(code.{name}, {s * WIDTH}) & {(1 << WIDTH) - 1}L").alias("value"))
        for w, name in enumerate(words) for s in range(WORD // WIDTH)
    ])
    by_code = cut(first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    index = cut(by_code.select("code", "ids", F.explode(segment).alias("at")).select("code", "ids", "at.segment", "at.value"))
    wanted = min(k, max(0, indexed.count() - 1))
    active = cut(queries.select(F.col("id").alias("query_id"), "code"))
    found = None
    if not wanted:
        return active.limit(0).select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("id"), F.lit(0).alias("distance"))
    state = active.withColumn("worst", F.lit(bits + 1))
    rounds = [("whole", 1, 1)] + [("segment", r, segments * (r + 1) - 1) for r in range(WIDTH + 1)]
    done = None
    for kind, radius, covered in rounds:
        many = state.count()
        if not many:
            break
        if kind == "whole":
            own = state.select("query_id", F.col("code").alias("own"), "worst")
            one = flips(own, WORD, 1)
            changed = [F.struct(*[(F.col("own")[w].bitwiseXOR(F.col("mask")) if w == name else F.col("own")[w]).alias(w) for w in words]) for name in words]
            probes = own.select("*", F.col("own").alias("code")).unionByName(one.select("query_id", "own", "worst", F.explode(F.array(*changed)).alias("code")))
            keys, target, n = ["code"], by_code, many * (1 + bits)
        else:
            probes = flips(state.select("query_id", F.col("code").alias("own"), "worst", F.explode(segment).alias("at")), WIDTH, radius)
            probes = probes.select("query_id", "own", "worst", "at.segment", F.col("at.value").bitwiseXOR(F.col("mask")).alias("value"))
            keys, target, n = ["segment", "value"], index, many * segments * n_flips(WIDTH, radius)
        if n * len(words) <= BROADCAST_PROBES:
            probes = F.broadcast(probes)
        far = apart(F.col("own"), target["code"], words)
        hit = target.join(probes, [target[c] == probes[c] for c in keys]).where(far <= F.col("worst"))
        hit = hit.select("query_id", target["code"].alias("code"), "ids", far.cast("int").alias("distance")).dropDuplicates(["query_id", "code"])
        near = hit.select("query_id", F.explode("ids").alias("id"), "distance").where("id <> query_id")
        if found is not None:
            near = near.unionByName(found)
        near = near.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
        best = near.selectExpr("query_id", "id", "distance", "row_number() over (partition by query_id order by distance, id) as rank").where(F.col("rank") <= wanted)
        best = cut(best)
        reach = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        state = cut(
            state.join(reach, "query_id", "left")
            .where(~((F.coalesce("n", F.lit(0)) == wanted) & (F.coalesce("far", F.lit(bits + 1)) <= covered)))
            .select("query_id", "code", F.when(F.col("n") == wanted, F.col("far")).otherwise(bits + 1).alias("worst"))
        )
        # queries that are covered leave with what they have; the others carry theirs on
        settled = best.join(state.select("query_id"), "query_id", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        found = best.join(state.select("query_id"), "query_id", "left_semi").select("query_id", "id", "distance")
    return done.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance")


def search(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest rows of every row whose id is divisible by ``every``."""
    indexed = cut(codes(vectors, id_col, vector_col))
    return top_k(indexed, indexed.where(F.col("id") % every == 0), k).withColumnRenamed("id", "vec_id")


ORACLE_SQL = """
with usable as (
  select vec_id, embedding from embeddings
  where vec_id is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
wide as (select max(len(embedding)) as n from usable),
coded as (
  select vec_id, rpad(list_aggregate(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end), 'string_agg', ''), n::int, '0') as code from usable, wide),
pairs as (
  select q.vec_id as query_id, d.vec_id, hamming(q.code, d.code)::int as distance
  from coded q join coded d on q.vec_id <> d.vec_id where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by distance, vec_id)::int as rank from pairs)
select query_id, rank, vec_id, distance from ranked where rank <= 10
"""
