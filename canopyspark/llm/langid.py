"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a space, and every n-gram of 1 to ``MAX_N``
characters is hashed into one of ``BUCKETS`` features. A language's score is the logarithm of its share of the
training texts plus those of its features' shares. A row of the sparse feature matrix is the list
of a text's feature numbers; its product with the broadcast log-probability matrix is a gather and a
segmented sum in numpy, made over slices of bounded length, so that a very long text needs no more
memory than a short one.

Edge cases: a null text or one without letters is ``und`` with score 0; an empty table gives an empty
table; no usable training rows make every text ``und``; repeated rows give the same result each; ties
go to the language first in alphabetical order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyspark.llm.common import bounded

MAX_N = 4
BITS = 16
BUCKETS = 1 << BITS
#: Characters that are worked on at once.
SLICE = 1 << 17
UNKNOWN = "und"
#: One odd multiplier per n-gram length, from the 64-bit golden ratio.
MIX = np.uint32(0x9E3779B1)


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in (text or "").lower())


def slices(texts: list[str | None]) -> Iterator[tuple[int, str, int]]:
    """(index, characters, count): n-grams start at the first ``count`` characters; the rest is lookahead."""
    for i, text in enumerate(texts):
        text = (text or "").lower()
        for at in range(0, len(text), SLICE):
            core = min(SLICE, len(text) - at)
            yield i, text[at : at + core + MAX_N - 1], core


def batches(texts: list[str | None]) -> Iterator[list[tuple[int, str, int]]]:
    held: list[tuple[int, str, int]] = []
    size = 0
    for piece in slices(texts):
        held.append(piece)
        size += piece[2]
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def features(pieces: list[tuple[int, str, int]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers by n-gram length at each position, segment starts, segment ends, and letters."""
    joined = "".join(text + " " * MAX_N for _, text, _ in pieces)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = letters()[codes]
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint32)
    lengths = np.fromiter((len(text) + MAX_N for _, text, _ in pieces), dtype=np.int64, count=len(pieces))
    starts = np.cumsum(lengths) - lengths
    ends = starts + np.fromiter((core for _, _, core in pieces), dtype=np.int64, count=len(pieces))
    found, h = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(MAX_N):
        ahead = np.full(len(codes), 32, dtype=np.uint32)
        ahead[: len(codes) - n] = codes[n:]
        h = (h ^ ahead) * MIX
        h ^= h >> np.uint32(15)
        found.append(((h * MIX) >> np.uint32(32 - BITS)).astype(np.int64))
    return found, starts, ends, letter


def scores(texts: list[str | None], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text in each language, and each text's number of letters. matrix: BUCKETS x languages."""
    total = np.zeros((len(texts), matrix.shape[1]))
    n_letters = np.zeros(len(texts), dtype=np.int64)
    for pieces in batches(texts):
        found, starts, ends, letter = features(pieces)
        edges = np.stack([starts, ends], axis=1).ravel()
        owner = np.fromiter((i for i, _, _ in pieces), dtype=np.int64, count=len(pieces))
        np.add.at(n_letters, owner, np.add.reduceat(letter.astype(np.int64), edges)[::2])
        counted = letter[:, None]  # n-grams that start with a letter
        rows = sum(matrix[f] for f in found) * counted
        np.add.at(total, owner, np.add.reduceat(rows, edges, axis=0, dtype=np.float64)[::2])
    return total, n_letters


def counts(texts: list[str | None]) -> np.ndarray:
    """How often each feature occurs in the texts together."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for pieces in batches(texts):
        found, starts, ends, letter = features(pieces)
        inside = np.zeros(len(letter) + 1, dtype=np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        keep = letter & (np.cumsum(inside[:-1]) > 0)
        for f in found:
            total += np.bincount(f[keep], minlength=BUCKETS)
    return total


def fold(id_col: str, of: int) -> Column:
    """crc32 of an id as text, modulo ``of``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


@dataclass(frozen=True)
class Model:
    """The languages in order, the log-probabilities of features (BUCKETS x languages) and those of languages."""

    langs: list[str]
    matrix: np.ndarray
    prior: np.ndarray


def train(docs: DataFrame, text_col: str, lang_col: str, alpha: float = 0.5) -> Model:
    """A model from every row of ``docs``: features' shares with ``alpha`` added to each count, languages' shares of the texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in parts:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
                c = np.append(counts(own), len(own))  # the last number is that of the texts
                seen[lang] = seen[lang] + c if lang in seen else c
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    table = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = table.column("lang").to_pylist()
    langs = sorted(set(names))
    seen = np.zeros((BUCKETS + 1, len(langs)))
    if langs:
        at = {lang: k for k, lang in enumerate(langs)}
        seen[table.column("bucket").to_numpy(), [at[x] for x in names]] = table.column("n").to_numpy()
    matrix, texts = seen[:-1] + alpha, seen[-1]
    return Model(langs, np.log(matrix / matrix.sum(axis=0)).astype(np.float32), np.log(texts / max(1.0, texts.sum())))


def sample(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """About ``size`` rows, or all if there are fewer: those whose id hashes below the share asked for."""
    n = rows.select(id_col).count()
    share = min(1.0, size / max(n, 1))
    return rows if share == 1 else rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 40)) < int(share * (1 << 40)))


def best(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """The language of each text and its share of the posterior probability."""
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total, n = scores(texts, model.matrix)
    total += model.prior
    names = np.array([*model.langs, UNKNOWN], dtype=object)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return names[np.where(n > 0, np.argmax(total, axis=1), len(model.langs))].tolist(), np.where(n > 0, score, 0.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, whatever the input

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            names, score = best(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def fitted(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int) -> Model:
    """A model from about ``sample_rows`` rows with a language whose id is not in the held-out fold (crc32 mod 4 = 2)."""
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = rows.where((fold("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return train(sample(usable, "doc_id", sample_rows), "text", "lang")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``; see fitted() for what it learns from."""
    found = predict(docs, fitted(docs, id_col, text_col, lang_col, sample_rows), id_col, text_col)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` whose text has a letter, so that it is in a language at all; same columns, a null language filled in.

    Where no language can be learned from, the same rows stay and a null language stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, id_col, text_col, lang_col, sample_rows))
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = batch.column(text_at).to_pylist()
            if not shared.value.langs:
                yield batch.filter(pa.array([has_letter(t) for t in texts], pa.bool_()))
                continue
            names, _ = best(texts, shared.value)
            filled = pc.coalesce(batch.column(lang_at), pa.array(names, batch.column(lang_at).type))
            batch = batch.set_column(lang_at, batch.schema.field(lang_at), filled)
            yield batch.filter(pa.array([x != UNKNOWN for x in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
