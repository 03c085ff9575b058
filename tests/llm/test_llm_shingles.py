"""Near-duplicates by similarity of five-word shingles, against brute force."""

import random
from itertools import combinations

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
import pytest

from canopyspark.llm import shingles
from canopyspark.llm.common import BATCH_BYTES, bounded

SCHEMA = "doc_id long, text string"


def corpus():
    """Texts, and copies of them with some words changed: pairs of a similarity from 0.6 to 1; a line that most texts have."""
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = [None, "", " ", "one two", "One  two", "three"]
    for k in range(30):
        base = [r.choice(vocabulary) for _ in range(r.randint(40, 200))]
        base = base + ["this line stands in most of the texts here"] if k % 3 else base
        texts.append(" ".join(base))
        for _ in range(12 if k == 0 else r.randint(0, 3)):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return texts


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def slow_kept(texts):
    sets, label = [slow_set(t) for t in texts], list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    return sorted(set(label))


@pytest.mark.parametrize("hot", [1, 3, 64])
def test_groups_are_those_of_all_pairs(spark, hot):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    kept = shingles.one_of_each(docs, hot=hot)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == slow_kept(texts)


def test_groups_without_bitmaps(spark, monkeypatch):
    """Beyond the bitmaps' bound row numbers are joined; the rows are the same."""
    monkeypatch.setattr(shingles, "MOST_BITMAPS", 0)
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "row") for k, t in enumerate(texts)], SCHEMA + ", row string")
    kept = shingles.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == slow_kept(texts)


def test_stage_drops_near_copies(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert sorted(x.doc_id for x in pipeline.drop_near_duplicates(spark, docs, "").collect()) == slow_kept(texts)


def test_empty_and_null_ids(spark):
    assert shingles.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, None), (None, "")], SCHEMA)
    assert sorted(x.doc_id for x in shingles.one_of_each(docs).collect()) == [2, 4]


def test_bitmaps_hold_row_numbers(spark):
    rows = [1, 2, 32767, 32768, 32769, 65536, 65537, (3 << 33) + 1, (3 << 33) + 32768]
    held = {x.at: bytes(x.bits) for x in shingles.bits(spark.createDataFrame([(x,) for x in rows], "row long")).collect()}
    asked = sorted({y for x in rows for y in (x - 1, x, x + 1) if y > 0})
    assert [x for x, y in zip(asked, shingles.among(np.array(asked), held), strict=True) if y] == rows


def test_batches_of_long_texts_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["k"])

    docs = spark.range(0, 6000, 1, 1).selectExpr("id as k", "repeat('abcdefgh', 300) as text")
    told = [x.k for x in bounded(docs).mapInArrow(sizes, "k long").collect()]
    assert sum(told) == 6000 and max(told) * 2400 < 2 * BATCH_BYTES
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "1m")
    bounded(docs)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
