"""Components of few edges are found without rounds of jobs, and are those of the rounds."""

import random

import pytest

from canopyspark import shared


def slow(edges):
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for a, b in edges:
        if a in label and b in label:
            low, high = sorted((label[a], label[b]))
            label = {x: low if v == high else v for x, v in label.items()}
    return label


def cases():
    r = random.Random(5)
    chain = list(range(300))
    r.shuffle(chain)
    yield list(zip(chain, chain[1:], strict=False))
    yield [(-9, k) for k in range(200)] + [(k, -(1 << 63)) for k in range(5)] + [(7, 7), (None, 3), (500, 500)]
    yield [(r.randrange(400), r.randrange(400)) for _ in range(220)] * 2
    yield []


@pytest.mark.parametrize("few", [0, shared.FEW])
def test_components_are_those_of_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(shared, "FEW", few)
    for edges in cases():
        found = shared.components(spark.createDataFrame(edges, "src long, dst long"))
        assert {x.node: x.label for x in found.collect()} == slow(edges)
        assert found.count() == len(slow(edges))


def test_few_edges_take_few_jobs(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(2000)], "src long, dst long")
    sc = spark.sparkContext
    sc.setJobGroup("few edges", "")
    found = shared.components(edges)
    jobs = len(sc.statusTracker().getJobIdsForGroup("few edges"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert found.where("label = 0").count() == 2001
    assert jobs <= 8
