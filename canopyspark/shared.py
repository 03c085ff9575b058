"""The shared folder, cut lineage and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that the rows of a hot value are dealt to where what is told of it may be wide.
SALTS = 32
#: Edges that the driver labels by itself at most: 4 MB.
FEW = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (tests in one JVM) a temporary folder takes its place; a cluster
    without it is refused, because a machine-local folder would lose what other machines need.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
        if not root:
            if not (sc.master or "").startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="canopyspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, so that a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(rows: DataFrame, keys: list[str], total: int | None = None, share: int = 1024, least: int = 64) -> DataFrame | None:
    """The values of ``keys`` that hold more than 1/``share`` of the rows, and more than ``least``: never more than ``share`` of them. None if there are none."""
    limit = max(least, (rows.count() if total is None else total) // share)
    found = cut(rows.groupBy(*keys).agg(F.count("*").alias("rows of a key")).where(F.col("rows of a key") > limit).select(*keys))
    return None if found.isEmpty() else found


def join_each(rows: DataFrame, told: DataFrame, keys: list[str], hot: DataFrame | None | str = "sought", by: list[str] | None = None) -> DataFrame:
    """The inner join of ``rows`` with ``told``, which has one row for each value of ``keys``.

    A value that holds a large share of the rows is not dealt to one task: what is told of such values, ``share``
    rows of hot_keys() at most, goes to every task, and the other rows are joined by a shuffle. Where what is told can be
    wide (texts, sets), ``by`` names columns of ``rows``: their hash then deals the rows of such a value to SALTS tasks, and
    what is told of it goes to these by a shuffle. ``rows`` is read several times, so it should be kept.
    """
    hot = hot_keys(rows, keys) if isinstance(hot, str) else hot
    if hot is None:
        return rows.join(told, keys)
    few = F.broadcast(hot)
    cold = rows.join(few, keys, "left_anti").join(told, keys)
    if by is None:
        return rows.join(F.broadcast(told.join(few, keys, "left_semi")), keys).unionByName(cold)
    dealt = rows.join(few, keys, "left_semi").withColumn("salt of a hot key", F.pmod(F.xxhash64(*by), F.lit(SALTS)))
    copies = told.join(few, keys, "left_semi").withColumn("salt of a hot key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, [*keys, "salt of a hot key"]).drop("salt of a hot key").unionByName(cold)


def labelled(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, sorted, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    label = np.arange(len(nodes))
    while len(a):
        # the larger label of each edge is lowered to the smaller, and labels are then followed to their ends
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (src, dst long); label is the component's smallest node.

    Up to FEW edges are labelled by the driver, which spares it and the disks the many small jobs of rounds. More go
    through rounds. Minimum propagation with pointer jumping: each round takes the smallest label among a node's
    neighbours and then that label's own label, so a chain of n nodes needs about log n rounds. A node with very
    many neighbours, and a label that very many nodes share, are joined apart (join_each). No edges: an empty table.
    """
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    edges = cut(edges)
    if edges.count() <= FEW:
        told = edges.toArrow()
        names = ["node", "label"]
        found = pa.table([pa.array(x) for x in labelled(told.column("src").to_numpy(), told.column("dst").to_numpy())], names=names)
        return cut(edges.sparkSession.createDataFrame(found, "node long, label long"))
    both = cut(edges.union(edges.select("dst", "src")).distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")).select("node", F.least("node", "least").alias("label")))
    nodes = labels.count()
    centres = hot_keys(both, ["dst"]) if nodes else None
    while nodes:
        near = join_each(both, labels.withColumnRenamed("node", "dst"), ["dst"], centres).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        lower = cut(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low")))
        # a label is itself a node, so its own lower label is found by one more join
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("lowest"))
        jumped = join_each(lower, jump, ["low"], hot_keys(lower, ["low"], nodes))
        after = cut(jumped.select("node", F.least("low", "lowest").alias("label"), (F.least("low", "lowest") < F.col("label")).alias("moved")))
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            break
    return labels


def stable(df: DataFrame) -> DataFrame:
    """``df`` if it reads its rows in the same order each time, as a scan of files does; otherwise its rows, kept.

    Row numbers are then the same in two passes over it. What a shuffle deals out may come in another
    order when other columns are read.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    return cut(df) if "Exchange" in plan else df
