"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import delete, small_or_shuffled, written

#: Links that a task turns into a forest together, and children of a node there.
HELD, FAN = 1 << 20, 16


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what a and b connect, as flat trees in which no node has more than FAN children."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for i in (label[a], label[b], a, b):
            np.minimum.at(new, i, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")  # nodes ascend within a component
    first = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0]) if len(order) else np.empty(0, np.int64)
    start = np.repeat(first, np.diff(np.r_[first, len(order)]))
    i = np.arange(len(order)) - start
    child = i > 0
    return nodes[order[(start + (i - 1) // FAN)[child]]], nodes[order[child]]


def thinned(links: DataFrame) -> DataFrame:
    """Links that connect the same: each task keeps a forest of its own, in which no node stands out."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("a", "b")))
            n += batch.num_rows
            if n >= HELD:
                held = [forest(*(np.concatenate([h[i] for h in held]) for i in range(2)))]
                n = 0
        if held:
            yield pa.record_batch([pa.array(x) for x in forest(*(np.concatenate([h[i] for h in held]) for i in range(2)))], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node it reaches) for every node of links (a, b).

    Each round gives a node the smallest label around it and then its label's label, so chains shrink by
    half. Every round's labels are a written table. Only labels that have a smaller one themselves are looked up, in a table of
    each once, so the label of a large component is no key of a shuffle. Without links there are no rows.
    """
    spark = links.sparkSession
    held: list[str] = []
    ends: list[str] = []
    links = thinned(links)
    edges = written(links.union(links.select("b", "a")).distinct(), "edges", ends)
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels", held)
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("_n")).agg(F.min("comp").alias("_c"))
        step = labels.join(near, labels.node == near._n).select("node", F.least("comp", "_c").alias("_l"), F.col("comp").alias("old"))
        now: list[str] = []
        over: list[str] = []
        step = written(step, "step", now)
        delete(spark, held)
        tops = step.where("_l <> node").select(F.col("node").alias("_t"), F.col("_l").alias("_tl")).join(step.select(F.col("_l").alias("_t")).distinct(), "_t", "left_semi")
        tops = small_or_shuffled(written(tops, "tops", over))
        held = now + over
        nxt = step.join(tops, step._l == F.col("_t"), "left").select("node", F.coalesce("_tl", "_l").alias("comp"), "old")
        labels = nxt.select("node", "comp")
        if nxt.where("comp <> old").isEmpty():
            delete(spark, ends)
            return labels
