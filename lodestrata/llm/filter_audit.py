"""What each of five filters removes in every order of them, by a table of first failures.

A text's failures are five bits. A table of 32 rows and 120 columns tells at which step of which order a text with such bits goes; tasks
look up whole batches in it, count removals by part, order, step and label with numpy's bincount, and the counts of all tasks are summed.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import in_batches, slices, text_bytes, written
from lodestrata.session import table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: The filter of each order's steps, as its number.
LETTERS = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
#: At which step of each order a text with these failures goes; STEPS if it stays. A row for each set of bits.
FIRST = np.array([[min((k for k in range(STEPS) if bits >> row[k] & 1), default=STEPS) for row in LETTERS.tolist()] for bits in range(1 << STEPS)])
#: Labels are two bits: good and toxic.
LABELS = 4
#: A part's counts: removals by order, step and label, then texts by their failures.
REMOVED = len(ORDERS) * (STEPS + 1) * LABELS
SLOTS = REMOVED + (1 << STEPS)
#: Parts whose counts a task holds at once; each takes 23 KB.
PARTS = 512
CAPITALS, MARKS, LATER = bytes(range(65, 91)), b"#$%&*|", bytes(range(128, 192))


def bits_of(data: bytes) -> int:
    """Which of A to D a text fails."""
    words = data.split()
    n, points = len(words), len(data.translate(None, LATER))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * points) << 2 | (len(data.translate(None, MARKS)) < len(data)) << 3


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, bits (of A to D) and sha (of the text) of each row."""

    def run(batches):
        for batch in slices(batches):
            texts = text_bytes(batch)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("part"), pa.array([bits_of(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
                ["doc_id", "part", "bits", "sha"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return in_batches(source, run, "doc_id long, part string, bits int, sha binary")


def counted(rows: DataFrame) -> DataFrame:
    """part, slot and n: sums of what tasks count in rows of part, bits (of A to E) and label."""

    def told(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        at = {part: np.flatnonzero(s) for part, s in sums.items()}
        parts = [part for part, i in at.items() for _ in range(len(i))]
        slot, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in ([*at.values()], [sums[p][i] for p, i in at.items()]))
        return pa.record_batch([pa.array(parts, pa.string()), pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int64))], ["part", "slot", "n"])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        place = np.arange(len(ORDERS)) * (STEPS + 1)
        for batch in slices(batches, 4096):
            parts = batch.column("part").dictionary_encode()
            code = parts.indices.to_numpy()
            bits, label = (batch.column(c).to_numpy().astype(np.int64) for c in ("bits", "label"))
            slot = ((place + FIRST[bits]) * LABELS + label[:, None]) + code[:, None] * SLOTS
            counts = np.bincount(slot.ravel(), minlength=len(parts.dictionary) * SLOTS) + np.bincount(code * SLOTS + REMOVED + bits, minlength=len(parts.dictionary) * SLOTS)
            for part, own in zip(parts.dictionary.to_pylist(), counts.reshape(-1, SLOTS), strict=True):
                sums[part] = sums[part] + own if part in sums else own
            if len(sums) > PARTS:
                yield told(sums)
                sums = {}
        yield told(sums)

    return in_batches(rows.select("part", "bits", "label"), run, "part string, slot int, n long").groupBy("part", "slot").agg(F.sum("n").alias("n"))


def reported(sums: DataFrame) -> DataFrame:
    """A row for each part, order and step; a part has at most SLOTS sums."""
    kinds = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    names = [x.split()[0] for x in kinds.split(", ")]
    has = np.arange(1 << STEPS)[:, None] >> np.arange(STEPS) & 1

    def run(batches):
        for batch in batches:
            for part, slots in zip(batch.column("part").to_pylist(), batch.column("slots"), strict=True):
                s = np.zeros(SLOTS, np.int64)
                s[slots.values.field("slot").to_numpy()] = slots.values.field("n").to_numpy()
                gone, bits = s[:REMOVED].reshape(len(ORDERS), STEPS + 1, LABELS)[:, :STEPS], s[REMOVED:]
                removed = gone.sum(axis=2)
                fails, alone = bits @ has, bits[1 << np.arange(STEPS)]
                every = np.bincount(LETTERS.ravel(), removed.ravel(), STEPS).astype(np.int64)
                columns = [bits.sum() - np.cumsum(removed, axis=1), removed, fails[LETTERS] - removed, alone[LETTERS], gone[:, :, [1, 3]].sum(axis=2), gone[:, :, 2:].sum(axis=2), every[LETTERS]]
                orders, steps = np.repeat(ORDERS, STEPS), np.tile(np.arange(1, STEPS + 1), len(ORDERS))
                yield pa.record_batch([pa.array([part] * len(steps)), pa.array(orders), pa.array(steps.astype(np.int32)), *(pa.array(c.ravel()) for c in columns)], names)

    return sums.groupBy("part").agg(F.collect_list(F.struct("slot", "n")).alias("slots")).mapInArrow(run, kinds)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for each language and order.

    Null texts are empty, and a null language is the part "". A row whose text also stands in a row of a smaller id fails E; rows with
    null ids neither do nor make others do, and have no labels. Rows that are there twice count twice. Of several labels of an id
    one that is 1 counts; null labels don't. Other columns are not looked at. Without rows there is no row.
    """
    rows = written(failures(docs), "failures")
    firsts = rows.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # by document, not by text: copies of one text, however many, are rows of many keys
    own = rows.where("doc_id IS NOT NULL").join(firsts, ["doc_id", "sha"], "left").join(known, "doc_id", "left")
    own = own.select("part", (F.col("bits") + F.when(F.col("first"), 0).otherwise(16)).alias("bits"), (F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))).alias("label"))
    rest = rows.where("doc_id IS NULL").select("part", "bits", F.lit(0).alias("label"))
    return reported(counted(own.unionByName(rest)))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents` and `labels`."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w, min(doc_id) OVER (PARTITION BY t) least FROM texts),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) x FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(q, 0) q, coalesce(x, 0) x, count(*) n, a, b, c, d, e FROM (
    SELECT doc_id, part, len(w) < 100 a, 100 * len(list_distinct(w)) < 80 * len(w) b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) c,
      regexp_matches(t, '[#$%&*|]') d, coalesce(doc_id > least, false) e FROM worded
  ) LEFT JOIN known USING (doc_id) GROUP BY ALL
),
long AS (SELECT row_number() OVER () id, part, q, x, n, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) f FROM fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps AS (SELECT o, k, substr(o, k, 1) l FROM orders, range(1, 6) r(k)),
gone AS (SELECT g.*, o, (SELECT min(k) FROM range(1, 6) r(k) WHERE contains(f, substr(o, k, 1))) first FROM long g, orders),
counts AS (
  SELECT part, s.o, s.k, s.l, sum(n) FILTER (first IS NULL OR first > s.k) kept, sum(n) FILTER (first = s.k) removed, sum(n) FILTER (contains(f, s.l) AND first < s.k) redundant,
    sum(n) FILTER (f = s.l) alone, sum(n) FILTER (first = s.k AND q = 1) good, sum(n) FILTER (first = s.k AND x = 1) toxic
  FROM gone JOIN steps s USING (o) GROUP BY ALL
)
SELECT part, o filter_order, CAST(k AS INTEGER) step, CAST(coalesce(kept, 0) AS BIGINT) kept, CAST(coalesce(removed, 0) AS BIGINT) removed, CAST(coalesce(redundant, 0) AS BIGINT) redundant,
  CAST(coalesce(alone, 0) AS BIGINT) unique_fails, CAST(coalesce(good, 0) AS BIGINT) good_lost, CAST(coalesce(toxic, 0) AS BIGINT) toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, l), 0) AS BIGINT) shapley
FROM counts
"""
