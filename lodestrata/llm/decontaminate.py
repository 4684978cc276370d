"""Benchmark decontamination with one Aho-Corasick automaton over normalised words.

Texts and benchmark items are reduced to the same words (A-Z lower-cased; runs of digits, letters and any
non-ASCII character). The automaton holds each window of 10 consecutive item words, or a shorter item
whole, as a sequence of word numbers. A document is scanned once, and each hit maps back through its word
numbers to characters of the original text.

The automaton is built from the benchmark alone and is broadcast, so its size is checked: beyond
MAX_WINDOWS windows the items are taken in blocks, each with an automaton and a scan of its own, one after
another; hits are merged by document.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import ALNUM, forget, in_batches, kept, of_rows, slices, text_bytes, with_rows, written
from lodestrata.session import table

WINDOW = 10
#: About 150 bytes a window word: 200,000 windows stay under 300 MB in a worker.
MAX_WINDOWS = 200_000
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


class Matcher:
    """The automaton of the windows of some items' words; `scan` gives hit words and items of a word list."""

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple, set] = {}
        for item, words in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + width]), set()).add(str(item))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, of in windows.items():
            self.automaton.add_word(w, (len(w), of))
        self.empty = not windows
        self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (merged, end exclusive) and the items whose windows occur."""
        if self.empty or not words:
            return [], set()
        get, spans, items = self.numbers.get, [], set()
        for end, (n, of) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            items |= of
            start = end - n + 1
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end + 1))
        return spans, items


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of the original text for spans of its words."""
    if not spans:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


def blocks(benchmark: DataFrame, max_windows: int = MAX_WINDOWS, width: int = WINDOW) -> Iterator[list[tuple]]:
    """Items and their words, so many at a time that their windows keep the bound; the driver holds one such block.

    An item of more windows comes in pieces that overlap by a window less a word.
    """
    held, room = [], max_windows
    for r in benchmark.where("item_id IS NOT NULL").select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        words = (r.text or "").encode().translate(ALNUM).split()
        at, n = 0, max(1, len(words) - width + 1) if words else 0
        while at < n:
            take = min(room, n - at)
            held.append((r.item_id, words[at : at + take + width - 1]))
            at, room = at + take, room - take
            if not room:
                yield held
                held, room = [], max_windows
    yield held


_matchers: dict[str, Matcher] = {}


def _matcher(block: str, known) -> Matcher:
    """The automaton of a block of items: built once by a worker, which holds one at a time."""
    if block not in _matchers:
        forget()
        kept(_matchers)[block] = Matcher(known.value)
    return _matchers[block]


def matches(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """row (all columns of docs), text, n_words, n_hit, items (sorted strings) and character spans of each document.

    Null and empty texts have no words. Each row counts as a document, also where ids repeat or are null.
    Items without an id or text hold no window; with an empty benchmark nothing is hit. Other columns of docs, whatever their names, are only carried.
    """
    out, spark = None, docs.sparkSession
    for held in blocks(benchmark, max_windows):
        known, block = spark.sparkContext.broadcast(held), uuid.uuid4().hex

        def scan(batches, known=known, block=block):
            matcher = _matcher(block, known)
            for batch in slices(batches):
                rows = [[] for _ in range(4)]
                texts = of_rows(batch, "text")
                for text, data in zip(texts.to_pylist(), text_bytes(texts), strict=True):
                    words = data.translate(ALNUM).split()
                    spans, items = matcher.scan(words)
                    for column, v in zip(rows, (len(words), sum(b - a for a, b in spans), sorted(items), [{"start": a, "stop": b} for a, b in original_spans(text or "", spans)]), strict=True):
                        column.append(v)
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                yield pa.record_batch([batch.column("row"), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], ["row", "n_words", "n_hit", "items", "spans"])

        if out is None:
            source = with_rows(docs, "text")
            more = T.StructType.fromDDL("n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>")
            out = in_batches(source, scan, T.StructType([source.schema["row"], *more.fields]))
        elif held:
            out = _again(written(out.withColumn("text", F.col("row.text").cast("string")), "hits"), block, known).drop("text")  # one automaton at a time in a worker
    return out.select("row", F.col("row.text").cast("string").alias("text"), "n_words", "n_hit", "items", "spans")


def _again(before: DataFrame, block: str, known) -> DataFrame:
    """Adds a further block's hits to rows that hold earlier ones."""

    def scan(batches):
        matcher = _matcher(block, known)
        for batch in slices(batches):
            rows = batch.to_pylist()
            for r in rows:
                text = r["text"] or ""
                words = text.encode().translate(ALNUM).split()
                found, items = matcher.scan(words)
                if items:
                    places = [m.span() for m in WORD.finditer(text)]
                    old = [(s["start"], s["stop"]) for s in r["spans"]]
                    hit = {i for a, b in found for i in range(a, b)} | {i for i, (a, b) in enumerate(places) for s, e in old if s <= a and b <= e}
                    r["items"], r["n_hit"], r["spans"] = sorted({*r["items"], *items}), len(hit), []
                    for i in sorted(hit):
                        if i - 1 in hit and r["spans"]:
                            r["spans"][-1]["stop"] = places[i][1]
                        else:
                            r["spans"].append({"start": places[i][0], "stop": places[i][1]})
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return before.mapInArrow(scan, before.schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those in which a benchmark window occurs.

    Null and empty texts stay, repeated rows are judged alike, and with an empty benchmark every row stays.
    """
    return matches(docs, benchmark).where("n_hit = 0").select("row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents` against whole `benchmark`."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr("row.doc_id", "n_words", "n_hit", "cast(size(items) as long) n_items", "sha2(array_join(items, ','), 256) items_sha256", "n_hit > 0 contaminated")


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = rf"""
WITH items AS (SELECT item_id, {WORDS_SQL} w FROM benchmark),
wins AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) g FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(g) k FROM wins),
docs AS (SELECT doc_id, {WORDS_SQL} w FROM documents),
grams AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) g FROM docs, sizes, unnest(range(1, len(w) - k + 2)) t(i) WHERE len(w) >= k),
hits AS (SELECT doc_id, k, i, item_id FROM grams JOIN wins USING (g)),
words AS (SELECT doc_id, count(DISTINCT i + j) n FROM hits, unnest(range(0, k)) t(j) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, CAST(coalesce(words.n, 0) AS BIGINT) n_hit, CAST(coalesce(found.n, 0) AS BIGINT) n_items,
       sha256(coalesce(found.ids, '')) items_sha256, coalesce(words.n, 0) > 0 contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
