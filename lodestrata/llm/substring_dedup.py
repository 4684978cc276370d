"""Substring dedup by prefix-partitioned suffix trees over words.

1. Suffixes that cannot repeat are left out first. In every window of 13 words the 6-word run with the smallest hash is its
   anchor, which equal windows have in common; anchors are dealt out by value, and only windows around anchors that
   different texts share go on. Texts of equal words are one: all but the smallest id lose every word.
2. Of those, the trees hold the suffixes that start at anchors (a sparse suffix tree: every window has one). A suffix travels
   once, with the words that its windows reach to the left and to the right. The prefix that picks its group is the anchor;
   an anchor that too many texts share is taken longer, to whole windows, and these are dealt out in several
   parts first, where all but those of the smallest document are settled. Within a batch, suffixes that repeat a
   smaller document's word for word are settled at once, and of those that a text itself repeats one goes on for all.
3. A group's suffixes are sorted by their words: a suffix array and the depths that neighbours have in common, in words, are its
   tree, and a second one holds the words to the left. A node of either tree is a run of leaves. A window with `a` words before
   its anchor lies below the right tree's node of depth 13 - a and the left one's of depth a; it is removed where
   leaves of that pair of nodes are in a smaller document.
4. `repeats` follows nodes down to maximal repeats of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import by_part, forget, in_batches, mix, runs_of, shuffles, slices, text_bytes, word_hashes, written
from lodestrata.llm.dealing import DEALT, HOT, KEYS, LOW, PLAIN, anywhere, dealt_batch, dealt_rows, packed, split, told
from lodestrata.session import table

WINDOW, RUN = 13, 6
BEFORE = WINDOW - RUN
#: Suffixes for which a task of step 3 is made; its memory is about 300 bytes a suffix.
GROUP = 1 << 18
#: Parts in which the windows of a common anchor are settled first.
SALTS = 64
#: Set on the keys of anchors that too many texts share.
LONG = 1 << 60
MARK = np.dtype([("valid", "<i8"), ("doc_id", "<i8"), ("mark", "<i8"), ("own", "<i8"), ("n", "<i8"), ("sha", "S64")])
#: A suffix: its document, place of its first window, number of windows, words before its anchor in the first, and whether
#: it stands for others of the same words in the text.
LEAF = np.dtype([("doc", "<i8"), ("own", "<i8"), ("start", "<i4"), ("n", "u1"), ("lead", "u1"), ("more", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("own", "<i8"), ("start", "<i4"), ("n", "<i4"), ("more", "u1")])
#: Spans of a row.
SPANS = 1024
#: Bytes of a word's hash that travel.
WORD = 6
#: Kind of dealt rows with windows of common anchors; they meet a second time.
AGAIN = KEYS + 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every RUN-word run, and for each window the place of its anchor."""
    runs = runs_of(hashes, RUN)
    span = WINDOW - RUN + 1
    if len(runs) < span:
        return runs, np.empty(0, np.int64)
    n = len(runs) - span + 1
    least, at = runs[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        less = runs[j : n + j] < least
        at[less] = j
        np.copyto(least, runs[j : n + j], where=less)
    return runs, at + np.arange(n)


def deal(docs: DataFrame, n_parts: int) -> DataFrame:
    """Document rows and the anchors of each text, dealt out."""

    def run(batches):
        import xxhash

        free = anywhere(n_parts)
        forget()
        for batch in slices(batches, 1024, 4 << 20):
            plain, seen, keys, owners = [], set(), [], []
            for doc, data in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                words = data.split()
                digest = hashlib.sha256(b" ".join(words))
                own = int.from_bytes(digest.digest()[:8], "little", signed=True)
                plain.append((doc is not None, doc or 0, signed(xxhash.xxh64_intdigest(data, 42)), own, len(words), digest.hexdigest().encode()))
                if doc is not None and len(words) >= WINDOW and own not in seen:
                    seen.add(own)
                    runs, at = anchors(word_hashes(words))
                    keys.append(np.unique(runs[at[np.r_[True, at[1:] != at[:-1]]]] & LOW))  # places never go back
                    owners.append(np.full(len(keys[-1]), own, np.int64))
            rows = [(next(free), PLAIN, np.array(plain, MARK).tobytes(), b"")] if plain else []
            if keys:
                k, o = np.concatenate(keys), np.concatenate(owners)
                rows += packed(k, o, np.zeros(len(k), np.uint32), n_parts)
            yield dealt_batch(rows)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_batches(source, run, DEALT)


TOLD = "kind int, doc_id long, mark long, own long, n_words long, sha string, key long"


def tell(dealt: DataFrame) -> DataFrame:
    """Document rows (kind 0), and which text (own) holds which shared anchor (kind 1); LONG is set on common ones."""

    def emit(kind: int, n: int, **cols) -> pa.RecordBatch:
        names = [x.split() for x in TOLD.split(", ")]
        full = {"kind": pa.array(np.full(n, kind, np.int32)), **cols}
        return pa.record_batch([full.get(c, pa.nulls(n, pa.string() if t == "string" else pa.int64())) for c, t in names], [c for c, _ in names])

    def run(batches):
        for x in told(batches):
            if isinstance(x, bytes):
                m = np.frombuffer(x, MARK)
                numbers = {c: pa.array(m[k].copy()) for c, k in (("mark", "mark"), ("own", "own"), ("n_words", "n"))}
                yield emit(0, len(m), doc_id=pa.array(m["doc_id"].copy(), mask=m["valid"] == 0), sha=pa.array([s.decode() for s in m["sha"].tolist()], pa.string()), **numbers)
            else:
                owners, _, keys, n = x
                yield emit(1, len(keys), own=pa.array(owners), key=pa.array(np.where(n >= HOT, keys | LONG, keys)))

    return in_batches(by_part(dealt), run, TOLD)


def taken(words: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """words[at[i] : at[i] + n[i]] for every i, one after another."""
    ends = np.cumsum(n)
    return words[np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]


def leaf_rows(kind: int, leaves: np.ndarray, words: np.ndarray, prefix: np.ndarray, n_parts: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Packed rows of leaves and the words of each (n + WINDOW - 1 of them, one after another), dealt out by prefix."""
    n = leaves["n"].astype(np.int64) + WINDOW - 1
    ends = np.cumsum(n)
    for p, i in split((prefix % np.uint64(n_parts)).astype(np.int64), n_parts):
        yield p, kind, leaves[i].tobytes(), taken(words, ends[i] - n[i], n[i]).view(np.uint8).reshape(-1, 8)[:, :WORD].tobytes()


def span_rows(parts: Iterator[int], spans: np.ndarray) -> list[tuple[int, int, bytes, bytes]]:
    return [(next(parts), PLAIN, spans[lo : lo + SPANS].tobytes(), b"") for lo in range(0, len(spans), SPANS)]


def spans_of(leaves: np.ndarray) -> np.ndarray:
    out = np.empty(len(leaves), SPAN)
    for c in SPAN.names:
        out[c] = leaves[c]
    return out


def leaves_of(doc: int, own: int, hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text's leaves, a hash of the prefix of each, whether its anchor is common, and a hash of all that it carries."""
    runs, at = anchors(hashes)
    low = (runs & LOW).astype(np.int64)
    live = np.flatnonzero(np.isin(low, keys & (LONG - 1))[at]) if len(at) else at
    out = np.empty(len(live), LEAF)
    if not len(live):
        return out, np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.uint64)
    place, whole = at[live], runs_of(hashes, WINDOW)
    long = np.isin(low, keys[keys >= LONG] & (LONG - 1))[place]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | long[1:]])
    n, live, place, long = np.diff(np.r_[first, len(live)]), live[first], place[first], long[first]
    out = out[: len(first)]
    out["doc"], out["own"], out["start"], out["n"], out["lead"], out["more"] = doc, own, live, n, place - live, 0
    return out, np.where(long, whole[live], runs[place]), long, mix(whole[live] + np.uint64(0x9E3779B97F4A7C15) * whole[live + n - 1] + n.astype(np.uint64))


def suffixes(near: DataFrame, n_parts: int, settle: bool = True) -> DataFrame:
    """Leaves dealt out by their group (kinds KEYS and, of common anchors, AGAIN), and spans that repeat a smaller document of their batch (PLAIN).

    Without settle every leaf is dealt out, common ones by their window.
    """

    def run(batches):
        from pyspark import TaskContext

        parts, salt = anywhere(n_parts), np.uint64(1 + TaskContext.get().partitionId() % SALTS)
        for batch in slices(batches, 1024, 4 << 20):
            held, base, side = [], 0, []
            for doc, own, data, keys in zip(batch.column("doc_id").to_pylist(), batch.column("own").to_pylist(), text_bytes(batch), batch.column("keys").to_pylist(), strict=True):
                hashes = word_hashes(data.split())
                leaves, prefix, long, same = leaves_of(doc, own, hashes, np.array(keys, np.int64))
                held.append((leaves, prefix, long, same, leaves["start"] + np.int64(base)))
                side.append(hashes)
                base += len(hashes)
            if not held:
                continue
            leaves, prefix, long, same, at = (np.concatenate([h[i] for h in held]) for i in range(5))
            if not len(same):
                continue
            if not settle:
                words = taken(np.concatenate(side), at, leaves["n"].astype(np.int64) + WINDOW - 1)
                yield dealt_batch(list(leaf_rows(KEYS, leaves, words, prefix, n_parts)))
                continue
            # one of those that a text repeats goes on; the others follow it when words are removed
            order = np.lexsort((leaves["own"], leaves["doc"], same))
            s, doc, own = same[order], leaves["doc"][order], leaves["own"][order]
            first = np.r_[True, s[1:] != s[:-1]]
            alone = first | np.r_[True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])]
            again = (doc > doc[first][np.cumsum(first) - 1])[alone]
            i = np.flatnonzero(alone)
            more, order = np.diff(np.r_[i, len(s)]) > 1, order[i]
            leaves, prefix, long, at = leaves[order], prefix[order], long[order], at[order]
            leaves["more"] = more
            rows = span_rows(parts, spans_of(leaves[again]))
            prefix = np.where(long, mix(prefix + salt), prefix)
            for kind, pick in ((KEYS, ~again & ~long), (AGAIN, ~again & long)):
                i = np.flatnonzero(pick)
                words = taken(np.concatenate(side), at[i], leaves["n"][i].astype(np.int64) + WINDOW - 1)
                rows += leaf_rows(kind, leaves[i], words, prefix[i], n_parts)
            yield dealt_batch(rows)

    return in_batches(near.select("doc_id", "own", "text", "keys"), run, DEALT)


def ordered(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words, and how many words neighbours have in common."""
    order = np.lexsort(words.T[::-1])
    s = words[order]
    same = s[1:] == s[:-1]
    return order, np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1))


class Subtree:
    """The suffix trees of some groups as sorted leaves with the depths, in words, that neighbours have in common.

    The right tree holds the words from the anchor on, the left one those before it, the nearest first.
    """

    def __init__(self, leaves: np.ndarray, words: np.ndarray):
        n, lead = leaves["n"].astype(np.int64) + WINDOW - 1, leaves["lead"].astype(np.int64)
        at = np.cumsum(n) - n + lead
        self.leaves, side = leaves, np.append(words, np.uint64(0))
        right, left = np.arange(WINDOW), np.arange(1, BEFORE + 1)
        right = side[np.where(right < (n - lead)[:, None], at[:, None] + right, len(words))]
        left = side[np.where(left <= lead[:, None], at[:, None] - left, len(words))]
        self.trees = {"right": ordered(right), "left": ordered(left)}

    def nodes(self, tree: str, depth: int) -> np.ndarray:
        """The node of at least so many words above each leaf, as the rank of its first leaf; depth 0 is the root."""
        order, common = self.trees[tree]
        first = np.r_[True, common < depth] if len(order) else np.empty(0, bool)
        out = np.empty(len(order), np.int64)
        out[order] = np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else 0
        return out

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each number of words before the anchor: the leaves with such a window, its number there, and its pair of nodes."""
        last = self.leaves["lead"].astype(np.int64)
        least = last - self.leaves["n"] + 1
        for a in range(BEFORE + 1):
            i = np.flatnonzero((least <= a) & (a <= last))
            if len(i):
                pair = self.nodes("right", WINDOW - a)[i] * len(last) + self.nodes("left", a)[i]
                yield i, last[i] - a, pair

    def removed(self) -> np.ndarray:
        """Which windows of each leaf have one of a smaller document under their nodes; a column for each window."""
        gone, docs = np.zeros((len(self.leaves), BEFORE + 1), bool), self.leaves["doc"]
        for i, number, pair in self.windows():
            order = np.lexsort((docs[i], pair))
            p, d = pair[order], docs[i][order]
            first = np.r_[True, p[1:] != p[:-1]]
            gone[i[order], number[order]] = d > d[first][np.cumsum(first) - 1]
        return gone

    def spans(self, gone: np.ndarray) -> np.ndarray:
        """SPAN rows of the windows that are gone, neighbours together."""
        edges = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (leaf, lo), (_, hi) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        out = spans_of(self.leaves[leaf])
        out["start"] += lo.astype(np.int32)
        out["n"] = hi - lo
        return out


def read_leaves(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(c for _, c in rows), np.uint8).reshape(-1, WORD)
    words = np.zeros((len(raw), 8), np.uint8)
    words[:, :WORD] = raw
    return np.concatenate([np.frombuffer(a, LEAF) for a, _ in rows]), words.view(np.uint64).ravel()


def settled(dealt: DataFrame, n_parts: int) -> DataFrame:
    """Of dealt leaves: spans that repeat a smaller document (PLAIN), and common windows that did not in their part, dealt out anew (AGAIN)."""

    def trees(held: dict[int, list]) -> Iterator[tuple[int, int, bytes, bytes]]:
        for kind, rows in held.items():
            if rows:
                leaves, words = read_leaves(rows)
                tree = Subtree(leaves, words)
                gone = tree.removed()
                yield from span_rows(repeat(0), tree.spans(gone))
                if kind == AGAIN:
                    left = np.flatnonzero(~gone[:, 0])  # one window a leaf
                    own = taken(words, left * WINDOW, np.full(len(left), WINDOW))
                    whole = runs_of(own, WINDOW)[::WINDOW]
                    yield from leaf_rows(KEYS, leaves[left], own, whole, n_parts)

    def run(batches):
        now, held = None, {KEYS: [], AGAIN: []}
        for part, kind, a, c in dealt_rows(batches):
            if part != now:
                if now is not None:
                    yield dealt_batch(list(trees(held)))
                now, held = part, {KEYS: [], AGAIN: []}
            if kind == PLAIN:
                yield dealt_batch([(0, PLAIN, a, b"")])
            else:
                held[kind].append((a, c))
        if now is not None:
            yield dealt_batch(list(trees(held)))

    return in_batches(by_part(dealt), run, DEALT)


def earlier(near: DataFrame, n_leaves: int) -> DataFrame:
    """doc_id, own, start and n of runs of windows (n of them from start) that also start in a smaller document; with more, their copies in the text do, too."""
    spark = near.sparkSession
    n_parts = max(shuffles(spark), -(-n_leaves // GROUP))
    found = written(settled(suffixes(near, n_parts), n_parts), "found")
    rest = found.where(F.col("kind") != PLAIN)
    if not rest.isEmpty():
        found = found.where(F.col("kind") == PLAIN).unionByName(settled(rest, n_parts))

    def run(batches):
        for batch in batches:
            for a in batch.column("a").to_pylist():
                m = np.frombuffer(a, SPAN)
                yield pa.record_batch([*(pa.array(m[c].copy()) for c in ("doc", "own", "start", "n")), pa.array(m["more"] > 0)], ["doc_id", "own", "start", "n", "more"])

    return found.where(F.col("kind") == PLAIN).select("a").mapInArrow(run, "doc_id long, own long, start int, n int, more boolean")


def shared_texts(docs: DataFrame, deal=deal) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Document rows; of each text its smallest document (first, own); the texts that share anchors with others (doc_id, own, text, keys); and about how many leaves they have.

    deal tells what a text's anchors are.
    """
    kinds = written(tell(deal(docs, 3 * shuffles(docs.sparkSession))), "told")
    rows = kinds.where("kind = 0").select("doc_id", "mark", "own", "n_words", "sha")
    shared = kinds.where("kind = 1").select("own", "key")
    texts = rows.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.first("own").alias("own"))
    lists = shared.groupBy("own").agg(F.collect_set("key").alias("keys"))
    wanted = texts.join(lists, "own").select(F.col("first.doc_id").alias("_d"), F.col("first.mark").alias("_m"), "own", "keys")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    near = source.join(wanted, (F.col("doc_id") == F.col("_d")) & (F.col("mark") == F.col("_m"))).select("doc_id", "mark", "own", "text", "keys")
    near = written(near.dropDuplicates(["doc_id", "mark"]).drop("mark"), "near")
    return rows, texts.select(F.col("first.doc_id").alias("_d"), F.col("own").alias("_o")), near, shared.count()


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (word spans) of each row of docs.

    Null texts have no words. Rows with a null doc_id are neither earlier nor later than any: they stay whole. Rows
    that repeat an id are each judged against smaller ids alone. Without rows there is no row.
    """
    rows, firsts, near, n_leaves = shared_texts(docs)
    places = earlier(near, n_leaves).groupBy("doc_id", "own").agg(F.collect_list(F.struct("start", "n", "more")).alias("places"))
    changed = _cut(near.join(places, ["doc_id", "own"])).withColumnsRenamed({"doc_id": "_cd", "own": "_co"})
    firsts = firsts.join(changed, (F.col("_d") == F.col("_cd")) & (F.col("_o") == F.col("_co")), "left")
    # by document, not by text: copies of one text, however many, are rows of many keys
    out = rows.join(firsts, (F.col("doc_id") == F.col("_d")) & (F.col("own") == F.col("_o")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("_d").isNull() & (F.col("n_words") >= WINDOW)
    none = F.array().cast("array<struct<start:int,stop:int>>")
    every = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copy, every).otherwise(F.coalesce("removed", none)).alias("removed"),
    )


def _cut(rows: DataFrame) -> DataFrame:
    """doc_id, own, n_removed, kept (hash of the words left) and removed spans."""

    def run(batches):
        for batch in slices(batches):
            out: list[list] = [[], [], []]
            for data, places in zip(text_bytes(batch), batch.column("places"), strict=True):
                words = data.split()
                at, n = (places.values.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
                cover = np.zeros(len(words) + WINDOW + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + n + WINDOW - 1, -1)
                more = np.flatnonzero(places.values.field("more").to_numpy(zero_copy_only=False))
                if len(more):
                    whole = runs_of(word_hashes(words), WINDOW)
                    copies = np.flatnonzero(np.isin(whole, taken(whole, at[more], n[more])))
                    np.add.at(cover, copies, 1)
                    np.add.at(cover, copies + WINDOW, -1)
                gone = np.cumsum(cover)[: len(words)] > 0
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2).tolist()
                out[0].append(int(gone.sum()))
                kept = [words[a:b] for a, b in zip([0, *(b for _, b in edges)], [*(a for a, _ in edges), len(words)], strict=True)]
                out[1].append(hashlib.sha256(b" ".join([w for piece in kept for w in piece])).hexdigest())
                out[2].append([{"start": a, "stop": b} for a, b in edges])
            kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            yield pa.record_batch([batch.column("doc_id"), batch.column("own"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "own", "n_removed", "kept", "removed"])

    return in_batches(rows.select("doc_id", "own", "text", "places"), run, "doc_id long, own long, n_removed long, kept string, removed array<struct<start:int,stop:int>>")


def nodes_of(near: DataFrame, n_leaves: int) -> DataFrame:
    """node, doc_id, own and start: the windows below each pair of nodes that has more than one."""
    n_parts = max(shuffles(near.sparkSession), -(-n_leaves // GROUP))

    def of(part, rows):
        tree, first = Subtree(*read_leaves(rows)), part << 40
        for i, number, pair in tree.windows():
            _, at, n = np.unique(pair, return_inverse=True, return_counts=True)
            i, number, own = i[n[at] > 1], number[n[at] > 1], tree.leaves[i[n[at] > 1]]
            cols = [first + at[n[at] > 1], own["doc"].copy(), own["own"].copy(), own["start"] + number]
            first += len(n)
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in cols], ["node", "doc_id", "own", "start"])

    def run(batches):
        now, held = None, []
        for part, _, a, c in dealt_rows(batches):
            if part != now and held:
                yield from of(now, held)
                held = []
            now = part
            held.append((a, c))
        if held:
            yield from of(now, held)

    return in_batches(by_part(suffixes(near, n_parts, settle=False)), run, "node long, doc_id long, own long, start long")


def followed(near: DataFrame, rows: DataFrame, depth: int, step: int) -> DataFrame:
    """rows (node, doc_id, own, start) with the word before (a number of its own where a text begins) and up to `step` words from `depth` on."""

    def run(batches):
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc, own, data, places in zip(batch.column("doc_id").to_pylist(), batch.column("own").to_pylist(), text_bytes(batch), batch.column("places"), strict=True):
                hashes = word_hashes(data.split())
                raw = hashes.view(np.uint8).reshape(-1, 8)[:, :WORD].tobytes()
                node, start = (places.values.field(c).to_numpy() for c in ("node", "start"))
                begin = int(mix(np.array([own], np.int64).view(np.uint64))[0])
                left = [int(hashes[x - 1]) if x else begin for x in start.tolist()]
                words = [raw[WORD * (x + depth) : WORD * (x + depth + step)] for x in start.tolist()]
                for column, v in zip(out, (node.tolist(), [doc] * len(node), [own] * len(node), start.tolist(), map(signed, left), words), strict=True):
                    column.extend(v)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["node", "doc_id", "own", "start", "left", "words"])

    lists = rows.groupBy("doc_id", "own").agg(F.collect_list(F.struct("node", "start")).alias("places"))  # no more than a text has words
    return in_batches(near.join(lists, ["doc_id", "own"]).select("doc_id", "own", "text", "places"), run, "node long, doc_id long, own long, start long, left long, words binary")


def ended(rows: DataFrame, depth: int, step: int) -> DataFrame:
    """n_words, n, doc_id and start (of the first occurrence) of the maximal repeats that end within the `step` words that were read.

    Leaves come in the order of their words, node by node, and the nodes below are told by a stack of those that are open, so
    memory does not grow with a node's leaves.
    """

    def joined(a, b):
        return (a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), min(a[3], b[3]), max(a[4], b[4]), min(a[5], b[5]))

    def closed(stack, leaf, down_to):
        """The leaf's node as far up as down_to, and what ends on the way."""
        found = []
        while stack and stack[-1][0] > down_to:
            common, sums = stack.pop()
            leaf = joined(sums, leaf)
            if common < step and leaf[1] < leaf[2] and leaf[3] < leaf[4]:
                found.append((depth + common, leaf[0], *leaf[5]))
        return leaf, found

    def run(batches):
        now, stack, last, before = None, [], None, b""
        for batch in batches:
            out = []
            for node, doc, own, start, left, words in zip(*(batch.column(c).to_pylist() for c in ("node", "doc_id", "own", "start", "left", "words")), strict=True):
                if node != now:
                    out += closed(stack, last, -1)[1]
                    now, stack = node, []
                else:
                    common = shared_words(before, words)
                    last, found = closed(stack, last, common)
                    out += found
                    if stack and stack[-1][0] == common:
                        stack[-1] = (common, joined(stack[-1][1], last))
                    else:
                        stack.append((common, last))
                last, before = (1, left, left, own, own, (doc, start)), words
            yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["n_words", "n", "doc_id", "start"])
        out = closed(stack, last, -1)[1]
        yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["n_words", "n", "doc_id", "start"])

    by_node = rows.repartition(shuffles(rows.sparkSession), "node").sortWithinPartitions("node", "words", "doc_id", "own", "start")
    return by_node.select("node", "doc_id", "own", "start", "left", "words").mapInArrow(run, "n_words long, n long, doc_id long, start long")


def shared_words(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // WORD
    if a[: n * WORD] == b[: n * WORD]:
        return n
    x, y = (np.frombuffer(v, np.uint8)[: n * WORD].reshape(-1, WORD) for v in (a, b))
    return int((x != y).any(axis=1).argmax())


def repeats(docs: DataFrame, step: int = 32) -> DataFrame:
    """n_words, n, doc_id and start (word) of every maximal repeat of at least WINDOW words that different texts share.

    A maximal repeat is a sequence of words whose n occurrences are not all preceded by one word, nor all followed by one; the
    first occurrence stands for all. Texts of equal words are one text, that of the smallest id; null texts and rows with null
    ids have no part. Nodes of WINDOW words come from the trees; what is alike beyond them is read on in growing steps, and only
    where a repeat may begin: where the word before differs. A node's leaves meet in one task, which holds its open nodes alone.
    """
    _, _, near, n_leaves = shared_texts(docs)
    out, depth = [], WINDOW
    now = written(nodes_of(near, n_leaves), "nodes")
    varied = [F.count("*").alias("c"), F.min("left").alias("lo"), F.max("left").alias("hi")]
    while not now.isEmpty():
        rows = written(followed(near, now, depth, step), "followed")
        begin = rows.groupBy("node").agg(*varied).where("c > 1 AND lo < hi").select("node")
        rows = written(rows.join(begin, "node", "left_semi"), "begin")
        out.append(written(ended(rows, depth, step), "repeats"))
        alike = rows.where(F.octet_length("words") == step * WORD).groupBy("node", "words").agg(*varied).where("c > 1 AND lo < hi").select("node", "words")
        now = rows.join(alike, ["node", "words"], "left_semi").select(F.xxhash64("node", "words").alias("node"), "doc_id", "own", "start")
        now, depth, step = written(now, "nodes"), depth + step, min(2 * step, 1024)
    if not out:
        return docs.sparkSession.createDataFrame([], "n_words long, n long, doc_id long, start long")
    return reduce(DataFrame.unionByName, out)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    return deduplicated(table(spark, sf_dir, "documents")).drop("removed")


OP10_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') g FROM words, unnest(range(1, len(w) - 11)) t(i) WHERE len(w) >= 13),
least AS (SELECT g, min(doc_id) d FROM wins GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + j k FROM wins JOIN least USING (g), unnest(range(0, 13)) u(j) WHERE doc_id > least.d),
flat AS (SELECT doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) k FROM words),
left_ AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) t, count(*) n FROM flat f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = f.doc_id AND g.k = f.k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(l.n, 0) AS BIGINT) n_removed, sha256(coalesce(l.t, '')) kept_sha256 FROM words w LEFT JOIN left_ l USING (doc_id)
"""
