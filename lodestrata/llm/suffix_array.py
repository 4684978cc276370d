"""Dedup of repeated byte strings by suffix arrays, sorted deep-shallow.

1. Suffixes that cannot repeat are left out. In every 100-byte window the 40-byte gram with the smallest hash is its anchor, which
   equal windows have in common. Anchors are dealt out by value; texts go on that hold one which another text, or
   the text itself, holds again. Texts of equal bytes are one: all but the smallest id lose every byte.
2. The suffixes that start at those anchors travel with what their windows reach to both sides, dealt out by the anchor. Of those
   that carry the same bytes only the first of a batch goes on.
3. A group's suffixes are sorted by multikey quicksort to a shallow depth (SHALLOW words of 8 bytes, taken as characters, all open
   segments partitioned at once); groups that are still alike are put in order by a blind trie, which compares each string
   with one other only. That gives a suffix array and the bytes that neighbours have in common; a second one holds what
   stands before the anchors, read backwards. A window with r bytes before its anchor is removed where a suffix that
   shares 100 - r bytes with it after the anchor, and r before it, starts earlier.
4. Anchors that very many texts hold (`dealing.HOT`) would meet in one task. Their windows are dealt out by themselves instead: first 7 bytes
   each, to learn which are shared at all, then 16-byte digests of those that are, first in salted parts, then what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import by_part, forget, in_batches, mix, shuffles, slices, text_bytes, written
from lodestrata.llm.dealing import DEALT, KEYS, LOW, PLAIN, anywhere, dealt_batch, dealt_rows, packed, split
from lodestrata.llm.substring_dedup import LONG, MARK, SALTS, SPAN, shared_texts, signed, span_rows, taken, tell
from lodestrata.session import table

WINDOW, RUN = 100, 40
#: Windows that may have one anchor.
REACH = WINDOW - RUN + 1
#: Words of 8 bytes that the multikey quicksort looks at; what is alike beyond goes to the tries.
SHALLOW = 2
#: Suffixes for which a part is made; its memory is about 1 KB a suffix.
GROUP = 1 << 16
#: Bytes of a text whose anchors are looked for at once.
STEP = 1 << 20
BASE = 0x9E3779B97F4A7C15
PLACE = np.uint64((1 << 31) - 1)
#: A suffix: its document, place of its first window, number of windows, and bytes before its anchor in the first.
LEAF = np.dtype([("doc", "<i8"), ("own", "<i8"), ("start", "<i4"), ("n", "u1"), ("lead", "u1")])
#: A window of a common anchor.
DIGEST = np.dtype([("doc", "<i8"), ("own", "<i8"), ("start", "<i4"), ("high", "<u8"), ("low", "<u8")])


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive bytes (at least k of them), by doubling."""
    h, n, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & n:
            m = len(data) - done - n + 1
            out = h if out is None else out[:m] * np.uint64(pow(BASE, n, 1 << 64)) + h[done : done + m]
            done += n
        if 2 * n > k:
            return mix(out)
        h = h[: len(h) - n] * np.uint64(pow(BASE, n, 1 << 64)) + h[n:]
        n *= 2


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` consecutive values, by doubling."""
    n, m = 1, values
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    size = len(values) - width + 1
    return np.minimum(m[:size], m[width - n : width - n + size])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key and place of each anchor, its first window and how many it has; a window's anchor depends on its bytes alone."""
    out, b = [], np.frombuffer(data, np.uint8)
    for lo in range(0, len(b) - WINDOW + 1, STEP):
        hashes = grams(b[lo : lo + STEP + WINDOW - 1], RUN)
        at = least((hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64), REACH) & PLACE  # of equal ones the leftmost
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        place = at[first].astype(np.int64)
        out.append((hashes[place] & LOW, place + lo, first + lo, np.diff(np.r_[first, len(at)])))
    if not out:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def held_twice(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return np.unique(keys[1:][keys[1:] == keys[:-1]])


def owned(keys: np.ndarray, places: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a text and their owner; what the text holds at two places has a second owner, so that it is told as shared."""
    keys = keys[np.r_[True, places[1:] != places[:-1]]] if len(places) else keys
    once, twice = np.unique(keys), held_twice(keys)
    return np.concatenate([once, twice]), np.concatenate([np.full(len(once), own, np.int64), np.full(len(twice), ~own, np.int64)])


def deal(docs: DataFrame, n_parts: int) -> DataFrame:
    """Document rows and the anchors of each text, dealt out."""

    def run(batches):
        import xxhash

        free = anywhere(n_parts)
        forget()
        for batch in slices(batches, 1024, 4 << 20):
            plain, seen, keys = [], set(), []
            for doc, data in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                digest = hashlib.sha256(data)
                own = int.from_bytes(digest.digest()[:8], "little", signed=True)
                plain.append((doc is not None, doc or 0, signed(xxhash.xxh64_intdigest(data, 42)), own, len(data), digest.hexdigest().encode()))
                if doc is not None and len(data) >= WINDOW and own not in seen:
                    seen.add(own)
                    key, place, _, _ = anchors(data)
                    keys.append(owned(key, place, own))
            rows = [(next(free), PLAIN, np.array(plain, MARK).tobytes(), b"")] if plain else []
            if keys:
                k, o = (np.concatenate(x) for x in zip(*keys, strict=True))
                rows += packed(k, o, np.zeros(len(k), np.uint32), n_parts)
            yield dealt_batch(rows)

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, DEALT)


def later(group: np.ndarray, doc: np.ndarray, own: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which entries have one of their group in a smaller document, or earlier in the same text."""
    order = np.lexsort((start, own, doc, group))
    g, d, o = group[order], doc[order], own[order]
    first = np.r_[True, g[1:] != g[:-1]][: len(g)]
    again = ~first
    again[1:] &= (d[1:] == d[:-1]) & (o[1:] == o[:-1])
    out = np.empty(len(g), bool)
    out[order] = again | (d > d[first][np.cumsum(first) - 1])
    return out


def spans_of(leaves: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(leaves), SPAN)
    out["doc"], out["own"], out["start"], out["n"] = leaves["doc"], leaves["own"], start, n
    return out


def chosen(data: bytes, keys: np.ndarray, common: bool) -> tuple[np.ndarray, ...]:
    """Of the anchors whose key is in keys (those of LONG, or the others): place, first window and number of windows."""
    key, place, first, n = anchors(data)
    wanted = keys[(keys >= LONG) == common] & (LONG - 1)
    live = np.isin(key.astype(np.int64), wanted)
    return place[live], first[live], n[live], key[live]


def texts_of(batch: pa.RecordBatch, *lists: str) -> Iterator[tuple]:
    columns = [[np.array(x, np.int64) for x in batch.column(c).to_pylist()] for c in lists]
    return zip(batch.column("doc_id").to_pylist(), batch.column("own").to_pylist(), text_bytes(batch), *columns, strict=True)


def suffixes(near: DataFrame, n_parts: int) -> DataFrame:
    """Leaves dealt out by their anchor (KEYS: the leaves, and the bytes of their windows), and spans that repeat what is earlier in their batch (PLAIN)."""

    def run(batches):
        import xxhash

        parts = anywhere(n_parts)
        forget()
        for batch in slices(batches, 1024, 4 << 20):
            held, keys, side = [], [], []
            for doc, own, data, told in texts_of(batch, "keys"):
                place, first, n, key = chosen(data, told, False)
                leaves = np.empty(len(place), LEAF)
                leaves["doc"], leaves["own"], leaves["start"], leaves["n"], leaves["lead"] = doc, own, first, n, place - first
                held.append(leaves)
                keys.append(key)
                side += [data[a : a + m + WINDOW - 1] for a, m in zip(first.tolist(), n.tolist(), strict=True)]
            if not side:
                continue
            leaves, key = np.concatenate(held), np.concatenate(keys)
            same = np.fromiter(map(xxhash.xxh3_64_intdigest, side), np.uint64, len(side)) + leaves["lead"]
            gone = later(same, leaves["doc"], leaves["own"], leaves["start"])
            rows = span_rows(parts, spans_of(leaves[gone], leaves["start"][gone], leaves["n"][gone]))
            left = np.flatnonzero(~gone)
            for p, i in split((mix(key[left]) % np.uint64(n_parts)).astype(np.int64), n_parts):
                rows.append((p, KEYS, leaves[left[i]].tobytes(), b"".join([side[j] for j in left[i].tolist()])))
            yield dealt_batch(rows)

    return in_batches(near.select("doc_id", "own", "text", "keys"), run, DEALT)


def multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words, and which start a group of equal rows: multikey quicksort, every open segment split by its pivot at once."""
    m, depth = words.shape
    order, start, level = np.arange(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
    at = np.arange(m) if m > 1 else np.empty(0, np.int64)
    while len(at):
        begin = np.flatnonzero(np.r_[True, start[at[1:]] != start[at[:-1]]])
        size = np.diff(np.r_[begin, len(at)])
        segment = np.repeat(np.arange(len(begin)), size)
        value = words[order[at], level[at]]
        pivot = value[begin + size // 2][segment]
        side = np.where(value < pivot, 0, np.where(value == pivot, 1, 2))
        key = segment * 3 + side
        by = np.argsort(key, kind="stable")
        order[at], key = order[at[by]], key[by]
        first = np.r_[True, key[1:] != key[:-1]]
        start[at] = at[first][np.cumsum(first) - 1]
        level[at] += key % 3 == 1
        n = np.diff(np.r_[np.flatnonzero(first), len(at)])[np.cumsum(first) - 1]
        at = at[(n > 1) & (level[at] < depth)]
    return order, np.r_[True, start[1:] != start[:-1]][:m]


def in_common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of distinct strings, and how many bytes each has in common with the one before it.

    A node holds the depth at which its strings part, one of them, and a child for each byte there (-1: the string ends). A
    string goes down by the bytes at the nodes' depths alone, is compared once with the string it comes to, and is put in where they part.
    """

    def byte(i, depth):
        return strings[i][depth] if depth < len(strings[i]) else -1

    root = 0
    for i in range(1, len(strings)):
        node = root
        while type(node) is tuple:
            node = node[2].get(byte(i, node[0]), node[1])
        parted = in_common(strings[i], strings[node])
        above, node = None, root
        while type(node) is tuple and node[0] < parted:
            above, node = node, node[2][byte(i, node[0])]
        if type(node) is tuple and node[0] == parted:
            node[2][byte(i, parted)] = i
            continue
        known = node[1] if type(node) is tuple else node
        fork = (parted, known, {byte(known, parted): node, byte(i, parted): i})
        if above is None:
            root = fork
        else:
            above[2][byte(i, above[0])] = fork
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if type(node) is tuple:
            below = [node[2][c] for c in sorted(node[2], reverse=True)]
            stack += [(x, node[0]) for x in below[:-1]]
            stack.append((below[-1], depth))
        else:
            order.append(node)
            common.append(depth)
    return order, common


def ordered(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The place of each string among the distinct ones in order, and how many bytes each of those shares with the one before it."""
    distinct = {s: i for i, s in enumerate(dict.fromkeys(strings))}
    names, m, width = list(distinct), len(distinct), 8 * SHALLOW
    head = np.frombuffer(b"".join([s[:width].ljust(width, b"\0") for s in names]), np.uint8).reshape(m, width)
    order, first = multikey(head.view(">u8").astype(np.uint64))
    begin, inner = np.flatnonzero(first), []
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), m], strict=True):
        if hi - lo > 1:
            group = order[lo:hi]
            by, shared = blind_trie([names[i] for i in group.tolist()])
            order[lo:hi] = group[by]
            inner.append((lo + 1, hi, shared[1:]))
    length, near = np.fromiter(map(len, names), np.int64, m)[order], head[order]
    common = np.zeros(m, np.int64)
    common[1:] = np.minimum((near[1:] != near[:-1]).argmax(axis=1), np.minimum(length[1:], length[:-1]))
    for lo, hi, shared in inner:
        common[lo:hi] = shared
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    return place[np.fromiter(map(distinct.__getitem__, strings), np.int64, len(strings))], common


class Suffixes:
    """The suffix arrays of some groups: what stands from the anchors on, and before them, the nearest first."""

    def __init__(self, leaves: np.ndarray, side: bytes):
        n, lead = leaves["n"].astype(np.int64) + WINDOW - 1, leaves["lead"].tolist()
        ends = np.cumsum(n).tolist()
        hulls = [side[e - k : e] for e, k in zip(ends, n.tolist(), strict=True)]
        self.leaves = leaves
        self.arrays = {
            "right": ordered([h[k:] for h, k in zip(hulls, lead, strict=True)]),
            "left": ordered([h[:k][::-1] for h, k in zip(hulls, lead, strict=True)]),
        }

    def alike(self, array: str, depth: int) -> np.ndarray:
        """A number for each leaf, the same for those that share so many bytes."""
        place, common = self.arrays[array]
        return np.maximum.accumulate(np.where(common < depth, np.arange(len(common)), 0))[place]

    def removed(self) -> np.ndarray:
        """Which windows of each leaf start earlier, too; a column for each window."""
        last = self.leaves["lead"].astype(np.int64)
        gone, fewest = np.zeros((len(last), REACH), bool), last - self.leaves["n"] + 1
        for r in range(REACH):
            i = np.flatnonzero((fewest <= r) & (r <= last))
            if len(i):
                x = self.leaves[i]
                pair = self.alike("right", WINDOW - r)[i] * (len(last) + 1) + self.alike("left", r)[i]
                gone[i, last[i] - r] = later(pair, x["doc"], x["own"], x["start"] + (last[i] - r))
        return gone


def in_parts(dealt: DataFrame, of) -> DataFrame:
    """of(rows of a part) for each part; spans pass."""

    def run(batches):
        now, held = None, []
        for part, kind, a, c in dealt_rows(batches):
            if part != now:
                if held:
                    yield dealt_batch(of(held))
                now, held = part, []
            if kind == PLAIN:
                yield dealt_batch([(0, PLAIN, a, b"")])
            else:
                held.append((a, c))
        if held:
            yield dealt_batch(of(held))

    return in_batches(by_part(dealt), run, DEALT)


def all_zero() -> Iterator[int]:
    while True:
        yield 0


def settled(rows: list[tuple[bytes, bytes]]) -> list[tuple[int, int, bytes, bytes]]:
    """Spans of the windows that start earlier elsewhere in the part."""
    leaves, side = np.concatenate([np.frombuffer(a, LEAF) for a, _ in rows]), b"".join(c for _, c in rows)
    gone = Suffixes(leaves, side).removed()
    edges = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (leaf, lo), (_, hi) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    return span_rows(all_zero(), spans_of(leaves[leaf], leaves["start"][leaf] + lo, hi - lo))


def common_windows(near: DataFrame, n_parts: int) -> DataFrame:
    """own and key: the windows with common anchors that texts share."""

    def run(batches):
        forget()
        for batch in slices(batches, 1024, 4 << 20):
            keys = []
            for _, own, data, told in texts_of(batch, "keys"):
                _, first, n, _ = chosen(data, told, True)
                key = grams(np.frombuffer(data, np.uint8), WINDOW) & LOW
                at = spread(first, n)
                keys.append(owned(key[at], at, own))
            if keys:
                k, o = (np.concatenate(x) for x in zip(*keys, strict=True))
                yield dealt_batch(list(packed(k, o, np.zeros(len(k), np.uint32), n_parts)))

    dealt = in_batches(near.select("doc_id", "own", "text", "keys"), run, DEALT)
    return tell(dealt).where("kind = 1").select("own", F.expr(f"key & {LONG - 1}L").alias("key"))


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Every number from first[i] on, n[i] of them."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(n) else 0)


def digests(near: DataFrame, n_parts: int) -> DataFrame:
    """Windows of common anchors that texts share, as digests in salted parts (KEYS), and spans of those that are earlier in their batch (PLAIN)."""

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        parts, salt = anywhere(n_parts), np.uint64(1 + TaskContext.get().partitionId() % SALTS)
        forget()
        for batch in slices(batches, 1024, 4 << 20):
            held = []
            for doc, own, data, told, shared in texts_of(batch, "keys", "windows"):
                _, first, n, _ = chosen(data, told, True)
                at = spread(first, n)
                at = at[np.isin((grams(np.frombuffer(data, np.uint8), WINDOW) & LOW).astype(np.int64)[at], shared)]
                raw = b"".join([xxhash.xxh3_128_digest(data[x : x + WINDOW]) for x in at.tolist()])
                out = np.empty(len(at), DIGEST)
                both = np.frombuffer(raw, "<u8").reshape(-1, 2)
                out["doc"], out["own"], out["start"], out["high"], out["low"] = doc, own, at, both[:, 0], both[:, 1]
                held.append(out)
            if held:
                rows, left = first_digests(np.concatenate(held))
                yield dealt_batch([(next(parts), *x[1:]) for x in rows] + list(by_digest(left, n_parts, salt)))

    return in_batches(near.select("doc_id", "own", "text", "keys", "windows"), run, DEALT)


def first_digests(rows: np.ndarray) -> tuple[list[tuple[int, int, bytes, bytes]], np.ndarray]:
    """Spans of those that are there earlier, and the others."""
    order = np.lexsort((rows["low"], rows["high"]))
    s = rows[order]
    group = np.cumsum(np.r_[True, (s["high"][1:] != s["high"][:-1]) | (s["low"][1:] != s["low"][:-1])][: len(s)])
    gone = later(group, s["doc"], s["own"], s["start"])
    found = np.sort(spans_of(s[gone], s["start"][gone], np.ones(gone.sum(), np.int32)), order=["doc", "own", "start"])
    # neighbours are one span
    first = np.ones(len(found), bool)
    first[1:] = (found["doc"][1:] != found["doc"][:-1]) | (found["own"][1:] != found["own"][:-1]) | (found["start"][1:] != found["start"][:-1] + 1)
    n = np.diff(np.r_[np.flatnonzero(first), len(found)])
    found = found[first]
    found["n"] = n
    return span_rows(all_zero(), found), s[~gone]


def by_digest(rows: np.ndarray, n_parts: int, salt: np.uint64 | None = None) -> Iterator[tuple[int, int, bytes, bytes]]:
    part = rows["high"] if salt is None else mix(rows["high"] + salt)
    for p, i in split((part % np.uint64(n_parts)).astype(np.int64), n_parts):
        yield p, KEYS, np.sort(rows[i], order=["doc", "own", "start"]).tobytes(), b""


def earlier(near: DataFrame, n_leaves: int) -> DataFrame:
    """doc_id, own, start and n of runs of windows (n of them from start) that start earlier, too."""
    spark = near.sparkSession
    n_parts = max(shuffles(spark), -(-n_leaves // GROUP))
    found = in_parts(suffixes(near, n_parts), settled).select("a")
    common = near.where(F.exists("keys", lambda k: k >= LONG))
    if not common.isEmpty():
        shared = common_windows(common, 3 * shuffles(spark))
        windows = shared.groupBy("own").agg(F.collect_set("key").alias("windows"))  # no more than a text has windows
        dealt = digests(common.join(windows, "own"), n_parts)

        def in_salted(rows):
            spans, left = first_digests(np.concatenate([np.frombuffer(a, DIGEST) for a, _ in rows]))
            return spans + list(by_digest(left, n_parts))

        def at_last(rows):
            return first_digests(np.concatenate([np.frombuffer(a, DIGEST) for a, _ in rows]))[0]

        first = written(in_parts(dealt, in_salted), "windows")
        rest = in_parts(first.where(F.col("kind") != PLAIN), at_last)
        found = found.unionByName(first.where(F.col("kind") == PLAIN).select("a")).unionByName(rest.select("a"))

    def run(batches):
        for batch in batches:
            for a in batch.column("a").to_pylist():
                m = np.frombuffer(a, SPAN)
                yield pa.record_batch([pa.array(m[c].copy()) for c in ("doc", "own", "start", "n")], ["doc_id", "own", "start", "n"])

    return found.mapInArrow(run, "doc_id long, own long, start int, n int")


def _cut(rows: DataFrame) -> DataFrame:
    """doc_id, own, n_removed, kept (hash of the bytes left) and removed (maximal spans)."""

    def run(batches):
        for batch in slices(batches):
            out: list[list] = [[], [], []]
            for data, places in zip(text_bytes(batch), batch.column("places"), strict=True):
                at, n = (places.values.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
                cover = np.zeros(len(data) + 1, np.int32)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + n + WINDOW - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2).tolist()
                kept = hashlib.sha256()
                for a, b in zip([0, *(b for _, b in edges)], [*(a for a, _ in edges), len(data)], strict=True):
                    kept.update(data[a:b])
                for column, v in zip(out, (int(gone.sum()), kept.hexdigest(), [{"start": a, "stop": b} for a, b in edges]), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            yield pa.record_batch([batch.column("doc_id"), batch.column("own"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "own", "n_removed", "kept", "removed"])

    return in_batches(rows.select("doc_id", "own", "text", "places"), run, "doc_id long, own long, n_removed long, kept string, removed array<struct<start:int,stop:int>>")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (byte spans) of each row of docs.

    Null texts are empty. Rows with a null doc_id are neither earlier nor later than any: they stay whole. Rows that
    repeat an id are judged against smaller ids and what stands earlier in their own text; rows that repeat id and
    text are judged alike. Texts of under 100 bytes stay whole. Other columns are not looked at. Without rows there is no row.
    """
    rows, firsts, near, n_leaves = shared_texts(docs, deal)
    places = earlier(near, n_leaves).groupBy("doc_id", "own").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    changed = _cut(near.join(places, ["doc_id", "own"])).withColumnsRenamed({"doc_id": "_cd", "own": "_co"})
    firsts = firsts.join(changed, (F.col("_d") == F.col("_cd")) & (F.col("_o") == F.col("_co")), "left")
    # by document, not by text: copies of one text, however many, are rows of many keys
    out = rows.join(firsts, (F.col("doc_id") == F.col("_d")) & (F.col("own") == F.col("_o")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("_d").isNull() & (F.col("n_words") >= WINDOW)
    none = F.array().cast("array<struct<start:int,stop:int>>")
    every = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))
    removed = F.when(copy, every).otherwise(F.coalesce("removed", none))
    return out.select(
        "doc_id",
        F.col("n_words").alias("n_bytes"),
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.size(removed).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        removed.alias("removed"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    return deduplicated(table(spark, sf_dir, "documents")).drop("removed")


OP11_SQL = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
blobs AS (SELECT doc_id, encode(coalesce(text, '')) b FROM documents),
wins AS (SELECT doc_id, i, md5_number(b[i + 1 : i + 100]) g FROM blobs, unnest(range(0, octet_length(b) - 99)) t(i) WHERE octet_length(b) >= 100),
least AS (SELECT g, min({'d': doc_id, 'i': i}) f FROM wins GROUP BY g HAVING count(*) > 1),
found AS (SELECT doc_id, i FROM wins JOIN least USING (g) WHERE f <> {'d': doc_id, 'i': i}),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END fresh FROM found WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, min(i) a, max(i) + 100 b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) s FROM marked) GROUP BY doc_id, s),
pieces AS (
  SELECT doc_id, b p, lead(a) OVER (PARTITION BY doc_id ORDER BY a) q FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id
),
cut AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (coalesce(q, length(h) // 2) - p)), '' ORDER BY p) t FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) n, count(*) k FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) n_bytes, CAST(coalesce(n, 0) AS BIGINT) n_removed, CAST(coalesce(k, 0) AS BIGINT) n_spans, sha256(unhex(coalesce(t, h))) kept_sha256
FROM docs d LEFT JOIN cut USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
