"""64-bit keys dealt out by value in packed rows, so that tasks see which keys several owners share.

A row holds one batch's keys of one part: a header for each run of one owner (owner, band, number of keys), and
the keys' low 56 bits. That is about 8 bytes a key where a row of columns would take several times as much. A
collision can only make a key look shared.

Common keys don't meet in one task: a key that LOCAL owners of a batch hold is known to be common there, so its owners
are dealt out by owner and only a mark goes to the key's part. A task that reads a part lets go of a key's owners
as soon as HOT of them are known. Either way all owners of such a key are told HOT as their number, so that the order of
keys by (number, key) is the same for all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

HEAD = np.dtype([("owner", "<i8"), ("band", "<u4"), ("n", "<u4")])
DEALT = "part int, kind int, a binary, c binary"
PLAIN, KEYS, KNOWN, MARKS = range(4)
LOCAL, HOT = 64, 1 << 15
#: Keys that a task holds before it looks for common ones.
HELD = 1 << 22
LOW = np.uint64((1 << 56) - 1)

Told = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _bytes(keys: np.ndarray) -> bytes:
    return keys.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view(np.int64).ravel()


def split(part: np.ndarray, n_parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, and the places of its entries in order."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(n_parts + 1))
    for p in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield p, order[edges[p] : edges[p + 1]]


def packed(keys: np.ndarray, owners: np.ndarray, bands: np.ndarray, n_parts: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(part, kind, headers, keys) of a batch's keys; owners stand together and hold a key once."""
    s = np.sort(keys)
    common = np.unique(s[LOCAL - 1 :][s[LOCAL - 1 :] == s[: max(0, len(s) - LOCAL + 1)]])
    known = np.isin(keys, common) if len(common) else np.zeros(len(keys), bool)
    for kind, pick, by in ((KEYS, ~known, keys), (KNOWN, known, owners.view(np.uint64))):
        at = np.flatnonzero(pick)
        for p, i in split((by[at] % np.uint64(n_parts)).astype(np.int64), n_parts):
            own, band = owners[at[i]], bands[at[i]]
            first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (band[1:] != band[:-1])])
            head = np.empty(len(first), HEAD)
            head["owner"], head["band"], head["n"] = own[first], band[first], np.diff(np.r_[first, len(own)])
            yield p, kind, head.tobytes(), _bytes(keys[at[i]])
    for p, i in split((common % np.uint64(n_parts)).astype(np.int64), n_parts):
        yield p, MARKS, b"", _bytes(common[i])


def anywhere(n_parts: int) -> Iterator[int]:
    """Parts for rows that only pass through: different ones for each row of a task, and for different tasks."""
    from pyspark import TaskContext

    seed = np.random.default_rng(TaskContext.get().partitionId())
    while True:
        yield int(seed.integers(n_parts))


def dealt_batch(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "kind", "a", "c"])


def dealt_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(x).to_pylist() for x in ("part", "kind", "a", "c")), strict=True)


def unpacked(a: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, band and key of each entry of a row."""
    head = np.frombuffer(a, HEAD)
    return np.repeat(head["owner"], head["n"]), np.repeat(head["band"], head["n"]).astype(np.int64), _keys(c)


class Part:
    """The keys of one part, as far as they have been read."""

    def __init__(self):
        self.held, self.n, self.most, self.hot = [], 0, HELD, np.empty(0, np.int64)

    def mark(self, c: bytes) -> None:
        self.hot = np.union1d(self.hot, _keys(c))

    def add(self, a: bytes, c: bytes) -> Iterator[Told]:
        self.held.append(unpacked(a, c))
        self.n += len(self.held[-1][0])
        if self.n > self.most:
            yield self.fold(False)
            self.most = max(HELD, 2 * self.n)

    def fold(self, last: bool) -> Told:
        """owner, band, key and number of owners of what can be told by now: common keys, and at last all that are shared."""
        owners, bands, keys = (np.concatenate([h[i] for h in self.held]) if self.held else np.empty(0, np.int64) for i in range(3))
        if last:
            order = np.argsort(keys, kind="stable")
            keys, owners, bands = keys[order], owners[order], bands[order]
            near = np.isin(keys, self.hot) if len(self.hot) else np.zeros(len(keys), bool)
            same = keys[1:] == keys[:-1]
            near[1:] |= same
            near[:-1] |= same
            keys, owners, bands = keys[near], owners[near], bands[near]
        order = np.lexsort((owners, keys))
        keys, owners, bands = keys[order], owners[order], bands[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
        keys, owners, bands = keys[first], owners[first], bands[first]
        _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        n = n[at] if len(keys) else np.empty(0, np.int64)
        hot = (n >= HOT) | np.isin(keys, self.hot)
        if not last:
            self.hot = np.union1d(self.hot, keys[hot])
            self.held, self.n = [(owners[~hot], bands[~hot], keys[~hot])], int((~hot).sum())
        tell = hot | (n > 1) if last else hot
        return owners[tell], bands[tell], keys[tell], np.where(hot, HOT, n)[tell].astype(np.int64)


def told(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes | Told]:
    """Of rows sorted by part: the plain ones as they are, and owner, band, key and number of owners of all shared keys."""
    now, part = None, None
    for p, kind, a, c in dealt_rows(batches):
        if p != now:
            if part:
                yield part.fold(True)
            now, part = p, Part()
        if kind == PLAIN:
            yield a
        elif kind == KNOWN:
            owners, bands, keys = unpacked(a, c)
            yield owners, bands, keys, np.full(len(keys), HOT, np.int64)
        elif kind == MARKS:
            part.mark(c)
        else:
            yield from part.add(a, c)
    if part:
        yield part.fold(True)
