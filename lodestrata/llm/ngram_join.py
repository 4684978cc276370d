"""N-gram Jaccard join by parity sketches.

A document's set is its distinct 5-word shingles, as 64-bit hashes. In a size band each shingle belongs to one of k parts by its
hash, and a part's word is the XOR of its shingles' hashes: a bit sketch in which one shingle of difference
changes one part at most, so the number of parts that differ is a lower bound of the symmetric difference. Two sets
with a Jaccard similarity of at least 3/4 differ in at most D = (|A| + |B|) / 7 shingles, so of k > D parts all but D agree.

1. Sketch words are dealt out by their value (packed, one row a batch and partition), and each task counts in
   how many different sets each of its words occurs. Sets that hold more than D words of their own have no
   partner and are done; those are nearly all.
2. Others join on their D + 1 rarest words (pigeonhole: two sets that agree in k - D parts share one of those). Words that
   the same sets hold have one key, so that a pair of near copies meets once and not in each word.
   Small buckets give all their pairs; large ones link each member to the smallest and to the one before in its block. Of the
   pairs only those go on whose fine sketches (a bit of parity for each of many parts) differ in D bits at most.
3. Pairs are verified on whole sets; components are built from the links. In large buckets that hold several
   components, members of different ones are then compared by their fine sketches, a bounded pair of blocks in each task: first
   a forest of compatible pairs is verified, then those of what is still apart. Few such pairs are listed; where there are more
   than rows, the whole sets come to the pair of blocks, which verifies until its components are joined or all their
   pairs are seen. So no task and no table holds a bucket's pairs.

Equal sets are one class from the start and never make pairs. Sets of fewer than SMALL shingles use one part
a shingle. Hash collisions of words add
candidates at most; a set's identity is a 128-bit fingerprint, of which links carry 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import HOT, by_part, forget, in_batches, meet, mix, runs_of, shuffles, slices, small_or_shuffled, text_bytes, word_hashes, written
from lodestrata.llm.dealing import DEALT, PLAIN, anywhere, dealt_batch, packed
from lodestrata.llm.dealing import HOT as COMMON
from lodestrata.llm.dealing import told as told_keys
from lodestrata.llm.graph import components
from lodestrata.session import table

WIDTH, SMALL, BUCKET = 5, 64, 8
#: Rows and shingles of a block of a large bucket, and compatible pairs a row that a pair of blocks lists at most.
BLOCK, WEIGHT, MOST = 512, 1 << 19, 1
#: Shares of a task's rows by which pairs of blocks are dealt out.
SHARES = 8
SALT = np.uint64(0xD6E8FEB86659FD93)


def shingles(data: bytes) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    words = data.lower().split()
    hashes = word_hashes(words)
    if len(words) < WIDTH:
        return mix(runs_of(hashes, len(words)) ^ np.uint64(len(words))) if words else np.empty(0, np.uint64)
    return np.unique(runs_of(hashes, WIDTH))


def bands(n: int) -> list[tuple[int, int, int]]:
    """(band, parts, D) in which a set of n shingles takes part; a pair meets in its larger set's band.

    parts is 0 for one part a shingle. The parts outnumber the largest D of a band by a tenth, and by more
    where chance may leave parts empty.
    """
    out = []
    for top, role in ((n, "own"), (4 * n // 3, "next")):
        low = 0 if top < SMALL else 1 << (top.bit_length() - 1)
        if role == "next" and low == out[0][0]:
            break
        most = 4 * n // 3 if role == "next" else min(4 * n // 3, 2 * low - 1 if low else SMALL - 1)
        out.append((low, int(0.63 * low + 2 * low**0.5) if low else 0, (n + max(most, n)) // 7))
    return out


def sketch(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part words by XOR, and which parts hold anything."""
    at = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    words, full = np.zeros(parts, np.uint64), np.zeros(parts, bool)
    np.bitwise_xor.at(words, at, hashes)
    full[at] = True
    return words, full


def parities(hashes: np.ndarray, band: int) -> np.ndarray:
    """One bit for each of many parts: whether it holds an odd number of shingles. As 64-bit words."""
    bits = 8 * max(band, 2 * SMALL)
    at = (mix(hashes ^ SALT) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(bool)).view(np.uint64)


def elements(hashes: np.ndarray, band: int, parts: int) -> np.ndarray:
    """A 64-bit key for each part's word that is not empty; equal words of different parts or bands differ."""
    if not parts:
        return mix(hashes ^ SALT)
    words, full = sketch(hashes, parts)
    at = np.flatnonzero(full)
    return mix(words[at] ^ mix(at.astype(np.uint64) + np.uint64(band * int(SALT) % (1 << 64))))


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    one, two = int(mix(hashes ^ SALT).sum(dtype=np.uint64)), int(mix(hashes + SALT).sum(dtype=np.uint64))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(one), signed(two)


DOC = ["valid", "doc_id", "mark", "n", "fp1", "fp2", "full0", "full1"]
TOLD = "kind int, doc_id long, mark long, n long, fp1 long, fp2 long, full0 long, full1 long, key long, df long, band long, count long"


def deal(docs: DataFrame, n_parts: int) -> DataFrame:
    """Per batch and part: the batch's document rows (kind 0) and sketch words with their sets (kind 1)."""

    def run(batches):
        import xxhash

        free = anywhere(n_parts)
        forget()
        for batch in slices(batches, 1024, 4 << 20):
            rows, seen, keys, owners, bandof = [], set(), [], [], []
            for doc, data in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                h = shingles(data)
                fp, full = fingerprint(h), [0, 0]
                fresh = len(h) and fp not in seen
                seen.add(fp)
                for i, (band, parts, most) in enumerate(bands(len(h)) if len(h) else ()):
                    if fresh:
                        e = elements(h, band, parts)
                        full[i] = len(e)
                        if len(e) <= most:
                            raise RuntimeError("a sketch has too few filled parts for its bound")
                        keys.append(e)
                        owners.append(np.full(len(e), fp[0], np.int64))
                        bandof.append(np.full(len(e), band, np.int32))
                mark = xxhash.xxh64_intdigest(data, 42)
                rows.append((doc is not None, doc or 0, mark - (1 << 64) if mark >> 63 else mark, len(h), *fp, *full))
            out = [(next(free), PLAIN, np.array(rows, np.int64).tobytes(), b"")] if rows else []
            if keys:
                out += packed(np.concatenate(keys), np.concatenate(owners), np.concatenate(bandof), n_parts)
            yield dealt_batch(out)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_batches(source, run, DEALT)


def alike(fps: np.ndarray, bands: np.ndarray, keys: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of words with all their sets: set, band, key, df and number of words, one row for those words of a set that the same sets hold."""
    if not len(keys):
        return fps, bands, keys, df, df
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    owners = mix(np.add.reduceat(mix(fps.view(np.uint64) ^ SALT), first)).view(np.int64)
    keys = np.where(df < COMMON, np.repeat(owners, np.diff(np.r_[first, len(keys)])), keys)
    order = np.lexsort((keys, bands, fps))
    fps, bands, keys, df = (c[order] for c in (fps, bands, keys, df))
    first = np.flatnonzero(np.r_[True, (fps[1:] != fps[:-1]) | (bands[1:] != bands[:-1]) | (keys[1:] != keys[:-1])])
    return fps[first], bands[first], keys[first], df[first], np.diff(np.r_[first, len(keys)])


def tell(dealt: DataFrame) -> DataFrame:
    """Document rows, and of each part how many words (count) each set shares with the same other sets.

    key stands for those sets and df is their number; of a common word, whose sets are not known together, key is the word.
    """

    def emit(kind: int, cols: dict, n: int) -> pa.RecordBatch:
        names = [x.split()[0] for x in TOLD.split(", ")]
        full = {"kind": pa.array(np.full(n, kind, np.int32)), **cols}
        return pa.record_batch([full.get(c, pa.nulls(n, pa.int64())) for c in names], names)

    def run(batches):
        for x in told_keys(batches):
            if isinstance(x, bytes):
                m = np.frombuffer(x, np.int64).reshape(-1, len(DOC))
                cols = {name: pa.array(m[:, i]) for i, name in enumerate(DOC) if i}
                cols["doc_id"] = pa.array(m[:, 1], mask=m[:, 0] == 0)
                yield emit(0, cols, len(m))
            else:
                cols = dict(zip(("fp1", "band", "key", "df", "count"), map(pa.array, alike(*x)), strict=True))
                yield emit(1, cols, len(cols["key"]))

    return in_batches(by_part(dealt), run, TOLD)


def rarest(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """key, band, fp1, n of the D + 1 rarest words of every set that may have a partner, where two sets share it.

    Words that the same sets hold have one key and follow each other in the order of words, which is by df and key: so that a
    set's words of one key count together, and the key stands for all of them.
    """
    n, low = F.col("n"), F.col("band")
    wide = F.floor(4 * n / 3)
    own = F.when(low == 0, F.lit(SMALL - 1)).otherwise(2 * low - 1)
    is_own = n >= low
    most = F.when(is_own, F.greatest(F.least(wide, own), n)).otherwise(wide)
    d = F.floor((n + most) / 7)
    full = F.when(is_own, F.col("full0")).otherwise(F.col("full1"))
    # dealt out by set once: the counts, their sums and the join with sets all keep to it
    words = shared.repartition(shuffles(shared.sparkSession), "fp1").groupBy("fp1", "band", "df", "key")
    words = words.agg(F.when(F.col("df") < COMMON, F.sum("count")).otherwise(1).alias("count"))  # a common word may be told of a set twice
    own = Window.partitionBy("fp1", "band")
    words = words.withColumns({"held": F.sum("count").over(own), "before": F.sum("count").over(own.orderBy("df", "key")) - F.col("count")})
    words = words.join(sets.select("fp1", "n", "full0", "full1"), "fp1").withColumns({"most": d, "alone": full - F.col("held")})
    return words.where((F.col("alone") <= F.col("most")) & (F.col("before") + F.col("alone") <= F.col("most"))).select("fp1", "band", "n", "key")


def own_band(n: np.ndarray) -> np.ndarray:
    return np.where(n < SMALL, 0, np.int64(1) << np.floor(np.log2(np.maximum(n, 1))).astype(np.int64))


ROW = ("key", "band", "block", "size", "lead_n", "lead_fp", "fp1", "n")


def pairs_of(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a, b, band) of rows (ROW): all of a small bucket; of a large one each member with the bucket's smallest
    and with the one before in its block. Pairs whose sizes rule a link out, or that meet in another band, are left out."""

    def run(batches):
        held = np.empty((len(ROW), 0), np.int64)  # the last rows, for pairs across batches
        for batch in batches:
            new = held.shape[1]
            held = np.concatenate([held, np.array([batch.column(c).to_numpy() for c in ROW])], axis=1)
            key, band, block, size, lead_n, lead_fp, fp, n = held
            larger = own_band(n) == band  # rows are in order of n, so a pair's later one is its larger
            larger[:new] = False
            found = []
            for d in range(1, min(BUCKET, len(n))):
                pair = larger[d:] & (key[d:] == key[:-d]) & (band[d:] == band[:-d]) & (block[d:] == block[:-d]) & (4 * n[:-d] >= 3 * n[d:]) & (fp[:-d] != fp[d:])
                j = np.flatnonzero(pair if d == 1 else pair & (size[d:] <= BUCKET))
                found.append((fp[j], fp[j + d], band[j]))
            j = np.flatnonzero(larger & (size > BUCKET) & (4 * lead_n >= 3 * n) & (lead_fp != fp))
            found.append((lead_fp[j], fp[j], band[j]))
            one, two, bands_ = (np.concatenate([f[i] for f in found]) for i in range(3))
            held = held[:, max(0, len(n) - BUCKET + 1) :].copy()
            yield pa.record_batch([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(bands_)], ["a", "b", "band"])

    by = ("key", "band", "block")
    dealt = rows.repartition(shuffles(rows.sparkSession), *by).sortWithinPartitions(*by, "n", "fp1")
    return dealt.select(*ROW).mapInArrow(run, "a long, b long, band long").distinct()


def near_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of pairs (a, b, band) whose sketches (fp1, n, band, words) differ in no more bits than linked sets can."""

    def run(batches):
        for batch in slices(batches):
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "wa", "wb")), strict=True):
                apart = np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum()
                keep.append(bool(apart <= (n + m) // 7))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sketches.select(F.col("fp1").alias("a"), "band", "n", F.col("words").alias("wa"))
    two = sketches.select(F.col("fp1").alias("b"), "band", F.col("n").alias("m"), F.col("words").alias("wb"))
    return pairs.join(one, ["a", "band"]).join(two, ["b", "band"]).select("a", "b", "n", "m", "wa", "wb").mapInArrow(run, "a long, b long")


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp1, n, tokens (sorted hashes) and for each of its bands a fine sketch, of the sets wanted (doc_id, mark)."""

    def run(batches):
        for batch in slices(batches):
            out = [[], [], [], []]
            for data in text_bytes(batch):
                h = shingles(data)
                sketches = [{"band": band, "words": parities(h, band).tobytes()} for band, _, _ in bands(len(h))]
                for column, v in zip(out, (fingerprint(h)[0], len(h), h.tobytes(), sketches), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("band", pa.int64()), ("words", pa.binary())])))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["fp1", "n", "tokens", "sketches"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    wanted = wanted.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"))
    wanted = small_or_shuffled(wanted)
    own = source.join(wanted, source.doc_id.eqNullSafe(wanted._d) & (source.mark == wanted._m), "left_semi")
    return in_batches(own.select("text"), run, "fp1 long, n long, tokens binary, sketches array<struct<band:long,words:binary>>").dropDuplicates(["fp1"])


def linked(one: bytes, two: bytes) -> bool:
    x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True)) if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) else 0
    return 100 * both >= 75 * (len(x) + len(y) - both)


def only(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of sets that wanted (fp1) names: if they are few, the others meet no shuffle."""
    return sets.join(small_or_shuffled(written(wanted.select("fp1").distinct(), "ends")), "fp1", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose whole sets have a Jaccard similarity of at least 3/4."""

    def run(batches):
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                keep.append(linked(x, y))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    tokens = only(sets.select("fp1", "tokens"), pairs.select(F.col("a").alias("fp1")).union(pairs.select("b")))
    both = pairs.join(tokens.withColumnsRenamed({"fp1": "a", "tokens": "ta"}), "a").join(tokens.withColumnsRenamed({"fp1": "b", "tokens": "tb"}), "b")
    return in_batches(both.select("a", "b", "ta", "tb"), run, "a long, b long")


def blocks_apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of large buckets that hold several components, once for each pair (p, q) of blocks to be compared.

    The bucket's largest component needs no comparison with itself: its blocks only meet those of all others, which also
    meet each other. Blocks are cut by rows and shingles, so that no pair of them is large.

    deal says which pairs of blocks go to a task together: those of buckets with the same largest component, in SHARES shares of a
    task's rows. They hold much the same sets, whose sketches then lie side by side and compress.
    """
    large = members.where(F.col("size") > BUCKET).select("key", "band", "fp1", "n")
    now = large.join(labels.withColumnRenamed("node", "fp1"), "fp1", "left").withColumn("comp", F.coalesce("comp", "fp1"))
    each = now.groupBy("key", "band", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    tops = each.groupBy("key", "band").agg(F.max(F.struct("c", "w", "comp")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda c, w: F.ceil(F.greatest(c / BLOCK, w / WEIGHT))
    one = blocks(F.col("c"), F.col("w")) == 1
    tops = tops.select("key", "band", F.col("top.comp").alias("family"), F.col("top.c").alias("top_c"), "c", F.when(~one, F.col("top.comp")).alias("main"), F.when(one, 1).otherwise(blocks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w"))).alias("minor"), F.when(one, 0).otherwise(blocks(F.col("top.c"), F.col("top.w"))).alias("major"), (F.col("c") > large.count() * HOT).alias("hot"))
    made = F.when(F.col("major") == 0, F.col("c")).otherwise((F.col("c") - F.col("top_c")) * (F.col("minor") + F.col("major")) + F.col("top_c") * F.col("minor"))
    tops = written(tops.withColumn("made", made).drop("c", "top_c"), "tops")
    share = max(1, (tops.agg(F.sum("made")).first()[0] or 0) // (SHARES * shuffles(members.sparkSession)))
    families = tops.groupBy("band", "family").agg(F.ceil(F.sum("made") / share).alias("shares"), (F.count("*") > tops.count() * HOT).alias("hot"))
    tops = meet(tops.withColumnRenamed("hot", "hot_key"), written(families, "families"), ["band", "family"]).drop("hot").withColumnRenamed("hot_key", "hot")
    now = meet(now, written(tops, "tops"), ["key", "band"]).drop("hot")
    is_main = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    own = F.when(is_main, F.col("minor") + F.pmod(F.xxhash64("fp1"), "major")).otherwise(F.pmod(F.xxhash64("fp1"), "minor"))
    others = F.sequence(F.lit(0).cast("long"), F.when(is_main, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1)
    now = now.withColumn("block", own).withColumn("other", F.explode(others))
    now = now.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})
    deal = F.xxhash64("band", "family", F.pmod(F.xxhash64("key", "p", "q"), "shares"))
    return now.select("key", "band", "p", "q", "block", "fp1", "n", "comp", deal.alias("deal"))


class Apart:
    """Two blocks of a bucket: pairs of different components whose sketches keep the bound."""

    def __init__(self, band: int, p: int, q: int, rows: list[tuple]):
        blocks, self.fp, self.n, comp = (np.array(c, np.int64) for c in zip(*(r[:4] for r in rows), strict=True))
        self.words = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)
        self.band, self.mine, self.theirs = band, np.flatnonzero(blocks == p), np.flatnonzero(blocks == q)
        self.same, (_, self.at) = p == q, np.unique(comp, return_inverse=True)

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Each pair is still apart when it is given; `join` tells that it no longer is."""
        for i in self.mine.tolist():
            n, m = self.n[self.theirs], self.n[i]
            fits = (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (np.maximum(n, m) >= self.band) & (self.at[self.theirs] != self.at[i])
            others = self.theirs[fits & (self.theirs > i) if self.same else fits]
            near = np.bitwise_count(self.words[others] ^ self.words[i]).sum(axis=1) <= (self.n[others] + m) // 7
            for j in others[near].tolist():
                if self.at[j] != self.at[i]:
                    yield i, j

    def join(self, i: int, j: int) -> None:
        self.at[self.at == self.at[i]] = self.at[j]


def grouped(batches, columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, band, p, q) and the rows of columns of each, from rows sorted by it."""
    now, rows = None, []
    for batch in batches:
        for key, band, p, q, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "band", "p", "q", *columns)), strict=True):
            if (key, band, p, q) != now:
                if rows:
                    yield now, rows
                now, rows = (key, band, p, q), []
            rows.append(tuple(row))
    if rows:
        yield now, rows


def _by_blocks(rows: DataFrame) -> DataFrame:
    by = ("key", "band", "p", "q")
    return rows.repartition(shuffles(rows.sparkSession), "deal").sortWithinPartitions(*by, "fp1")


def pairs_apart(blocks: DataFrame, sketches: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs (a, b) still apart whose sketches keep the bound, with their key, band, p and q; of a pair of blocks with more than `most` a row these alone.

    Without most, a forest of such pairs: those that would join what the ones before leave apart.
    """

    def run(batches):
        for (key, band, p, q), rows in grouped(batches, ("block", "fp1", "n", "comp", "words")):
            apart = Apart(band, p, q, rows)
            if most is None:
                found = []
                for i, j in apart.pairs():
                    apart.join(i, j)
                    found.append((i, j))
            else:
                found = list(islice(apart.pairs(), most * len(rows) + 1))
            if most is not None and len(found) > most * len(rows):
                yield pa.record_batch([pa.array([x], pa.int64()) for x in (None, None, key, band, p, q)], ["a", "b", "key", "band", "p", "q"])
            elif found:
                i, j = apart.fp[np.array(found)].T
                cols = [pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), *(pa.array(np.full(len(i), x)) for x in (key, band, p, q))]
                yield pa.record_batch(cols, ["a", "b", "key", "band", "p", "q"])

    rows = blocks.join(sketches.select("fp1", "band", "words"), ["fp1", "band"])
    return _by_blocks(rows).select("key", "band", "p", "q", "block", "fp1", "n", "comp", "words").mapInArrow(run, "a long, b long, key long, band long, p long, q long")


def links_apart(blocks: DataFrame, sketches: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links (a, b) within pairs of blocks, verified where they are found: a forest of what was apart, so one row a member at most."""

    def run(batches):
        for (_, band, p, q), rows in grouped(batches, ("block", "fp1", "n", "comp", "words", "tokens")):
            apart, out = Apart(band, p, q, rows), [[], []]
            for i, j in apart.pairs():
                if linked(rows[i][5], rows[j][5]):
                    apart.join(i, j)
                    out[0].append(min(rows[i][1], rows[j][1]))
                    out[1].append(max(rows[i][1], rows[j][1]))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    sketches, tokens = only(sketches, blocks), only(tokens, blocks)
    rows = blocks.join(sketches.select("fp1", "band", "words"), ["fp1", "band"]).join(tokens.select("fp1", "tokens"), "fp1")
    return _by_blocks(rows).select("key", "band", "p", "q", "block", "fp1", "n", "comp", "words", "tokens").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, n, fp1, fp2) of docs, and per set (fp1, fp2) its class, smallest doc_id and first member.

    Null and empty texts have no shingles and are in no class. Every row counts, also where ids repeat or are
    null; a class of null ids alone has a null smallest doc_id. mark is a hash of the text.
    """
    spark = docs.sparkSession
    told = written(tell(deal(docs, 3 * shuffles(spark))), "told")
    rows = told.where("kind = 0").select("doc_id", "mark", "n", "fp1", "fp2", "full0", "full1")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    # full0 and full1 are 0 on those rows of a set that repeat within a batch
    sets = rows.where("n > 0").groupBy("fp1", "fp2").agg(F.first("n").alias("n"), F.max("full0").alias("full0"), F.max("full1").alias("full1"), first.alias("first"), F.count("*").alias("copies"))
    sets = written(sets, "sets")
    shared = told.where("kind = 1").select("fp1", "key", "df", "band", "count")
    rare = written(rarest(shared, sets), "rare")
    sizes = rare.groupBy("key", "band").agg(F.count("*").alias("size"), F.min(F.struct("n", "fp1")).alias("lead")).where("size > 1")
    sizes = sizes.select("key", "band", "size", F.col("lead.n").alias("lead_n"), F.col("lead.fp1").alias("lead_fp"))
    block = F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("fp1"), F.ceil(F.col("size") / BLOCK))).otherwise(F.lit(0).cast("long"))
    sizes = written(sizes.withColumn("hot", F.col("size") > rare.count() * HOT), "sizes")
    members = written(meet(rare, sizes, ["key", "band"]).drop("hot").withColumn("block", block), "members")
    pairs = written(pairs_of(members), "pairs")
    in_large = members.where(F.col("size") > BUCKET).select("fp1")
    wanted = pairs.select(F.col("a").alias("fp1")).union(pairs.select("b")).union(in_large).distinct()
    wanted = written(sets.join(wanted, "fp1", "left_semi").select("first.doc_id", "first.mark"), "wanted")
    tokens = written(token_sets(docs, wanted), "tokens")
    sketches = tokens.select("fp1", "n", F.explode("sketches").alias("s")).select("fp1", "n", F.col("s.band").alias("band"), F.col("s.words").alias("words"))
    near = written(near_pairs(pairs, sketches), "near")  # else each task would have a worker for either step
    links = written(verified(near, tokens), "links")
    labels = components(links)
    blocks = written(blocks_apart(members, labels), "blocks")
    if not blocks.isEmpty():
        by = ["key", "band", "p", "q"]
        apart = written(pairs_apart(blocks, sketches), "apart")
        late = written(verified(apart.select("a", "b").distinct(), tokens), "late")
        # a pair of blocks without compatible pairs, or whose forest holds, has nothing more to give
        again = small_or_shuffled(written(apart.join(late, ["a", "b"], "left_anti").select(*by).distinct(), "again"))
        if not late.isEmpty():
            links = links.union(late)
            labels = components(links)
        blocks = blocks.join(again, by, "left_semi").join(labels.select(F.col("node").alias("fp1"), F.col("comp").alias("now")), "fp1", "left")
        blocks = written(blocks.withColumn("comp", F.coalesce("now", "comp")).drop("now"), "blocks")
        apart = written(pairs_apart(blocks, sketches, MOST), "apart")
        many = small_or_shuffled(written(apart.where("a IS NULL").select(*by), "many"))
        late = verified(apart.where("a IS NOT NULL").select("a", "b").distinct(), tokens)
        if not many.isEmpty():
            late = late.union(links_apart(blocks.join(many, by, "left_semi"), sketches, tokens))
        late = written(late, "late")
        if not late.isEmpty():
            labels = components(links.union(late))
    # copies of one set and sets linked: the smallest member of each class. The largest classes and sets of most copies meet no shuffle by their key
    labels = written(labels.select(F.col("node").alias("fp1"), "comp"), "classes")
    linked_ = sets.join(labels, "fp1")
    best = linked_.groupBy("comp").agg(F.min("first").alias("best"), (F.count("*") > labels.count() * HOT).alias("hot"))
    linked_ = meet(linked_, written(best, "best"), ["comp"]).drop("hot")
    alone = sets.join(labels, "fp1", "left_anti").withColumns({"comp": F.col("fp1"), "best": F.col("first")})
    known = linked_.unionByName(alone).select("fp1", "fp2", "comp", "best", (F.col("copies") > rows.count() * HOT).alias("hot"))
    return rows, written(known, "known")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row, with its mark and its class's first member."""
    rows, known = classes(docs)
    out = meet(rows.select("doc_id", "mark", "n", "fp1", "fp2"), known, ["fp1", "fp2"], "left", 10_000)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), "mark", "best")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but the first member (smallest doc_id, then hash of text) of each class; texts without shingles stay.

    Of rows with the same id and the same text one stays: the first by its columns as JSON. Null ids are last of a class.
    Columns may have any names; without rows there is no row.
    """
    found = joined(docs).select("doc_id", "mark", "best").where("best IS NOT NULL")
    own = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("mark") == F.col("best.mark"))
    found = written(found.withColumn("own", own), "found")
    key = lambda df, d, m: df.select(F.col("doc_id").alias(d), F.col("mark").alias(m))
    gone = small_or_shuffled(written(key(found.where("NOT own"), "_d", "_m").distinct(), "gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m"))
    left = rows.join(gone, same, "left_anti")
    twice = written(key(found.where("own"), "_d", "_m").groupBy("_d", "_m").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "twice")
    if not twice.isEmpty():
        twice = small_or_shuffled(twice)
        one = left.join(twice, same, "left_semi").groupBy("doc_id", "mark").agg(F.min_by("row", F.to_json("row")).alias("row"))
        left = left.join(twice, same, "left_anti").select("row").unionByName(one.select("row"))
    return left.select("row.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') w FROM documents),
sets AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) s FROM words WHERE len(w) > 0),
items AS MATERIALIZED (SELECT doc_id, len(s) n, unnest(s) x FROM sets),
both_ AS (SELECT a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) c FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM both_ WHERE 100 * c >= 75 * (na + nb - c)),
reach AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a doc_id, min(b) component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(len(s), 0) AS BIGINT) n_shingles, component_id FROM documents d LEFT JOIN sets USING (doc_id) JOIN least USING (doc_id)
"""
