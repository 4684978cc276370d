"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the rows of its hashed features: the word and its first 3, 4 and 5 bytes. Filters
of several widths run over all words of a text; the maximum of each over the text, cut off at zero, goes
into one logistic unit. Embeddings start from the log-odds of their features among training texts and all weights are then
trained together by Adam; only the words under a maximum get a gradient.

Training takes at most MAX_TRAIN labelled documents of at most MAX_CHARS characters (those whose hashed ids come first, without a
fifth of them), a documented bound. All labelled documents outside the held-out third that did not train calibrate the rejection threshold of each
language, by histograms of their scores. Every document is scored whole: long texts in
steps that overlap by the widest filter. lang, source, ids and labels are no inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import ALNUM, SMALL_ROWS, forget, in_batches, of_rows, slices, with_rows, written
from lodestrata.session import table

MAX_TRAIN, BUCKETS, DIM, WIDTHS, FILTERS = 6000, 1 << 16, 16, (1, 2, 3), 8
EPOCHS, STEPS, BATCH, RATE, SEED = 3, 120, 128, 0.01, 7
MARGIN = max(WIDTHS) - 1
#: Characters of all training texts together.
MAX_CHARS = 1 << 26
#: Bins of the histograms of scores.
BINS = 10_000
#: Words that are convolved at once.
STEP = 60_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(ALNUM).split()


def features(words: list[bytes]) -> np.ndarray:
    """Bucket numbers of each word's features; bucket 0 is kept for padding."""
    crc, n = zlib.crc32, BUCKETS - 1
    each = (x % n + 1 for w in words for x in (crc(w), crc(w[:3], 3), crc(w[:4], 4), crc(w[:5], 5)))
    return np.fromiter(each, np.int32, 4 * len(words)).reshape(len(words), 4)


class Words:
    """A text's words by its different ones (with blanks between) and the place of each: goes through like a list of words, in a tenth of its memory."""

    def __init__(self, different: bytes, places: bytes):
        self.different, self.places = different, np.frombuffer(places, np.int32)

    @classmethod
    def of(cls, words: list[bytes]) -> Words:
        known: dict[bytes, int] = {}
        places = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
        return cls(b" ".join(known), places.tobytes())

    def __len__(self) -> int:
        return len(self.places)

    def __iter__(self) -> Iterator[bytes]:
        return map(self.different.split().__getitem__, self.places.tolist())


def numbered(texts: list[Words]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Features by word number (0 is padding), and the numbers of each text's words, with padding: all of them in one array."""
    known: dict[bytes, int] = {}
    ends = np.cumsum([len(t) + MARGIN for t in texts])
    out = np.zeros(ends[-1], np.int32)
    for t, end in zip(texts, ends.tolist(), strict=True):
        own = np.array([known.setdefault(w, len(known) + 1) for w in t.different.split()], np.int32)
        out[end - MARGIN - len(t) : end - MARGIN] = own[t.places]
    return np.vstack([np.zeros((1, 4), np.int32), features([*known])]), np.split(out, ends[:-1])


class Net:
    """The weights. offsets: the columns of each width's positions in the projected embeddings."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.w = rng.normal(0, 0.3, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32)
        self.c = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.v = rng.normal(0.3, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.b = np.full(1, -2.0, np.float32)
        # the first dimension holds the log-odds: each filter begins as a detector of it
        self.w[0] = np.abs(self.w[0]) + 0.5
        self.e[0] = 0

    def windows(self, table_: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Responses of the k-th width's filters at each place of at (which ends with padding)."""
        first = sum(WIDTHS[:k]) * FILTERS
        n = len(at) - MARGIN
        out = table_[at[:n], first : first + FILTERS]
        for j in range(1, WIDTHS[k]):
            out = out + table_[at[j : n + j], first + j * FILTERS : first + (j + 1) * FILTERS]
        return out

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        best = np.full((len(texts), len(self.c)), -np.inf, np.float32)
        pieces = [(i, lo, min(lo + STEP, len(t))) for i, t in enumerate(texts) for lo in range(0, max(1, len(t)), STEP)]
        at = 0
        while at < len(pieces):
            held, n = [], 0
            while at < len(pieces) and (not held or n + pieces[at][2] - pieces[at][1] <= STEP):
                held.append(pieces[at])
                n += pieces[at][2] - pieces[at][1]
                at += 1
            known: dict[bytes, int] = {}
            places, own = [], []
            for i, lo, hi in held:
                own += [True] * (hi - lo) + [False] * (min(hi + MARGIN, len(texts[i])) - hi + MARGIN)
                places += [known.setdefault(w, len(known) + 1) for w in texts[i][lo : hi + MARGIN]]
                places += [0] * MARGIN
            rows = np.zeros((len(known) + 1, DIM), np.float32)
            if known:
                f = features([*known])
                rows[1:] = self.e[f[:, 0]] + self.e[f[:, 1]] + self.e[f[:, 2]] + self.e[f[:, 3]]
            projected, places, own = rows @ self.w, np.array(places, np.int32), np.array(own, bool)
            ends = np.cumsum([min(hi + MARGIN, len(texts[i])) - lo + MARGIN for i, lo, hi in held])
            starts = np.r_[0, ends[:-1]]
            for k in range(len(WIDTHS)):
                # no window starts in the padding, nor in the words of the next step of a text
                got = self.windows(projected, places, k)
                got[~own[: len(got)]] = -np.inf
                top = np.maximum.reduceat(got, np.minimum(starts, len(got) - 1), axis=0) if len(got) else np.full((len(held), FILTERS), -np.inf, np.float32)
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                for j, (i, _, _) in enumerate(held):
                    best[i, cols] = np.maximum(best[i, cols], top[j])
        best[np.isneginf(best)] = 0  # a text without words
        return np.maximum(best + self.c, 0) @ self.v + self.b[0]

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts).astype(np.float64), -40, 40)))


class Adam:
    def __init__(self, shape, rate: float):
        self.m, self.s, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, x: np.ndarray, g: np.ndarray, rows=slice(None)) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * g
        self.s[rows] = 0.999 * self.s[rows] + 0.001 * g * g
        x[rows] -= self.rate * (self.m[rows] / (1 - 0.9**self.t)) / (np.sqrt(self.s[rows] / (1 - 0.999**self.t)) + 1e-6)


def train(texts: list[list[bytes] | Words], labels: np.ndarray, seed: int = SEED) -> Net:
    """A net fitted to texts (word lists or Words) and their 0/1 labels; few texts are gone through more often."""
    epochs = min(30, max(EPOCHS, -(-STEPS * BATCH // len(texts))))
    net, rng = Net(seed), np.random.default_rng(seed)
    feats, coded = numbered([t if isinstance(t, Words) else Words.of(t) for t in texts])
    # log-odds of each feature by the texts that hold it
    seen = np.zeros((2, BUCKETS), np.float64)
    for c, y in zip(coded, labels, strict=True):
        seen[y, np.unique(feats[c])] += 1
    n = np.bincount(labels, minlength=2) + 1.0
    net.e[:, 0] = np.clip(np.log((seen[1] + 0.3) / n[1]) - np.log((seen[0] + 0.3) / n[0]), -2, 6) / 6 * (seen.sum(axis=0) >= 3)
    net.e[0] = 0
    opt = {k: Adam(getattr(net, k).shape, RATE * (0.5 if k == "e" else 1)) for k in "ewcvb"}
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            rows, at = np.unique(np.concatenate([coded[i] for i in pick]), return_inverse=True)
            f = feats[rows]
            u = net.e[f].sum(axis=1)
            u[rows == 0] = 0
            projected = u @ net.w
            best = np.zeros((len(pick), len(net.c)), np.float32)
            where = np.zeros((len(pick), len(net.c)), np.int64)
            start = 0
            for j, i in enumerate(pick):
                own = at[start : start + len(coded[i])]
                if len(own) > MARGIN:
                    for k in range(len(WIDTHS)):
                        got = net.windows(projected, own, k)
                        cols = slice(k * FILTERS, (k + 1) * FILTERS)
                        top = got.argmax(axis=0)
                        where[j, cols], best[j, cols] = top + start, got[top, np.arange(FILTERS)]
                start += len(coded[i])
            pre = best + net.c
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ net.v + net.b[0], -30, 30)))
            d = ((p - labels[pick]) / len(pick)).astype(np.float32)
            dh = np.outer(d, net.v) * (pre > 0)
            gw, gu = np.zeros_like(net.w), np.zeros_like(u)
            for k, width in enumerate(WIDTHS):
                for j in range(width):
                    first = (sum(WIDTHS[:k]) + j) * FILTERS
                    for q in range(FILTERS):
                        col = k * FILTERS + q
                        place = at[np.minimum(where[:, col] + j, len(at) - 1)]
                        gw[:, first + q] += u[place].T @ dh[:, col]
                        np.add.at(gu, place, np.outer(dh[:, col], net.w[:, first + q]))
            hit = np.flatnonzero(np.abs(gu).sum(axis=1) > 0)
            hit = hit[rows[hit] != 0]
            buckets, inverse = np.unique(f[hit].ravel(), return_inverse=True)
            ge = np.zeros((len(buckets), DIM), np.float32)
            np.add.at(ge, inverse, np.repeat(gu[hit], 4, axis=0))
            opt["v"].step(net.v, h.T @ d + 1e-4 * net.v)
            opt["b"].step(net.b, np.array([d.sum()], np.float32))
            opt["c"].step(net.c, dh.sum(axis=0))
            opt["w"].step(net.w, gw + 1e-4 * net.w)
            if len(buckets):
                opt["e"].step(net.e, ge, buckets)
    net.e[0] = 0
    return net


#: A threshold of a language stays between these, however few of its texts decide it.
LOWEST, HIGHEST = 0.3, 0.9


def _best(bins: list[int], good: list[int], bad: list[int]) -> float:
    """The score with the best F1, between two bins that hold rows; bins descend."""
    hit, n = np.cumsum(bad), np.cumsum(np.add(good, bad))
    i = int((2 * hit / (n + max(1, hit[-1]))).argmax())
    low = (bins[i] + bins[i + 1] + 1) / 2 if i + 1 < len(bins) else bins[i]
    return min(HIGHEST, max(LOWEST, low / BINS))


def thresholds(rows: DataFrame, least: int = 20) -> dict:
    """For each language the score with the best F1 over rows (lang, score, toxic); '' for languages with fewer than least of either label.

    Only histograms of BINS scores reach the driver, of languages with enough rows and of all rows together.
    """
    bins = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    per = written(rows.groupBy("lang", bins).agg(F.sum(1 - F.col("toxic")).alias("good"), F.sum("toxic").alias("bad")), "histogram")
    enough = per.groupBy("lang").agg(F.sum("good").alias("_g"), F.sum("bad").alias("_b")).where((F.col("_g") >= least) & (F.col("_b") >= least) & F.col("lang").isNotNull())
    own = per.join(enough.select("lang"), "lang").select("lang", "bin", "good", "bad")
    total = per.groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).select(F.lit(None).cast("string").alias("lang"), "bin", "good", "bad")
    held: dict = {}
    for r in sorted(own.unionByName(total).collect(), key=lambda r: -r.bin):
        held.setdefault("" if r.lang is None else ("lang", r.lang), []).append(r)
    cut = {k: _best(*zip(*((r.bin, r.good, r.bad) for r in v), strict=True)) for k, v in held.items() if 0 < sum(r.bad for r in v) and 0 < sum(r.good for r in v)}
    return {"": cut.pop("", 0.7)} | {k[1]: t for k, t in cut.items() if k[1]}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _known(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of labelled ids outside the held-out third."""
    use = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    return use.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))


def _with_lang(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))


def with_words(found: DataFrame) -> DataFrame:
    """doc_id, toxic, _h, n (characters) of found (with text), the text's crc32 and its Words: the driver needs no more of it."""

    def run(batches):
        forget()
        for batch in slices(batches):
            out = [[], [], []]
            for text in batch.column("text").to_pylist():
                words = Words.of(words_of(text))
                for column, v in zip(out, (zlib.crc32((text or "").encode()), words.different, words.places.tobytes()), strict=True):
                    column.append(v)
            more = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "toxic", "_h", "n")), *more], ["doc_id", "toxic", "_h", "n", "crc", "words", "places"])

    source = found.select("doc_id", "toxic", "_h", F.coalesce(F.length("text"), F.lit(0)).alias("n"), "text")
    return in_batches(source, run, "doc_id long, toxic int, _h long, n int, crc long, words binary, places binary")


def learned(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_CHARS) -> tuple[Net | None, list[int]]:
    """The net, and the ids it was trained on: labelled rows outside the held-out third.

    At most max_train texts with at most max_chars characters together come to the driver, as Words of the tasks: those whose hashed
    ids, then texts, come first; a text that no longer fits is left out. Rows that repeat an id and text count once.
    They come by one job as Arrow, whatever the number of partitions.
    """
    use = _known(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    found = _with_lang(docs).join(F.broadcast(use), "doc_id").select("doc_id", "text", "toxic", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    found = written(with_words(found), "labelled")  # one pass over all texts
    heads = found.select("doc_id", "_h", "n").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_h").limit(max_train).toArrow()
    chosen, size = [], 0
    for doc_id, h, n in zip(*(heads.column(c).to_pylist() for c in ("doc_id", "_h", "n")), strict=True):
        if size + n <= max_chars:
            size += n
            if zlib.crc32(b"c%d" % doc_id) % 5:  # a fifth only calibrates
                chosen.append((doc_id, h))
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, _h long")
    got = found.join(F.broadcast(wanted), ["doc_id", "_h"], "left_semi").dropDuplicates(["doc_id", "_h"]).select("doc_id", "crc", "toxic", "words", "places").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("crc", "ascending")])
    ids, y = got.column("doc_id").to_pylist(), got.column("toxic").to_numpy().astype(np.int64)
    if len({*y.tolist()}) < 2:
        return None, []
    texts = [Words(*x) for x in zip(got.column("words").to_pylist(), got.column("places").to_pylist(), strict=True)]
    del got
    return train(texts, y), sorted({*ids})


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[Net | None, dict]:
    """The net and the thresholds by language, these from all labelled rows outside the held-out third that did not train."""
    net, ids = learned(docs, labels, max_train)
    if net is None:
        return None, {"": 0.7}
    trained = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    rest = written(_known(labels).join(F.broadcast(trained), "doc_id", "left_anti"), "rest")
    source = _with_lang(docs).where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).join(F.broadcast(trained), "doc_id", "left_anti")
    if rest.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:  # else texts without a label are scored, too, since no text is shuffled
        source = source.join(F.broadcast(rest.select("doc_id")), "doc_id", "left_semi")
    scores = scored(source, net, {"": 1.0}).select("row.doc_id", "row.lang", "score")
    return net, thresholds(scores.join(rest, "doc_id"))


def scored(docs: DataFrame, net: Net | None, limits: dict) -> DataFrame:
    """row (all columns of docs), score and rejected (score at or over its language's threshold) of each row.

    Null and empty texts are scored like a text without words; without a net every score is 0. Every row is
    scored by itself, so repeated rows and ids, null ids and further columns make no difference.
    """
    known = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = known.value
        forget()
        for batch in slices(batches):
            raw = of_rows(batch, "text").to_pylist()
            s = model.scores([words_of(x) for x in raw]) if model and raw else np.zeros(len(raw))
            cut = np.array([limits.get(x, limits[""]) for x in of_rows(batch, "lang").to_pylist()])
            yield pa.record_batch([batch.column("row"), pa.array(s, pa.float64()), pa.array(s >= cut, pa.bool_())], ["row", "score", "rejected"])

    source = with_rows(docs, "text", "lang")
    return in_batches(source, run, T.StructType([source.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))


def cleared(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that a net trained on their labels rejects, at the threshold of their language.

    Null and empty texts are scored as texts without words. Repeated rows and ids are judged alike, labels of null or unknown
    ids teach nothing, and with labels of one kind alone nothing is rejected. Columns may have any names.
    """
    return scored(docs, *fit(docs, labels)).where("NOT rejected").select("row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents`, by a net that learned outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net, _ = learned(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, net, {"": 0.7})
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
