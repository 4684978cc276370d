"""Quality rules: base counts of a text, and robust multivariate outliers among texts of a language and source.

Counts become a vector of logarithms of rates. For each language and source a minimum-covariance-determinant estimate
is found by concentration steps, in which the share H of rows nearest to an estimate gives the next mean and covariance. There are
three starts, all around the medians and scaled by median deviations: without correlations, with those of hyperbolic tangents,
and with those of spatial signs. After FIRST steps the start of the least determinant goes on until no group's determinant falls
any more; each group keeps its least. A variance is at least that
of rounding to whole counts in the group's middle text, which matters only for statistics that hardly vary in the core. Each step is two aggregations over all rows (an exact percentile of
rounded distances, then sums), both combined before the shuffle, and rows meet their group's numbers by a broadcast, that of a bounded
number of large groups if there are too many, so a group may be of any size. Rows whose squared
Mahalanobis distance is beyond the group's own bound are rejected: from its median and upper quartile over all rows,
which up to a quarter of junk cannot move far, the exponential tail of a chi-squared variable is carried on to where CHANCE
rows of the group (with PRIOR more) are to be expected.

Nothing switches with a group's size. Estimates are made for each language and source, each language, and all rows; a language's centre,
covariance and quartiles then count as its rows and those of all as PRIOR rows, and those of a language and source as its rows
against PRIOR rows of its language. So large groups are judged by themselves, and a lone text by its language.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import HOT, in_batches, meet, runs_of, slices, text_bytes, word_hashes, written
from lodestrata.session import table

WINDOW, H = 8, 0.75
#: How many rows what stands above a group counts for: about as many as six dimensions need.
PRIOR = 40
MIN_WORDS, MAX_REPEAT = 20, 30
#: Distances are scaled by their median over that of a chi-squared variable with 6 degrees. CHANCE: expected false rejections in a group.
MEDIAN, CHANCE = 5.348, 0.01
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
P = 6
#: A group is at rest when the logarithm of its determinant falls by no more than this.
REST = 1e-3
#: Steps of every start, before the best goes on.
FIRST = 2


def counts(data: bytes) -> tuple[int, ...]:
    """NAMES of a text."""
    words = data.split()
    n = len(words)
    blank = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    chars = len(data) if data.isascii() else len(data.decode("utf-8", "replace"))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    seen, again, lines = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\r\x0b\x0c"):
            lines += 1
            again += line in seen
            seen.add(line)
    repeat = 0
    h = runs_of(word_hashes(words), WINDOW)
    if len(h) > 1:
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        starts = order[same[1:] | same[:-1]]
        if len(starts):
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + WINDOW, -1)
            repeat = int((np.cumsum(cover) > 0).sum())
    return n, chars - blank, symbols, again, repeat, upper, lines


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and NAMES of each row; null texts count as empty, absent columns as null."""

    def run(batches):
        for batch in slices(batches):
            rows = list(zip(*map(counts, text_bytes(batch)), strict=True)) or [()] * len(NAMES)
            yield pa.record_batch([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(c, pa.int64()) for c in rows)], ["doc_id", "lang", "source", *NAMES])

    own = lambda c: F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *map(own, ("text", "lang", "source")))
    return in_batches(source, run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in NAMES))


def vector() -> list[Column]:
    """The transformed statistics: logarithms of rates, each with its scale."""
    n, chars = F.col("n_words") + 1.0, F.col("word_chars") + 1.0
    return [
        F.log(chars / n) * 4,
        F.log1p(200 * F.col("n_symbols") / chars),
        F.log1p(20 * F.col("n_dup_lines") / (F.col("n_lines") + 1.0)),
        F.log1p(20 * F.col("n_repeat_words") / n),
        F.log1p(20 * F.col("n_upper") / chars),
        F.log(n) / 2,
    ]


def _floors(n: Column, chars: Column, lines: Column) -> Column:
    """Variance of each statistic when its count is rounded (a twelfth of the squared step), in a text of n words, chars and lines."""
    n, chars, lines = n + 1.0, chars + 1.0, lines + 1.0
    steps = [4 / chars, F.log1p(200 / chars), F.log1p(20 / lines), F.log1p(20 * WINDOW / n), F.log1p(20 / chars), 0.5 / n]
    return F.array(*(x * x / 12 for x in steps))


def _named(rows: DataFrame) -> DataFrame:
    """rows with s, the name of their language and source, and l, that of their language."""
    fine = F.concat_ws("\x01", F.lit("s"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    return rows.withColumns({"s": fine, "l": F.concat_ws("\x01", F.lit("l"), F.coalesce("lang", F.lit("")))})


def _levels() -> Column:
    """What a row counts in: its language and source, its language, and all."""
    return F.explode(F.array("s", "l", F.lit(""))).alias("g")


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from mu under the precision prec (row by row)."""
    d = [F.col(f"x{i}") - F.get("mu", F.lit(i)) for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i + 1):
            total = total + d[i] * d[j] * F.get("prec", F.lit(i * P + j)) * (1 if i == j else 2)
    return total


NOW = "g string, start int, hot boolean, mu array<double>, prec array<double>, det double, floor array<double>"


def _rows(df: DataFrame, one) -> DataFrame:
    """A NOW row for each dictionary that `one` makes of a row of df."""

    def run(batches):
        names = [c.split()[0] for c in NOW.split(", ")]
        many = pa.list_(pa.float64())
        kinds = (pa.string(), pa.int32(), pa.bool_(), many, many, pa.float64(), many)
        for batch in batches:
            made = [x for r in batch.to_pylist() for x in one(r)]
            yield pa.record_batch([pa.array([x[c] for x in made], k) for c, k in zip(names, kinds, strict=True)], names)

    return df.mapInArrow(run, NOW)


def _symmetric(lower: list[float]) -> np.ndarray:
    out = np.zeros((P, P))
    out[np.tril_indices(P)] = lower
    return out + np.tril(out, -1).T


def _estimate(r: dict) -> list[dict]:
    """The estimate of sums: n, s (sums), q (sums of products, lower triangle), and floor. det is the determinant's logarithm."""
    mu, floor = np.array(r["s"]) / r["n"], np.array(r["floor"])
    cov = _symmetric(r["q"]) / r["n"] - np.outer(mu, mu)
    cov += np.diag(np.maximum(floor - np.diag(cov), 0) + 0.01 * floor)  # a little more, so that it can be inverted
    return [r | {"mu": mu.tolist(), "prec": np.linalg.inv(cov).ravel().tolist(), "det": float(np.linalg.slogdet(cov)[1])}]


def _starts(r: dict) -> list[dict]:
    """Three starts of a group, of its medians mu, scales sd, and sums of tangents t, their products tt and those of signs kk."""
    sd, mean = np.array(r["sd"]), np.array(r["t"]) / r["n"]
    out = []
    for scatter in (np.eye(P), _symmetric(r["tt"]) / r["n"] - np.outer(mean, mean), _symmetric(r["kk"]) / r["n"]):
        size = np.sqrt(np.maximum(np.diag(scatter), 1e-12))
        correlation = scatter / np.outer(size, size)
        correlation = 0.95 * np.where(np.eye(P) > 0, 1.0, correlation) + 0.05 * np.eye(P)  # so that it can be inverted
        out.append(r | {"start": len(out), "prec": np.linalg.inv(correlation * np.outer(sd, sd)).ravel().tolist(), "det": float("inf")})
    return out


_X = [f"x{i}" for i in range(P)]
_ROUNDED = 2  # the exact percentile keeps a count of each distinct value


def _sums(one: list[Column]) -> Column:
    return F.array(*map(F.sum, one))


def _products(one: list[Column]) -> Column:
    return F.array(*(F.sum(one[i] * one[j]) for i in range(P) for j in range(i + 1)))


def _level(d2: Column) -> Column:
    return F.round(F.log(d2 + 1e-6), 2)


def _step(rows: DataFrame, now: DataFrame, held: list[str]) -> DataFrame:
    """now after a concentration step of each group and start, with `falls`: whether its determinant fell."""
    by = ["g", "start"]
    cut = meet(rows, now, ["g"]).groupBy(*by).agg(F.percentile(_level(_distance()), F.lit(H)).alias("cut"))
    near = written(now.join(cut, by), "cut")
    core = meet(rows, near, ["g"]).where(_level(_distance()) <= F.col("cut"))
    x = [F.col(c) for c in _X]
    sums = core.groupBy(*by).agg(F.count("*").alias("n"), _sums(x).alias("s"), _products(x).alias("q"), F.first("floor").alias("floor"), F.first("hot").alias("hot"))
    new = _rows(sums, _estimate).select(*by, F.struct("mu", "prec", "det").alias("new"))
    both = near.drop("cut").join(new, by).withColumn("falls", F.col("new.det") < F.col("det") - REST)
    picked = {c: F.when(F.col("falls"), F.col(f"new.{c}")).otherwise(F.col(c)) for c in ("mu", "prec", "det")}
    return written(both.withColumns(picked).drop("new"), "estimates", held)


def estimates(rows: DataFrame, levels: int = 1) -> DataFrame:
    """g, size, hot, mu and prec of every group of rows (g, x0.., n_words, word_chars, n_lines), in each of which a row comes so many times."""
    half = lambda c: F.percentile(c, F.lit(0.5))
    total = rows.count() / levels
    middles = F.array(*(half(F.round(c, _ROUNDED)) for c in _X)).alias("mu")
    mid = rows.groupBy("g").agg(middles, _floors(*map(half, ("n_words", "word_chars", "n_lines"))).alias("floor"), F.count("*").alias("size"), (F.count("*") > total * HOT).alias("hot"))
    mid = written(mid, "mid")
    off = [F.col(c) - F.get("mu", F.lit(i)) for i, c in enumerate(_X)]
    spread = meet(rows, mid, ["g"]).groupBy("g").agg(F.array(*(half(F.round(F.abs(x), _ROUNDED)) for x in off)).alias("mad"))
    sd = F.transform(F.arrays_zip("mad", "floor"), lambda x: F.sqrt(F.greatest((1.4826 * x["mad"]) ** 2, x["floor"])))
    mid = written(mid.join(spread, "g").withColumn("sd", sd).drop("mad"), "spread")
    z = meet(rows, mid, ["g"]).withColumns({f"z{i}": x / F.get("sd", F.lit(i)) for i, x in enumerate(off)})
    z = z.withColumn("norm", F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(P)), F.lit(1e-12))))
    t, k = [F.tanh(f"z{i}") for i in range(P)], [F.col(f"z{i}") / F.col("norm") for i in range(P)]
    sums = z.groupBy("g").agg(F.count("*").alias("n"), _sums(t).alias("t"), _products(t).alias("tt"), _products(k).alias("kk"))
    held: list[str] = []
    now = written(_rows(mid.join(sums, "g"), _starts), "estimates", held)
    for _ in range(FIRST):
        now = _step(rows, now, held).drop("falls")
    best = now.groupBy("g").agg(F.min_by(F.struct(*(c for c in now.columns if c != "g")), F.struct("det", "start")).alias("b"))
    now = written(best.select("g", "b.*"), "estimates", held)
    falls = True
    while falls:  # ends: a determinant only falls, by REST at least, and floors bound it
        now = _step(rows, now, held)
        falls = bool(now.agg(F.max("falls")).head()[0])
        now = now.drop("falls")
    return now.select("g", "hot", "mu", "prec").join(mid.select("g", "size"), "g")


KNOWN = "s string, l string, size long, hot boolean, mu array<double>, prec array<double>"


def _weight(size: int | None) -> float:
    return (size or 0) / ((size or 0) + PRIOR)


def shrunk(groups: DataFrame, found: DataFrame) -> DataFrame:
    """KNOWN rows of groups (s, l, size, hot): own estimates and those above, by their rows. One row of found, that of all, goes with the tasks."""
    top = found.where("g = ''").select("mu", "prec").head()
    own = found.select(F.col("g").alias("s"), "mu", "prec")
    langs = written(found.where("g LIKE 'l%'").select(F.col("g").alias("l"), "hot", F.struct("size", "mu", "prec").alias("lang")), "languages")
    rows = meet(groups.withColumnRenamed("hot", "large").join(own, "s", "left"), langs, ["l"], "left").drop("hot")

    def blend(batches):
        square = lambda prec: np.linalg.inv(np.array(prec).reshape(P, P))
        names = [c.split()[0] for c in KNOWN.split(", ")]
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                mu, cov = np.array(top.mu), square(top.prec)
                for size, m, prec in ((r["lang"]["size"], r["lang"]["mu"], r["lang"]["prec"]) if r["lang"] else (0, None, None), (r["size"], r["mu"], r["prec"])):
                    w = _weight(size) if m is not None else 0.0
                    mu, cov = ((1 - w) * mu + w * np.array(m), (1 - w) * cov + w * square(prec)) if w else (mu, cov)
                made.append((r["s"], r["l"], r["size"], r["large"], mu.tolist(), np.linalg.inv(cov).ravel().tolist()))
            many = pa.list_(pa.float64())
            kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), many, many)
            yield pa.record_batch([pa.array([x[i] for x in made], k) for i, k in enumerate(kinds)], names)

    return rows.where(F.lit(top is not None)).mapInArrow(blend, KNOWN)


def bounds(rows: DataFrame, known: DataFrame, chance: float = CHANCE) -> DataFrame:
    """known with scale and bound, from the quartiles of distances of rows in each group and above it."""
    each = meet(rows.drop("l"), known, ["s"]).select("s", "l", _level(_distance()).alias("level")).select(_levels(), "level")
    quartiles = each.groupBy("g").agg(F.count("*").alias("n"), *(F.percentile("level", F.lit(q)).alias(c) for q, c in ((0.5, "half"), (0.75, "upper"))))
    quartiles = written(quartiles, "quartiles")
    top = quartiles.where("g = ''").head()
    langs = written(quartiles.where("g LIKE 'l%'").select(F.col("g").alias("l"), F.lit(False).alias("hot"), F.struct("n", "half", "upper").alias("lang")), "languages")
    own = quartiles.select(F.col("g").alias("s"), F.struct("n", "half", "upper").alias("own"))
    out = meet(known.withColumnRenamed("hot", "large").join(own, "s", "left"), langs, ["l"], "left").drop("hot").withColumnRenamed("large", "hot")
    share = lambda c: F.coalesce(F.col(f"{c}.n") / (F.col(f"{c}.n") + PRIOR), F.lit(0.0))

    def value(c: str) -> Column:
        above = F.lit(float(top[c]) if top else None)
        for level in ("lang", "own"):
            above = (1 - share(level)) * above + share(level) * F.coalesce(F.col(f"{level}.{c}"), F.lit(0.0))
        return F.exp(above)

    out = out.withColumns({"half": value("half"), "upper": value("upper")}).withColumn("scale", F.greatest(F.col("half") / MEDIAN, F.lit(1e-9)))
    bound = F.col("half") + (F.col("upper") - F.col("half")) / math.log(2) * F.log((F.col("size") + PRIOR) / (2 * chance))
    return out.select("s", "hot", "mu", "prec", "scale", (bound / F.col("scale")).alias("bound"))


def judged(docs: DataFrame, chance: float = CHANCE) -> DataFrame:
    """doc_id, NAMES, base_failed, distance (scaled and squared) and kept of each row of docs.

    Every row counts and comes back, also where ids repeat or are null. Rows that fail the base rule take no
    part in the estimates. With too few rows for any estimate nothing is rejected but by the base rule.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    rows = _named(written(counted(docs).withColumn("base_failed", failed), "counts"))
    rows = written(rows.select("doc_id", *NAMES, "base_failed", "s", "l", *(x.alias(f"x{i}") for i, x in enumerate(vector()))), "vectors")
    usable, total = rows.where("NOT base_failed"), rows.count()
    groups = rows.groupBy("s", "l").agg(F.count_if(~F.col("base_failed")).alias("size"), (F.count("*") > total * HOT).alias("hot"))
    found = written(estimates(usable.select(_levels(), *_X, "n_words", "word_chars", "n_lines"), 3), "mcd")
    known = written(shrunk(groups, found), "shrunk")
    known = written(bounds(usable, known, chance), "bounds")
    out = meet(rows, known, ["s"], "left").withColumn("distance", _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("bound"), F.lit(True))
    return out.select("doc_id", *NAMES, "base_failed", "distance", kept.alias("kept"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *NAMES[:5], "base_failed", "kept", "distance")
