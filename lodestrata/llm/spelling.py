"""Spelling variants: words one edit apart, by automata over the halves of words.

If two words differ by one inserted, deleted or replaced letter, one of the two halves of either stands whole in the other: the first at
its beginning or the second at its end. Shards of automata hold the halves of every word; every word is scanned by the shards that can
hold a half of a near word, whose offset and length have to fit, and what is left between is looked up and verified.

A half that very many words share is no key for one task. Its words are told apart by halving what is left of
them once more, and so on: a bucket is what two words have in common before and behind the edit, and `rest` is what
stands between. With rests of two letters a bucket has no more words than there are pairs of letters, so that this ends.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import by_part, in_batches, shuffles, small_or_shuffled, written
from lodestrata.session import table

LETTERS = "[a-z\\u00C0-\\u00FF]+"
#: Of so many (document, word) hashes one changes its word.
EVERY = 97
LEAST_LETTERS, LEAST_TIMES = 5, 3
#: Rows of a bucket (words that hold its half and words to scan) before their rests are halved again; rests of two letters make no more.
BUCKET = 1 << 14
#: Words for which a shard is made; its memory is about 2 KB each.
SHARD = 1 << 15
ROWS = "before string, behind string, way string, word string, n long, owned boolean"


def words(docs: DataFrame) -> DataFrame:
    """word and n of what the texts hold at least LEAST_TIMES."""
    upper = "".join(map(chr, range(65, 91)))
    runs = F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(LETTERS), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
    word = F.when(F.col("h") % EVERY == 0, shorter).otherwise(F.col("run")).alias("word")
    return each.select(word).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TIMES)


def halves(before: str, behind: str, way: str, word: str, owned: bool) -> Iterator[tuple[str, str, str]]:
    """The buckets of a word: by halves of its own rest, or by those that the rest of a near word can have."""
    rest = word[len(before) : len(word) - len(behind)]
    k = len(rest)
    lengths = [k] if owned else [m for m in (k - 1, k, k + 1) if m >= 1]
    for h in {m // 2 for m in lengths if m // 2 <= k}:
        yield before + rest[:h], behind, way + "<"
    for h in {m - m // 2 for m in lengths if m - m // 2 <= k}:
        yield before, rest[k - h :] + behind, way + ">"


def one_edit(a: str, b: str) -> bool:
    """Whether they differ by exactly one letter."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    n, at = min(len(a), len(b)), 0
    while at < n and a[at] == b[at]:
        at += 1
    return a[at + (len(a) >= len(b)) :] == b[at + (len(b) >= len(a)) :]


def way_of(word: str, other: str, steps: int) -> str:
    """By which halves of word a near other is found: the first one wherever it stands in other, so that each pair is found once."""
    before, behind, way = 0, 0, ""
    for _ in range(steps):
        rest = word[before : len(word) - behind]
        h = len(rest) // 2
        if other[before : len(other) - behind].startswith(rest[:h]):
            before, way = before + h, way + "<"
        else:
            behind, way = behind + len(rest) - h, way + ">"
    return way


class Bucket:
    """Words that agree before and behind their rests."""

    def __init__(self):
        self.whole, self.cut, self.gap = defaultdict(list), defaultdict(list), defaultdict(list)

    def add(self, word: str, rest: str) -> None:
        self.whole[rest].append(word)
        for i in range(len(rest)):
            self.cut[rest[:i] + rest[i + 1 :]].append(word)
            self.gap[i, rest[:i] + rest[i + 1 :]].append(word)

    def near(self, rest: str) -> set[str]:
        found = set(self.cut.get(rest, ()))
        for i in range(len(rest)):
            cut = rest[:i] + rest[i + 1 :]
            found.update(self.whole.get(cut, ()), self.gap.get((i, cut), ()))
        return found


def shard(rows: list[tuple]) -> Iterator[tuple[str, int, int, str]]:
    """word, number of near words in the shard, largest n of those, and the smallest word that has it; rows are those of ROWS."""
    import ahocorasick

    buckets, n_of, scanned = defaultdict(Bucket), {}, set()
    for before, behind, way, word, n, owned in rows:
        if owned:
            buckets[before, behind, way].add(word, word[len(before) : len(word) - len(behind)])
            n_of[word] = n
        else:
            scanned.add(word)
    if not buckets:
        return
    first, last = defaultdict(list), defaultdict(list)
    for key in buckets:
        (first if key[0] else last)[key[0] or key[1]].append(key)
    automaton = ahocorasick.Automaton()
    for segment in {*first, *last}:
        automaton.add_word(segment, segment)
    automaton.make_automaton()
    for word in scanned:
        fits, count, best = [], 0, (0, "")
        for end, segment in automaton.iter(word):
            if end + 1 == len(segment):  # it begins the word
                fits += first.get(segment, ())
            if end + 1 == len(word):
                fits += last.get(segment, ())
        for key in fits:
            before, behind, way = key
            if len(before) + len(behind) > len(word) or not word.endswith(behind):
                continue
            for other in buckets[key].near(word[len(before) : len(word) - len(behind)]):
                if one_edit(word, other) and way_of(other, word, len(way)) == way:
                    count += 1
                    if (n_of[other], best[1]) > (best[0], other):
                        best = n_of[other], other
        if count:
            yield word, count, *best


def bucketed(vocabulary: DataFrame) -> DataFrame:
    """ROWS: every word in the buckets of its own halves (owned), and in those where it has to be scanned. None has more than BUCKET rows."""

    def run(batches):
        for batch in batches:
            out = []
            for before, behind, way, word, n, owned in zip(*(batch.column(c).to_pylist() for c in ("before", "behind", "way", "word", "n", "owned")), strict=True):
                out += [(*key, word, n, owned) for key in halves(before, behind, way, word, owned)]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in ROWS.split(", ")])

    blank = [F.lit("").alias(c) for c in ("before", "behind", "way")]
    open_ = vocabulary.select(*blank, "word", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("owned"))
    done, key = [], ["before", "behind", "way"]
    while True:
        rows = written(in_batches(open_, run, ROWS), "halves")
        rest = F.length("word") - F.length("before") - F.length("behind")
        held = rows.groupBy(*key).agg(F.count("*").alias("held"), F.max(rest).alias("most"))
        full = written(held.where((F.col("held") > BUCKET) & (F.col("most") > 2)).select(*key), "full")
        if full.isEmpty():
            return _union([*done, rows])
        full = small_or_shuffled(full)
        done.append(rows.join(full, key, "left_anti"))
        open_ = rows.join(full, key, "left_semi")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, form_n and form (the near word of largest n) of words that have near ones."""
    rows = bucketed(vocabulary)
    n_parts = max(shuffles(vocabulary.sparkSession), -(-2 * vocabulary.count() // SHARD))

    def run(batches):
        now, held = None, []

        def told(found):
            columns = list(zip(*found, strict=True)) or [()] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "found", "form_n", "form"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "before", "behind", "way", "word", "n", "owned")]
            for part, *row in zip(*columns, strict=True):
                if part != now:
                    yield told(shard(held))
                    now, held = part, []
                held.append(row)
        yield told(shard(held))

    dealt = by_part(rows.select(F.pmod(F.xxhash64("before", "behind", "way"), F.lit(n_parts)).cast("int").alias("part"), "before", "behind", "way", "word", "n", "owned"))
    found = in_batches(dealt, run, "word string, found long, form_n long, form string")
    # of equal n the smallest word
    best = F.min(F.struct((-F.col("form_n")).alias("least"), F.col("form").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("found").alias("n_near"), best).select("word", "n_near", (-F.col("best.least")).alias("form_n"), F.col("best.form").alias("form"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word with at least 5 letters and 3 occurrences.

    Null texts have no words; a null id counts as an empty one. Rows that are there twice count twice. Other columns are not
    looked at. Of near words with the same n the smallest in code-point order is the form. Without words there is no row.
    """
    vocabulary = written(words(docs), "vocabulary")
    near = near_words(vocabulary)
    form = F.col("form_n") >= 2 * F.col("n")
    out = written(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("form")).alias("form"), F.when(form, F.col("form_n")).alias("form_n")
        ),
        "forms",
    )
    # n doubles at every step, so paths are short; each round doubles what is followed
    links = written(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return out.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    return variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(x, list_transform(range(8), lambda k: 0::BIGINT)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY x) t FROM range(256) r(x)),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) run FROM documents),
each AS (SELECT id, run, count(*) c, hex(encode(id || ':' || run)) x FROM runs GROUP BY id, run),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) h
  FROM each, crc
),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, c FROM hashed),
vocabulary AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
gaps AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) d FROM vocabulary, unnest(range(0, length(word))) u(i)),
pairs AS (
  SELECT a.word, b.word other, b.n m FROM gaps a JOIN gaps b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN vocabulary b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN vocabulary b ON a.d = b.word
),
ranked AS (SELECT word, count(*) OVER (PARTITION BY word) k, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) r FROM pairs),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(k, 0) k, CASE WHEN m >= 2 * v.n THEN other END form, CASE WHEN m >= 2 * v.n THEN m END form_n FROM vocabulary v LEFT JOIN ranked p ON p.word = v.word AND r = 1),
paths AS (SELECT word, word root FROM forms WHERE form IS NULL UNION ALL SELECT f.word, p.root FROM forms f JOIN paths p ON f.form = p.word)
SELECT f.word, form, root, n, CAST(k AS BIGINT) n_near, form_n FROM forms f JOIN paths USING (word)
"""
