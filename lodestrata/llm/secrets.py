"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Patterns give each text's base spans and, beside them, bare candidates: long tokens that mix digits with
letters of both cases. The hash of every candidate and base value is aggregated over the corpus by distinct repositories (documents) and
owners (sources). A value that more than MAX_OWNERS owners or more than MAX_REPOSITORIES documents carry is a widely
copied example; one that few carry looks live. Bare candidates that look live and overlap no base span become spans of kind `owned`.

Places come from the gaps between matches (lengths of what the same pattern splits off), summed by a
window per document and kind. A document is known by doc_id and a hash of its text, so repeated rows share
their spans and every input row comes back once. Null text is empty; null ids and owners group as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import small_or_shuffled, written
from lodestrata.session import table

MAX_OWNERS, MAX_REPOSITORIES = 2, 10
#: Values in more documents than this are left out by a list of their own.
WIDELY = 1000
# fixed values: the kinds in the order in which they are listed, and the patterns of the base spans
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
BARE = r"[A-Za-z0-9+/_-]{20,}"


def _found(text: Column, kind: int, pattern: str, keep, value) -> Column:
    """Matches in order: number, gap before, length, whether it holds, hash of its value."""
    one = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    entry = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(F.col(f"_gaps{kind}"), i)).alias("gap"), F.length(x).alias("len"), keep(x).alias("keep"), F.xxhash64(value(x)).alias("hash"))
    return one, gaps, entry


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, owner, mark (hash of the text) and hits of each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    owned_by = F.col(owner).cast("string") if owner in docs.columns else F.lit(None).cast("string")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owned_by.alias("_owner"), text.alias("_text"))
    always = lambda x: F.lit(True)
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]")
    same = lambda x: x
    kinds = [
        (ASSIGN, lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 12, lambda x: F.regexp_extract(x, ASSIGN, 2)),
        (ACCESS, lambda x: F.length(x) >= 18, same),
        (HEX, always, same),
        (BARE, mixed, same),
    ]
    parts = []
    t = F.col("_text")
    for k, (pattern, keep, value) in enumerate(kinds):
        one, gaps, entry = _found(t, k, pattern, keep, value)
        df = df.withColumn(f"_m{k}", one)
        df = df.withColumn(f"_gaps{k}", F.when(F.size(f"_m{k}") > 0, gaps))
        parts.append(F.transform(f"_m{k}", entry))
    return df.select("doc_id", F.col("_owner").alias("owner"), F.xxhash64("_text").alias("mark"), F.concat(*parts).alias("hits"))


def spans_of(scanned: DataFrame) -> DataFrame:
    """One row a span that holds: doc_id, mark, owner, kind, start, stop (code points, end exclusive), hash."""
    once = scanned.where(F.size("hits") > 0).groupBy("doc_id", "mark").agg(F.first("hits").alias("hits"), F.min("owner").alias("owner"))
    each = once.select("doc_id", "mark", "owner", F.explode("hits").alias("h")).select("doc_id", "mark", "owner", "h.*")
    upto = Window.partitionBy("doc_id", "mark", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("len")).over(upto)
    return each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("len")).where("keep").drop("i", "gap", "len", "keep")


def ownership(spans: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners, aggregated step by step so that no value's rows meet in one task."""
    by_doc = spans.groupBy("hash", "owner", "doc_id").agg(F.count("*").alias("_n"))
    by_owner = by_doc.groupBy("hash", "owner").agg(F.count("*").alias("_n"))
    return by_owner.groupBy("hash").agg(F.sum("_n").alias("n_repositories"), F.count("*").alias("n_owners"))


def found(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> tuple[DataFrame, DataFrame]:
    """The scanned rows, and per document its spans in order: arrays base and spans of (start, kind, stop).

    Only bare candidates need a verdict. Rows of widely copied values are left out before any are dealt out by value, so that
    no value's rows meet in one task.
    """
    scanned = written(scan(docs, owner), "scanned")
    spans = written(spans_of(scanned), "spans")
    copied = written(ownership(spans).where((F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories)), "copied")
    widely = small_or_shuffled(written(copied.where(F.col("n_repositories") > WIDELY).select("hash"), "widely"))
    live = spans.where("kind = 3").join(widely, "hash", "left_anti").join(copied.select("hash"), "hash", "left_anti")
    every = spans.where("kind < 3").unionByName(live)
    lists = every.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("all"))
    lists = lists.withColumn("base", F.filter("all", lambda x: x["kind"] < 3))
    apart = lambda x: ~F.exists("base", lambda y: (y["start"] < x["stop"]) & (y["stop"] > x["start"]))
    lists = lists.withColumn("spans", F.filter("all", lambda x: (x["kind"] < 3) | apart(x))).drop("all")
    return scanned, lists


def _shown(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    scanned, lists = found(docs)
    lists = lists.withColumnsRenamed({"doc_id": "_d", "mark": "_m"})
    both = scanned.select("doc_id", "mark").join(lists, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    both = both.withColumns({c: F.coalesce(F.col(c), none) for c in ("base", "spans")})
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return both.select("doc_id", *map(count, range(3)), F.sha2(_shown("base"), 256).alias("base_sha256"), _shown("spans").alias("spans"))


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span's text replaced by mask; the columns stay, whatever their names, and n_chars follows the text.

    Rows without spans come back as they are, null texts too; repeated rows are masked alike; without rows there is no row.
    """
    _, lists = found(docs)
    each = lists.where(F.size("spans") > 0).select("doc_id", "mark", F.explode("spans").alias("s")).select("doc_id", "mark", "s.start", "s.stop")
    lists = written(_runs(each).withColumnsRenamed({"doc_id": "_d", "mark": "_m"}), "lists")
    if (lists.agg(F.max(F.size("runs"))).head()[0] or 0) <= 64:  # else a row may be large
        lists = small_or_shuffled(lists, 100_000)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_doc"), text.alias("_text"), F.xxhash64(text).alias("_mark"))
    both = marked.join(lists, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_mark") == F.col("_m")), "left")
    both = both.withColumn("_wide", F.when(F.col("runs").isNotNull(), F.encode("_text", "UTF-32")))
    # places count code points, of which this form has four bytes each: a piece is found without reading what is before it
    piece = lambda at, n: F.decode(F.substring("_wide", (4 * at + 1).cast("int"), (4 * n).cast("int")), "UTF-32")
    kept = F.concat(F.transform("runs", lambda x: piece(x["start"] - x["gap"], x["gap"])), F.array(piece(F.element_at("runs", -1)["stop"], F.octet_length("_wide"))))
    both = both.withColumn("_new", F.when(F.col("runs").isNotNull(), F.array_join(kept, mask)))
    row, hit = lambda c: F.col("row").getField(c), F.col("_new").isNotNull()
    new = {"text": lambda c: F.coalesce("_new", row(c)), "n_chars": lambda c: F.when(hit, F.length("_new")).otherwise(row(c)).cast(docs.schema[c].dataType)}
    return both.select(*(new.get(c, row)(c).alias(c) for c in docs.columns))


def _runs(spans: DataFrame) -> DataFrame:
    """doc_id, mark and runs of overlapping spans in order: start, stop and the gap before each."""
    own = Window.partitionBy("doc_id", "mark")
    before = F.max("stop").over(own.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(own.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("doc_id", "mark", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    rows = rows.withColumn("gap", F.col("start") - F.lag("stop", 1, 0).over(own.orderBy("_run")))
    return rows.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "gap"))).alias("runs"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    return report(table(spark, sf_dir, "documents"))


def _places(k: int, pattern: str) -> str:
    return f"""SELECT doc_id, source, {k} kind, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) stop FROM (
        SELECT doc_id, source, unnest(ms) m, unnest(gs) g, unnest(range(len(ms))) i FROM (
            SELECT doc_id, source, ms, list_slice(string_split_regex(t, '{pattern}'), 1, len(ms)) gs FROM (SELECT doc_id, source, t, regexp_extract_all(t, '{pattern}', 0) ms FROM docs) WHERE len(ms) > 0))"""


_A = ASSIGN.replace("'", "''")
OP9_SQL = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') t FROM documents),
found AS ({" UNION ALL ".join(_places(k, p) for k, p in enumerate((_A, ACCESS, HEX, BARE)))}),
held AS (SELECT doc_id, source, kind, CAST(stop AS BIGINT) stop, CAST(stop - length(m) AS BIGINT) start, CASE WHEN kind = 0 THEN regexp_extract(m, '{_A}', 2) ELSE m END v FROM found
    WHERE CASE kind WHEN 0 THEN length(regexp_extract(m, '{_A}', 2)) >= 12 WHEN 1 THEN length(m) >= 18 WHEN 2 THEN true
          ELSE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') END),
owners AS (SELECT v, count(DISTINCT source) n, count(DISTINCT doc_id) copies FROM held GROUP BY v),
spans AS (SELECT h.* FROM held h JOIN owners USING (v) WHERE kind < 3 OR (owners.n <= {MAX_OWNERS} AND owners.copies <= {MAX_REPOSITORIES} AND NOT EXISTS (
    SELECT 1 FROM held b WHERE b.doc_id = h.doc_id AND b.kind < 3 AND b.start < h.stop AND b.stop > h.start))),
shown AS (SELECT doc_id, kind, start, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop s FROM spans),
lists AS (SELECT doc_id, count(*) FILTER (kind = 0) a, count(*) FILTER (kind = 1) b, count(*) FILTER (kind = 2) c,
    string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) base, string_agg(s, ',' ORDER BY start, kind) spans FROM shown GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) n_assign, coalesce(b, 0) n_access, coalesce(c, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
FROM docs d LEFT JOIN lists USING (doc_id)
"""
