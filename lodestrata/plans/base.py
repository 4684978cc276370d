"""Queries over the star-schema and text tables, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.scalars import char_entropy, cores, quote_literal, rarest_symbol
from lodestrata.operators.flow import flow_analysis
from lodestrata.operators.relational import (
    adjacent_runs,
    as_of,
    bounded_reach,
    first_reference_labels,
    first_source_wins,
    islands,
    ordinal_lookup,
    range_saturation,
    resolved_share,
    stage_matrix,
    stage_rows,
    text_runs,
    tri_state,
    union_in_order,
    with_blocks,
)
from lodestrata.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can say it, its oracle."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


@query(
    "q01_callers",
    """
    SELECT o.o_orderkey, o.o_custkey, o.o_orderpriority FROM orders o
    WHERE EXISTS (SELECT 1 FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                  WHERE l.l_orderkey = o.o_orderkey AND contains(lower(p.p_name), 'ring'))
    """,
)
def callers(spark: SparkSession, d: str) -> DataFrame:
    """Bodies that make a matching call: a semi-join chain, so one match per body is enough."""
    hits = table(spark, d, "part").filter(F.lower("p_name").contains("ring")).select("p_partkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    matched = lines.join(hits, lines.l_partkey == hits.p_partkey, "left_semi")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return orders.join(matched, orders.o_orderkey == matched.l_orderkey, "left_semi")


@query(
    "q02_resolution_rate",
    """
    SELECT e.event_type, count(*) AS n_refs, count(c.c_custkey) AS n_resolved,
           round(100.0 * count(c.c_custkey) / count(*), 6) AS pct_resolved
    FROM events e LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON e.user_id = c.c_custkey
    GROUP BY e.event_type
    """,
)
def resolution_rate(spark: SparkSession, d: str) -> DataFrame:
    """References against a table by ordinal; a miss is null and never a placeholder."""
    known = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    refs = table(spark, d, "events").select("event_type", "user_id")
    return resolved_share(ordinal_lookup(refs, known, "user_id", "c_custkey"), ["event_type"], "c_custkey")


@query(
    "q03_saturation",
    """
    WITH used AS (SELECT l_returnflag, 'part' AS target, max(l_partkey) AS top FROM lineitem GROUP BY 1
                  UNION ALL SELECT l_returnflag, 'supplier', max(l_suppkey) FROM lineitem GROUP BY 1),
    sizes AS (SELECT 'part' AS target, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier)
    SELECT u.l_returnflag, u.target, u.top AS max_ordinal, s.n AS table_size, u.top = s.n - 1 AS saturates
    FROM used u JOIN sizes s USING (target)
    """,
)
def saturation(spark: SparkSession, d: str) -> DataFrame:
    """Largest ordinal that a reference kind uses against the size of the table that it may mean."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey")
    sizes = {t: table(spark, d, t) for t in ("part", "supplier")}
    return range_saturation(lines, ["l_returnflag"], {"part": "l_partkey", "supplier": "l_suppkey"}, sizes)


@query(
    "q04_entropy",
    """
    WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0),
    f AS (SELECT doc_id, ch, count(*) AS n FROM c GROUP BY ALL),
    p AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS total FROM f)
    SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM p GROUP BY doc_id
    """,
)
def entropy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    return docs.select("doc_id", F.round(char_entropy(F.col("text")), 6).alias("entropy"))


@query(
    "q05_runs",
    """
    SELECT page_id, CAST(i - 1 AS BIGINT) AS seq, r[i] AS run
    FROM (SELECT page_id, regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]{3,}', 0) AS r FROM pages) t, unnest(range(1, len(r) + 1)) u(i)
    """,
)
def runs(spark: SparkSession, d: str) -> DataFrame:
    return text_runs(table(spark, d, "pages"), "page_id", "html", "[A-Za-z_][A-Za-z0-9_]{3,}")


@query(
    "q06_adjacent_runs",
    """
    WITH l AS (SELECT conv_id, turn, role AS a, lead(role, 1) OVER w AS b, lead(role, 2) OVER w AS c, lead(role, 3) OVER w AS d
               FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, 2::BIGINT AS width, a || '/' || b AS joined FROM l WHERE b IS NOT NULL
    UNION ALL SELECT conv_id, turn, 3, a || '/' || b || '/' || c FROM l WHERE c IS NOT NULL
    UNION ALL SELECT conv_id, turn, 4, a || '/' || b || '/' || c || '/' || d FROM l WHERE d IS NOT NULL
    """,
)
def adjacent(spark: SparkSession, d: str) -> DataFrame:
    return adjacent_runs(table(spark, d, "conversations"), ["conv_id"], "turn", "role", 4, "/")


@query(
    "q07_first_source",
    """
    WITH u AS (SELECT lang AS value, 1 AS prio FROM documents UNION ALL SELECT source, 2 FROM documents UNION ALL SELECT substring(source, 1, 3), 3 FROM documents),
    f AS (SELECT value, min(prio) AS prio FROM u WHERE value IS NOT NULL GROUP BY value)
    SELECT CASE prio WHEN 1 THEN 'lang' WHEN 2 THEN 'source' ELSE 'stem' END AS harvester, count(*) AS n_fresh FROM f GROUP BY prio
    """,
)
def first_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    parts = {"lang": docs.select("lang"), "source": docs.select("source"), "stem": docs.select(F.substring("source", 1, 3))}
    return first_source_wins(parts).groupBy("harvester").agg(F.count("*").alias("n_fresh"))


@query(
    "q08_blocks",
    """
    WITH b AS (SELECT user_id, event_id, event_type,
        CASE WHEN coalesce(lag(event_type) OVER w, 'error') = 'error' THEN 1 ELSE 0 END AS leader
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT e.user_id, e.event_id, sum(b.leader) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS block FROM events e JOIN b USING (event_id))
    SELECT user_id, CAST(block - 1 AS BIGINT) AS block, count(*) AS n_statements, min(event_id) AS least_id FROM s GROUP BY user_id, block
    """,
)
def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Straight-line blocks: a terminator ends one, and what follows leads the next."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    cut = with_blocks(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return cut.groupBy("user_id", "block").agg(F.count("*").alias("n_statements"), F.min("event_id").alias("least_id"))


@query(
    "q09_status",
    """
    WITH s AS (SELECT conv_id, 'starts' AS stage, bool_or(turn = 0 AND role = 'user') AS ok FROM conversations GROUP BY 1
        UNION ALL SELECT conv_id, 'answered', CASE WHEN count(*) > 1 THEN bool_or(role = 'assistant') END FROM conversations GROUP BY 1
        UNION ALL SELECT conv_id, 'long', CASE WHEN count(*) > 3 THEN max(length(text)) > 400 END FROM conversations GROUP BY 1)
    SELECT conv_id, CASE WHEN bool_or(NOT ok) THEN 'FAIL' WHEN count(ok) = count(*) THEN 'PASS' ELSE 'PARTIAL' END AS status FROM s GROUP BY conv_id
    """,
)
def status(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    found = turns.groupBy("conv_id").agg(
        F.bool_or((F.col("turn") == 0) & (F.col("role") == "user")).alias("starts"),
        F.when(F.count("*") > 1, F.bool_or(F.col("role") == "assistant")).alias("answered"),
        F.when(F.count("*") > 3, F.max(F.length("text")) > 400).alias("long"),
    )
    return tri_state(stage_rows(found, ["conv_id"], ["starts", "answered", "long"]), ["conv_id"])


@query(
    "q10_declared",
    "SELECT doc_id, n_chars AS declared, CAST(length(text) AS BIGINT) AS recovered, n_chars = length(text) AS ok FROM documents",
)
def declared(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.col("n_chars").alias("declared"), F.length("text").cast("long").alias("recovered"), (F.col("n_chars") == F.length("text")).alias("ok"))


@query(
    "q11_reachability",
    """
    WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation),
    r AS (SELECT a AS start, b AS node, 1 AS depth FROM e UNION ALL SELECT r.start, e.b, r.depth + 1 FROM r JOIN e ON r.node = e.a WHERE r.depth < 6)
    SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY start, node
    """,
)
def reachability(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation")
    edges = nations.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("dst"))
    return bounded_reach(edges, 6).withColumnRenamed("src", "start")


@query(
    "q12_tags",
    """
    SELECT sha256(text) AS tag, count(*) AS n_entries, min(doc_id) AS first_entry FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1
    """,
)
def tags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("tag"))
    return docs.groupBy("tag").agg(F.count("*").alias("n_entries"), F.min("doc_id").alias("first_entry")).where("n_entries > 1")


@query(
    "q12b_tag_matches",
    """
    WITH keys AS (SELECT DISTINCT sha256(text) AS tag FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))
    SELECT d.doc_id, k.tag FROM documents d JOIN keys k ON sha256(d.text) = k.tag
    """,
)
def tag_matches(spark: SparkSession, d: str) -> DataFrame:
    """Entries that one of the supplied keys (texts labelled as junk) opens: equality of tags."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("tag"))
    junk = table(spark, d, "labels").where("quality = 0").select("doc_id")
    keys = docs.join(junk, "doc_id", "left_semi").select("tag").distinct()
    return docs.join(keys, "tag").select("doc_id", "tag")


@query(
    "q13_rarest_letter",
    """
    WITH l AS (SELECT chr(CAST(i AS INTEGER)) AS ch, i FROM range(97, 123) t(i)),
    n AS (SELECT doc_id, ch, i, length(text) - length(replace(text, ch, '')) AS n FROM documents, l WHERE length(text) > 0)
    SELECT doc_id, arg_min(ch, n * 1000 + i) AS rarest, CAST(min(n) AS BIGINT) AS n FROM n GROUP BY doc_id
    """,
)
def rarest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    least = rarest_symbol(F.col("text"), [chr(c) for c in range(97, 123)])
    return docs.select("doc_id", least.alias("r")).select("doc_id", F.col("r.symbol").alias("rarest"), F.col("r.n").alias("n"))


@query(
    "q14_labels",
    """
    WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT user_id, event_type, min(i) AS i FROM o GROUP BY ALL)
    SELECT user_id, event_type, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS label FROM f
    """,
)
def labels(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return first_reference_labels(events, ["user_id"], ["ts", "event_id"], "event_type")


@query(
    "q15_block_of",
    """
    WITH s AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN event_id END AS start FROM events)
    SELECT event_id, last_value(start IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block_start FROM s
    """,
)
def block_of(spark: SparkSession, d: str) -> DataFrame:
    """As-of lookup: the last block start at or before each row, by one window and no join."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    start = F.when(F.col("event_type") == "error", F.col("event_id"))
    return as_of(events, ["user_id"], ["ts", "event_id"], start, "block_start").select("event_id", "block_start")


@query(
    "q16_islands",
    """
    WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS g FROM orders)
    SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first_key, count(*) AS length FROM r GROUP BY o_custkey, o_orderstatus, g
    """,
)
def runs_of_status(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    found = islands(orders, ["o_custkey"], "o_orderkey", "o_orderstatus")
    return found.select("o_custkey", "o_orderstatus", F.col("first").alias("first_key"), "length")


@query(
    "q16b_next_name",
    "SELECT o_custkey, o_orderkey, lead(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_priority FROM orders",
)
def next_name(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return orders.select("o_custkey", "o_orderkey", F.lead("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("next_priority"))


@query(
    "q17_quoted",
    r"""
    SELECT conv_id, turn, '"' || replace(replace(replace(replace(CASE WHEN length(text) > 60 THEN substring(text, 1, 60) || '...' ELSE text END,
        chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(0), chr(92) || '0'), chr(10), chr(92) || 'n') || '"' AS quoted FROM conversations
    """,
)
def quoted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", quote_literal(F.col("text")).alias("quoted"))


@query(
    "q17b_slots",
    """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 3 THEN 's' || (3 - l_linenumber) WHEN l_linenumber = 3 THEN 'this'
        WHEN l_linenumber - 3 <= 2 THEN 'a' || (l_linenumber - 4) ELSE 'v' || (l_linenumber - 3) END AS slot FROM lineitem
    """,
)
def slots(spark: SparkSession, d: str) -> DataFrame:
    """Names of frame slots of a method with two parameters of one slot each."""
    slot = F.col("l_linenumber") - 3
    name = F.when(slot < 0, F.concat(F.lit("s"), (-slot).cast("string"))).when(slot == 0, "this").when(slot <= 2, F.concat(F.lit("a"), (slot - 1).cast("string"))).otherwise(F.concat(F.lit("v"), slot.cast("string")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("slot"))


@query(
    "q18_override",
    "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS value FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def override(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("new"))
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return docs.join(new, "doc_id", "left").select("doc_id", F.coalesce("new", "lang").alias("value"))


@query(
    "q19_matrix",
    """
    SELECT lang, sum(CASE WHEN length(text) > 0 THEN 1 ELSE 0 END)::BIGINT AS has_text, sum(CASE WHEN n_chars = length(text) THEN 1 ELSE 0 END)::BIGINT AS count_ok,
           sum(CASE WHEN text LIKE '%.%' THEN 1 ELSE 0 END)::BIGINT AS has_stop FROM documents GROUP BY lang
    """,
)
def matrix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.length("text") > 0).alias("has_text"), (F.col("n_chars") == F.length("text")).alias("count_ok"), F.contains("text", F.lit(".")).alias("has_stop"))
    return stage_matrix(stage_rows(docs, ["lang"], ["has_text", "count_ok", "has_stop"]), "lang", ["has_text", "count_ok", "has_stop"])


@query(
    "q20_union",
    """
    WITH u AS (SELECT c_nationkey AS k, 1 AS o FROM customer UNION ALL SELECT s_nationkey, 2 FROM supplier UNION ALL SELECT n_nationkey, 3 FROM nation)
    SELECT k AS id, min(o) AS first_source FROM u GROUP BY k
    """,
)
def union_of_sources(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, "customer").select("c_nationkey"), table(spark, d, "supplier").select("s_nationkey"), table(spark, d, "nation").select("n_nationkey")]
    return union_in_order(parts)


@query(
    "q21_loops",
    """
    WITH RECURSIVE e AS (SELECT user_id AS u, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_id FROM events),
    g AS MATERIALIZED (SELECT u, a, b, min(event_id) AS s FROM e WHERE b IS NOT NULL GROUP BY u, a, b),
    entry AS (SELECT u, arg_min(a, s) AS r FROM g GROUP BY u),
    reach AS (SELECT u, r AS n FROM entry UNION SELECT reach.u, g.b FROM reach JOIN g ON g.u = reach.u AND g.a = reach.n),
    cut AS (SELECT entry.u, x.n AS x, r AS n FROM entry JOIN reach x USING (u) WHERE r <> x.n UNION SELECT cut.u, x, g.b FROM cut JOIN g ON g.u = cut.u AND g.a = cut.n WHERE g.b <> x),
    dom AS MATERIALIZED (SELECT r.u, x.n AS x, r.n FROM reach r JOIN reach x USING (u) WHERE x.n = r.n OR NOT EXISTS (SELECT 1 FROM cut WHERE cut.u = r.u AND cut.x = x.n AND cut.n = r.n)),
    depth AS (SELECT u, n, count(*) AS k FROM dom GROUP BY u, n),
    nearest AS (SELECT dom.u, dom.n, arg_max(x, k) AS idom FROM dom JOIN depth ON depth.u = dom.u AND depth.n = dom.x WHERE x <> dom.n GROUP BY dom.u, dom.n),
    back AS (SELECT g.u, g.b AS h, g.a FROM g JOIN dom ON dom.u = g.u AND dom.x = g.b AND dom.n = g.a),
    body AS (SELECT u, h, a AS n FROM back UNION SELECT body.u, h, g.a FROM body JOIN g ON g.u = body.u AND g.b = body.n JOIN reach ON reach.u = g.u AND reach.n = g.a WHERE body.n <> h),
    sizes AS (SELECT u, h, count(*) AS k FROM (SELECT u, h, n FROM body UNION SELECT u, h, h FROM back) GROUP BY u, h)
    SELECT reach.u AS user_id, reach.n AS node, coalesce(idom, reach.n) AS idom, sizes.k IS NOT NULL AS is_header, coalesce(sizes.k, 0) AS loop_size
    FROM reach LEFT JOIN nearest ON nearest.u = reach.u AND nearest.n = reach.n LEFT JOIN sizes ON sizes.u = reach.u AND sizes.h = reach.n
    """,
)
def loops(spark: SparkSession, d: str) -> DataFrame:
    """Immediate dominators and loop headers of each user's graph of event types."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = events.select("user_id", F.col("event_type").alias("src"), after.alias("dst"), "event_id").where("dst IS NOT NULL")
    return flow_analysis(edges.groupBy("user_id", "src", "dst").agg(F.min("event_id").alias("seq")), "user_id")


@query(
    "q22_cores",
    """
    WITH s AS (SELECT doc_id, trim(text, ' .') AS trimmed, list_filter(string_split(text, '.'), lambda x: length(trim(x)) > 0) AS parts FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, unnest(list_concat([trimmed, replace(trimmed, '.', '')], list_transform(parts, lambda x: trim(x)))) AS core FROM s)
    SELECT DISTINCT doc_id, core FROM c WHERE length(core) > 0
    """,
)
def harvested_cores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.explode(cores(F.col("text"), ".")).alias("core"))
