"""URL filter: rules first, else the ratio of two character language models; DataFrame functions alone.

URLs that a rule accepts or rejects are the two training sets (but for a fifth that calibrates). Each model is an
interpolated Markov model of orders 0 to ORDER: P_k(c|context) = (n(context c) + D * P_{k-1}) / (n(context) + D),
so long contexts count where they were seen and shorter ones fill in; below order 0 all characters of all URLs are alike. A URL's score is the difference of
its log-likelihoods under both, divided by its number of characters; the threshold is the
highest that still accepts KEEP of the held-out accepted URLs.

Counts cover all pages. They are kept by distinct n-gram, and every distinct URL is scored once, by a join of its
n-grams with their scores: a broadcast of those that more than a HOT share of all have, a shuffle for the rest, so that no n-gram's
rows meet in one task. Pages get their URL's score without meeting by a very common URL, and those without a URL meet none. Scores are summed as whole billionths, so their order doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import HOT as HOT_URL
from lodestrata.llm.common import SMALL_ROWS, meet, shuffles, written
from lodestrata.session import table

ORDER, D, BINS, KEEP = 4, 2.0, 10_000, 0.97
#: An n-gram with more than this share of all is hot; there are at most 1 / HOT of them.
HOT = 1e-4
PAD, STOP = "\x01", "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): the rule's host up to its first slash, then its path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    get = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(get(1), UPPER, LOWER), get(2)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out.cast("struct<rule:string,verdict:string>")


def distinct_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """url, how many pages have it, its rule's label (1 accepted, 0 rejected, null none), and whether it calibrates."""
    host, path = parts(F.col("url"))
    urls = pages.select(F.col("url").cast("string")).where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("n"))
    label = F.when(ruled(host, path, rules)["verdict"] == "allow", 1).when(ruled(host, path, rules)["verdict"] == "block", 0)
    # dealt out evenly: each of these rows becomes one for each of its characters
    out = urls.select("url", "n", label.alias("label"), (F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long") % 5 == 0).alias("held"))
    return written(out.repartition(shuffles(pages.sparkSession)), "urls")


def grams(urls: DataFrame) -> DataFrame:
    """url, n, label, held and each of its (ORDER + 1)-grams, padded in front, with an end sign."""
    text = F.concat(F.lit(PAD * ORDER), F.translate("url", UPPER, LOWER), F.lit(STOP))
    at = F.explode(F.sequence(F.lit(1), F.length("_t") - ORDER))
    return urls.withColumn("_t", text).withColumn("_i", at).select("url", "n", "label", "held", F.substring("_t", F.col("_i"), F.lit(ORDER + 1)).alias("gram"))


def models(urls: DataFrame) -> DataFrame:
    """gram, c (how often it occurs in distinct URLs) and s: whole billionths of ln P_accepted - ln P_rejected, for every gram of any URL."""
    use = ~F.col("held") & F.col("label").isNotNull()
    each = [F.sum(F.when(use & (F.col("label") == k), F.col("n")).otherwise(0)).alias(c) for k, c in ((1, "a"), (0, "r"))]
    level = {ORDER: grams(urls).groupBy("gram").agg(*each, F.count("*").alias("c"))}
    for k in range(ORDER - 1, -1, -1):
        level[k] = level[k + 1].groupBy(F.substring("gram", 2, k + 1).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.sum("c").alias("c"))
    below = None
    for k in range(ORDER + 1):
        near = Window.partitionBy(F.substring("gram", 1, k))  # at most as many rows as there are characters
        df = level[k].select("*", F.sum("a").over(near).alias("na"), F.sum("r").over(near).alias("nr"), F.count("*").over(near).alias("kinds"))
        if below is None:
            df = df.select("*", (1 / F.col("kinds")).alias("pa0"), (1 / F.col("kinds")).alias("pr0"))
        else:
            df = df.join(below, F.substring("gram", 2, k) == F.col("g0"))
        probability = lambda c, n, p: (F.col(c) + D * F.col(p)) / (F.col(n) + D)
        below = df.select(F.col("gram").alias("g0"), "c", probability("a", "na", "pa0").alias("pa0"), probability("r", "nr", "pr0").alias("pr0"))
        last, below = below, below.drop("c")
    return last.select(F.col("g0").alias("gram"), "c", F.round((F.log("pa0") - F.log("pr0")) * 1e9).cast("long").alias("s"))


def scored(urls: DataFrame) -> DataFrame:
    """urls with score, the length-normalised difference of log-likelihoods."""
    known = written(models(urls), "models")
    hot = known.where(F.col("c") > (known.agg(F.sum("c")).head()[0] or 0) * HOT)
    each = grams(urls).select("url", "gram")
    total = lambda df: df.groupBy("url").agg(F.sum("s").alias("s"), F.count("*").alias("k"))
    common = total(each.join(F.broadcast(hot.select("gram", "s")), "gram"))
    rest = total(each.join(F.broadcast(hot.select("gram")), "gram", "left_anti").join(known.select("gram", "s"), "gram"))
    sums = common.unionByName(rest).groupBy("url").agg(F.sum("s").alias("_s"), F.sum("k").alias("_c"))
    return urls.join(sums, "url").select("url", "n", "label", "held", (F.col("_s") / F.col("_c") / 1e9).alias("score"))


def threshold(scores: DataFrame) -> float:
    """The highest score from which on KEEP of the held-out accepted URLs are accepted; 0 if either set is empty."""
    bins = scores.where("held AND label IS NOT NULL").groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.sum(F.col("n") * F.col("label")).alias("a"), F.sum(F.col("n") * (1 - F.col("label"))).alias("r"))
    # few rows: one a bin of scores
    up, all_ = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    cut = bins.select("bin", F.sum("a").over(up).alias("ta"), F.sum("r").over(up).alias("tr"), F.sum("a").over(all_).alias("na"), F.sum("r").over(all_).alias("nr"))
    best = cut.where("na > 0 AND nr > 0").where(F.col("ta") >= KEEP * F.col("na")).orderBy(F.col("bin").desc()).head()
    return best["bin"] / BINS if best else 0.0


def judged(pages: DataFrame, rules=RULES, small: int = SMALL_ROWS) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages; a null URL scores 0.

    Rows that repeat stay; null page_ids stay; without pages there are no rows.
    """
    scores = written(scored(distinct_urls(pages, rules)), "scores")
    at = threshold(scores)
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", ruled(F.col("host"), F.col("path"), rules))
    total = scores.agg(F.sum("n")).head()[0] or 0
    # a digest stands for the URL, so that what is broadcast is small whatever its length
    known = scores.select(F.unhex(F.sha2("url", 256)).alias("_u"), "score", (F.col("n") > total * HOT_URL).alias("hot"))
    rows = rows.withColumn("_u", F.unhex(F.sha2("url", 256)))
    without = rows.where("url IS NULL").withColumn("score", F.lit(None).cast("double"))
    rows = meet(rows.where("url IS NOT NULL"), known, ["_u"], "left", small).drop("hot").unionByName(without)
    own = F.when(F.coalesce("score", F.lit(0.0)) >= at, "allow").otherwise("block")
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `pages`."""
    return judged(table(spark, sf_dir, "pages")).drop("score")



def _fits(rule: str) -> str:
    h, _, p = rule.partition("/")
    return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"


_LONGEST = sorted(RULES, key=lambda r: -len(r[1]))
_PART = r"regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', {}, 's')"
_PARTS = f"translate(coalesce({_PART.format(1)}, ''), '{UPPER}', '{LOWER}') host, coalesce({_PART.format(2)}, '') path"


def _level(k: int) -> tuple[str, str]:
    context, below = f"substring(gram, 1, {k})", "pa pa0, pr pr0" if k else "1.0 / kinds pa0, 1.0 / kinds pr0"
    join = f"JOIN p{k - 1} b ON substring(c.gram, 2, {k}) = b.gram" if k else ""
    grams_ = f"SELECT substring(gram, 2, {k + 1}) gram, sum(a) a, sum(r) r FROM n{k + 1} GROUP BY ALL" if k < ORDER else "SELECT gram, sum(CASE WHEN label = 1 AND NOT held THEN n ELSE 0 END) a, sum(CASE WHEN label = 0 AND NOT held THEN n ELSE 0 END) r FROM grams GROUP BY gram"
    counts = f"n{k} AS MATERIALIZED ({grams_})"
    contexts = f"SELECT *, sum(a) OVER w na, sum(r) OVER w nr, count(*) OVER w kinds FROM n{k} WINDOW w AS (PARTITION BY {context})"
    return counts, f"p{k} AS MATERIALIZED (SELECT c.gram, (a + {D} * pa0) / (na + {D}) pa, (r + {D} * pr0) / (nr + {D}) pr FROM (SELECT c.*, {below} FROM ({contexts}) c {join}) c)"


_LEVELS = [_level(k) for k in range(ORDER + 1)]
OP6_SQL = f"""
WITH urls AS (SELECT url, count(*) n, ('0x' || substring(md5(url), 1, 8))::BIGINT % 5 = 0 held FROM pages WHERE url IS NOT NULL GROUP BY url),
known AS (SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in _LONGEST)} END rule FROM (SELECT url, n, held, {_PARTS} FROM urls)),
labelled AS MATERIALIZED (SELECT url, n, held, CASE {" ".join(f"WHEN rule = '{r}' THEN {int(v == 'allow')}" for v, r in RULES)} END label FROM known),
texts AS (SELECT *, repeat(chr(1), {ORDER}) || translate(url, '{UPPER}', '{LOWER}') || chr(2) t FROM labelled),
grams AS MATERIALIZED (SELECT url, n, label, held, substring(t, i, {ORDER + 1}) gram FROM texts, unnest(range(1, length(t) - {ORDER - 1})) u(i)),
{", ".join(c for c, _ in reversed(_LEVELS))}, {", ".join(p for _, p in _LEVELS)},
scores AS MATERIALIZED (SELECT url, any_value(n) n, any_value(label) label, any_value(held) held, sum(CAST(round((ln(pa) - ln(pr)) * 1e9) AS BIGINT)) / count(*) / 1e9 score FROM grams JOIN p{ORDER} USING (gram) GROUP BY url),
bins AS (SELECT floor(score * {BINS}) bin, sum(n * label) a, sum(n * (1 - label)) r FROM scores WHERE held AND label IS NOT NULL GROUP BY bin),
cut AS (SELECT bin, sum(a) OVER (ORDER BY bin DESC) ta, sum(a) OVER () na, sum(r) OVER () nr FROM bins),
least AS (SELECT coalesce(max(bin) / {BINS}, 0) limit_ FROM cut WHERE na > 0 AND nr > 0 AND ta >= {KEEP} * na),
found AS (SELECT page_id, url, {_PARTS} FROM pages),
ruled AS (SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in _LONGEST)} END rule FROM found)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)} WHEN coalesce(score, 0) >= (SELECT limit_ FROM least) THEN 'allow' ELSE 'block' END verdict
FROM ruled LEFT JOIN scores USING (url)
"""
