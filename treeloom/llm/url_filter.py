"""URL filters: host/path rules first, then a blocked Bloom filter in front of an exact hash join.

A listed URL is blocked. The Bloom filter of the listed canonical URLs is a small table of 256-bit blocks (four 64-bit
words, two bits each), built with bit_or aggregates and probed by a broadcast join on the block number. Only urls that hit go
to the exact hash join, which removes the false positives. The number of blocks is capped (`max_blocks`), so what is
broadcast is bounded whatever the list's length; beyond the cap only the false positive rate grows, the verdicts stay exact.

Two urls are the same if their canonical forms are: host (A-Z lower-cased, without default port), path without trailing
slashes, and the query's parts in order. Another query is another url.

Defined cases: a null url, or one without "://", has an empty host and path and an empty canonical form, fits no rule and
is never listed (allow). Null, empty and repeated listed urls count once or not at all. An empty list blocks nothing. Of rules
that fit equally long the one with the longer host, then the greater text, wins; a rule given twice has its last verdict.
Repeated pages give a row each; urls may be of any length. Other columns of the pages, whatever their names, are left out of
the result but for those in `keep`. A popular page meets a list of distinct urls, so it isn't gathered with others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import ASCII_LOWER, ASCII_UPPER, ascii_lower, materialize, table

#: (verdict, rule); a rule is a host and a path that starts with "/".
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
MAX_RULES = 1000
BLOCK_BITS = 256
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 20
#: Listed urls whose hash table one task of the exact join holds, about.
KEYS_PER_TASK = 500_000


def url_host(url: Column) -> Column:
    """What is after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.when(url.contains("://"), ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def url_path(url: Column) -> Column:
    """From the host's end up to "?", "#" or the end; else empty."""
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.when(url.contains("://"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def url_query(url: Column) -> Column:
    """What is between the first "?" and "#" or the end; else empty."""
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.when(url.contains("://"), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)).otherwise("")


def canonical_url(url: Column) -> Column:
    """Host without a default port, path without trailing slashes, the query's parts in order; scheme and fragment don't count.

    Null and urls without "://" give an empty form.
    """
    host = F.regexp_replace(url_host(url), r":(80|443)?$", "")
    query = F.array_join(F.array_sort(F.split(url_query(url), "&")), "&")
    return F.concat(host, F.rtrim(url_path(url), F.lit("/")), F.when(url_query(url) != "", F.concat(F.lit("?"), query)).otherwise(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits (then the one with the longer host, then by text), else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    parts = [(r, r[: r.index("/")], r[r.index("/") :]) for _, r in rules]
    found = F.lit(None).cast("string")
    for rule, at, start in sorted(parts, key=lambda p: (len(p[0]), len(p[1]), p[0])):  # the last one outermost
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def bloom_block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks).cast("long"))


def bloom_word(key: str, k: int) -> str:
    """SQL for the two bits that a key sets in the k-th word of its block."""
    h = f"xxhash64({key}, {0x9E3779B9}L)"
    bit = lambda n: f"shiftleft(1L, cast(shiftrightunsigned({h}, {6 * n}) & 63 AS int))"
    return f"({bit(2 * k)} | {bit(2 * k + 1)})"


def bloom_filter(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0..w3) of the non-null keys; partial bit_or aggregates combine before the shuffle."""
    words = [F.bit_or(F.expr(bloom_word(key, k))).alias(f"w{k}") for k in range(4)]
    return keys.groupBy(bloom_block(F.col(key), n_blocks).alias("block")).agg(*words)


def blocks_for(n_keys: int, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, -(-n_keys * BITS_PER_KEY // BLOCK_BITS)))


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    keep: Sequence[str] = (),
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """id, host, path, rule, verdict, reason (rule, list, none) of every page; listed holds the urls to block."""
    canon = canonical_url(F.col(listed_col)).alias("canon")
    list_keys = materialize(listed.select(canon).where(F.col("canon") != "").distinct(), "listed-urls")
    # one small job: the filter's size follows the list's, up to the cap
    n_keys = list_keys.agg(F.count("*")).first()[0]
    n_blocks = blocks_for(n_keys, max_blocks)
    bloom = F.broadcast(bloom_filter(list_keys, "canon", n_blocks))

    url, own = F.col(url_col), ["host", "path", "rule"]
    kept = F.struct(F.col(id_col), *[F.col(c) for c in keep]).alias("kept")  # whatever their names, they meet no other column
    base = pages.select(kept, url_host(url).alias("host"), url_path(url).alias("path"), F.coalesce(canonical_url(url), F.lit("")).alias("canon"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for v, r in rules:
        by_rule = F.when(F.col("rule") == r, F.lit(v)).otherwise(by_rule)
    asked = F.col("rule").isNull() & (F.col("canon") != "")
    probed = base.withColumn("block", F.when(asked, bloom_block(F.col("canon"), n_blocks))).join(bloom, "block", "left")
    hit = F.lit(True)
    for k in range(4):
        want = F.expr(bloom_word("canon", k))
        hit = hit & (F.col(f"w{k}").bitwiseAND(want) == want)
    probed = probed.withColumn("hit", F.coalesce(hit, F.lit(False)))

    passed = probed.where(~F.col("hit")).select(
        "kept", *own, F.coalesce(by_rule, F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), "none").otherwise("rule").alias("reason")
    )
    # the exact join; a list too long for hash tables in memory is merged. Spark may split a popular url's rows in either
    n_parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exact = list_keys.select("canon", F.lit(True).alias("listed")).hint("shuffle_hash" if n_keys <= KEYS_PER_TASK * n_parts else "merge")
    judged = probed.where("hit").select("kept", *own, "canon").join(exact, "canon", "left")
    judged = judged.select(
        "kept", *own, F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"), F.when(F.col("listed"), "list").otherwise("none").alias("reason")
    )
    field = lambda c: F.col("kept").getField(c).alias(c)
    return passed.unionByName(judged).select(field(id_col), *own, "verdict", "reason", *[field(c) for c in keep])


#: A host with such a label is a seed of the list.
SEED_LABEL = r"(^|\.)(spam|casino)-"


def seed_list(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The list that the query takes: every url of a host with a spam- or casino- label, spelled as a list from elsewhere might be."""
    url = F.col(url_col)
    host, query = url_host(url), url_query(url)
    port = F.when(F.contains(host, F.lit(":")), "").otherwise(":80")
    spelled = F.concat(F.lit("HTTP://"), F.translate(host, ASCII_LOWER, ASCII_UPPER), port, url_path(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.lit("#listed"))
    return pages.where(host.rlike(SEED_LABEL)).select(spelled.alias("url"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, seed_list(pages)).select("page_id", "host", "path", "rule", "verdict")


_HOST = "CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
_QUERY = "CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*\\?([^#]*)', 1) ELSE '' END"

OP1_SQL = f"""
WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM pages),
p AS (SELECT *, regexp_replace(host, ':(80|443)?$', '') || rtrim(path, '/') ||
  CASE WHEN query <> '' THEN '?' || array_to_string(list_sort(string_split(query, '&')), '&') ELSE '' END AS canon FROM u),
r AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for v, r in RULES)}) t(rule, rhost, rpath, verdict)),
fit AS (
  SELECT p.*, (SELECT max_by(r.rule, length(r.rule)) FROM r WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)) AS rule
  FROM p),
listed AS (SELECT DISTINCT canon FROM p WHERE regexp_matches(host, '{SEED_LABEL}'))
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN (SELECT verdict FROM r WHERE r.rule = fit.rule)
       WHEN canon IN (SELECT canon FROM listed WHERE canon <> '') THEN 'block' ELSE 'allow' END AS verdict
FROM fit
"""
