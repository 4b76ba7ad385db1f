"""Secret scans over a trigram inverted index; DataFrame functions only.

A Boolean trigram query is derived from each rule's regular expression. The index has a posting list per trigram and block of
documents: a block is a hash range of some thousand documents, so the postings of a trigram that every document holds are many
short lists instead of a long one. Each block intersects and unites its lists by the queries; the candidates' rules come back
to the documents by a join, which is broadcast only if the written candidates are few, and only candidates are verified by the
regular expression. A rule without mandatory trigrams (hex) has no query and scans every document.

Matches are leftmost and do not overlap within a rule. A rule may ask a least length of the match or of a group: shorter
matches still take their place, but are dropped. Spans are counted in code points, ends exclusive.

Defined cases: a null text counts as empty and has no spans. Texts may be of any length, and so may secrets. Of matches that start at one place all
are listed, in the rules' order. Repeated rows give a row each, as do rows with null ids; an empty table gives none. Other
columns, whatever their names, pass through `keep` or are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import ascii_lower, materialize, table
from treeloom.llm.trigrams import Query, trigram_query, trigrams_of


class Rule(NamedTuple):
    kind: str
    pattern: str  # means the same to Java and Python
    group: int = 0
    least: int = 0  # characters that the group must have


#: The base rules, in the order in which spans at the same start are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # of a run of these letters the shorter ones fail as a whole
)
#: Rules of this operator's own.
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
_PEM_NAME = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_LINE_END = r"(?:\r?\n|\\++[nr])"  # also as written in JSON and settings
_GAP = r"(?:\s|\\++[nrt])"
_CODE = r"(?:[A-Za-z0-9+/]|\\++/)"
_PEM_HEADERS = rf"(?:{_GAP}++[A-Z][A-Za-z]*-[A-Za-z-]++:\x20[^\n\\]*+)*+"
_PEM_SHORT = rf"(?:[ \t]*+{_LINE_END})++[ \t]*+(?=[A-Za-z]*+[0-9+/=]|[A-Z]*[a-z]+[A-Z]){_CODE}++={{0,2}}+(?=[ \t]*+(?:{_LINE_END}|(?![\s\S])))"
#: To the END line of this key, whatever stands before it; without one to the end of the base64: runs of 16 letters, and shorter lines
#: that don't look like a word. All repeats are possessive, so none is counted and none can overflow the matcher's stack.
_PEM_BODY = (
    rf"(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END {_PEM_NAME}"
    rf"|{_PEM_HEADERS}(?:{_CODE}{{16,}}+)?+(?:{_GAP}++{_CODE}{{16,}}+={{0,2}}+|{_PEM_SHORT})*+)"
)
_WHOLE = {"pem": rf"-----BEGIN {_PEM_NAME}{_PEM_BODY}"}
#: The same rules for removal: their matches span the whole secret, where some of RULES, as listed by op6, end earlier.
REDACT_RULES = tuple(r._replace(pattern=_WHOLE.get(r.kind, r.pattern)) for r in RULES)
BLOCK_DOCS = 4096
BROADCAST_ROWS = 1 << 20
_SUM_BLOCK = 128


def _postings(keyed: DataFrame, grams: Sequence[str], n_blocks: int) -> DataFrame:
    """(block, gram, keys): the keys of the block's documents whose lower-cased text holds the trigram."""
    low = ascii_lower(F.col("text"))
    held = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    rows = keyed.select("key", low.alias("low")).select("key", F.explode(held).alias("gram"))
    block = F.pmod(F.col("key"), F.lit(n_blocks).cast("long"))
    return rows.groupBy(block.alias("block"), "gram").agg(F.collect_set("key").alias("keys"))


def _evaluate(lists: Column, query: Query) -> Column:
    """The keys that a block's lists (a map of trigram to keys) give for a query."""
    none = F.array().cast("array<bigint>")
    get = lambda g: F.coalesce(F.try_element_at(lists, F.lit(g)), none)

    def all_of(grams: frozenset[str]) -> Column:
        first, *rest = sorted(grams)
        found = get(first)
        for g in rest:
            found = F.array_intersect(found, get(g))
        return found

    result = None
    for clause in query:
        found = all_of(clause[0])
        for alternative in clause[1:]:
            found = F.array_union(found, all_of(alternative))
        result = found if result is None else F.array_intersect(result, found)
    return result


def candidates(keyed: DataFrame, rules: Sequence[Rule], n_blocks: int) -> DataFrame:
    """(key, mask): bit r is set if the document passes the trigram query of rule r; keys without any are left out."""
    queries = [trigram_query(r.pattern) for r in rules]
    index = _postings(keyed, trigrams_of(queries), n_blocks)
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))
    flagged = lambda bit: lambda k: F.struct(k.alias("key"), F.lit(bit).cast("long").alias("bit"))
    found = F.concat(*[F.transform(_evaluate(F.col("lists"), q), flagged(1 << r)) for r, q in enumerate(queries) if q])
    hits = lists.select(F.explode(found).alias("hit")).select("hit.key", "hit.bit")
    return hits.groupBy("key").agg(F.bit_or("bit").alias("mask"))


def _sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it; sums of blocks first, so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")
    total = lambda part: F.aggregate(part, zero, lambda a, x: a + x)
    n_blocks = F.ceil(F.size(lengths) / F.lit(_SUM_BLOCK)).cast("int")
    numbers = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda b: F.slice(lengths, b * _SUM_BLOCK + 1, F.lit(_SUM_BLOCK))
    sums = F.transform(numbers, lambda b: total(block(b)))
    before = F.transform(numbers, lambda b: total(F.slice(sums, F.lit(1), b)))
    inner = F.transform(
        numbers,
        lambda b: F.transform(block(b), lambda x, i: F.element_at(before, b + 1) + total(F.slice(block(b), F.lit(1), i))),
    )
    return F.flatten(inner)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, kind, end>> of the rule's matches that pass."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    size = lambda x: F.char_length(x).cast("long")
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(size(g).alias("gap"), size(h).alias("hit")))
    before = _sums_before(F.transform(pairs, lambda p: p["gap"] + p["hit"]))
    spans = F.zip_with(
        pairs,
        before,
        lambda p, b: F.struct((b + p["gap"]).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (b + p["gap"] + p["hit"]).alias("end")),
    )
    if rule.least:
        asked = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: F.char_length(g) >= rule.least)
        both = F.zip_with(spans, asked, lambda s, ok: F.struct(s.alias("s"), ok.alias("ok")))
        spans = F.transform(F.filter(both, lambda x: x["ok"]), lambda x: x["s"])
    return spans


SPAN = "array<struct<start:bigint,order:int,kind:string,end:bigint>>"


def scan_secrets(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
    block_docs: int = BLOCK_DOCS,
    broadcast_rows: int = BROADCAST_ROWS,
    found_col: str = "found",
) -> DataFrame:
    """The id, `keep`, and found_col: array<struct<start, order, kind, end>> by start, then the rules' order, of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    keyed = docs.select(F.xxhash64(id_col, text).alias("key"), F.col(id_col).alias("id"), text.alias("text"), *kept)
    n_docs = docs.agg(F.count("*")).first()[0]
    passed = materialize(candidates(keyed.select("key", "text"), rules, max(1, -(-n_docs // block_docs))), "secret-candidates")
    if passed.agg(F.count("*")).first()[0] <= broadcast_rows:
        passed = F.broadcast(passed)
    joined = keyed.join(passed, "key", "left")
    none = F.array().cast(SPAN)
    spans = []
    for r, rule in enumerate(rules):
        due = F.rlike("text", F.lit(rule.pattern))
        if trigram_query(rule.pattern):
            due = (F.coalesce("mask", F.lit(0)).bitwiseAND(F.lit(1 << r)) != 0) & due
        spans.append(F.when(due, _spans(F.col("text"), rule, r)).otherwise(none))
    out = joined.select("id", *[f"keep_{i}" for i in range(len(keep))], F.array_sort(F.concat(*spans)).alias("found"))
    return out.select(F.col("id").alias(id_col), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], F.col("found").alias(found_col))


def joined_spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """text with every span, overlapping ones as one, replaced by mark."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(more.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    tail = lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int")))
    return F.when(F.size(found) > 0, F.aggregate(found, state, step, tail)).otherwise(text)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE_RULES]
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"))


def _sql_matches() -> str:
    parts = []
    for order, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, t, '{r.kind}' AS kind, {order} AS ord, {r.least} AS least, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {r.group}) AS asked FROM d WHERE regexp_matches(t, '{p}')"
        )
    return " UNION ALL ".join(parts)


_JOINED = "kind || ':' || s || ':' || e, ',' ORDER BY s, ord"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_sql_matches()}),
u AS (SELECT rid, kind, ord, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, asked FROM m),
l AS (SELECT rid, kind, ord, least, i, length(gaps[i]) AS g, length(hits[i]) AS h, length(asked[i]) AS a FROM u),
sp AS (
  SELECT *, e - h AS s FROM (SELECT *, sum(g + h) OVER (PARTITION BY rid, ord ORDER BY i)::BIGINT AS e FROM l)
  WHERE a >= least),
x AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg({_JOINED}) FILTER (ord < {len(BASE_RULES)}) AS base, string_agg({_JOINED}) AS spans
  FROM sp GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (rid)
"""
