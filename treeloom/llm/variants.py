"""Spelling variants: words at distance one by a self-join of vocabulary tries with active nodes, and the form each word goes back to.

Two words are near if one inserted, deleted or replaced code point turns one into the other. A pair belongs to the class c of its shorter
word's length and to the segment of [0, c] in which its common prefix ends; both words then agree on what stands before the segment and
on what follows it. So a word goes to the groups of its own length's class and of the class below, one a segment, keyed by what lies
outside the segment, and each pair meets in exactly one of them. At first there are two segments, which is a trie parted by prefixes for edits
in the second half and one parted by suffixes for edits in the first. Groups of over `group_words` words are parted again by halving
their segment, down to one place, where a group has a word for each letter at most; no group needs to be cut off.

Within a group the segments' strings form a trie. A walk from the root carries each node's active nodes, those within distance one,
derived from its parent's; where both ends are words at distance one, the pair is found.

Defined cases: a null text has no words, a null id counts as an empty string in the checksum that deletes letters. Texts may be of any
length. Repeated rows count as often as they occur. Ties between forms go to the smallest word in code-point order. Without words
there are no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import bound_batches, materialize, slices, table

MIN_CHARS = 5
MIN_COUNT = 3
DELETE_MOD = 97
GROUP_WORDS = 2000
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: One byte a code point: letters of the runs stay, A-Z as a-z, all else is a space.
_RUNS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))


def runs_of(text: str) -> list[bytes]:
    """The lower-cased runs of a text in Latin-1; code points beyond it become question marks, which part runs as they did."""
    return text.encode("latin-1", "replace").translate(_RUNS).split()


def damaged(run: bytes, doc_crc: int, mod: int) -> bytes:
    """The run, without one letter if the checksum of id, colon and run in UTF-8 says so. doc_crc is that of id and colon."""
    crc = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), doc_crc)
    if crc % mod:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    delete_mod: int = DELETE_MOD,
) -> DataFrame:
    """word, n of the words of min_chars code points that occur min_count times. Tasks count before the shuffle."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_crc = zlib.crc32(f"{doc_id or ''}:".encode())
                for run, n in Counter(runs_of(text)).items():
                    if len(run) >= min_chars:
                        word = damaged(run, doc_crc, delete_mod)
                        if len(word) >= min_chars:
                            held[word] += n
            if len(held) >= HELD_WORDS:
                yield out()
                held.clear()
        yield out()

    texts = docs.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Node:
    __slots__ = ("at", "children", "depth")

    def __init__(self, depth: int):
        self.children: dict[str, Node] = {}
        self.depth = depth
        self.at: int | None = None  # the word that ends here


def near_pairs_of(words: list[str]) -> Iterator[tuple[int, int]]:
    """Indexes (i, j), i < j, of the distinct words at distance one, by a walk over their trie with active nodes."""
    root = Node(0)
    for i, word in enumerate(words):
        node = root
        for c in word:
            child = node.children.get(c)
            if child is None:
                child = node.children[c] = Node(node.depth + 1)
            node = child
        node.at = i
    # a node's active nodes with their distances: itself, and those at distance one
    stack = [(root, list(root.children.values()))]
    while stack:
        node, ones = stack.pop()
        if node.at is not None:
            for other in ones:
                if other.at is not None and node.at < other.at:
                    yield node.at, other.at
        siblings = node.children
        for c, child in siblings.items():
            # distance one from the child: its parent (c deleted), its siblings (c replaced), its children (one inserted), and what
            # follows the parent's active nodes by the same letter
            found = {id(node): node}
            for other in siblings.values():
                if other is not child:
                    found[id(other)] = other
            for other in child.children.values():
                found[id(other)] = other
            for other in ones:
                step = other.children.get(c)
                if step is not None and step is not child:
                    found[id(step)] = step
            stack.append((child, list(found.values())))


def _segment_rows(words: DataFrame) -> DataFrame:
    """word, n, c, lo, hi for each class and each half."""
    length = F.char_length("word")
    classes = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("c")).where("c > 0")
    half = F.floor(F.col("c") / 2).cast("int")
    bounds = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("c").alias("hi")))
    return classes.withColumn("b", F.explode(bounds)).select("word", "n", "c", "b.lo", "b.hi")


def _keyed(rows: DataFrame) -> DataFrame:
    """pre and post: what stands before lo and what follows hi, counted from the end as in a word of c letters."""
    return rows.withColumn("pre", F.substr("word", F.lit(1), F.col("lo"))).withColumn("post", F.right("word", F.col("c") - F.col("hi")))


_KEY = ["c", "lo", "hi", "pre", "post"]


def groups(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """c, lo, hi, members (word, n): groups of two to group_words words, or of words that differ at one place; all near pairs lie within one."""
    out, rows = None, _segment_rows(words)
    while True:
        keyed = _keyed(rows)
        sizes = keyed.groupBy(*_KEY).agg(F.count("*").alias("size"))
        large = materialize(sizes.where((F.col("size") > group_words) & (F.col("hi") - F.col("lo") > 1)).select(_KEY), "variant-large-groups")
        some = large.limit(1).count() > 0
        small = keyed.join(large, _KEY, "left_anti") if some else keyed
        shortest = F.min(F.char_length("word")).alias("shortest")  # without a word of c letters there is no pair of this class
        gathered = small.groupBy(*_KEY).agg(F.collect_list(F.struct("word", "n")).alias("members"), shortest).where((F.size("members") > 1) & (F.col("shortest") == F.col("c")))
        gathered = gathered.select("c", "lo", "hi", "members")
        out = gathered if out is None else out.unionByName(gathered)
        if not some:
            return out
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
        rows = materialize(keyed.join(large, _KEY, "left_semi").withColumn("b", F.explode(parts)).select("word", "n", "c", "b.lo", "b.hi"), "variant-parts")


def near_pairs(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """a, n_a, b, n_b: each pair of near words of the vocabulary (word, n) once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = [p for r in batch.to_pylist() for p in pairs_of_group(r["c"], r["lo"], r["hi"], r["members"])]
            columns = list(zip(*pairs, strict=True)) if pairs else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], names=["a", "n_a", "b", "n_b"])

    return groups(words, group_words).mapInArrow(find, "a string, n_a long, b string, n_b long")


def pairs_of_group(c: int, lo: int, hi: int, members: list[dict]) -> Iterator[tuple[str, int, str, int]]:
    """The group's near pairs whose shorter word has c letters and whose common prefix ends within [lo, hi), or at c if that is hi."""
    words = [m["word"] for m in members]
    for i, j in near_pairs_of([w[lo : len(w) - (c - hi)] for w in words]):
        a, b = words[i], words[j]
        if min(len(a), len(b)) == c:
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), c)
            if same < hi or same == c == hi:
                yield a, members[i]["n"], b, members[j]["n"]


def spelling_variants(words: DataFrame, *, ratio: int = 2, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n): the form is the most frequent near word if it is `ratio` times as frequent."""
    words = materialize(words, "variant-words")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """word, k, m, form: its near words in the group, how often the first of them occurs, and which that is."""
        for batch in slices(batches):
            out: list[tuple] = []
            for r in batch.to_pylist():
                held: dict[str, tuple[int, int, str]] = {}
                for a, n_a, b, n_b in pairs_of_group(r["c"], r["lo"], r["hi"], r["members"]):
                    for word, m, form in ((a, n_b, b), (b, n_a, a)):
                        k, most, first = held.get(word, (0, 0, ""))
                        held[word] = (k + 1, m, form) if m > most or (m == most and form < first) else (k + 1, most, first)
                out += [(w, *x) for w, x in held.items()]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "k", "m", "form"])

    found = groups(words, group_words).mapInArrow(best, "word string, k long, m long, form string")
    first = F.min(F.struct((-F.col("m")).alias("m"), F.col("form"))).alias("first")
    near = found.groupBy("word").agg(F.sum("k").alias("n_near"), first)
    good = -F.col("first.m") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("first.form")).alias("form"), F.when(good, -F.col("first.m")).alias("form_n")
    )
    told = materialize(told, "variant-forms")
    return told.join(roots(told), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(told: DataFrame) -> DataFrame:
    """word, root of the words with a form: each round doubles the steps taken, and counts grow along forms, so rounds are few and end."""
    now = materialize(told.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialize(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if stepped.where("moved").limit(1).count() == 0:
            return stepped.select("word", "root")
        now = stepped.select("word", "root")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents")))


_BYTES = "flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6)::BIGINT, 128 + (ord(x) & 63)::BIGINT] END))"
OP12_SQL = f"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
d AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run
  FROM documents),
e AS (SELECT doc, run, count(*) AS k FROM d WHERE length(run) >= {MIN_CHARS} GROUP BY ALL),
h AS (SELECT run, k, xor(4294967295, list_reduce({_BYTES}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM e, tab),
w AS (SELECT CASE WHEN h % {DELETE_MOD} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) t(i)),
y AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
z AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM y GROUP BY word),
f AS (
  SELECT word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM v LEFT JOIN z USING (word)),
r AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) JOIN f g ON g.word = r.root WHERE g.form IS NULL
"""
