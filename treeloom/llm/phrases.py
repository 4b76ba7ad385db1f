"""Phrase collocation mining by Apriori passes, one per phrase length.

The first pass counts words and gives each frequent word of a language a number; texts become sequences of these numbers, zero
for a rare word or a boundary. A frequent phrase of k words is a pair of two frequent phrases of k-1 words that overlap, so the pass for k
puts the numbers of the frequent (k-1)-grams in the sequences' places, and counts pairs of neighbouring numbers only where both
are frequent. Tasks count before the shuffle and hand on their counts when these reach a bound. Numbers come to the
sequences by a broadcast of the level, as long as it has at most `broadcast_grams` words or four times as many pairs. Beyond that sequences
are coded in blocks of bounded size, and a block's distinct words or pairs meet the level in a shuffled join, a row each; the rows are the same. Each level's table carries the counts of a phrase's beginnings and endings, so cuts are scored without another look at the texts.

Defined cases: a null text counts as empty, a null language as `und`. Texts may be of any length: they are cut into chunks of
`chunk_words` words, each with the words that follow it. Repeated rows and repeated or null ids count as often as they occur. Ties
end at the phrase, which is unique in its language. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.llm.common import bound_batches, materialize, shuffled, slices, table

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: Levels of more words, or four times as many pairs, come to the sequences by a join: 2^18 words are some 30 MB in each Python worker, four times as many pairs 24 MB.
BROADCAST_GRAMS = 1 << 18
CHUNK_WORDS = 4096
#: Entries that a task counts before it hands them on.
HELD_COUNTS = 250_000
SPLITS = b".,;:!?\x0a\x0b\x0c\x0d"
#: No byte of UTF-8; stands between pieces.
_BOUNDARY = b"\xff"
_LOWER = bytes(0xFF if c in SPLITS else c + 32 if 0x41 <= c <= 0x5A else 0x20 if c == 0x09 else c for c in range(256))
_CHUNK = "own int, ids array<bigint>"
#: Places of a block, whose distinct words or pairs meet a level that isn't broadcast.
BLOCK_WORDS = 1 << 17
_BLOCK_COLUMNS = ("chunk_own", "lengths", "codes")
_BLOCK = ", ".join(f"{c} binary" for c in _BLOCK_COLUMNS)


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words of a text in UTF-8, and a boundary between pieces."""
    return text.translate(_LOWER).replace(_BOUNDARY, b" \xff ").split(b" ")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Language and words of each row; splitting at single spaces leaves empty strings, which are no words."""
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            yield lang, [w for w in words_of(text) if w]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, f; the number of all words stands beside a null word."""
    held: dict[str, Counter] = defaultdict(Counter)
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        while held:  # a language's counts go as soon as they are arrays
            lang, counts = held.popitem()
            words, f = pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(f), np.int32))), words, f], names=["lang", "word", "f"])

    for lang, words in _texts(batches):
        counts = held[lang]
        before = len(counts)
        boundaries = words.count(_BOUNDARY)
        counts.update(words)
        counts.pop(_BOUNDARY, None)
        if len(words) > boundaries:
            counts[None] += len(words) - boundaries
        size += len(counts) - before
        if size >= HELD_COUNTS:
            yield from out()
            size = 0
    yield from out()


def _chunks(words: list, size: int, more: int) -> Iterator[tuple[int, list]]:
    """(own, words): the chunk's own words and up to `more` of those that follow."""
    for at in range(0, len(words), size):
        yield min(size, len(words) - at), words[at : at + size + more]


def _numbered_words(docs: DataFrame, level: DataFrame, small: bool, max_words: int, chunk_words: int) -> DataFrame:
    """chunk, own, ids: the numbers of the frequent words, zero elsewhere and once more at the end; texts without two of them in a row are left out."""
    spark = docs.sparkSession
    if small:
        numbers: dict[str, dict[bytes, int]] = defaultdict(dict)
        for r in level.select("lang", "phrase", "id").toPandas().itertuples():
            numbers[r.lang][r.phrase.encode()] = r.id
        sent = spark.sparkContext.broadcast(dict(numbers))

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, ids, held = [], [], 0

            def out() -> pa.RecordBatch:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["own", "ids"])

            for lang, words in _texts(batches):
                get = sent.value.get(lang, {}).get
                for n, part in _chunks(words, chunk_words, max_words - 1):
                    found = np.fromiter((get(w, 0) for w in part), np.int64, len(part))
                    if np.any((found[:-1] != 0) & (found[1:] != 0)):
                        own.append(n)
                        ids.append(np.append(found, 0))
                        held += len(part)
                if held > 1 << 20:
                    yield out()
                    own, ids, held = [], [], 0
            yield out()

        return docs.mapInArrow(number, _CHUNK).withColumn("chunk", F.monotonically_increasing_id())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Block] = defaultdict(_Block)
        size = 0
        for lang, words in _texts(batches):
            for n, part in _chunks(words, chunk_words, max_words - 1):
                held[lang].add(n, part)
                size += len(part)
                if size >= BLOCK_WORDS:
                    yield from (held[x].row(x) for x in held)
                    held.clear()
                    size = 0
        yield from (held[x].row(x) for x in held)

    blocks = materialize(docs.mapInArrow(coded, f"{_BLOCK}, lang string, words array<string>").withColumn("block", F.monotonically_increasing_id()), "phrase-words")
    met = blocks.select("block", "lang", F.posexplode("words").alias("code", "phrase")).join(level.select("lang", "phrase", "id"), ["lang", "phrase"])
    return _decoded(blocks, met)


class _Block:
    """Chunks of words of one language; each distinct word has a code from 1, and zero is a boundary."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {_BOUNDARY: 0}
        self.own: list[int] = []
        self.parts: list[np.ndarray] = []

    def add(self, own: int, part: list[bytes]) -> None:
        codes = self.codes
        self.own.append(own)
        self.parts.append(np.fromiter((codes.setdefault(w, len(codes)) for w in part), np.int32, len(part)))

    def row(self, lang: str) -> pa.RecordBatch:
        words = pa.array(list(self.codes)[1:], pa.binary()).cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        return pa.RecordBatch.from_arrays([*_packed(self.own, [len(x) for x in self.parts], np.concatenate(self.parts)), pa.array([lang], pa.string()), lists], names=[*_BLOCK_COLUMNS, "lang", "words"])


def _packed(own, lengths, codes) -> list[pa.Array]:
    return [pa.array([np.asarray(x, np.int32).tobytes()], pa.binary()) for x in (own, lengths, codes)]


def _decoded(blocks: DataFrame, met: DataFrame) -> DataFrame:
    """chunk, own, ids of blocks and of the numbers that their codes have (block, code from 0, id); a block's codes are bounded."""
    numbers = met.groupBy("block").agg(F.collect_list("code").alias("code"), F.collect_list("id").alias("id"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            own, lengths, codes = (np.frombuffer(batch.column(k)[0].as_py(), np.int32) for k in range(3))
            code, numbers = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (3, 4))
            known = np.zeros(max(codes.max(initial=0), code.max(initial=-1) + 1) + 1, np.int64)
            known[code + 1] = numbers
            # a zero more at the end of each chunk
            ends = np.cumsum(lengths + 1, dtype=np.int64)
            ids = np.zeros(ends[-1], np.int64)
            last = np.zeros(len(ids), bool)
            last[ends - 1] = True
            ids[~last] = known[codes]
            pairs = np.concatenate([(ids[:-1] != 0) & (ids[1:] != 0), [False]])
            keep = np.add.reduceat(pairs, ends - lengths - 1) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(own), lists], names=["own", "ids"]).filter(pa.array(keep))

    whole = blocks.select("block", *_BLOCK_COLUMNS).join(shuffled(numbers), "block").select(*_BLOCK_COLUMNS, "code", "id")
    return whole.mapInArrow(decode, _CHUNK).withColumn("chunk", F.monotonically_increasing_id())


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the lists of column 1 in a row, their ends, and which places are a chunk's own. A list ends in a zero, so no pair reaches over it."""
    lists = batch.column(1)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    own = np.arange(len(values)) - np.repeat(begins, ends - begins) < np.repeat(batch.column(0).to_numpy(zero_copy_only=False), ends - begins)
    return values, ends, own


def _tallied(p: np.ndarray, q: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and the sums of f."""
    order = np.lexsort((q, p))
    p, q, f = p[order], q[order], f[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])]) if len(p) else np.zeros(0, bool)
    return p[new], q[new], np.add.reduceat(f, np.flatnonzero(new)) if len(p) else f


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """p, q, f of neighbouring numbers, both of frequent phrases."""
    names = ["p", "q", "f"]
    held = (np.zeros(0, np.int64),) * 3
    for batch in filter(len, batches):
        ids, _, own = _flat(batch)
        here = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0) & own[:-1])
        p, q = ids[here], ids[here + 1]
        if p.size and max(p.max(), q.max()) < 1 << 31:  # two numbers are one then, which sorts faster
            both, f = np.unique(p << 32 | q, return_counts=True)
            p, q = both >> 32, both & 0xFFFFFFFF
        else:
            p, q, f = _tallied(p, q, np.ones(len(p), np.int64))
        held = _tallied(*(np.concatenate([a, b]) for a, b in zip(held, (p, q, f), strict=True)))
        if len(held[0]) > HELD_COUNTS:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=names)
            held = (np.zeros(0, np.int64),) * 3
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in held], names=names)


def _numbered_pairs(chunks: DataFrame, level: DataFrame, small: bool) -> DataFrame:
    """chunk, own, ids, with the numbers of the level's phrases where they begin."""
    if small:
        rows = level.select("p", "q", "id").toPandas()
        order = np.lexsort((rows["q"], rows["p"]))
        p, q, numbers = (rows[c].to_numpy(np.int64)[order] for c in ("p", "q", "id"))
        sent = chunks.sparkSession.sparkContext.broadcast((p, q, numbers))

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, q, numbers = sent.value
            pairs = np.rec.fromarrays([p, q], names="p,q") if p.size and max(p.max(), q.max()) >= 1 << 31 else p << 32 | q
            for batch in filter(len, batches):
                ids, ends, _ = _flat(batch)
                here = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
                a, b = ids[here], ids[here + 1]
                wanted = np.rec.fromarrays([a, b], names="p,q") if pairs.dtype.names else a << 32 | b
                at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
                found = np.zeros(len(ids), np.int64)
                found[here] = np.where(pairs[at] == wanted, numbers[at], 0)
                keep = np.add.reduceat((found[:-1] != 0) & (found[1:] != 0), np.concatenate([[0], ends[:-1]]).astype(np.int64)) > 0 if len(ids) > 1 else np.zeros(len(ends), bool)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["own", "ids", "chunk"]).filter(pa.array(keep))

        return chunks.mapInArrow(number, f"{_CHUNK}, chunk bigint")
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, BLOCK_WORDS):
            ids, ends, _ = _flat(batch)
            here = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
            p, q, _ = _tallied(ids[here], ids[here + 1], np.ones(len(here), np.int64))
            codes = np.zeros(len(ids), np.int32)
            codes[here] = 1 + _places(p, q, ids[here], ids[here + 1])
            last = np.zeros(len(ids), bool)
            last[ends - 1] = True
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (p, q)]
            yield pa.RecordBatch.from_arrays([*_packed(batch.column(0), np.diff(ends, prepend=0) - 1, codes[~last]), *lists], names=[*_BLOCK_COLUMNS, "p", "q"])

    blocks = materialize(chunks.select("own", "ids").mapInArrow(coded, f"{_BLOCK}, p array<bigint>, q array<bigint>").withColumn("block", F.monotonically_increasing_id()), "phrase-pairs")
    each = blocks.select("block", F.posexplode(F.arrays_zip("p", "q")).alias("code", "x")).select("block", "code", "x.p", "x.q")
    return _decoded(blocks, each.join(level.select("p", "q", "id"), ["p", "q"]))


def _gathered(batches: Iterator[pa.RecordBatch], places: int) -> Iterator[pa.RecordBatch]:
    """The same rows of chunks in batches of about so many places, without empty ones."""
    held, size = [], 0
    for batch in batches:
        for piece in slices([batch], max(1, places * batch.num_rows // max(1, len(batch.column(1).flatten())))):
            held.append(piece)
            size += len(piece.column(1).flatten())
            if size >= places:
                yield pa.concat_batches(held)
                held, size = [], 0
    if size:
        yield pa.concat_batches(held)


def _places(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where in the sorted pairs (p, q), that hold them all, the pairs (a, b) are."""
    if p.size and max(p.max(), q.max()) < 1 << 31:
        return np.searchsorted(p << 32 | q, a << 32 | b)
    return np.searchsorted(np.rec.fromarrays([p, q], names="p,q"), np.rec.fromarrays([a, b], names="p,q"))


def _with_numbers(level: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The table, written, with a column id that counts from 1 without gaps, and its number of rows."""
    stored = materialize(level.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    sizes = sorted(stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a number a task
    before, starts = 1, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    if not starts:
        return stored.withColumnRenamed("at", "id"), 0
    starts = F.broadcast(level.sparkSession.createDataFrame(starts, "part long, start long"))
    numbered = stored.withColumn("part", part).join(starts, "part").withColumn("id", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.drop("part", "start", "at"), before - 1


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)), exactly: the products have up to 38 digits, so counts may have 17."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a * 1000) * wide(n), wide(l) * wide(r))


def levels(
    docs: DataFrame,
    *,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    lang_col: str = "lang",
    text_col: str = "text",
    broadcast_grams: int = BROADCAST_GRAMS,
    chunk_words: int = CHUNK_WORDS,
) -> tuple[list[DataFrame], DataFrame]:
    """The tables of the frequent phrases of 1, 2, ... words, as far as there are any, and (lang, n).

    lang, phrase, last (its last word), id, f, and for more than one word p and q (the numbers of its first and its last words but one),
    begins and ends (counts of its beginnings and endings of 1, 2, ... words).
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = rows.mapInArrow(_count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    words = materialize(counts.where(F.col("word").isNull() | (F.col("f") >= min_count)), "phrase-words")
    totals = words.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    none = F.array().cast("array<bigint>")
    first = words.where(F.col("word").isNotNull()).select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("begins"), none.alias("ends"))
    level, size = _with_numbers(first, "phrase-level")
    found = [level]
    chunks = materialize(_numbered_words(rows, level, size <= broadcast_grams, max_words, chunk_words), "phrase-sequences")
    for k in range(2, max_words + 1):
        pairs = chunks.select("own", "ids").mapInArrow(_count_pairs, "p bigint, q bigint, f bigint").groupBy("p", "q").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
        part = lambda side, *cols: level.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in cols])  # noqa: E731, B023
        joined = pairs.join(part("p", "lang", "phrase", "f", "begins"), "p").join(part("q", "last", "f", "ends"), "q")
        grown = lambda col, f: F.array_append(col, F.col(f))
        phrase = F.concat_ws(" ", "p_phrase", "q_last").alias("phrase")
        longer = joined.select(F.col("p_lang").alias("lang"), phrase, F.col("q_last").alias("last"), "p", "q", "f", grown("p_begins", "p_f").alias("begins"), grown("q_ends", "q_f").alias("ends"))
        level, size = _with_numbers(longer, "phrase-level")
        if not size:
            break
        found.append(level)
        if k < max_words:
            chunks = materialize(_numbered_pairs(chunks, level, size <= 4 * broadcast_grams), "phrase-sequences")
    return found, totals


def collocations(docs: DataFrame, *, covered_percent: int = 100, **options) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words or more, scored by their weakest cut.

    A phrase goes if it lies in a longer frequent one that has covered_percent of its occurrences. What lies between the two has as many
    at least and is frequent, too, so the phrases with one word more tell. Options are those of levels().
    """
    found, totals = levels(docs, **options)
    out = None
    for level, longer in zip(found[1:], [*found[2:], None], strict=False):
        kept = level
        if longer is not None:
            inside = longer.select(F.col("p").alias("id"), "f").unionByName(longer.select(F.col("q").alias("id"), "f"))
            most = inside.groupBy("id").agg(F.max("f").alias("longer_f"))
            kept = level.join(most, "id", "left").where(F.col("longer_f").isNull() | (100 * F.col("longer_f") < covered_percent * F.col("f"))).drop("longer_f")
        out = kept if out is None else out.unionByName(kept)
    fields = "lang string, phrase string, a long, l long, r long, n long, score long"
    if out is None:
        return docs.sparkSession.createDataFrame([], fields)
    cuts = F.transform(
        F.arrays_zip(F.col("begins").alias("l"), F.reverse("ends").alias("r")),
        lambda x, i: F.struct(score(F.col("f"), F.col("n"), x["l"], x["r"]).alias("score"), i.alias("cut"), x["l"].alias("l"), x["r"].alias("r")),
    )
    weakest = out.join(totals, "lang").withColumn("weakest", F.array_min(cuts))
    return weakest.select("lang", "phrase", F.col("f").alias("a"), "weakest.l", "weakest.r", "n", "weakest.score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(table(spark, sf_dir, "documents"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= TOP)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _sql_grams() -> str:
    """Every occurrence of 1 to MAX_WORDS words in a row within a piece."""
    parts = []
    for k in range(1, MAX_WORDS + 1):
        parts.append(f"SELECT lang, {k} AS k, ws[i:i + {k - 1}] AS g FROM p, unnest(range(1, len(ws) - {k} + 2)) t(i)")
    return " UNION ALL ".join(parts)


OP11_SQL = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
s AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM s),
f AS (SELECT lang, k, g, count(*) AS f FROM ({_sql_grams()}) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1),
o AS (SELECT lang, g[1:k - 1] AS g, max(a) AS m FROM c GROUP BY ALL UNION ALL SELECT lang, g[2:k] AS g, max(a) AS m FROM c GROUP BY ALL),
kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = c.lang AND o.g = c.g AND o.m >= c.a)),
cut AS (
  SELECT kept.*, n.n, j, l.f AS l, r.f AS r, (1000::HUGEINT * a * n.n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM kept JOIN n USING (lang), unnest(range(1, kept.k)) x(j), f AS l, f AS r
  WHERE l.lang = kept.lang AND r.lang = kept.lang AND l.g = kept.g[1:j] AND r.g = kept.g[j + 1:kept.k]),
w AS (SELECT *, array_to_string(g, ' ') AS phrase FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM w QUALIFY rank <= {TOP}
"""
