"""Language identification with interpolated Kneser-Ney character models, one per language.

Texts are lower-cased and cut into words (runs of letters). A language's model gives each character of a word, and its end, a
probability from up to four characters before it, back to the word's start. A language holds one sorted array of n-gram hashes per
order, with a discounted probability and, as the context of longer ones, a back-off weight for each. A text goes to the language
with the lowest cross-entropy per character. Words are scored once per worker and then looked up.

The models are fitted on a bounded sample of labelled rows: up to `sample_rows` of each language, `sample_total` of all, but one row
of each at least; of a text longer than `max_chars` characters the sample takes an excerpt of that length from a place that a hash
of the id picks. Every label is learned. Predictions score whole texts, whatever their length.

Rejection is calibrated by language and length on sample rows kept from the fit: cut into pieces of a length, the rows give the
cross-entropy that a share of `false_rejections` of them exceeds; a text of that length is rejected beyond the middle between it and
what random letters reach, or if it has no letter. Where random letters are no worse, that share alone is the limit.

The score is the share of the language in the likelihoods of all, as if the text had `EVIDENCE_CHARS` characters at most: over
whole texts it would always be 0 or 1.

Defined cases: null texts and texts without a letter are `und`, score 0, rejected. Without any labelled rows all are. Rows with
a null id are predicted but teach nothing and are not held out. Ties go to the language first in order. Repeated rows give a
row each; an empty table gives none; other columns are kept apart, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from treeloom.llm.common import bound_batches, slices, table

ORDER = 5
SAMPLE_ROWS = 800
SAMPLE_TOTAL = 16_000
MAX_CHARS = 4_000
FALSE_REJECTIONS = 0.001
#: Characters of the pieces that rejection is calibrated on; a text goes by the longest that isn't longer than itself.
LENGTHS = (1, 8, 32, 128, 512, 2048)
UNKNOWN = "und"
CACHE_CELLS = 1_200_000  # log-probabilities of words that a worker keeps
EVIDENCE_CHARS = 50
_BOS, _EOS = 2, 3
_letters = re.compile(r"[^\W\d_]+").findall
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: str | None) -> list[str]:
    return _letters(text.lower()) if text else []


def clean(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


@dataclass
class _Grams:
    """Hashes of the n-grams that end at each character of padded words; 0 where the word's start cuts them off."""

    word: np.ndarray  # the word of each position
    at: np.ndarray  # the position within its word, 0 for the start mark
    by_order: list[np.ndarray]  # by_order[k] for orders 1 to ORDER; by_order[0] is zero


def _grams(words: list[str]) -> _Grams:
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    codes = np.zeros(int(sizes.sum()), np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes)) - starts[word] if len(words) else np.zeros(0, np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    inner = (at > 0) & (at < sizes[word] - 1)
    codes[inner] = flat
    codes[at == 0] = _BOS
    codes[(at == sizes[word] - 1)] = _EOS
    by_order = [np.zeros(len(codes), np.uint64), _mix((codes + np.uint64(1)) * _M1)]
    for k in range(2, ORDER + 1):
        longer = np.zeros(len(codes), np.uint64)
        before = codes[: max(0, len(codes) - k + 1)]
        longer[k - 1 :] = _mix(by_order[k - 1][k - 1 :] * _M1 + before + np.uint64(k))
        longer[at < k - 1] = 0
        by_order.append(longer)
    return _Grams(word, at, by_order)


def _context(g: _Grams, k: int) -> np.ndarray:
    """The hash of the k - 1 characters before each position."""
    return np.r_[np.zeros(1, np.uint64), g.by_order[k - 1][:-1]] if k > 1 else g.by_order[0]


def _one_language(counts: Counter) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By order from 1: sorted n-gram hashes, discounted probabilities, sorted context hashes, back-off weights."""
    words = list(counts)
    weight = np.fromiter((counts[w] for w in words), np.float64, len(words))
    g = _grams(words)
    per_position = weight[g.word]
    out = []
    for k in range(1, ORDER + 1):
        there = g.at >= max(1, k - 1)  # the start mark is never predicted
        h, ctx = g.by_order[k][there], _context(g, k)[there]
        first = g.at[there] == k - 1  # these begin with the start mark: nothing can stand before them
        keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        raw = np.bincount(inverse.ravel(), per_position[there], len(keys))
        adjusted = raw
        if k < ORDER:
            longer = g.at >= k
            _, one = np.unique(g.by_order[k + 1][longer], return_index=True)
            types = np.bincount(np.searchsorted(keys, g.by_order[k][longer][one]), minlength=len(keys))
            adjusted = np.where(first[at], raw, types).astype(np.float64)
        n1, n2 = (adjusted == 1).sum(), (adjusted == 2).sum()
        discount = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 else 0.5
        contexts, which = np.unique(ctx[at], return_inverse=True)
        which = which.ravel()
        total = np.bincount(which, adjusted)
        kinds = np.bincount(which, np.minimum(adjusted, discount))
        out.append((keys, np.maximum(adjusted - discount, 0) / total[which], contexts, kinds / total))
    return out


class Language:
    """One language's sorted hash arrays: by order the hashes, what each adds as an n-gram and what it multiplies by as a context.

    The last value of either array is that of hashes which aren't there.
    """

    def __init__(self, counts: Counter):
        parts = _one_language(counts)
        self.start = np.float32(parts[0][3][0])
        self.orders = []
        for k in range(ORDER):
            grams, later = parts[k][0], parts[k + 1][2] if k + 1 < ORDER else np.zeros(0, np.uint64)
            keys = np.union1d(grams, later)
            prob, back = np.zeros(len(keys) + 1, np.float32), np.ones(len(keys) + 1, np.float32)
            prob[np.searchsorted(keys, grams)] = parts[k][1]
            if k + 1 < ORDER:
                back[np.searchsorted(keys, later)] = parts[k + 1][3]
            self.orders.append((keys, prob, back))

    def values(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each of the sorted hashes adds and multiplies by in order k + 1."""
        keys, prob, back = self.orders[k]
        at = np.searchsorted(keys, hashes)
        there = at < len(keys)
        there[there] = keys[at[there]] == hashes[there]
        at = np.where(there, at, len(keys))
        return prob[at], back[at]


class Model:
    """The languages' models, and the cross-entropies beyond which a text is rejected, by language and length."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        self.alphabet = len({c for words in counts.values() for w in words for c in w}) + 2
        self.languages = [Language(counts[name]) for name in self.langs]
        self.limits = np.full((len(self.langs), len(LENGTHS)), np.inf)

    def log_probs(self, words: list[str]) -> np.ndarray:
        """The log-probability of each word, its end included, under each language."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        return np.add.reduceat(self.log_steps(words), np.cumsum(sizes) - sizes, axis=0)

    def log_steps(self, words: list[str]) -> np.ndarray:
        """The log-probability of each character of the words laid end to end, each from its start mark to its end."""
        g = _grams(words)
        # the distinct hashes of an order are looked up once a language, in order
        distinct = [np.unique(h, return_inverse=True) for h in g.by_order[1:]]
        inside = [g.at >= k for k in range(ORDER)]
        logs = np.empty((len(g.at), len(self.langs)), np.float32)
        for j, language in enumerate(self.languages):
            p = np.full(len(g.at), language.start / self.alphabet, np.float32)
            before = None  # the back-off weight of the context of each position, in the order below
            for k, ((hashes, which), there) in enumerate(zip(distinct, inside, strict=True)):
                prob, back = language.values(k, hashes)
                if before is not None:
                    p[1:] *= before[:-1]
                p += np.where(there, prob[which], 0)
                before = np.where(there, back[which], 1)
            logs[:, j] = np.log(np.maximum(p, 1e-30))
        logs[g.at == 0] = 0  # the start mark is given
        return logs


class Scorer:
    """A model with the words that it has scored."""

    def __init__(self, model: Model):
        self.model, self.index, self.size = model, {}, 1
        n = max(1, len(model.langs))
        self.room, self.part = max(20_000, CACHE_CELLS // n), max(500, 80_000 // n)
        # row 0: no letter
        self.logs, self.chars = np.zeros((1024, len(model.langs)), np.float32), np.zeros(1024, np.int64)

    def _learn(self, words: set[str]) -> None:
        new = words - self.index.keys()
        if self.size + len(new) > self.room:
            self.index, self.size, new = {}, 1, words
        cleaned = [(w, clean(w)) for w in sorted(new)]
        self.index.update((w, 0) for w, c in cleaned if not c)
        good = [(w, c) for w, c in cleaned if c]
        while len(self.chars) < self.size + len(good):
            self.logs, self.chars = np.concatenate([self.logs, np.zeros_like(self.logs)]), np.concatenate([self.chars, np.zeros_like(self.chars)])
        for at in range(0, len(good), self.part):
            part = good[at : at + self.part]
            rows = slice(self.size, self.size + len(part))
            self.logs[rows] = self.model.log_probs([c for _, c in part])
            self.chars[rows] = [len(c) + 1 for _, c in part]
            self.index.update(zip((w for w, _ in part), range(rows.start, rows.stop), strict=True))
            self.size = rows.stop

    def steps(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, log-probabilities by language, characters) of the words of each text, or of a stretch of a long one."""

        def flush():
            self._learn({w for _, words in held for w in words})
            for i, words in held:
                rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
                yield i, self.logs[rows], self.chars[rows]

        held, n = [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            for at in range(0, len(words), self.room // 2):
                held.append((i, words[at : at + self.room // 2]))
                n += len(held[-1][1])
                if n >= self.room // 2 or len(held) >= 64:
                    yield from flush()
                    held, n = [], 0
        yield from flush()

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropies per character (nats) by language, and the characters that count, of each text."""
        h = np.zeros((len(texts), len(self.model.langs)))
        n = np.zeros(len(texts), np.int64)
        for i, logs, chars in self.steps(texts):
            h[i] -= logs.sum(axis=0, dtype=np.float64)
            n[i] += chars.sum()
        return h / np.maximum(n, 1)[:, None], n

    def pieces(self, texts: list[str], length: int) -> np.ndarray:
        """Cross-entropies by language of the texts cut into pieces of at least so many characters."""
        found = []
        for _, logs, chars in self.steps(texts):
            ends, total = [], 0
            for k, c in enumerate(chars.tolist(), 1):
                total += c
                if total >= length:
                    ends.append(k)
                    total = 0
            if ends:
                sums = lambda x: np.diff(np.cumsum(np.r_[np.zeros((1, *x.shape[1:])), x], axis=0, dtype=np.float64)[[0, *ends]], axis=0)
                n = sums(chars)
                found.append(-sums(logs)[n > 0] / n[n > 0][:, None])
        return np.concatenate(found) if found else np.zeros((0, len(self.model.langs)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, float]]:
        """(language, score, rejected, cross-entropy) of each text."""
        if not self.model.langs:
            return [(UNKNOWN, 0.0, True, 0.0)] * len(texts)
        h, n = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        odds = np.exp(-(h - low[:, None]) * np.minimum(n, EVIDENCE_CHARS)[:, None])
        score = 1 / odds.sum(axis=1)
        kind = np.maximum(np.searchsorted(LENGTHS, n, "right") - 1, 0)
        rejected = low > self.model.limits[best, kind]
        return [
            (self.model.langs[b], float(s), bool(r), float(e)) if m else (UNKNOWN, 0.0, True, 0.0)
            for b, s, r, e, m in zip(best, score, rejected, low, n, strict=True)
        ]


def fit(rows: Iterable[tuple[str, str]], false_rejections: float = FALSE_REJECTIONS) -> Model:
    """A model from (language, text) rows; every fifth row of a language only calibrates the rejection."""
    counts: dict[str, Counter] = {}
    kept: dict[str, list[str]] = {}
    seen: Counter = Counter()
    for lang, text in rows:
        seen[lang] += 1
        if seen[lang] % 5 == 0:
            kept.setdefault(lang, []).append(text)
        else:
            own = counts.setdefault(lang, Counter())
            own.update(c for c in map(clean, words_of(text)) if c)
    model = Model({k: v for k, v in counts.items() if v})
    if not model.langs:
        return model
    scorer = Scorer(model)
    letters = sorted({c for words in counts.values() for w in words for c in w})
    rng = np.random.default_rng(3)
    noise = [" ".join("".join(rng.choice(letters, 6)) for _ in range(400)) for _ in range(50)]
    for k, length in enumerate(LENGTHS):
        worst = np.quantile(scorer.pieces(noise, length).min(axis=1), false_rejections)
        for j, lang in enumerate(model.langs):
            own = scorer.pieces(kept.get(lang) or [" ".join(counts[lang])], length)[:, j]
            if len(own):
                usual = np.quantile(own, 1 - false_rejections, method="higher")
                model.limits[j, k] = max(usual, (usual + worst) / 2)
            elif k:  # no row of that length: as of shorter ones
                model.limits[j, k] = model.limits[j, k - 1]
    return model


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    sample_total: int = SAMPLE_TOTAL,
    max_chars: int = MAX_CHARS,
) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out; a number a language comes to the driver before."""
    spark = docs.sparkSession
    able = F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)
    rows = docs.where(able).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return fit([])
    most = max(1, min(sample_rows, sample_total // len(counts)))
    # a hash of the id decides, so that some more than `most` rows of a language come; of these the `most` least are taken
    shares = [(r[0], int(min(1.0, (1.1 * most + 20) / r[1]) * (1 << 30))) for r in counts]
    shares = F.broadcast(spark.createDataFrame(shares, StructType([rows.schema["lang"], StructField("share", LongType())])))
    order = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30))
    place = F.pmod(F.xxhash64("id", F.lit(18)), F.greatest(F.length("text") - max_chars, F.lit(0)) + 1).cast("int")
    few = rows.join(shares, "lang").where(order < F.col("share")).select("lang", "id", F.substr("text", place + 1, F.lit(max_chars)).alias("text"), order.alias("o"))
    first = Window.partitionBy("lang").orderBy("o", "id", "text")
    few = few.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).select("lang", "text", "r").collect()
    return fit((r[0], r[1]) for r in sorted(few, key=lambda r: (r[0], r[2])))


#: The worker's scorer of the model that it used last.
_scorers: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """`keep` (if not given, all columns whose names the added ones leave free) and lang_pred, score, rejected, cross_entropy.

    prefix goes before the added names.
    """
    bound_batches(docs.sparkSession)
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    added = ", ".join(prefix + x for x in ("lang_pred string", "score double", "rejected boolean", "cross_entropy double"))
    types = [pa.string(), pa.float64(), pa.bool_(), pa.float64()]
    names = [x.split()[0] for x in added.split(", ")]
    keep = [c for c in docs.columns if c not in names] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(sent.value)
        scorer = _scorers[key]
        for batch in slices(batches):
            made = scorer.predict(batch.column(text_at).to_pylist())
            cols = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=[*inner, *names])

    inner = [f"k{i}" for i in range(len(keep))]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    shape = ", ".join([*(f"{n} {k}" for n, k in zip(inner, kinds, strict=True)), added])
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, inner, strict=True)], *([] if text_col in keep else [F.col(text_col).alias("t")]))
    text_at = keep.index(text_col) if text_col in keep else len(keep)
    out = rows.mapInArrow(run, shape)
    for n, c in zip(inner, keep, strict=True):
        out = out.withColumnRenamed(n, c)
    return out


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.withColumn("held_out", held_out("doc_id")), train(docs), keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy")
