"""Toxicity scores by a counterfactual-regularised classifier.

A logistic model over a text's words and word beginnings, each present at least 1, 2 or 4 times. In every labelled
training text the identity terms, as whole words, are swapped for the next ones of their groups; the loss penalises the
square of the change that this makes to the score's logit, over all features of the two texts. A text without identity
terms adds no penalty. An L1 term keeps only features that matter, so long neutral texts do not drift; a small L2 term
shares weight among features that go together.
Training takes a bounded sample of the labelled rows (MAX_TRAINING_ROWS, a third of them toxic at most, those of the
smallest hash of doc_id, weighted back to their share; of several rows of an id, that of the least text) and its most frequent
features (MAX_FEATURES, ties by hash); scoring covers all rows, one by one.

L1 and L2 have the least log loss in a five-fold cross-validation within the training rows
(tests/llm/cross_validation.py), and training stops where its own loss settles: the held-out fold (crc32 of doc_id mod 5
= 0) decides nothing.

Defined cases: a null or empty text is scored by the intercept; a null doc_id counts as the empty string for the fold;
labels of several rows for one doc_id: the highest counts; null labels are ignored; without labels of both classes nothing
can be learnt and every score is 0. An empty table gives no row; other columns are ignored (or passed on by the filter).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_POWERS, bounded_batches, by_batch, mix64, range_hashes, table, utf8_values, word_spans, written

#: Bounds of the training sample: labelled documents, and their features.
MAX_TRAINING_ROWS, MAX_FEATURES = 6_000, 1_000_000
#: A word is a feature when this many sampled texts have it.
MIN_TEXTS = 3
SWAP_WEIGHT, L1, L2 = 1.0, 2e-4, 1e-4
#: Training stops where CHECKED steps together lower the loss by less than TOLERANCE of it, or after MOST_STEPS.
TOLERANCE, CHECKED, MOST_STEPS = 1e-3, 20, 1000
#: Lengths of word beginnings in bytes, and the numbers of occurrences that are told apart.
PREFIXES, LEVELS = (3, 4, 5, 6, 8), (1, 2, 4)

#: Identity terms, one group of interchangeable ones a line.
IDENTITY_GROUPS = [
    "christian muslim jewish hindu buddhist catholic protestant sikh atheist mormon",
    "christians muslims jews hindus buddhists catholics protestants sikhs atheists mormons",
    "black white asian african european latino hispanic arab indian chinese mexican american",
    "man woman", "men women", "male female", "boy girl", "boys girls", "he she", "him her", "his hers",
    "gay straight lesbian bisexual heterosexual homosexual transgender cisgender queer",
    "blind deaf disabled", "old young", "immigrant refugee foreigner native", "immigrants refugees foreigners natives",
]


def raw_features(text: bytes) -> np.ndarray:
    """Hashes of all words of a text and of their beginnings, with repeats."""
    data, starts, ends = word_spans(text)
    parts = [range_hashes(data, starts, ends, WORD_POWERS)]
    for size in PREFIXES:
        long = starts[ends - starts > size]
        parts.append(mix64(range_hashes(data, long, long + size, WORD_POWERS) + np.uint64(size)))
    return np.concatenate(parts)


def leveled(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sorted feature hashes: one for each level that a hash's count reaches; level 1 is the hash itself."""
    return np.sort(np.concatenate([found[counts >= n] if n == 1 else mix64(found[counts >= n] + np.uint64(n)) for n in LEVELS]))


def features_of(text: bytes) -> np.ndarray:
    return leveled(*np.unique(raw_features(text), return_counts=True))


def swap_table(groups: list[str] = IDENTITY_GROUPS) -> dict[bytes, bytes]:
    """Each identity term to the next one of its group."""
    found = [(words[k], words[(k + 1) % len(words)]) for words in (g.encode().split() for g in groups) for k in range(len(words))]
    return dict(found)


SWAPS = swap_table()
_TERMS = re.compile(rb"(?<![0-9A-Za-z\x80-\xff])(?:" + b"|".join(sorted(SWAPS, key=len, reverse=True)) + rb")(?![0-9A-Za-z\x80-\xff])", re.IGNORECASE)


def swapped_text(text: bytes) -> bytes | None:
    """The text with each identity term, as a whole word of any case, replaced by the next of its group; None without any."""
    out, n = _TERMS.subn(lambda m: SWAPS[m.group().lower()], text)
    return out if n else None


def swapped_features(text: bytes) -> np.ndarray | None:
    """The features of the swapped text; None for a text without identity terms."""
    swapped = swapped_text(text)
    return None if swapped is None else features_of(swapped)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    """Sorted hashes, their weights by level and the intercept."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float, constant: float | None = None):
        """words: hashes of level 1 with the weight of each level (a column a level)."""
        self.words, self.weights, self.bias, self.constant = words, weights, bias, constant
        self.bases = words
        self.gains = np.zeros((LEVELS[-1] + 1, len(words)))
        for n in range(LEVELS[-1] + 1):
            for k, level in enumerate(LEVELS):
                if n >= level:
                    self.gains[n] += weights[:, k]

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        logit = self.bias
        if len(self.words):
            found = raw_features(text)
            at = np.minimum(np.searchsorted(self.bases, found), len(self.bases) - 1)
            at = at[self.bases[at] == found]
            logit += float(self.gains[np.minimum(np.bincount(at, minlength=len(self.bases)), LEVELS[-1]), np.arange(len(self.bases))].sum())
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


class _Sparse:
    """A matrix by its entries, sorted by row; its products with vectors."""

    def __init__(self, rows: list[np.ndarray], columns: int, signs: list[np.ndarray] | None = None):
        self.shape = len(rows), columns
        sizes = np.array([len(r) for r in rows], int)
        self.col = np.concatenate([*rows, np.zeros(0, int)], dtype=int)
        self.sign = np.concatenate([*signs, np.zeros(0)]) if signs is not None else None
        order = np.argsort(self.col, kind="stable")
        # the entries' rows are held narrow while the order is, as this is where the driver holds the most
        by_col = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[order]
        self.sign_by_col = self.sign[order] if signs is not None else None
        del order
        self.by_col = by_col.astype(int)
        self.rows, self.row_starts = self._filled(sizes)
        self.cols, self.col_starts = self._filled(np.bincount(self.col, minlength=columns))

    @staticmethod
    def _filled(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which runs of these sizes hold anything, and where each of them starts."""
        at = np.flatnonzero(sizes)
        return at, (np.cumsum(sizes) - sizes)[at]

    def times(self, v: np.ndarray) -> np.ndarray:
        return self._sums(v[self.col], self.sign, self.rows, self.row_starts, self.shape[0])

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return self._sums(v[self.by_col], self.sign_by_col, self.cols, self.col_starts, self.shape[1])

    @staticmethod
    def _sums(values: np.ndarray, sign: np.ndarray | None, at: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        if len(values):
            out[at] = np.add.reduceat(values if sign is None else values * sign, starts)
        return out


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, share: np.ndarray, bases: np.ndarray, swapped: list[np.ndarray | None], l1: float | None = None, l2: float | None = None) -> Model:
    """Proximal gradient (accelerated) on logistic loss + SWAP_WEIGHT * (logit change under swaps)**2 + L1 + L2.

    rows: each text's features; share: each text's weight, of mean 1; bases: the hashes of level 1; swapped: the features of
    each text with its identity terms swapped, None for a text without any. A feature that is not learnt from the rows
    weighs 0, in the penalty as in the model, so that where a swap's target is unknown the penalty is on the term's own weight.
    """
    n, positive = len(rows), int(labels.sum())
    l1, l2 = L1 if l1 is None else l1, L2 if l2 is None else l2
    if not n or positive in (0, n):
        return Model(np.zeros(0, np.uint64), np.zeros((0, len(LEVELS))), 0.0, 0.0)
    words, seen = np.unique(np.concatenate(rows), return_counts=True)
    words = words[seen >= min(MIN_TEXTS, positive)]
    if not len(words):
        return Model(words, np.zeros((0, len(LEVELS))), 0.0, (positive + 0.5) / (n + 1))

    def columns(hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        return at[words[at] == hashes].astype(np.int32)

    cols = [columns(r) for r in rows]
    gone = [np.setdiff1d(c, columns(o)) if o is not None else c[:0] for c, o in zip(cols, swapped)]
    come = [np.setdiff1d(columns(o), c) if o is not None else c[:0] for c, o in zip(cols, swapped)]
    d = len(words)
    has = _Sparse(cols, d)
    del cols
    change = _Sparse([np.concatenate(x) for x in zip(gone, come)], d, [np.repeat([1.0, -1.0], [len(g), len(c)]) for g, c in zip(gone, come)])
    y = labels.astype(float)

    def loss_of(v: np.ndarray, u: float) -> tuple[float, np.ndarray, np.ndarray]:
        """The smooth loss, and the logits and their changes."""
        z, delta = has.times(v) + u, change.times(v)
        return float(np.mean(share * (np.logaddexp(0, z) - y * z)) + SWAP_WEIGHT * np.mean(delta**2) + l2 / 2 * float(v @ v)), z, delta

    # steps go by each feature's own scale, so that rare features do not wait for the common ones
    scale = has.transposed_times(share / n) + 8 * SWAP_WEIGHT * np.bincount(change.col, minlength=d) / n + l2
    w = v = np.zeros(d)
    b = u = float(np.log((share * y).sum() / (share * (1 - y)).sum()))
    t, step, losses = 1.0, 1.0, []
    for _ in range(MOST_STEPS):
        smooth, z, delta = loss_of(v, u)
        g = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        grad, grad_u = has.transposed_times(g) + change.transposed_times(2 * SWAP_WEIGHT / n * delta) + l2 * v, float(g.sum())
        step *= 1.2
        while True:  # a long step whose quadratic bound holds
            w2 = v - step / scale * grad
            w2 = np.sign(w2) * np.maximum(np.abs(w2) - step / scale * l1, 0)
            b2 = u - step * grad_u
            move, move_u = w2 - v, b2 - u
            reached = loss_of(w2, b2)[0]
            if reached <= smooth + grad @ move + grad_u * move_u + (scale @ move**2 + move_u**2) / (2 * step) + 1e-12 or step < 1e-9:
                break
            step /= 2
        losses.append(reached + l1 * float(np.abs(w2).sum()))
        if len(losses) > 1 and losses[-1] > losses[-2]:
            t = 1.0  # the momentum leads uphill: drop it
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, u = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
        if len(losses) > CHECKED and losses[-CHECKED - 1] - losses[-1] < TOLERANCE * losses[-1]:
            break
    bases = np.unique(bases)
    gains = np.zeros((len(bases), len(LEVELS)))
    for k, level in enumerate(LEVELS):
        hashes = bases if level == 1 else mix64(bases + np.uint64(level))
        at = np.minimum(np.searchsorted(words, hashes), d - 1)
        gains[:, k] = np.where(words[at] == hashes, w[at], 0)
    kept = gains.any(axis=1)
    return Model(bases[kept], gains[kept], b)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """The model from labelled documents outside the held-out fold; at most max_rows of them, and their max_features most frequent features."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("toxic").cast("int").alias("label")).dropna()
    known = known.filter(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))
    known = known.withColumn("label", (F.col("label") > 0).cast("int"))
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = min(total.get(1, 0), max_rows // 3)
    taken = {1: toxic, 0: min(total.get(0, 0), max_rows - toxic)}
    first = [known.filter(F.col("label") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(n) for k, n in taken.items()]

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = list(utf8_values(batch.column("text")))
        own, swapped = [features_of(t).view(np.int64) for t in texts], [x if x is None else x.view(np.int64) for x in map(swapped_features, texts)]
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (own, swapped)]
        return pa.RecordBatch.from_arrays([batch.column("label"), *lists], ["label", "words", "swapped"])

    # the sample is bounded by max_rows, so it may be broadcast; of several rows of an id the one of the least text is learnt from
    sampled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sampled = sampled.join(F.broadcast(first[0].unionByName(first[1])), F.col("doc_id") == F.col("label_id"))
    sampled = sampled.groupBy("label_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    found = written(sampled.mapInArrow(by_batch(features), "label int, words array<bigint>, swapped array<bigint>"), "sample")
    common = found.select(F.explode("words").alias("word")).groupBy("word").count().filter(F.col("count") >= MIN_TEXTS)
    common = common.orderBy(F.desc("count"), "word").limit(max_features)
    return fit_rows(*gathered(found, common, taken, total))


def gathered(found: DataFrame, common: DataFrame, taken: dict[int, int], total: dict[int, int]) -> tuple:
    """What fit_rows takes, on the driver; the sample's bound bounds what comes there, without the features of fewer than MIN_TEXTS texts."""
    vocabulary = np.sort(common.select("word").toArrow()["word"].to_numpy()).view(np.uint64)
    vocabulary = np.sort(vocabulary)

    def number(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for name in ("words", "swapped"):
            lists = []
            for row in batch.column(name):
                words = np.asarray(row.values if row.is_valid else []).astype(np.int64).view(np.uint64)
                at = np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))
                known = at[vocabulary[at] == words].astype(np.int32) if len(vocabulary) else np.zeros(0, np.int32)
                lists.append(known if row.is_valid else None)
            out.append(pa.array(lists, pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays([batch.column("label"), *out], ["label", "words", "swapped"])

    got = found.mapInArrow(by_batch(number), "label int, words array<int>, swapped array<int>").toArrow()
    packed = lambda row: np.asarray(row.values, np.int32).tobytes() if row.is_valid else None
    rows = sorted(zip(got["label"].to_pylist(), map(packed, got["words"]), map(packed, got["swapped"])), key=lambda r: (*r[:2], r[2] or b""))
    labels = np.array([r[0] for r in rows], int)
    share = np.array([total[k] / max(taken[k], 1) for k in labels.tolist()])
    share = share / share.mean() if len(share) else share
    hashes = lambda x: None if x is None else vocabulary[np.frombuffer(x, np.int32)]
    return [hashes(r[1]) for r in rows], labels, share, vocabulary, [hashes(r[2]) for r in rows]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    bounded_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = pa.array([model.score(t) for t in utf8_values(batch.column("text"))], pa.float64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(by_batch(run), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model predicts toxic; columns as they were."""
    bounded_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([model.score(t) < 0.5 for t in utf8_values(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(by_batch(run), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_toxicity": op6_toxicity}
