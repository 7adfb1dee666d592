"""Toxicity by cumulative-link ordinal regression over sparse hashed words and word beginnings.

Features are whole words and the beginnings of words (an inflected stem has few whole words in common between texts),
each once as present and once for every share of the text's words that it reaches: clean texts hold such stems too, but rarely.

P(grade > k) = sigmoid(x . w - threshold_k): one weight per feature, shared by all ordered thresholds; the output is
the expected grade. The model is fitted on a bounded sample of labelled rows (``SAMPLE``, those with the smallest
hashes of their id); every document is scored in one scan with broadcast weights of a fixed size.

Defined results: null and empty texts have no features and score as the thresholds alone say. Labels without a
grade or id are left out; of several labels of an id the highest counts, and of several texts the one with the largest hash. Without labels, or with one grade only,
nothing is toxic. Repeated rows are each scored. Columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgauge.llm.textarrays import BYTE_VALUES, U64, Words, flat, mix, prefix, slices, spans

#: Labelled rows at most that the fit takes, and hashed features.
SAMPLE, BITS = 12_000, 20
#: Bytes of the word beginnings, and the shares (one in so many words) that are features of their own.
BEGINNINGS, SHARES = (4, 6), (256, 128, 64, 32, 16)
ROUNDS, RATE, DECAY, LEAST_DOCS, LEAST_Z = 300, 0.15, 1e-4, 4, 5.0
#: Probability of a grade or a higher one from which on a document is said to have it; grade 1 is toxic.
CUT = 0.4
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: text number and feature of each distinct (text, feature), and the words of each text."""
    w = Words(*flat(part.column(column)), lower=True, inside=INSIDE)
    sums, size, of = prefix(BYTE_VALUES[w.text]), w.end - w.begin, w.texts().astype(U64)
    owners, hashes = [of], [w.hashes]
    for n in BEGINNINGS:
        at = np.flatnonzero(size >= n)
        owners.append(of[at])
        hashes.append(mix(mix(spans(sums, w.begin[at], w.begin[at] + n)) + U64(n)))
    keys, uses = np.unique((np.concatenate(owners) << U64(BITS)) | (np.concatenate(hashes) >> U64(64 - BITS)), return_counts=True)
    pairs, words = [keys], w.counts[(keys >> U64(BITS)).astype(np.int64)]
    for share in SHARES:
        often = keys[uses * share >= words]
        pairs.append((often >> U64(BITS) << U64(BITS)) | (mix((often & U64(2**BITS - 1)) + U64(share << BITS)) >> U64(64 - BITS)))
    pairs = np.unique(np.concatenate(pairs))
    return (pairs >> U64(BITS)).astype(np.int64), (pairs & U64(2**BITS - 1)).astype(np.int64), w.counts


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            of, feature, _ = features(part, 1)
            at = np.searchsorted(of, np.arange(part.num_rows + 1))
            rows = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["grade", "features"])


class Ordinal:
    """Weights and ordered thresholds of a proportional-odds model, fitted by full-batch Adam."""

    def __init__(self, grades: int):
        self.thresholds = np.full(max(0, grades - 1), np.inf)
        self.weights = np.zeros(2**BITS, np.float32)

    def fit(self, rows: list[np.ndarray], grades: np.ndarray) -> Ordinal:
        levels = len(self.thresholds)
        if not levels or len(np.unique(grades)) < 2:
            return self
        # only features whose documents' mean grade is far from the overall one: the rest would learn the sample by heart
        docs, total = np.zeros(2**BITS, np.int64), np.zeros(2**BITS)
        for r, g in zip(rows, grades):  # a row has a feature once
            docs[r] += 1
            total[r] += g
        mean = total / np.maximum(docs, 1)
        apart = np.abs(mean - grades.mean()) * np.sqrt(docs) / grades.std()
        telling = (docs >= LEAST_DOCS) & (apart >= LEAST_Z)
        rows = [r[telling[r]] for r in rows]
        of, flat_features = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        used, column = np.unique(flat_features, return_inverse=True)
        above = (grades[:, None] > np.arange(levels)).astype(float)
        share = np.clip(above.mean(0), 1e-4, 1 - 1e-4)
        # thresholds as a first one and positive steps, so that they stay in order
        start = np.log((1 - share) / share)
        free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
        x = np.concatenate([np.zeros(len(used)), free])
        m, v = np.zeros_like(x), np.zeros_like(x)
        n = len(rows)
        for step in range(1, ROUNDS + 1):
            w, free = x[: len(used)], x[len(used) :]
            theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
            z = np.bincount(of, w[column], n)
            s = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -40, 40)))  # P(grade > k)
            # likelihood of grade g: s[g-1] - s[g]
            upper = np.concatenate([np.ones((n, 1)), s], 1)[np.arange(n), grades]
            lower = np.concatenate([s, np.zeros((n, 1))], 1)[np.arange(n), grades]
            p = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            gz = -(du - dl) / n
            gt = np.zeros((n, levels + 2))
            gt[np.arange(n), grades] += du
            gt[np.arange(n), grades + 1] -= dl
            gt = gt[:, 1 : levels + 1].sum(0) / n
            tail = np.cumsum(gt[::-1])[::-1]
            g = np.concatenate([np.bincount(column, gz[of], len(used)) + DECAY * w, tail[:1], tail[1:] * np.exp(free[1:])])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (1 - 0.9 * step / ROUNDS)
        self.weights[used] = x[: len(used)]
        free = x[len(used) :]
        self.thresholds = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        return self

    def above(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -500, 500)))


def score_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: Ordinal = model.value
    for batch in batches:
        for part in slices(batch, 1):
            of, feature, words = features(part, 1)
            above = m.above(np.bincount(of, m.weights[feature], part.num_rows))
            first = above[:, 0] if above.shape[1] else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(words, pa.int64()),
                    pa.array(above.sum(1)),
                    pa.array((above >= CUT).sum(1), pa.int32()),
                    pa.array(first),
                    pa.array(first >= CUT),
                ],
                names=["doc_id", "n_words", "expected_severity", "severity", "p_toxic", "toxic"],
            )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """``labels``: doc_id and grade (0, 1, ...). Only ``sample`` labelled rows reach the driver."""
    known = labels.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.max("grade").alias("grade"), F.max_by("text", F.xxhash64("text")).alias("text"))
        .select("grade", "text")
        .mapInArrow(featurise, "grade int, features binary")
        .collect()  # at most ``sample`` rows
    )
    once: dict[bytes, int] = {}  # copies would make the words of one text look telling
    for r in rows:
        once[bytes(r["features"])] = max(r["grade"], once.get(bytes(r["features"]), 0))
    texts = sorted(once)
    grades = np.array([once[t] for t in texts], np.int64)
    return Ordinal(int(grades.max(initial=0)) + 1).fit([np.frombuffer(t, np.int32) for t in texts], grades)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, n_words, expected_severity, severity, p_toxic, toxic of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS floats
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        partial(score_batches, model=shared),
        f"doc_id {kind}, n_words long, expected_severity double, severity int, p_toxic double, toxic boolean",
    )


def severity(labels: DataFrame) -> DataFrame:
    """Grades from two flags: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0).alias("grade"))
