"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is its own bucket and the buckets of its character 3- to 5-grams (with word-edge marks),
so a misspelling that was never seen shares most vectors with the word it hides. A window of
`WINDOW` words is the mean of its words, each the mean of its buckets' embeddings; the linear
softmax of that mean gives the window's log-odds. A document's log-odds pool its windows'
smoothly towards the largest (log-mean-exp), so that an insult counts as much in a long text as
in a short one. Embeddings and softmax are trained together through the pooling.

As everything before the pooling is linear, a trained model is one number per bucket, of fixed
size whatever the corpus, and scoring reads each text once, with no shuffle.

Buckets of fewer than `MIN_DOCS` training documents, or of more than `MOST_SHARE` of them, stay
at zero: the first could only learn one document by heart, the second only what the bias says.

Training takes a bounded sample of labelled rows, as a classifier may have: `MAX_ROWS` rows by
hash of the id in the proportion of the classes, but `LEAST_POSITIVE` toxic ones where there are
so many; the bias is then corrected by the log-odds of the sample against those of all labelled
rows. Texts of over `MAX_TEXT` bytes are not trained on, and at most `MAX_BYTES` together are.
Scoring is over all rows and whole texts.

Cases: a null, empty or blank text scores by the bias alone. With no labelled rows, or rows of
one class only, every score is that class's share (0.0 when there are none). Repeated rows score
alike; null ids score and are never trained on. Very long texts are scored in one piece each, in
memory in proportion to their length. Other columns are never read by a score, and pass through
`drop_toxic` whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import whole_row
from .tokens import mix64, slices, text_bytes, word_spans

BUCKETS = 1 << 18
DIM = 8
WINDOW = 12
SHARP = 2.0
EPOCHS = 10
#: Documents of the sample that a bucket must be in, and the share of them that it may be in.
MIN_DOCS, MOST_SHARE = 6, 0.2
#: First step of Adagrad for embeddings; a window's mean shrinks what one word says by WINDOW.
RATE = 4.0
#: Bounds of the training sample.
MAX_ROWS, LEAST_POSITIVE = 8000, 500
MAX_TEXT, MAX_BYTES = 1 << 20, 48 << 20
#: Words of training windows at most in one step.
STEP_WORDS = 60_000
#: Bytes of text that are scored at once: subwords take about a hundred times as much.
SCORE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GRAMS = (3, 4, 5)
_ROLL = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """value: each bucket's log-odds per unit of mean; bias: log-odds of an empty text."""

    value: np.ndarray
    bias: float
    window: int = WINDOW
    sharp: float = SHARP


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the distinct words (A-Z lower-cased), and each word's place among them."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    at = np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])
    joined = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[at]])])
    coded = joined.dictionary_encode()
    _, bounds, data = coded.dictionary.buffers()
    words = coded.dictionary
    bounds = np.frombuffer(bounds, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, bounds, coded.indices.to_numpy()


def subwords(data: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of every word, words one after the other, and the words' offsets.

    Grams run over code points of the marked word; a word's own bucket comes first.
    """
    n = len(bounds) - 1
    lengths = np.diff(bounds)
    size = int(lengths.sum()) + 2 * n
    marked = np.full(size, 60, np.uint8)
    begin = bounds[:-1] - bounds[0] + 2 * np.arange(n)
    inner = np.repeat(begin + 1 - (bounds[:-1] - bounds[0]), lengths) + np.arange(int(lengths.sum()))
    marked[inner] = data[bounds[0] : bounds[-1]]
    marked[begin + lengths + 1] = 62
    lead = np.flatnonzero((marked & 0xC0) != 0x80)
    ends = np.append(lead[1:], size)
    points = marked[lead].astype(np.uint64)
    for k in range(1, 4):
        more = lead + k < ends
        points[more] = points[more] * np.uint64(256) + marked[(lead + k)[more]]
    first = np.searchsorted(lead, begin)
    last = np.append(first[1:], len(lead))
    word_of = np.repeat(np.arange(n), last - first)
    mixed = mix64(points + np.uint64(1))
    totals = np.zeros(len(mixed) + 1, np.uint64)
    place = np.arange(len(mixed)) - first[word_of]
    np.cumsum(mix64(mixed + place.astype(np.uint64) * _ROLL), out=totals[1:])
    owner = [np.arange(n)]
    code = [mix64(totals[last] - totals[first])]
    for g in _GRAMS:
        ok = np.flatnonzero(np.arange(len(mixed)) + g <= last[word_of])
        rolled = np.full(len(ok), g, np.uint64)
        for k in range(g):
            rolled = (rolled * _ROLL) ^ mixed[ok + k]
        owner.append(word_of[ok])
        code.append(mix64(rolled))
    owner, code = np.concatenate(owner), np.concatenate(code)
    order = np.argsort(owner, kind="stable")
    return (code[order] & np.uint64(buckets - 1)).astype(np.int64), np.searchsorted(owner[order], np.arange(n + 1))


def _windows(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word of each window, and the first window of each text; a text without words has none."""
    counts = np.diff(first)
    per = -(-counts // window)
    offsets = np.concatenate([[0], np.cumsum(per)])
    start = np.repeat(first[:-1], per) + (np.arange(offsets[-1]) - np.repeat(offsets[:-1], per)) * window
    return start, offsets


def _pool(z: np.ndarray, offsets: np.ndarray, sharp: float, empty: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mean-exp of each text's windows, and each window's share of the gradient."""
    has = np.diff(offsets) > 0
    out = np.full(len(has), empty)
    if not len(z):
        return out, z
    at = offsets[:-1][has]
    sizes = np.diff(offsets)[has]
    top = np.maximum.reduceat(z, at)
    e = np.exp(sharp * (z - np.repeat(top, sizes)))
    total = np.add.reduceat(e, at)
    out[has] = top + np.log(total / sizes) / sharp
    return out, e / np.repeat(total, sizes)


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    raw, at = text_bytes(texts)
    starts, ends, first = word_spans(raw, at)
    if not len(starts):
        return np.full(len(texts), 1 / (1 + np.exp(-model.bias)))
    data, bounds, word = distinct_words(raw, starts, ends)
    codes, offsets = subwords(data, bounds)
    value = np.add.reduceat(model.value[codes], offsets[:-1]) / np.diff(offsets)
    start, of = _windows(first, model.window)
    sizes = np.diff(np.append(start, len(word)))
    z = np.add.reduceat(value[word], start) / sizes + model.bias
    pooled, _ = _pool(z, of, model.sharp, model.bias)
    return 1 / (1 + np.exp(-np.clip(pooled, -30, 30)))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, buckets: int = BUCKETS, seed: int = 11) -> Model:
    """Adagrad over whole documents; embeddings and softmax weights move together."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))))
    random = np.random.default_rng(seed)
    speaks = _speaking(texts, buckets)
    steps = _steps(texts, speaks)
    emb = random.normal(0, 1e-4, (buckets, DIM)).astype(np.float32)
    emb[~speaks] = 0
    out = random.normal(0, DIM**-0.5, DIM).astype(np.float32)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    emb_sq, out_sq, bias_sq = np.full(buckets, 1e-6, np.float32), np.full(DIM, 1e-6, np.float32), 1e-6
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in random.permutation(len(steps)):
            step = steps[k]
            start, of = _windows(step.first, WINDOW)
            sizes = np.diff(np.append(start, len(step.word))).astype(np.float32)
            has = step.kept > 0
            words = np.zeros((len(step.kept), DIM), np.float32)
            if len(step.codes):
                words[has] = np.add.reduceat(emb[step.codes], (np.cumsum(step.kept) - step.kept)[has], axis=0)
            words /= step.total[:, None]
            mean = np.add.reduceat(words[step.word], start, axis=0) / sizes[:, None]
            pooled, share = _pool((mean @ out).astype(float) + bias, of, SHARP, bias)
            slope = 1 / (1 + np.exp(-pooled)) - y[step.docs]
            g = (np.repeat(slope, np.diff(of)) * share).astype(np.float32) / len(step.docs) ** 0.5
            g_out = g @ mean
            g_word = np.bincount(step.word, np.repeat(g / sizes, sizes.astype(int)), len(step.kept)) / step.total
            g_code = np.bincount(step.codes, np.repeat(g_word, step.kept), buckets).astype(np.float32)
            touched = np.flatnonzero(g_code)
            emb_sq[touched] += g_code[touched] ** 2
            move = (rate * g_code[touched] / np.sqrt(emb_sq[touched]))[:, None] * out
            out_sq += g_out**2
            out = out - 0.05 * g_out / np.sqrt(out_sq)
            emb[touched] -= move
            bias_sq += float(g.sum()) ** 2
            bias -= 0.1 * float(g.sum()) / bias_sq**0.5
    return Model(emb @ out, bias)


@dataclass(frozen=True)
class _Step:
    """A group of texts: their places and first words, the distinct word that each word is, and of
    each distinct word how many subwords it has, how many of them speak, and which."""

    docs: np.ndarray
    first: np.ndarray
    word: np.ndarray
    total: np.ndarray
    kept: np.ndarray
    codes: np.ndarray


def _groups(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about STEP_WORDS words: places, first words, words, and the subwords of distinct words with their offsets."""
    group, size = [], 0
    for i, text in enumerate(texts):
        group.append(i)
        size += len(text) // 5
        if size >= STEP_WORDS or len(group) >= 64 or i == len(texts) - 1:
            raw, at = text_bytes(pa.array([texts[k] for k in group], pa.large_string()))
            starts, ends, first = word_spans(raw, at)
            if len(starts):
                data, bounds, word = distinct_words(raw, starts, ends)
                yield np.array(group), first, word, *subwords(data, bounds)
            group, size = [], 0


def _speaking(texts: list[str], buckets: int) -> np.ndarray:
    """Whether a bucket is in neither too few nor too many training documents."""
    counts = np.zeros(buckets, np.int32)
    for _, first, word, codes, offsets in _groups(texts):
        for a, b in zip(first[:-1], first[1:], strict=True):
            own = np.unique(word[a:b])
            if len(own):
                counts[np.unique(np.concatenate([codes[offsets[w] : offsets[w + 1]] for w in own]))] += 1
    return (counts >= MIN_DOCS) & (counts <= max(2 * MIN_DOCS, MOST_SHARE * len(texts)))


def _steps(texts: list[str], speaks: np.ndarray) -> list[_Step]:
    """All groups, with the subwords that speak: what a task holds is a fraction of all subwords."""
    steps = []
    for group, first, word, codes, offsets in _groups(texts):
        total = np.diff(offsets)
        heard = speaks[codes]
        kept = np.add.reduceat(heard.astype(np.int32), offsets[:-1])
        steps.append(_Step(group, first.astype(np.int32), word.astype(np.int32), total.astype(np.float32), kept, codes[heard].astype(np.int32)))
    return steps


def sample_sizes(positive: int, negative: int) -> tuple[int, int, float]:
    """Rows of each class to train on, and by how much the sample's log-odds of class 1 exceed those of all labelled rows."""
    total = positive + negative
    if not positive or not negative:
        return min(positive, MAX_ROWS), min(negative, MAX_ROWS), 0.0
    one = min(positive, max(LEAST_POSITIVE, round(MAX_ROWS * positive / total)))
    zero = min(negative, max(1, MAX_ROWS - one))
    return one, zero, math.log(one / zero) - math.log(positive / negative)


def usable_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id, y of labelled ids that are not held out."""
    asked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    return asked.where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))


def sample(docs: DataFrame, known: DataFrame, positive: int, negative: int, id_col: str, text_col: str) -> DataFrame:
    """id, y, text of the training rows: as many of each class, spread by hash, within the bounds on bytes."""
    order = (F.xxhash64("id"), F.col("id"))
    parts = [known.where(F.col("y") == y).orderBy(*order).limit(n) for y, n in ((1, positive), (0, negative))]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # MAX_ROWS and LEAST_POSITIVE rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= MAX_TEXT)
    rows = texts.join(chosen, "id").groupBy("id").agg(F.min("y").cast("long").alias("y"), F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(*order))
    return rows.withColumn("upto", upto).where(F.col("upto") <= MAX_BYTES).drop("upto")


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("id", "y", "text")), strict=True)]
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    model = train([r[2] for r in rows], [r[1] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([model.value.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["value", "bias"])


def held_out(id_column):
    """Whether a row is kept from training: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(id_column.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [k for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
            for part in slices(batch, "text", SCORE_BYTES):
                score = score_texts(part.column("text"), model)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in others), pa.array(score, pa.float64())], names=[*(batch.schema.names[k] for k in others), "score"])

    return run


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model trained in one task on the bounded sample; the driver gets two counts and the finished numbers only."""
    known = usable_labels(labels, id_col, label_col)
    counts = {r["y"]: r["n"] for r in known.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi").groupBy("y").agg(F.count("*").alias("n")).collect()}
    positive, negative, shift = sample_sizes(counts.get(1, 0), counts.get(0, 0))
    if not positive and not negative:
        return train([], [])
    found = sample(docs, known, positive, negative, id_col, text_col).repartition(1).mapInArrow(_train_task, "value binary, bias double").first()
    return Model(np.frombuffer(bytes(found["value"]), "<f4").astype(np.float32), float(found["bias"]) - shift)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; columns unchanged."""
    packed = docs.select(whole_row(docs).alias("row"), F.col(text_col).cast("string").alias("text"))
    scored = packed.mapInArrow(_score(model), T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.where("score < 0.5").select("row.*")
