"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to rows of an embedding table, each by itself and by its first
PREFIXES bytes, so that inflected and compound forms share what is learned; the
three rows are added. Filters of several widths slide over the words, each filter keeps its largest value over the text, and a logistic
layer reads these. All of it is trained by Adam; only the words at a filter's
maximum have gradients. The first embedding coordinate begins as the word's
log odds in the training rows, drawn to zero by 2.5 standard errors, so that
training starts from single words and the filters learn what they mean together.

Thresholds are calibrated by language on training rows kept apart: for each
language the logit with the best F-score (precision counting double) that
reaches PRECISION; a language without one takes the threshold of all rows. A
score is the logistic function of the logit less its threshold, so that 0.5 is
the threshold everywhere. The language is guessed from the text's own function
words, never from a column.

Training uses a bounded sample: at most TRAIN_ROWS labelled ids of each class,
chosen by a hash of their id, and at most SAME texts of one id. With fewer than
ten toxic rows kept apart, thresholds are calibrated on all rows of the sample.
Scoring reads every whole text.

Defined results: a null text is an empty one, whose pooled values are all zero;
documents with several labels take the largest; without labelled rows every
score is 0; the columns `score` and `predicted` must be new.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ALNUM, Words, blocks, mix, utf8

TRAIN_ROWS, SAME = 3000, 4
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 12
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 7
PRECISION = 0.8
PREFIXES = (4, 6)
ROWS = BUCKETS * (1 + len(PREFIXES))

#: Frequent function words, by which a text's language is guessed (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that for with was".split(),
    "de": "der die und das ist mit den von nicht ein".split(),
    "fr": "le les des et dans est pour que une sur".split(),
    "es": "el los las y por con del para una es".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) % np.uint64(BUCKETS)).astype(np.int32)


def rows_of(words: Words) -> np.ndarray:
    """The embedding rows of each word: its own, and those of its beginnings."""
    if not len(words.length):
        return np.zeros((0, 1 + len(PREFIXES)), np.int32)
    own = [bucket(words.hashes(prefix=p)) + np.int32(BUCKETS * k) for k, p in enumerate((0, *PREFIXES))]
    return np.stack(own, 1)


def _function_buckets() -> np.ndarray:
    out = np.full(BUCKETS, len(FUNCTION_WORDS), np.int8)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        out[bucket(Words([w.encode() for w in words], ALNUM).hashes())] = i
    return out


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, SIZE, FILTERS)
    weights: np.ndarray
    bias: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    function: np.ndarray = field(default_factory=_function_buckets)

    def pooled(self, ids: np.ndarray, at: np.ndarray, count: np.ndarray, where: bool = False):
        """Largest filter values of texts whose words are ids[at : at + count]; with where, also their first places."""
        out = np.zeros((len(count), len(WIDTHS) * FILTERS), np.float32)
        places = np.zeros(out.shape, np.int64)
        x = sum(self.embedding[ids[:, k]] for k in range(ids.shape[1]))
        for k, (width, w) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            some = np.flatnonzero(count >= width)
            n = len(ids) - width + 1
            if n < 1 or not len(some):
                continue
            y = sum(x[j : j + n] @ w[j] for j in range(width))
            # begin and end of each text's windows; what lies between belongs to two texts
            edge = np.stack((at[some], at[some] + count[some] - width + 1), 1).ravel()
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            out[some, cols] = np.maximum.reduceat(np.vstack((y, np.full((1, FILTERS), -np.inf, np.float32))), edge, axis=0)[::2]
            if where:
                for i in some:
                    places[i, cols] = at[i] + y[at[i] : at[i] + count[i] - width + 1].argmax(0)
        return (out, places) if where else out

    def logits(self, ids: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(ids, at, count), 0) @ self.weights + self.bias

    def language(self, ids: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(count)), count)
        votes = np.bincount(doc * len(LANGUAGES) + self.function[ids[:, 0]], minlength=len(count) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
        votes[:, -1] = 0
        return np.where(votes.any(1), votes.argmax(1), len(LANGUAGES) - 1)

    def scores(self, ids: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        z = self.logits(ids, at, count) - self.thresholds[self.language(ids, at, count)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count = np.array([len(r) for r in rows], np.int64)
    return np.concatenate([*rows, np.zeros((0, 1 + len(PREFIXES)), np.int32)]), np.cumsum(count) - count, count


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float) -> Model:
    """A model of hashed texts; share: of toxic rows among all labelled ones, which the sample need not have."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    held = rng.random(len(rows)) < 0.25
    seen = np.zeros((2, ROWS))
    for r, y, h in zip(rows, labels, held, strict=True):
        if not h:
            seen[y, np.unique(r)] += 1
    total = np.bincount(labels[~held], minlength=2).astype(float)
    p = (total[1] + 1) / (total.sum() + 2)
    odds = np.log((seen[1] + 0.5) / (seen[0] + 0.5)) - np.log(p / (1 - p))
    error = np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    embedding = rng.normal(0, 0.02, (ROWS, SIZE)).astype(np.float32)
    embedding[:, 0] = np.sign(odds) * np.maximum(np.abs(odds) - 2.5 * error, 0)
    filters = [rng.normal(0, 0.1, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] += 1.0 / len(f)
    model = Model(embedding, filters, rng.normal(0.1, 0.05, len(WIDTHS) * FILTERS).astype(np.float32))
    values = [model.embedding, *model.filters, model.weights]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    train = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for lo in range(0, len(train), BATCH):
            part = train[lo : lo + BATCH]
            ids, at, count = _flat([rows[i] for i in part])
            best, place = model.pooled(ids, at, count, where=True)
            active = np.maximum(best, 0)
            z = active @ model.weights + model.bias
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels[part]).astype(np.float32) / len(part)
            back = d[:, None] * model.weights * (best > 0)
            grads = [np.zeros_like(model.embedding), *(np.zeros_like(f) for f in model.filters), active.T @ d + 1e-3 * model.weights]
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                use = count >= width
                for j in range(width):
                    if not use.any():
                        continue
                    words = ids[place[use, cols] + j]
                    grads[1 + k][j] += np.einsum("bf,bfe->ef", back[use, cols], model.embedding[words].sum(2))
                    for c in range(words.shape[2]):
                        np.add.at(grads[0], words[:, :, c], back[use, cols, None] * model.filters[k][j].T[None])
            model.bias -= RATE * float(d.sum()) * 10
            step += 1
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                on = np.flatnonzero(g.any(1)) if g is grads[0] else slice(None)
                m[on] = 0.9 * m[on] + 0.1 * g[on]
                s[on] = 0.99 * s[on] + 0.01 * g[on] ** 2
                v[on] -= RATE * (m[on] / (1 - 0.9**step)) / (np.sqrt(s[on] / (1 - 0.99**step)) + 1e-6)
    held = held if labels[held].sum() >= 10 else np.ones(len(rows), bool)  # few rows: all of them
    calibrate(model, [rows[i] for i in np.flatnonzero(held)], labels[held], share)
    return model


def calibrate(model: Model, rows: list[np.ndarray], labels: np.ndarray, share: float) -> None:
    """Set the thresholds of a model, from rows it was not trained on where there are enough."""
    ids, at, count = _flat(rows)
    z, lang = model.logits(ids, at, count), model.language(ids, at, count)
    positive = max(labels.mean(), 1e-9) if len(labels) else 0.5
    weight = np.where(labels == 1, share / positive, (1 - share) / max(1 - positive, 1e-9))

    def best(on: np.ndarray) -> float | None:
        order = np.argsort(-z[on], kind="stable")
        y, w, v = labels[on][order], weight[on][order], z[on][order]
        if y.sum() < (10 if len(y) < len(z) else 1):
            return None
        hit, all_ = np.cumsum(w * y), np.cumsum(w)
        precision, recall = hit / all_, hit / hit[-1]
        score = np.where(precision >= PRECISION, 1.25 * precision * recall / (0.25 * precision + recall), -1)
        score[:-1][v[1:] == v[:-1]] = -1  # between equal logits there is no threshold
        k = int(score.argmax())
        if score[k] < 0.25:
            return None
        return float((v[k] + v[k + 1]) / 2 if k + 1 < len(v) else v[k] - 0.1)

    overall = best(np.ones(len(z), bool)) if len(z) else None
    overall = 0.0 if overall is None else overall
    for i in range(len(LANGUAGES)):
        found = best(lang == i)
        model.thresholds[i] = overall if found is None else found


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch["text"])
        for lo, hi in blocks(texts):
            w = Words(texts[lo:hi], ALNUM)
            ends = np.append(w.at, len(w.length)).astype(np.int32)
            ids = pa.ListArray.from_arrays(ends * (1 + len(PREFIXES)), pa.array(rows_of(w).ravel()))
            yield pa.RecordBatch.from_arrays([ids, batch["label"].slice(lo, hi - lo)], ["ids", "label"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model | None:
    """A model from the labelled rows of docs; None without both classes."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    texts = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    known = known.join(texts.select("id"), "id", "left_semi")
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(rows) for k in (0, 1)]
    first = Window.partitionBy("id").orderBy(F.xxhash64("text"), "text")
    own = texts.join(F.broadcast(chosen[0].union(chosen[1])), "id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAME)
    sample = own.select("text", "label").mapInArrow(_hashed, "ids array<int>, label int")
    table = sample.toArrow()
    found = [np.asarray(x.values, np.int32).reshape(-1, 1 + len(PREFIXES)) for x in table["ids"]]
    y = np.asarray(table["label"], np.int64)
    order = sorted(range(len(y)), key=lambda i: (len(found[i]), found[i].tobytes(), y[i]))  # whatever order the rows came in
    return fit([found[i] for i in order], y[order], sizes[1] / (sizes[0] + sizes[1]))


def score(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 at 0.5 or more)."""
    if taken := {"score", "predicted"} & set(df.columns):
        raise ValueError(f"column names taken: {sorted(taken)}")
    if model is None:
        return df.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = utf8(batch[text]), [np.zeros(0)]
            for lo, hi in blocks(texts):
                w = Words(texts[lo:hi], ALNUM)
                out.append(sent.value.scores(rows_of(w), w.at, w.count))
            s = np.concatenate(out).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
