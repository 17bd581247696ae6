"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams of lengths 1 to 3 (A-Z folded), each present
or not; single bytes have places of their own, two- and three-grams are hashed.  The
kernel of two texts is the cosine of their presence vectors.  A bounded, stratified
sample of labelled texts gives the training rows, and a part of it the Nystroem
landmarks; kernel ridge regression is solved one language against the rest.
Scoring is two matrix products for each batch: presence by landmarks, and kernel
values by coefficients.

The only bounded steps are the sample (``per_language`` texts of each language, by
hash order, and about ``SAMPLE`` in all) and the landmarks (``ALL_LANDMARKS`` in all);
of more than ``LANGUAGES`` languages the most frequent are learned.  Scoring reads
every whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0; ties
go to the lesser language name; without any labelled text everything is ``und``;
of several texts under one id and language the least presence row is learned.
The score is the winning share of a softmax over the languages' outputs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage, textscan

UNKNOWN = "und"
#: Training texts of one language at most, landmarks of one language at most.
PER_LANGUAGE, LANDMARKS = 1000, 48
#: Training texts and landmarks of all languages; languages, of which there are fewer than 8,000 in use.
SAMPLE, ALL_LANDMARKS, LANGUAGES = 40_000, 1536, 8000
RIDGE = 1e-3
#: Outputs are near 0 or 1; this makes their softmax a share.
SHARPNESS = 8.0
#: A score from which a language is as likely as all others together.
MAJORITY = 0.5
TRIGRAMS = 1 << 14
#: Two-grams are hashed too, to as many places.
BIGRAMS = 1 << 12
DIM = 256 + BIGRAMS + TRIGRAMS
_ROWS = 128

_LETTER_BYTES = textscan.byte_class((0x41, 0x5A), (0x61, 0x7A))


def presence(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 0/1 matrix: which n-grams each text of a slice has."""
    at = at - at[0]
    n = len(at) - 1
    out = np.zeros((n, DIM), np.bool_)
    flat = out.reshape(-1)
    low = textscan.LOWER[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * DIM, np.diff(at))
    flat[row + low] = True
    if len(low) > 1:
        two = (low[:-1] << np.uint32(8)) | low[1:]
        place = ((two * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64) + 256
        same = row[:-1] == row[1:]
        flat[(row[:-1] + place)[same]] = True
    if len(low) > 2:
        three = (two[:-1] << np.uint32(8)) | low[2:]
        place = ((three * np.uint32(0x85EBCA6B)) >> np.uint32(18)).astype(np.int64) + 256 + BIGRAMS
        same = row[:-2] == row[2:]
        flat[(row[:-2] + place)[same]] = True
    return out


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows of length one; empty rows stay zero."""
    size = np.sqrt(x.sum(axis=1, dtype=np.float32))
    return x.astype(np.float32) / np.maximum(size, 1)[:, None]


def slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in textscan.slices(at, 1 << 20):
        for c in range(a, b, _ROWS):
            yield c, min(b, c + _ROWS)


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    sums = np.concatenate([[0], np.cumsum(_LETTER_BYTES[data])])
    at = at - at[0]
    out = sums[at[1:]] > sums[at[:-1]]
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = any(unicodedata.category(c)[0] == "L" for c in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


class Model:
    """Landmarks and coefficients."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, coefficients: np.ndarray):
        self.languages, self.landmarks, self.coefficients = languages, landmarks, coefficients

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score) of presence rows."""
        out = (normalised(x) @ self.landmarks) @ self.coefficients
        share = np.exp((out - out.max(axis=1, keepdims=True)) * SHARPNESS)
        share /= share.sum(axis=1, keepdims=True)
        best = out.argmax(axis=1)
        return best, share[np.arange(len(best)), best].astype(np.float64)


def fit(bits: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on packed presence rows, in the given order; the first of each language are its landmarks."""
    if not labels:
        return None

    def unpacked(rows: list[bytes]) -> np.ndarray:
        return normalised(np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1, count=DIM))

    languages = sorted(set(labels))
    number = {name: i for i, name in enumerate(languages)}
    y = np.array([number[label] for label in labels])
    each = max(1, min(landmarks, ALL_LANDMARKS // len(languages)))
    order = np.argsort(y, kind="stable")
    place = np.arange(len(y)) - np.searchsorted(y[order], y[order])
    chosen = order[place < each]
    if len(chosen) > ALL_LANDMARKS:
        # More languages than landmarks: those that come first.
        chosen = np.sort(chosen)[:ALL_LANDMARKS]
    marks = unpacked([bits[i] for i in chosen])
    gram = np.zeros((len(chosen),) * 2)
    right = np.zeros((len(chosen), len(languages)))
    weight = len(y) / (len(languages) * np.bincount(y))
    for a in range(0, len(y), 512):
        k = (unpacked(bits[a : a + 512]) @ marks.T).astype(np.float64)
        w = weight[y[a : a + 512]]
        gram += k.T @ (k * w[:, None])
        aim = np.zeros((len(k), len(languages)))
        aim[np.arange(len(k)), y[a : a + 512]] = w
        right += k.T @ aim
    own = (marks @ marks.T).astype(np.float64)
    solved = np.linalg.solve(gram + ridge * len(y) * own + 1e-6 * len(y) * np.eye(len(own)), right)
    return Model(languages, np.ascontiguousarray(marks.T), solved.astype(np.float32))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Learn from the rows where ``learn`` holds and the language is known."""
    spark = docs.sparkSession
    rows = docs.where(learn) if learn is not None else docs
    rows = rows.select(F.col(doc_id).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    # Ids are chosen first, without texts, in hash order.  The languages' counts tell which part of the
    # hashes holds enough of them, so that few rows are sorted however many there are.
    languages = storage.materialise(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES), spark, "languages")
    per_language = max(1, min(per_language, SAMPLE // max(1, languages.count())))
    ids = rows.select("id", "lang", F.xxhash64(F.lit(7), "id").alias("order")).join(F.broadcast(languages), "lang")
    ids = ids.where((F.col("order") / F.lit(2.0**64) + 0.5) * F.col("count") < 2 * per_language + 100)
    ids = ids.selectExpr("id", "lang", "row_number() over (partition by lang order by order, id) as place").where(F.col("place") <= per_language)
    # At most SAMPLE ids.
    picked = F.broadcast(storage.materialise(ids.select("id", "lang").distinct(), spark, "sample-ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = textscan.string_buffers(batch.column("text"))
            for a, b in slices(at):
                data = raw[at[a] : at[b]]
                x = presence(data, at[a : b + 1])
                bits = [r.tobytes() for r in np.packbits(x, axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("lang").slice(a, b - a), pa.array(bits, pa.binary())], names=["id", "lang", "bits"]).filter(pa.array(has_letter(data, at[a : b + 1])))

    sample = storage.materialise(rows.join(picked, ["id", "lang"], "left_semi").mapInArrow(run, "id string, lang string, bits binary"), spark, "sample")
    # A bounded sample of DIM / 8 bytes a text.
    held = sample.groupBy("id", "lang").agg(F.min("bits").alias("bits")).orderBy(F.xxhash64(F.lit(8), "id"), "id", "lang").toArrow()
    return fit(held.column("bits").to_pylist(), held.column("lang").to_pylist(), landmarks)


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predicted(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names, scores], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def predicted(column: pa.Array, model: Model | None) -> tuple[pa.Array, pa.Array]:
    """Languages and scores of one batch of texts."""
    n = len(column)
    names, scores = np.full(n, UNKNOWN, object), np.zeros(n)
    raw, at = textscan.string_buffers(column)
    for a, b in slices(at) if model is not None else ():
        data = raw[at[a] : at[b]]
        known = has_letter(data, at[a : b + 1])
        best, score = model.predict(presence(data, at[a : b + 1]))
        names[a:b][known] = np.array(model.languages, object)[best[known]]
        scores[a:b][known] = score[known]
    return pa.array(names, pa.string()), pa.array(scores)


def accepted(docs: DataFrame, model: Model | None, text: str = "text", min_score: float = 0.0) -> DataFrame:
    """The documents whose language is known, with a score of at least ``min_score``, with all their columns.

    Without a model, all texts that have a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text).cast(pa.string())
            if shared.value is None:
                raw, at = textscan.string_buffers(column)
                keep = [has_letter(raw[at[a] : at[b]], at[a : b + 1]) for a, b in slices(at)]
                yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))
                continue
            names, scores = predicted(column, shared.value)
            keep = (names.to_numpy(zero_copy_only=False) != UNKNOWN) & (scores.to_numpy() >= min_score)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
