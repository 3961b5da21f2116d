"""Language of texts by error-correcting output codes.

Every language has a codeword of +1 and -1; for each bit a linear classifier over hashed byte
trigrams predicts it.  Decoding takes the language whose codeword has the least loss, each bit
weighted by how well its classifier did on the language's own sample.  The score is the softmax of the
losses; a text whose score is under ``MIN_SCORE`` is flagged ambiguous.

The model is fitted on a bounded sample: at most ``PER_LANGUAGE`` texts of a language and
``SAMPLE`` in all, whole texts, chosen by hash of the id.  Prediction reads only texts, whole.

Null, empty and letterless texts are ``und`` with score 0, and so is every text if nothing could be learnt.  With one
language to learn, every text with letters is of it.  Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm import arrays
from repograph.llm.learning import adam, bounded_sample, held_out, one_row_each, sigmoid

FEATURES = 1 << 12
PER_LANGUAGE, SAMPLE = 300, 4000
MIN_SCORE = 0.5
UNKNOWN = "und"

# White space, digits and punctuation are one class; letters are lower-cased; bytes over 7F stay.
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)
_ASCII_LETTER = (_CLASS > 0) & (np.arange(256) < 128)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of trigram shares, a row for each text; two blanks stand before every text."""

    rows = len(offsets) - 1
    out = np.zeros((rows, FEATURES), np.float32)
    for a, b in arrays.slices(offsets, 1 << 18):
        for c in range(a, b, 64):
            d = min(b, c + 64)
            sizes = np.diff(offsets[c:d + 1])
            owner = np.repeat(np.arange(d - c), sizes + 2)
            padded = np.zeros(len(owner) + 2, np.uint32)
            padded[np.arange(sizes.sum()) + 2 * (np.repeat(np.arange(d - c), sizes) + 1)] = _CLASS[
                data[offsets[c]:offsets[d]]]
            code = padded[:-2] * np.uint32(155 * 155) + padded[1:-1] * np.uint32(155) + padded[2:]
            code = (code * np.uint32(2654435761)) >> np.uint32(32 - 12)
            counts = np.bincount(owner * FEATURES + code, minlength=(d - c) * FEATURES).reshape(d - c, FEATURES)
            out[c:d] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return out


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = np.append(0, np.cumsum(_ASCII_LETTER[data]))
    found = plain[offsets[1:]] > plain[offsets[:-1]]
    for row in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        text = data[offsets[row]:offsets[row + 1]].tobytes().decode("utf-8", "ignore")
        found[row] = any(map(str.isalpha, text))
    return found


def codewords(n: int) -> np.ndarray:
    """Codewords of n languages: all splits for a few, else random ones far from each other."""

    if n <= 5:
        bits = [[1 if (split >> i) & 1 or i == 0 else -1 for i in range(n)]
                for split in range(0, 1 << n, 2) if split != (1 << n) - 2]
        return np.array(bits, np.float64).reshape(-1, n).T if n else np.zeros((0, 0))
    width = 10 * int(np.ceil(np.log2(n)))
    best, far = None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, width))
        apart = ((width - code @ code.T) / 2 + np.eye(n) * width).min()
        if apart > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and its score."""

        bits = x @ self.weights + self.bias
        loss = np.logaddexp(0, -self.code[None] * bits[:, None, :])
        far = (loss * self.trust[None]).sum(axis=2)
        p = np.exp(far.min(axis=1, keepdims=True) - far)
        return far.argmin(axis=1), 1 / p.sum(axis=1)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    languages = sorted(set(labels))
    code = codewords(len(languages))
    place = np.array([languages.index(label) for label in labels], np.int64)
    target = code[place] if len(labels) else np.zeros((0, code.shape[1]))
    share = 1 / np.maximum(np.bincount(place, minlength=len(languages)), 1)[place] if len(labels) else np.zeros(0)
    share = (share / max(share.sum(), 1e-12))[:, None]
    x = x.astype(np.float64)

    def gradient(w: np.ndarray) -> np.ndarray:
        pull = -target * sigmoid(-target * (x @ w[:-1] + w[-1])) * share
        return np.vstack([x.T @ pull + 1e-5 * w[:-1], pull.sum(axis=0)])

    w = adam(gradient, np.zeros((FEATURES + 1, code.shape[1])), 300, 0.2)
    right = (np.sign(x @ w[:-1] + w[-1]) == target).astype(np.float64)
    trust = np.ones_like(code)
    for i in range(len(languages)):
        trust[i] = np.maximum(right[place == i].mean(axis=0), 1e-3)
    trust *= code.shape[1] / np.maximum(trust.sum(axis=1, keepdims=True), 1e-12)
    return Model(languages, code, w[:-1].astype(np.float32), w[-1], trust)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, data, offsets in arrays.text_slices(batch.column("text")):
            rows = features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(start, stop - start), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["label", "x"])


def learn(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          lang_column: str = "lang") -> Model:
    """Fit on a bounded sample of the rows that are not held out."""

    known = documents.select(
        F.col(id_column).alias("id"), F.col(lang_column).alias("label"), F.col(text_column).alias("text")
    ).where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    n = max(known.select("label").distinct().count(), 1)
    sample = bounded_sample(known, min(PER_LANGUAGE, max(1, SAMPLE // n)))
    sampled = known.join(sample, ["id", "label"], "left_semi").where("text IS NOT NULL")
    rows = one_row_each(sampled).mapInArrow(_describe, "label string, x binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), FEATURES)
    return fit(x, [r["label"] for r in rows])


def _predict(model: Model, text_index: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, _, data, offsets in arrays.text_slices(batch.column(text_index)):
                letters = has_letters(data, offsets)
                if model.languages:
                    best, score = model.predict(features(data, offsets))
                else:
                    best, score = np.zeros(len(letters), np.int64), np.zeros(len(letters))
                known = letters & bool(model.languages)
                names += [model.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                scores.append(np.where(known, score, 0.0))
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(score < MIN_SCORE)],
                names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return arrays.tidy(predict)


def predict(documents: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``record``, a struct of the input's columns, with lang_pred, score and ambiguous."""

    columns = documents.columns
    names = [f"c{i}" for i in range(len(columns))]
    renamed = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema.fields)
    found = renamed.mapInArrow(
        _predict(model, columns.index(text_column)), f"{fields}, lang_pred string, score double, ambiguous boolean")
    return found.select(
        F.struct(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)]).alias("record"),
        "lang_pred", "score", "ambiguous")
