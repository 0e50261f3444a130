"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, table

BUCKETS = 4096
DIM = 32
NGRAMS = (1, 2, 3, 4)
#: Bound of the training sample: so many documents of each language, those with the smallest hash of their id.
SAMPLE_PER_LANGUAGE = 1500
#: ... and about so many of all languages together, as the driver holds a dense row of BUCKETS counts for each.
SAMPLE = 12_000
#: The SGD.
EPOCHS, BATCH, RATE, SEED = 12, 32, 0.5, 7
#: Predictions are rejected below the confidence that this part of the right validation predictions exceeds.
KEEP_RIGHT = 0.99
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RUNS = re.compile(rb" +")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def subword_counts(raw: bytes) -> np.ndarray:
    """How often each bucket's subwords (1 to 4 bytes of the words and their edges) stand in the whole text."""
    b = np.frombuffer(_RUNS.sub(b" ", b" " + raw.translate(_FOLD) + b" "), np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    code = np.zeros(len(b), np.uint32)
    for n in range(1, NGRAMS[-1] + 1):
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] if n > 1 else b.copy()
        if n in NGRAMS and len(code):
            h = (code + np.uint32(n)) * np.uint32(2654435761)
            out += np.bincount((h >> np.uint32(20)).astype(np.int64), minlength=BUCKETS)
    return out


class Model:
    """logits(text) = mean over subwords of E[bucket] @ W, divided by a temperature fitted on validation rows."""

    def __init__(self, languages: list[str], table_: np.ndarray, temperature: float, threshold: float) -> None:
        self.languages, self.table, self.temperature, self.threshold = languages, table_, temperature, threshold

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        x = subword_counts(text.encode("utf-8", "surrogatepass"))
        z = (x @ self.table / max(1, x.sum()))[None] / self.temperature
        p = _softmax(z)[0]
        i = int(p.argmax())  # of equal ones the first in the order of names
        return self.languages[i], float(min(1.0, p[i])), bool(_margins(z)[0] >= self.threshold)


def _margins(z: np.ndarray) -> np.ndarray:
    """How far the largest logit is above the next one; unlike its probability this does not saturate."""
    if z.shape[1] < 2:
        return z[:, 0]
    top = np.partition(z, -2, axis=1)
    return top[:, -1] - top[:, -2]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(counts: np.ndarray, labels: list[str]) -> Model:
    """Fits embeddings and softmax by mini-batch SGD on nine tenths of the rows; the rest calibrate.

    The temperature minimises the log loss of the validation rows, whose labels count as right but for one row in all (so that
    rows without an error do not drive it to 0); predictions are rejected below the margin that KEEP_RIGHT of the right
    validation predictions exceed.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), 1.0, 0.0)
    y = np.array([languages.index(x) for x in labels])
    x = (counts / np.maximum(1, counts.sum(1, keepdims=True))).astype(np.float32)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 10], order[len(y) // 10 :]
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 1 / np.sqrt(DIM), (DIM, len(languages))).astype(np.float32)
    scale = np.float32(np.sqrt(BUCKETS))  # mean subword counts are small numbers
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for at in range(0, len(fit), BATCH):
            rows = rng.permutation(fit)[:BATCH] if len(fit) <= BATCH else fit[at : at + BATCH]
            xb = x[rows] * scale
            hidden = xb @ emb
            g = _softmax(hidden @ out)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            d_out, d_emb = hidden.T @ g, xb.T @ (g @ out.T)
            out -= rate * d_out
            emb -= rate * d_emb
        rng.shuffle(fit)
    table_ = (emb @ out).astype(np.float64) * float(scale)
    temperature, threshold = 1.0, 0.0
    if len(held):
        z, t = x[held] @ table_, y[held]
        at = np.arange(len(held))
        doubt = 1 / (len(held) + 2)

        def loss(c: float) -> float:
            p = np.log(_softmax(z / c) + 1e-12)
            return float(np.mean(-(1 - doubt) * p[at, t] - doubt * p.mean(1)))

        temperature = min((loss(c), c) for c in np.geomspace(0.1, 100, 61))[1]
        right = _margins(z / temperature)[z.argmax(1) == t]
        threshold = float(np.quantile(right, 1 - KEEP_RIGHT)) if len(right) else 0.0
    return Model(languages, table_, temperature, threshold)


def _remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def fit_language(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from a bounded sample of the rows with a language and crc32(doc_id) mod 5 other than 0.

    The sample is the ``per_language`` rows of each language with the smallest hash of their id; it comes to
    the driver as the subword counts that are not 0, about SAMPLE rows in all.  A task sends at most that many ids of a language (the limit of the ranking
    is applied before its shuffle), so a language with most of the rows is no hot key.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(_remainder(), F.lit(0)) != 0))
    per_language = min(per_language, max(1, SAMPLE // max(1, rows.select("lang").distinct().count())))
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= per_language).select("doc_id", "lang").distinct()

    def run(batches):
        for batch in batches:
            got = [subword_counts(x) for x in batch.column(1).to_pylist()]
            used = [np.flatnonzero(x) for x in got]
            yield {"lang": batch.column(0), "at": [i.astype("<u2").tobytes() for i in used], "counts": [x[i].astype("<u4").tobytes() for x, i in zip(got, used)]}

    chosen = rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")  # at most per_language ids of each language
    sample = arrow_map(chosen.select("lang", F.col("text").cast("binary").alias("raw")), run, "lang string, at binary, counts binary").collect()
    sample.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.counts)))
    counts = np.zeros((len(sample), BUCKETS), np.float32)
    for i, r in enumerate(sample):
        counts[i, np.frombuffer(r.at, "<u2")] = np.frombuffer(r.counts, "<u4")
    return train(counts, [r.lang for r in sample])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, accepted.

    A null text, a text without letters, or a model without languages gives ``und``, score 0, not accepted.
    ``accepted`` is false where the calibrated confidence is below the model's threshold. A null doc_id counts
    as held out. Very short texts are predicted from what they have, very long ones from all of it. Only the whole text is an input.
    Of equal logits the first language by name wins. Repeated rows, and rows that share a doc_id, are predicted each. An empty
    table gives no rows. Extra columns are ignored.
    """

    def run(batches):
        for batch in batches:
            got = [model.predict(x) for x in batch.column(2).to_pylist()]
            yield {"doc_id": batch.column(0), "held_out": batch.column(1)} | {c: [g[i] for g in got] for i, c in enumerate(("lang_pred", "score", "accepted"))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", (F.coalesce(_remainder(), F.lit(0)) == 0).alias("held_out"), "text")
    return arrow_map(source, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_language(docs))
