"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded by fixed numeric features (byte classes, hashed
byte pairs, word and line statistics) and a trained layer. Gated attention weighs the passages; the weighted representation
is scored. Only document labels are used. Training takes a bounded sample of labelled rows that are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import bounded_batches, frugal

PASSAGE_BYTES = 1500
PAIRS = 128
#: Bound of the training sample, for each of the two labels.
SAMPLE = 2000
#: Bound of a training document's passages, evenly spaced over the whole text. Scores use all passages.
TRAIN_PASSAGES = 128
FOLDS = 5
HIDDEN, ATTENTION = 24, 12
STEPS, RATE, DECAY = 250, 0.02, 1e-4
SEED = 5
THRESHOLD = 0.3

_CLASSES = np.full(256, 15, np.uint8)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\r\x0b\x0c", b".", b",", b";:?", b"!", b"'\"", b"()[]{}<>", b"#$%&*+=@^_`|~", b"-/\\", bytes(range(128, 192)), bytes(range(192, 256)))):
    _CLASSES[list(_bytes)] = _k
N_STATS = 16 + 8
WIDTH = N_STATS + PAIRS


def passages(text: bytes) -> list[bytes]:
    """The whole text in pieces of about PASSAGE_BYTES, cut at white space where there is some; at least one piece."""
    out, at = [], 0
    while len(text) - at > PASSAGE_BYTES * 3 // 2:
        end = max(text.rfind(b" ", at + 1, at + PASSAGE_BYTES), text.rfind(b"\n", at + 1, at + PASSAGE_BYTES))
        end = end if end > at + PASSAGE_BYTES // 2 else at + PASSAGE_BYTES
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def encode_passage(piece: bytes) -> np.ndarray:
    x = np.zeros(WIDTH, np.float32)
    n = len(piece)
    if not n:
        return x
    b = np.frombuffer(piece, np.uint8)
    x[:16] = np.bincount(_CLASSES[b], minlength=16) / n
    words, lines = piece.split(), piece.split(b"\n")
    lower = piece.lower().split()
    w = max(1, len(words))
    x[16] = len(set(lower)) / w
    x[17] = sum(map(len, words)) / w / 10
    x[18] = len(set(lines)) / len(lines)
    x[19] = np.log1p(n) / 8
    x[20] = sum(x.isupper() for x in words) / w
    x[21] = len(set(zip(lower, lower[1:], lower[2:], strict=False))) / w
    x[22] = n / len(lines) / 500
    x[23] = 1
    pairs = (b[:-1].astype(np.uint32) * 40503 + b[1:].astype(np.uint32) * 9973 >> 3) & (PAIRS - 1)
    x[N_STATS:] = np.sqrt(np.bincount(pairs, minlength=PAIRS) / n)
    return x


def encode_text(text: bytes | None, most: int | None = None) -> np.ndarray:
    """A row for each passage, or for most of them at most; null and empty texts have one of zeros."""
    found = passages(text or b"")
    if most and len(found) > most:
        found = [found[i * len(found) // most] for i in range(most)]
    return np.stack([encode_passage(p) for p in found])


def _softmax(e: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> np.ndarray:
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    return e / np.add.reduceat(e, starts)[bag]


class Model:
    """Passage layer, gated attention and score. Without labels of both kinds every score is the smoothed share of label 1."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        shapes = {"w": (WIDTH, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: rng.standard_normal(s) / np.sqrt(s[0]) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}

    def forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        alpha = _softmax((t * s) @ p["a"], starts, bag)
        z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "alpha": alpha, "z": z, "y": y}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> Model:
        share = (float(weights @ labels) + 1) / (float(weights.sum()) + 2)
        self.p["d"][0] = np.log(share / (1 - share))
        if len(set(labels.tolist())) < 2:
            self.p["c"][:] = 0
            return self
        x = np.concatenate(bags).astype(np.float64)
        sizes = np.array([len(b) for b in bags])
        starts, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        weights = weights / weights.sum()
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            p, f = self.p, self.forward(x, starts, bag)
            dy = (f["y"] - labels) * weights
            dz = dy[:, None] * p["c"]
            dalpha = (f["h"] * dz[bag]).sum(axis=1)
            de = f["alpha"] * (dalpha - np.add.reduceat(f["alpha"] * dalpha, starts)[bag])
            dt, ds = de[:, None] * p["a"] * f["s"], de[:, None] * p["a"] * f["t"]
            dv, du = dt * (1 - f["t"] ** 2), ds * f["s"] * (1 - f["s"])
            dh = f["alpha"][:, None] * dz[bag] + dv @ p["v"].T + du @ p["u"].T
            dpre = dh * (1 - f["h"] ** 2)
            g = {"w": f["x"].T @ dpre, "b": dpre.sum(axis=0), "v": f["h"].T @ dv, "u": f["h"].T @ du, "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": np.array([dy.sum()])}
            for k in p:
                grad = g[k] + DECAY * p[k] * (k not in "bd")
                m[k], q[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * q[k] + 0.001 * grad**2
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in bags])
        return self.forward(np.concatenate(bags), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes))["y"]


def held_out(doc_id: Column | str) -> Column:
    """Rows that never teach: a fifth of all ids by a checksum. False for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


@frugal
def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [encode_text(t.as_py(), TRAIN_PASSAGES) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.astype("<f4").tobytes() for b in bags], pa.binary())], names=["doc_id", "label", "bag"])


@frugal
def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = []
        for s in range(0, batch.num_rows, 64):
            scores.append(model.score([encode_text(t.as_py()) for t in batch.column(1).slice(s, 64)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*scores, np.empty(0)]))], names=["doc_id", "score"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most sample rows of each label, chosen by a hash of doc_id among those not held out.

    labels: doc_id long, quality int; rows with nulls teach nothing, of a repeated doc_id the smallest label counts. Sampled
    rows are weighted so that the labels keep their shares.
    """
    bounded_batches(documents.sparkSession)
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    # of rows that share a doc_id one teaches
    known = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = known.select("doc_id", "label", "text").mapInArrow(_encode, "doc_id long, label int, bag binary").toPandas()
    rows = rows.sort_values(["doc_id", "bag"]).reset_index(drop=True)
    bags = [np.frombuffer(b, "<f4").reshape(-1, WIDTH) for b in rows["bag"]]
    y = rows["label"].to_numpy(np.float64)
    taken = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    return Model().fit(bags, y, np.array([counts[int(k)] / taken[int(k)] for k in y], np.float64))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of documents: whole texts, null and empty ones too."""
    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(partial(_score, model=model), "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out boolean, score double, predicted int (1 if score >= threshold) for each row of documents.

    Other columns than doc_id and text are ignored. Rows without doc_id are scored and not held out.
    """
    scored = score(documents, train(documents, labels, sample))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@frugal
def _keep(batches: Iterator[pa.RecordBatch], model: Model, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 64):
            part = batch.slice(s, 64)
            good = model.score([encode_text((t.as_py() or "").encode()) for t in part.column(at)]) >= threshold
            yield part.filter(pa.array(good))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """documents whose score reaches the threshold, columns unchanged: each row is judged by its own text, in one pass."""
    model = train(documents, labels, sample)
    schema = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes)
    return documents.mapInArrow(partial(_keep, model=model, at=documents.columns.index("text"), threshold=threshold), schema)
