"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

Each text becomes a sparse vector: its words hashed into WORD_SLOTS columns
(log-scaled counts, scaled to unit length), followed by STATS dense columns of
shape and size.  The model has a weight and a RANK-wide factor for each column,
and scores  b + w.x + sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2,
which is linear in the number of entries.

Fitting takes a bounded, documented sample of labelled rows (``sample_rows``,
drawn by the hash of the key); scoring reads every whole text.

Cases: a null or empty text is scored by its statistics alone; with no
labelled rows, or labels of one kind only, the model is their base rate;
repeated rows give repeated rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import PIECE_BYTES, slices, word_hashes

WORD_SLOTS = 2048
RANK = 6
SAMPLE_ROWS = 6_000              # labelled rows that the model is fitted on at most
EPOCHS = 24
BATCH = 128
SEED = 7

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 10, 11, 12, 13), "newline": (10,),
            "bang": (33,), "bar": (124,), "marks": (35, 36, 37, 38, 42, 64, 94, 126), "stops": (44, 46, 59, 58, 63), "high": range(128, 256)}
_TABLE = np.zeros((256, len(_CLASSES)), np.int64)
for _i, _codes in enumerate(_CLASSES.values()):
    _TABLE[list(_codes), _i] = 1
STATS = len(_CLASSES) + 8
COLUMNS = WORD_SLOTS + STATS


def byte_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Occurrences of each byte value by row, counted in slices so that one very long row needs little memory."""
    rows = len(offsets) - 1
    hist = np.zeros(rows << 8, np.int64)
    for a in range(0, len(raw), PIECE_BYTES):
        b = min(len(raw), a + PIECE_BYTES)
        of = np.searchsorted(offsets, np.arange(a, b), "right") - 1 if rows > 1 else 0
        hist += np.bincount((of << 8) + raw[a:b].astype(np.int64), minlength=rows << 8)
    return hist.reshape(rows, 256)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, bounds, stats): the sparse words of row i are slots[bounds[i]:bounds[i+1]]."""
    words, wb = word_hashes(raw, offsets)
    rows, n_words = len(offsets) - 1, np.diff(wb)
    of = np.repeat(np.arange(rows), n_words)
    slot = (words >> np.uint64(40)).astype(np.int64) % WORD_SLOTS
    pair, counts = np.unique(of * WORD_SLOTS + slot, return_counts=True)
    row = pair // WORD_SLOTS
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(row, value * value, rows))
    value = value / np.maximum(norm[row], 1e-9)
    bounds = np.searchsorted(row, np.arange(rows + 1))
    hist = byte_counts(raw, offsets)
    size = np.diff(offsets)
    share = (hist @ _TABLE) / np.maximum(size, 1)[:, None]
    order = np.lexsort((words, of))
    w, o = words[order], of[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    kinds = np.bincount(o[new], minlength=rows)
    again = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=rows) if len(words) else np.zeros(rows)
    p = hist / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(axis=1)
    many = np.maximum(n_words, 1)
    stats = np.column_stack([share, np.log1p(size) / 10, np.log1p(n_words) / 8, kinds / many, again / many,
                             (size - hist[:, 32]) / many / 10, entropy / 6, n_words <= 5, kinds / np.maximum(np.sqrt(many), 1) / 20])
    return pair % WORD_SLOTS, value.astype(np.float32), bounds, stats.astype(np.float32)


class Model:
    """Weights of a fitted machine; plain arrays, a few hundred kilobytes."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.bias, self.w, self.v, self.mean, self.scale = bias, w, v, mean, scale

    def probability(self, slots: np.ndarray, values: np.ndarray, bounds: np.ndarray, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) * self.scale, -4, 4)
        rows = len(bounds) - 1
        of = np.repeat(np.arange(rows), np.diff(bounds))
        vs, v2 = self.v[WORD_SLOTS:], self.v * self.v
        linear = np.bincount(of, self.w[slots] * values, rows) + x @ self.w[WORD_SLOTS:]
        total, squares = x @ vs, (x * x) @ v2[WORD_SLOTS:].sum(axis=1)
        for f in range(self.v.shape[1]):
            total[:, f] += np.bincount(of, self.v[slots, f] * values, rows)
        squares = squares + np.bincount(of, v2.sum(axis=1)[slots] * values * values, rows)
        z = self.bias + linear + ((total * total).sum(axis=1) - squares) / 2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Adam on the log loss over (slots, values, stats) rows."""
    rng = np.random.default_rng(SEED)
    n, rate = len(rows), float(labels.mean()) if len(labels) else 0.5
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    w, v = np.zeros(COLUMNS, np.float32), rng.normal(0, 0.02, (COLUMNS, RANK)).astype(np.float32)
    bias = np.array([np.log(rate / (1 - rate))], np.float32)
    if n == 0 or rate in (1e-3, 1 - 1e-3):
        return Model(float(bias[0]), w, v * 0, np.zeros(STATS, np.float32), np.zeros(STATS, np.float32))
    stats = np.vstack([s for _, _, s in rows])
    mean, scale = stats.mean(axis=0), 1 / (stats.std(axis=0) + 1e-3)
    stats = np.clip((stats - mean) * scale, -4, 4)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v, bias)]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        rate_now = 0.02 * (1 - epoch / EPOCHS) + 0.001
        for a in range(0, n, BATCH):
            take = order[a:a + BATCH]
            x = np.zeros((len(take), COLUMNS), np.float32)
            for i, r in enumerate(take):
                x[i, rows[r][0]] = rows[r][1]
            x[:, WORD_SLOTS:] = stats[take]
            total = x @ v
            z = bias + x @ w + ((total * total).sum(axis=1) - (x * x) @ (v * v).sum(axis=1)) / 2
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[take]) / len(take)
            grads = (x.T @ e + 1e-4 * w, x.T @ (e[:, None] * total) - v * ((x * x).T @ e)[:, None] + 1e-4 * v, np.array([e.sum()], np.float32))
            step += 1
            for p, g, (m, s) in zip((w, v, bias), grads, state, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate_now * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)
    return Model(float(bias[0]), w, v, mean, scale)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` rows with a 0/1 label, drawn by the hash of the key.

    Tasks turn the drawn texts into sparse vectors; only those reach the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in slices(batch, text):
                slots, values, bounds, stats = features(raw, offsets)
                rows = range(len(offsets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1).cast(pa.float32()),
                     pa.array([slots[bounds[i]:bounds[i + 1]].astype(np.uint16).tobytes() for i in rows], pa.binary()),
                     pa.array([values[bounds[i]:bounds[i + 1]].tobytes() for i in rows], pa.binary()),
                     pa.array([stats[i].tobytes() for i in rows], pa.binary())], ["h", "y", "slots", "vals", "stats"])

    usable = labelled.where(F.col(label).isin(0, 1)).select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(label).alias("y"), F.col(text))
    # a bound on the hash keeps about sample_rows rows before any text moves
    n = usable.count()
    edge = F.lit(2**63 - 1) if n <= sample_rows else F.lit(int(-(2**63) + 2**64 * (sample_rows / n)))
    sample = usable.where(F.col("h") < edge).mapInArrow(work, "h long, y float, slots binary, vals binary, stats binary").toPandas()
    sample = sample.sort_values(["h", "y", "stats"], kind="stable").head(sample_rows)
    rows = [(np.frombuffer(s, np.uint16), np.frombuffer(x, np.float32), np.frombuffer(t, np.float32)) for s, x, t in zip(sample["slots"], sample["vals"], sample["stats"], strict=True)]
    return train(rows, sample["y"].to_numpy(np.float32))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """(key, score) of every row by its whole text; ``keep`` names columns to carry along in place of the key."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [key] if keep is None else keep
    at = [(names.index(text))] if text in names else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in slices(batch, batch.schema.names[at[0]] if at else "__text"):
                p = shared.value.probability(*features(raw, offsets))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], pa.array(p, pa.float64())], [*names, name])

    source = df.select(*[F.col(f"`{c}`") for c in names], *([] if at else [F.col(text).alias("__text")]))
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return source.mapInArrow(work, f"{fields}, `{name}` double")
