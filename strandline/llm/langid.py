"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are read in consecutive blocks of ``BLOCK`` bytes. In each block one network
reads forwards and one backwards; both states together label every byte position, and the
positions' probabilities are averaged over the whole text. Training is backpropagation through
time over a bounded, documented sample of labelled rows; prediction covers every byte of every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import text as tx
from strandline.llm.work import small_batches

BLOCK = 128
HIDDEN = 8
#: Bytes of a training piece; the network starts anew in each.
PIECE = 64
#: Bound of the training sample: about so many rows of each label are fitted on, PIECES pieces of each.
ROWS_PER_LABEL = 1000
PIECES = 3
#: Steps of Adam, whatever the size of the sample.
STEPS = 400
_WIDTH = 2048
UNKNOWN = "und"


@dataclass
class Network:
    """Weights: for each direction input columns (3H x 257, the last for padding), recurrent (3H x H); output (L x 2H) and bias."""

    labels: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: np.ndarray
    bias: np.ndarray

    @property
    def arrays(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, self.output, self.bias]


def new_network(labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    one = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(labels, [one(3 * hidden, 257, scale=0.3) for _ in range(2)], [one(3 * hidden, hidden, scale=0.35) for _ in range(2)], one(len(labels), 2 * hidden, scale=0.3), np.zeros((len(labels), 1), np.float32))


def _states(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T x H x N) of one direction over x (T x N); keep gets what backpropagation needs."""
    hidden, (steps, n) = u.shape[1], x.shape
    out = np.empty((steps, hidden, n), np.float32)
    w, u = w.copy(), u.copy()
    w[: 2 * hidden] = w[: 2 * hidden] * 0.2 + 0.5  # gates are clip(0.2 v + 0.5, 0, 1)
    u[: 2 * hidden] *= 0.2
    h = np.zeros((hidden, n), np.float32)
    a, m = np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
    for t in range(steps):
        np.take(w, x[t], axis=1, out=a, mode="clip")
        np.matmul(u, h, out=m)
        gates = a[: 2 * hidden]
        gates += m[: 2 * hidden]
        np.maximum(gates, 0, out=gates)
        np.minimum(gates, 1, out=gates)
        z, r = gates[:hidden], gates[hidden:]
        candidate = a[2 * hidden :]
        candidate += r * m[2 * hidden :]
        np.tanh(candidate, out=candidate)
        if keep is not None:
            keep.append((h, a.copy(), m[2 * hidden :].copy()))
        new = out[t]
        np.subtract(h, candidate, out=new)
        new *= z
        new += candidate
        h = new
    return out


def _probabilities(net: Network, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Label probabilities (T x L x N) of every position."""
    hidden = forward.shape[1]
    p = np.matmul(net.output[:, :hidden], forward)
    p += np.matmul(net.output[:, hidden:], backward)
    p += net.bias
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the positions of blocks x (T x N, 256 pads) with labels y, and its gradients."""
    kept: list[list] = [[], []]
    sides = [x, x[::-1]]
    states = [_states(sides[d], net.inputs[d], net.recurrent[d], kept[d]) for d in (0, 1)]
    states[1] = states[1][::-1]
    p = _probabilities(net, *states)
    real = (x < 256).astype(np.float32)
    total = real.sum()
    columns = np.arange(x.shape[1])
    loss = float(-(np.log(p[:, y, columns] + 1e-9) * real).sum() / total)
    p[:, y, columns] -= 1
    p *= real[:, None, :] / total
    hidden = net.recurrent[0].shape[1]
    both = np.concatenate(states, axis=1)
    d_output = np.einsum("tln,thn->lh", p, both, optimize=True)
    d_bias = p.sum(axis=(0, 2))[:, None]
    d_inputs, d_recurrent = [], []
    for d in (0, 1):
        dp = np.matmul(net.output[:, d * hidden : (d + 1) * hidden].T, p)
        dp = dp if d == 0 else dp[::-1]
        u, du = net.recurrent[d], np.zeros_like(net.recurrent[d])
        dx = np.empty((3 * hidden, *x.shape), np.float32)
        dh = np.zeros((hidden, x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, a, m = kept[d][t]
            dh += dp[t]
            z, r, c = a[:hidden], a[hidden : 2 * hidden], a[2 * hidden :]
            dc = dh * (1 - z) * (1 - c * c)
            rec = np.concatenate((dh * (h - c) * 0.2 * ((z > 0) & (z < 1)), dc * m * 0.2 * ((r > 0) & (r < 1)), dc * r))
            dx[:, t] = rec
            dx[2 * hidden :, t] = dc
            du += rec @ h.T
            dh = dh * z + u.T @ rec
        flat = sides[d].ravel()
        d_inputs.append(np.stack([np.bincount(flat, weights=row.ravel(), minlength=257)[:257] for row in dx]).astype(np.float32))
        d_recurrent.append(du)
    return loss, [*d_inputs, *d_recurrent, d_output, d_bias]


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network:
    """Fits a network by backpropagation through time (Adam) on pieces of text, each with its label."""
    names = sorted(set(labels))
    net = new_network(names, seed=seed)
    x = np.full((len(texts), PIECE), 256, np.intp)
    for i, piece in enumerate(texts):
        raw = np.frombuffer(piece[:PIECE], np.uint8)
        x[i, : len(raw)] = raw
    y = np.array([names.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    first, second = ([np.zeros_like(v) for v in net.arrays] for _ in range(2))
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate((order, rng.permutation(len(x))))
        rows, order = order[:batch], order[batch:]
        _, grads = _gradients(net, np.ascontiguousarray(x[rows].T), y[rows])
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for v, g, m, s in zip(net.arrays, grads, first, second, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return net


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """Mean position probabilities of each whole text (rows x labels); zeros for a text without bytes."""
    data, offsets = tx.text_buffers(texts)
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    starts = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
    size = np.minimum(offsets[1:][owner] - starts, BLOCK)
    padded = np.concatenate((data, np.zeros(BLOCK, np.uint8)))
    total = np.zeros((len(lengths), len(net.labels)))
    for at in range(0, len(owner), _WIDTH):
        s, n, o = starts[at : at + _WIDTH], size[at : at + _WIDTH], owner[at : at + _WIDTH]
        steps = np.arange(BLOCK)[:, None]
        real = steps < n
        x = np.where(real, padded[s + steps], 256).astype(np.intp)
        p = _probabilities(net, _states(x, net.inputs[0], net.recurrent[0]), _states(x[::-1], net.inputs[1], net.recurrent[1])[::-1])
        pooled = (p * real[:, None, :]).sum(axis=0, dtype=np.float64)
        for k in range(len(net.labels)):
            total[:, k] += np.bincount(o, weights=pooled[k], minlength=len(lengths))
    return total / np.maximum(lengths, 1)[:, None]


def fit(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows_per_label: int = ROWS_PER_LABEL, seed: int = 7) -> Network | None:
    """Trains on about ``rows_per_label`` rows of each label, chosen by a hash of their key; None without labelled text.

    Labels are counted over all rows and every one is learned. The driver gets the labels' counts and, of the chosen rows,
    PIECES pieces of PIECE characters spread evenly over each text. Rows without label or letters don't count.
    """
    labelled = df.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = dict(df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string")).count().collect())
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for name, n in counts.items() for v in (name, min(1.0, 1.1 * rows_per_label / n))])
    uniform = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    start = lambda k: (F.length(text) * F.lit(k) / F.lit(float(PIECES))).cast("int") + 1
    pieces = F.array(*[F.substring(F.col(text), start(k), F.lit(PIECE)) for k in range(PIECES)])
    chosen = labelled.where(uniform < share[F.col(label).cast("string")]).select(F.col(label).cast("string").alias("label"), pieces.alias("pieces"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"))
    rows = chosen.orderBy("h").limit(2 * rows_per_label * len(counts)).collect()
    pairs = [(piece.encode()[:PIECE], r.label) for r in rows for piece in dict.fromkeys(r.pieces) if piece.strip()]
    if not pairs:
        return None
    return train([p for p, _ in pairs], [v for _, v in pairs], seed=seed)


def predict(df: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1). Null text and text without any letter: ``und`` with score 0; so is all without a model.

    Columns of these names are replaced.
    """
    fields = [f for f in df.schema.fields if f.name not in ("lang_pred", "score")]
    base = df.select([f.name for f in fields])
    if net is None:
        return base.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    def run(batches):
        for part in tx.chunks(batches, text):
            p = score_texts(net, part.column(text))
            best = p.argmax(axis=1)
            columns = [part.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([net.labels[k] for k in best], pa.string()), pa.array(np.minimum(p[np.arange(len(p)), best], 1.0))], names=[*(f.name for f in fields), "lang_pred", "score"])

    small_batches(df.sparkSession)
    out = base.mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return out.withColumns({"lang_pred": F.when(known, F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(known, F.col("score")).otherwise(0.0)})
