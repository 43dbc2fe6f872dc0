"""Language-model scoring by a hidden Markov model.

Latent states move by a transition matrix and emit symbols; a symbol is one of the most frequent
words, the end of a text, or a class of the remaining words. A word's probability given its class
comes from counts over all training tokens, so the model covers every word. Baum-Welch's expected
counts are summed inside each partition, then over partitions; a text's likelihood is that of the
whole sequence, by the forward recursion with scaling.

``prepare`` codes the texts once: each chunk becomes a row with its distinct tokens and every
document's token numbers. Counting and looking up tokens then moves one row per distinct token of
a chunk, not one per token.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import text as tx
from strandline.llm.work import dropped, new_path, released, saved

#: Symbols with a word of their own, classes of other words, and latent states.
WORDS = 1024
CLASSES = 256
STATES = 6
ROUNDS = 6
#: Training sequences are cut into pieces of so many tokens; scoring joins the pieces again exactly.
PIECE = 128
CHUNK_BYTES = 8 << 20
#: Additive smoothing of expected counts.
ALPHA = 0.1
END = "end"

CHUNK_SCHEMA = "chunk bigint, doc_ids array<bigint>, train array<boolean>, ends array<int>, tokens array<string>, counts array<bigint>, numbers binary"


def prepare(docs: DataFrame, key: str = "doc_id", text: str = "text", train: str = "train", path: str | None = None) -> DataFrame:
    """Codes texts in chunks: per chunk its documents, distinct words, their counts in training texts, and all words' numbers.

    Words are runs of other than ASCII white space, A-Z lower-cased. A null text has no words.
    """

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        for k, part in enumerate(tx.chunks(batches, text, CHUNK_BYTES)):
            numbers, tokens, ends = tx.encoded(part.column(text), tx.NON_SPACE)
            learn = part.column(train).to_numpy(zero_copy_only=False).astype(bool)
            of_doc = np.repeat(learn, np.diff(ends, prepend=0))
            counts = np.bincount(numbers[of_doc], minlength=len(tokens))
            one = lambda v, kind: pa.array([v], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([pa.array([task + k], pa.int64()), one(part.column(key), pa.int64()), one(part.column(train), pa.bool_()), one(ends, pa.int32()), one(tokens.cast(pa.string()), pa.string()), one(counts, pa.int64()), pa.array([zstandard.compress(numbers.astype(np.int32).tobytes(), 1)], pa.binary())], names=["chunk", "doc_ids", "train", "ends", "tokens", "counts", "numbers"])

    coded = docs.select(F.col(key).cast("long").alias(key), text, F.coalesce(train, F.lit(False)).alias(train)).mapInArrow(run, CHUNK_SCHEMA)
    return saved(coded, "chunks", path)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    #: log10 likelihood of the training pieces before each round.
    likelihoods: list[float] = field(default_factory=list)


@dataclass
class Symbols:
    """What turns words into symbols: the most frequent words, and training tokens and distinct words of each class."""

    own: list[str]
    tokens: np.ndarray
    distinct: np.ndarray


def statistics(chunks: DataFrame) -> tuple[DataFrame, Symbols, dict]:
    """Each training token's count c over all training texts with its symbol; the symbols' sizes; and totals.

    A word without a symbol of its own has that of its class: words alike in their last two letters share it.
    Totals: ends (training texts), n (training tokens with ends), v (distinct ones with the end).
    """
    counted = chunks.select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).select(F.col("x.tokens").alias("token"), F.col("x.counts").alias("n")).where("n > 0")
    counted = saved(counted.groupBy("token").agg(F.sum("n").alias("c")), "counts")
    totals = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = chunks.select(F.explode("train").alias("t")).where("t").count()
    own = [r.token for r in counted.orderBy(F.desc("c"), "token").limit(WORDS).collect()]
    sizes = counted.select("c", symbol(F.col("token"), own).alias("symbol")).where(F.col("symbol") > WORDS).groupBy("symbol").agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("distinct")).collect()
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sizes:
        tokens[r["symbol"] - WORDS - 1], distinct[r["symbol"] - WORDS - 1] = r["tokens"], r["distinct"]
    return counted, Symbols(own, tokens, distinct), {"ends": ends, "n": totals["n"] + ends, "v": totals["v"] + (ends > 0)}


def symbol(token: Column, own: list[str]) -> Column:
    """A word's symbol: its rank among the words that have one, else its class after them and the end."""
    ranks = F.from_json(F.lit(json.dumps({w: i for i, w in enumerate(own)})), "map<string, int>")
    kind = F.pmod(F.crc32(F.right(token, F.lit(2))), F.lit(CLASSES)) + WORDS + 1
    return F.coalesce(F.try_element_at(ranks, token), kind).cast("int") if own else kind.cast("int")


def looked_up(chunks: DataFrame, counts: DataFrame, symbols: Symbols) -> DataFrame:
    """Chunks with, for each distinct token in order, its count and symbol (packed: count * 2048 + symbol)."""
    rows = chunks.select("chunk", F.posexplode("tokens").alias("place", "token")).join(counts, "token", "left")
    packed = F.coalesce("c", F.lit(0)) * 2048 + symbol(F.col("token"), symbols.own)
    arrays = rows.select("chunk", F.struct("place", packed.alias("v")).alias("x")).groupBy("chunk").agg(F.array_sort(F.collect_list("x"))["v"].alias("packed"))
    return chunks.select("chunk", "doc_ids", "train", "ends", "numbers").join(arrays, "chunk", "left")


def _symbols(batch: pa.RecordBatch, row: int, sizes: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: documents' token ends (each text's end counted), symbols, log10 probabilities given them, counts, and whether a token is an end."""
    cell = lambda name: batch.column(name)[row]
    numbers = np.frombuffer(zstandard.decompress(cell("numbers").as_py()), np.int32)
    ends = cell("ends").values.to_numpy().astype(np.int64)
    n_docs = len(ends)
    total = len(numbers) + n_docs
    is_end = np.zeros(total, bool)
    is_end[ends + np.arange(n_docs)] = True
    symbol, given, count = np.full(total, WORDS, np.int32), np.zeros(total), np.zeros(total, np.int64)
    if len(numbers):
        packed = cell("packed").values.to_numpy()[numbers]
        words = ~is_end
        symbol[words] = packed % 2048
        count[words] = packed // 2048
        kind = np.maximum(symbol - WORDS - 1, 0)
        given[words] = np.where(symbol < WORDS, 0.0, np.log10((count + 1) / (sizes.tokens[kind] + sizes.distinct[kind] + 1)))[words]
    return ends + np.arange(1, n_docs + 1), symbol, given, count, is_end


def _pieces(ends: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of at most PIECE tokens of the kept documents: owner, first token, length, whether it starts its document."""
    firsts = np.concatenate(([0], ends[:-1]))
    lengths = (ends - firsts) * keep
    n = -(-lengths // PIECE)
    owner = np.repeat(np.arange(len(ends)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = firsts[owner] + place * PIECE
    return owner, start, np.minimum(ends[owner] - start, PIECE), place == 0


def _grid(start: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Symbols of pieces as steps x pieces, -1 beyond a piece's end."""
    steps = np.arange(int(size.max()))[:, None]
    real = steps < size
    return np.where(real, symbol[np.minimum(start + steps, len(symbol) - 1)], -1)


def expected(model: Model, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch's expected counts over pieces x (steps x pieces): starts, moves, emissions, and the log10 likelihood.

    Pieces that don't start a document start from the states' stationary shares, their mean here.
    """
    k = len(model.start)
    emit = np.concatenate((model.emit, np.ones((k, 1))), axis=1)  # column -1: beyond the end
    steps, n = x.shape
    emit, move = emit.astype(np.float32), model.move.astype(np.float32)
    alpha, scale = np.empty((steps, k, n), np.float32), np.empty((steps, n), np.float32)
    mean = _stationary(model.move)
    state = np.where(first, model.start[:, None], mean[:, None]).astype(np.float32)
    for t in range(steps):
        a = (state if t == 0 else move.T @ alpha[t - 1]) * emit[:, x[t]]
        s = a.sum(axis=0)
        alpha[t] = a / s
        scale[t] = s
    real = x >= 0
    log = float(np.log10(np.where(real, scale, 1)).sum())
    moves = np.zeros((k, k))
    emissions = np.zeros((k, model.emit.shape[1]))
    beta = np.ones((k, n), np.float32)
    for t in range(steps - 1, -1, -1):
        gamma = alpha[t] * beta * real[t]
        gamma /= np.maximum(gamma.sum(axis=0), 1e-30)
        for i in range(k):
            emissions[i] += np.bincount(x[t][real[t]], weights=gamma[i][real[t]], minlength=emissions.shape[1])
        if t:
            ahead = beta * emit[:, x[t]] / scale[t]
            moves += (alpha[t - 1] * real[t]) @ ahead.T
            beta = move @ ahead
    starts = (gamma * first).sum(axis=1)
    return starts, moves * model.move, emissions, log


def _stationary(move: np.ndarray) -> np.ndarray:
    share = np.full(len(move), 1 / len(move))
    for _ in range(200):
        share = share @ move
    return share / share.sum()


def initial(symbols: int, states: int = STATES, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    emit = rng.gamma(1.0, size=(states, symbols)) + 0.2
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))


def fit(coded: DataFrame, sizes: Symbols, rounds: int = ROUNDS, states: int = STATES, seed: int = 7) -> Model:
    """Baum-Welch over all training documents. Each task sums its chunks' expected counts; the driver gets only their sum.

    A round moves states * (symbols + states + 1) numbers, whatever the size of the corpus.
    """
    symbols = WORDS + 1 + CLASSES
    model = initial(symbols, states, seed)
    spark = coded.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            model, total = shared.value, None
            for batch in batches:
                for row in range(batch.num_rows):
                    ends, symbol, _, _, _ = _symbols(batch, row, sizes)
                    keep = batch.column("train")[row].values.to_numpy(zero_copy_only=False).astype(bool)
                    _, start, size, first = _pieces(ends, keep)
                    by = np.argsort(size, kind="stable")
                    for at in range(0, len(by), 2048):
                        part = by[at : at + 2048]
                        found = expected(model, _grid(start[part], size[part], symbol), first[part])
                        flat = np.concatenate([np.ravel(v) for v in found])
                        total = flat if total is None else total + flat
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "v"])

        sums = coded.mapInArrow(run, "place bigint, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
        if not sums.num_rows:
            break
        flat = np.zeros(states + states * states + states * symbols + 1)
        flat[sums.column("place").to_numpy()] = sums.column("v").to_numpy()
        start, move, emit = np.split(flat[:-1], [states, states + states * states])
        norm = lambda v: (v + ALPHA) / (v + ALPHA).sum(axis=-1, keepdims=True)
        model = Model(norm(start), norm(move.reshape(states, states)), norm(emit.reshape(states, symbols)), [*model.likelihoods, float(flat[-1])])
    return model


def likelihood(model: Model, ends: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """log10 probability of each document's whole symbol sequence.

    Every piece is run from each state at once (the forward recursion is linear in its start); the pieces'
    matrices are then applied one after the other to the document's own state, which is exact.
    """
    k = len(model.start)
    emit = np.concatenate((model.emit, np.ones((k, 1))), axis=1)
    owner, start, size, _ = _pieces(ends, np.ones(len(ends), bool))
    n = len(owner)
    product, log = np.empty((n, k, k)), np.zeros(n)  # product[p, i]: states after piece p from state i
    by = np.argsort(size, kind="stable")
    for at in range(0, n, 1024):
        part = by[at : at + 1024]
        x = _grid(start[part], size[part], symbol)
        a = np.repeat(np.eye(k)[:, :, None], len(part), axis=2)  # state, origin, piece
        run = np.zeros(len(part))
        for t in range(len(x)):
            if t:
                a = (model.move.T @ a.reshape(k, -1)).reshape(k, k, -1)
            a *= emit[:, x[t]][:, None, :]
            if t % 8 == 7 or t == len(x) - 1:
                s = a.sum(axis=(0, 1))
                a /= s
                run += np.log10(s)
        # beyond a piece's end the emission is 1 and moves keep the sum over states
        product[part] = a.transpose(2, 1, 0)
        log[part] = run
    out = np.zeros(len(ends))
    np.add.at(out, owner, log)
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    counts = np.diff(np.append(firsts, n))
    state = np.repeat(model.start[None], len(ends), axis=0)
    live = np.arange(len(ends))
    j = 0
    while len(live):
        p = firsts[live] + j
        begun = state[live] if j == 0 else state[live] @ model.move
        ahead = np.einsum("ni,nij->nj", begun, product[p])
        s = ahead.sum(axis=1)
        out[live] += np.log10(s)
        state[live] = ahead / s[:, None]
        j += 1
        live = live[counts[live] > j]
    return out


SCORE_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score(coded: DataFrame, model: Model, sizes: Symbols, totals: dict) -> DataFrame:
    """For each document: tokens (words and one end), those known from training, and log10 probabilities.

    base_score is the add-one unigram's, score the hidden Markov model's.
    """
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                ends, symbol, given, count, is_end = _symbols(batch, row, sizes)
                count[is_end] = totals["ends"]
                firsts = np.concatenate(([0], ends[:-1]))
                per_doc = lambda v: np.add.reduceat(v, firsts) if len(firsts) else v
                base = np.log10((count + 1) / (totals["n"] + totals["v"] + 1))
                whole = likelihood(model, ends, symbol) + per_doc(given)
                held = pa.array(~batch.column("train")[row].values.to_numpy(zero_copy_only=False).astype(bool))
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[row].values, held, pa.array(ends - firsts), pa.array(per_doc((count > 0).astype(np.int64))), pa.array(per_doc(base)), pa.array(whole)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return coded.mapInArrow(run, SCORE_SCHEMA)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", train: str = "train", rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """Learns from the rows whose ``train`` is true and scores every row; a null text is a text without words.

    Without training rows all symbols keep their starting weights. Adds train_tokens (training tokens with ends).
    """
    spark = docs.sparkSession
    at = new_path(spark, "chunks")
    chunks = prepare(docs, key, text, train, at)
    counts, symbols, totals = statistics(chunks)
    released(spark)
    coded = saved(looked_up(chunks, counts, symbols), "coded")
    dropped(spark, at)
    released(spark)
    model = fit(coded, symbols, rounds, states)
    return score(coded, model, symbols, totals).withColumn("train_tokens", F.lit(totals["n"]).cast("long"))
