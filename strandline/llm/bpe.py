"""Byte-pair encoding by a pair occurrence index, and decoding.

A partition's distinct words are laid out as one array of symbols. An index maps every mergeable
pair to the positions where it stands; the active pair of the lowest rank is taken, all its
occurrences are merged at once, and the index is updated for the neighbours of each merge. Ranks
are taken in ascending order, so every word sees its merges in the order of single-word encoding.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandline.llm import text as tx

# Code points that the regex module counts as letters or numbers and the tokenizers library doesn't yet.
_UNKNOWN = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9"
    r"\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    r"\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
# Lower case of letters that the library knows and Python's tables don't yet.
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: The vocabulary's pre-tokenization pattern, as its file states it, with the library's idea of letters and numbers.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_UNKNOWN}]]+|[\p{{N}}--[{_UNKNOWN}]]|[[^\s\p{{L}}\p{{N}}]||[{_UNKNOWN}]]+", regex.V1)
WORD_END = "</w>"
#: Bytes of text whose words share one pair index; larger chunks repeat fewer merges.
CHUNK_BYTES = 4 << 20


def byte_chars() -> list[str]:
    """Byte-level alphabets print a byte as itself if it is visible Latin-1, else as the next character from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tables of a word-end BPE vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, content: bytes):
        file = json.loads(content)
        ids = file["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.texts = pa.array(self.tokens, pa.string())
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        chars = byte_chars()
        self.inner = np.array([ids[c] for c in chars], np.int32)
        self.last = np.array([ids[c + WORD_END] for c in chars], np.int32)
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in file["model"]["merges"]]
        self.merges = merges
        keys = np.array([a << 32 | b for a, b, _ in merges], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        made: dict[int, int] = {}
        for rank, (_, _, c) in enumerate(merges):
            made.setdefault(c, rank)
        if any(made.get(x, -1) >= rank for rank, (a, b, _) in enumerate(merges) for x in (a, b)):
            raise ValueError("a merge stands before the merges that make its parts")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def normal(self, word: str) -> str:
        if word.isascii():
            return word.lower()
        return "".join(c.lower() for c in unicodedata.normalize("NFC", word)).translate(_LOWER)

    def pieces(self, word: str) -> list[str | int]:
        """A word's pre-tokens, special tokens as their id."""
        if self.split is None or "<|" not in word and not self.split.search(word):
            return WORDS.findall(self.normal(word))
        out: list[str | int] = []
        for part in self.split.split(word):
            out += [self.special[part]] if part in self.special else WORDS.findall(self.normal(part))
        return out

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) pre-tokens, and how many each has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        n = len(symbol)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends - lengths] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank = self.ranks(symbol[at], symbol[after[at]])
            known = rank >= 0
            at, rank = at[known], rank[known]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            first = rank[np.concatenate(([0], cuts))].tolist()
            for r, positions in zip(first, np.split(at, cuts) if len(cuts) else [at], strict=True):
                if r in index:
                    index[r].append(positions)
                else:
                    index[r] = [positions]
                    heapq.heappush(active, r)

        add(np.arange(n, dtype=np.int32))
        while active:
            rank = heapq.heappop(active)
            a, b, c = self.merges[rank]
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            right = after[at]
            valid = alive[at] & (right >= 0) & (symbol[at] == a) & (symbol[right] == b)
            if not valid.all():
                at, right = at[valid], right[valid]
            if a == b and len(at) > 1:  # of a run of one symbol, every second pair
                new_run = np.concatenate(([True], at[1:] != right[:-1]))
                start = np.flatnonzero(new_run)
                odd = (np.arange(len(at)) - start[np.cumsum(new_run) - 1]) % 2 == 1
                at, right = at[~odd], right[~odd]
            if not len(at):
                continue
            symbol[at] = c
            alive[right] = False
            following = after[right]
            after[at] = following
            has = following >= 0
            before[following[has]] = at[has]
            previous = before[at]
            add(np.unique(np.concatenate((at[has], previous[previous >= 0]))))
        counts = np.add.reduceat(alive.astype(np.int64), ends - lengths) if n else np.zeros(0, np.int64)
        return symbol[alive], counts

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has; words hold no ASCII white space."""
        number: dict[str | int, int] = {}
        counts, flat = [], []
        for word in words:
            pieces = self.pieces(word)
            counts.append(len(pieces))
            flat += [number.setdefault(p, len(number)) for p in pieces]
        plain = [(p.encode(), i) for p, i in number.items() if isinstance(p, str)]
        ids, per_piece = self.merged([p for p, _ in plain]) if plain else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        length = np.ones(len(number), np.int64)
        start = np.zeros(len(number), np.int64)
        own = np.array([i for _, i in plain], np.int64)
        length[own] = per_piece
        start[own] = np.cumsum(per_piece) - per_piece
        special = [(p, i) for p, i in number.items() if isinstance(p, int)]
        for k, (_, i) in enumerate(special):
            start[i] = len(ids) + k
        ids = np.concatenate((ids, np.array([p for p, _ in special], np.int32)))
        flat = np.array(flat, np.int64)
        counts = np.array(counts, np.int64)
        total = np.concatenate(([0], np.cumsum(length[flat])))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        return ids[tx.ragged(start[flat], length[flat])], np.diff(total[bounds])


@functools.lru_cache(maxsize=4)
def _vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def vocabulary_bytes(path: str) -> bytes:
    """A vocabulary file's bytes, read by the driver; files of this kind are a few MB."""
    with open(path, "rb") as f:
        return f.read()


def encode_texts(vocabulary: Vocabulary, texts: pa.Array) -> pa.ListArray:
    """The ids of each text of an Arrow array; a null has none."""
    numbers, distinct, ends = tx.encoded(texts, tx.NON_SPACE, lower=False)
    ids, counts = vocabulary.encoded([x.decode("utf-8", "replace") for x in distinct.to_pylist()])
    starts = np.cumsum(counts) - counts
    per_word = counts[numbers]
    flat = ids[tx.ragged(starts[numbers], per_word)] if len(numbers) else np.zeros(0, np.int32)
    total = np.concatenate(([0], np.cumsum(per_word)))
    offsets = total[np.concatenate(([0], ends))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def decode_ids(vocabulary: Vocabulary, lists: pa.ListArray) -> pa.Array:
    """The text of each list of ids of an Arrow array."""
    if lists.null_count:
        lists = lists.fill_null([])
    tokens = vocabulary.texts
    flat = lists.flatten()
    keep = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))).fill_null(False)
    bounds = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
    if pc.sum(keep).as_py() not in (len(flat), None):
        bounds = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False))))[bounds]
        flat = flat.filter(keep)
    parts = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), tokens.take(flat))
    return pc.binary_join(parts, " ")


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [x for x in batch.schema.names if x != name]
    return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), column], names=[*names, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, vocabulary: Broadcast, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds each whole text's token ids (array of int), as the vocabulary's library encodes without added special tokens.

    vocabulary: a broadcast of the file's bytes. Null and empty texts, and texts of white space only,
    get an empty array. A column that has the new one's name is replaced.
    """

    def run(batches):
        v = _vocabulary(vocabulary.value)
        for part in tx.chunks(batches, text, CHUNK_BYTES):
            yield _with(part, ids, encode_texts(v, part.column(text)))

    return df.mapInArrow(run, _schema(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, vocabulary: Broadcast, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of token ids: the tokens joined by one space, special ones kept, as a file without decoder is decoded.

    Ids beyond the vocabulary are skipped; null ids give an empty text.
    """

    def run(batches):
        v = _vocabulary(vocabulary.value)
        for batch in batches:
            yield _with(batch, decoded, decode_ids(v, batch.column(ids)))

    return df.mapInArrow(run, _schema(df, decoded, T.StringType()))


def round_trip(df: DataFrame, vocabulary: Broadcast, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both at once, by one Python worker a task: each text's ids, and the text decoded from them. The text itself is left out."""
    fields = [f for f in df.schema.fields if f.name not in (text, ids, decoded)]
    out = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches):
        v = _vocabulary(vocabulary.value)
        for part in tx.chunks(batches, text, CHUNK_BYTES):
            coded = encode_texts(v, part.column(text))
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), coded, decode_ids(v, coded)], names=out.names)

    return df.mapInArrow(run, out)
