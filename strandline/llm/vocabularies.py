"""Two public vocabularies applied to the distinct segments of a chunk of texts: byte-level BPE and BPE pieces with byte fallback."""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from public_tokenizers import PATTERN

from strandline.llm.text import ragged

#: A space and characters of which none is white space or a control: alone or joined, such segments are tokenized alike.
_PLAIN = r"^ [^\pZ\pC]+$"
#: The part of the pattern that only matters where white space is longer than one space.
_LOOK_AHEAD = r"|\s+(?!\S)"


@dataclass
class Tokens:
    """Ids of distinct segments one after the other, and the number of each segment's."""

    ids: np.ndarray
    counts: np.ndarray


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printed, else one beyond U+00FF in turn."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printed}
    letters |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}
    return letters


class _Spelling:
    """A vocabulary whose ids stand for bytes."""

    bytes: list[bytes]

    @functools.cached_property
    def length(self) -> np.ndarray:
        return np.array([len(b) for b in self.bytes], np.int64)

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids' bytes in a row, and where each one's start."""
        return np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.length) - self.length


class ByteVocabulary(_Spelling):
    """Byte-level BPE from a file of the tokenizers library (content); added tokens are cut out of texts first if ``special``."""

    def __init__(self, content: bytes, special: bool) -> None:
        described = json.loads(content)
        letters = _byte_letters()
        added = {t["content"]: t["id"] for t in described["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): k for token, k in described["model"]["vocab"].items() if token not in added}
        self.added = added if special else {}
        made = functools.partial(tiktoken.Encoding, mergeable_ranks=ranks, special_tokens=self.added)
        self.whole = made("whole", pat_str=PATTERN)
        self.plain = made("plain", pat_str=PATTERN.replace(_LOOK_AHEAD, ""))
        self.size = max([*ranks.values(), *added.values()]) + 1
        self.bytes = [b""] * self.size
        for token, k in [*ranks.items(), *((t.encode(), k) for t, k in self.added.items())]:
            self.bytes[k] = token
        names = [re.escape(t) for t in self.added]
        self.apart = "|".join(names) if names else None

    def encode(self, segments: pa.StringArray) -> Tokens:
        """Segments that hold a space and plain characters are joined and tokenized at once: their tokens end where they end."""
        plain = pc.match_substring_regex(segments, _PLAIN)
        if self.apart:
            plain = pc.and_not(plain, pc.match_substring_regex(segments, self.apart))
        is_plain = plain.to_numpy(zero_copy_only=False)
        ids: list[np.ndarray] = []
        counts = np.zeros(len(segments), np.int64)
        if is_plain.any():
            joined, offsets = buffers(segments.filter(plain))
            found = self.plain.encode_to_numpy(joined.tobytes().decode(), disallowed_special=()).astype(np.int32)
            ends = np.searchsorted(np.cumsum(self.length[found]), offsets[1:]) + 1
            counts[is_plain] = np.diff(np.concatenate(([0], ends)))
            ids.append(found)
        rest = [self.whole.encode(s, allowed_special=set(self.added), disallowed_special=()) for s in segments.filter(pc.invert(plain)).to_pylist()]
        counts[~is_plain] = [len(x) for x in rest]
        ids.append(np.array([k for x in rest for k in x], np.int32))
        return Tokens(*_in_order(np.concatenate(ids), counts, is_plain))


class PieceVocabulary(_Spelling):
    """BPE pieces with byte fallback from a sentencepiece model (content). Texts get a leading space by the library.

    No piece may hold a space after another character: segments are then tokenized as in the whole text.
    """

    def __init__(self, content: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(k) for k in range(n)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of this model spans words")
        self.size = n
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]

    def encode(self, segments: pa.StringArray) -> Tokens:
        """segments: each starts with the space that the library puts before it."""
        found = self.library.encode([s[1:] for s in segments.to_pylist()], num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return Tokens(np.array([k for x in found for k in x], np.int32), counts)


def buffers(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts in a row, and each one's bounds in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _in_order(ids: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids given as those of the segments marked first, then of the others, put in the order of all segments."""
    order = np.concatenate((np.flatnonzero(first), np.flatnonzero(~first)))
    stands = np.empty(len(counts), np.int64)
    moved = counts[order]
    stands[order] = np.cumsum(moved) - moved
    return ids[ragged(stands, counts)], counts


@functools.lru_cache(maxsize=2)
def byte_vocabulary(content: bytes, special: bool) -> ByteVocabulary:
    return ByteVocabulary(content, special)


@functools.lru_cache(maxsize=2)
def piece_vocabulary(content: bytes) -> PieceVocabulary:
    return PieceVocabulary(content)


def content(path: str) -> bytes:
    """A vocabulary file's bytes, read by the driver; files of this kind are a few MB."""
    with open(path, "rb") as f:
        return f.read()
