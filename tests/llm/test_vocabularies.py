import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from strandline.llm import segments, vocabularies

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
POINTS = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000] + list(range(0x20000, 0x110000, 211))
TEXTS = [f"a{c}b1{c} {c}{c} x 'l{c} ;{c}" for c in map(chr, POINTS)]


def tokenized(vocabulary, texts, spaced):
    data, offsets = segments.spaced(pa.array(texts, pa.string())) if spaced else segments.tx.text_buffers(pa.array(texts, pa.string()))
    codes, distinct, ends = segments.cut(data, offsets)
    tokens = vocabulary.encode(distinct)
    ids, upto = segments.expanded(codes, ends, tokens.ids, tokens.counts)
    return [ids[i:j].tolist() for i, j in zip([0, *upto[:-1]], upto)]


@pytest.mark.parametrize("special", [True, False])
def test_byte_vocabulary_is_the_librarys_on_every_character(special):
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = not special
    texts = [*TEXTS, "<|endoftext|>", "a<|endoftext|> <|endoftext|>  b", "", " ", "a  b   c\n\n d", "tab\t x\x0b\x0c y  z", "don't I'LL we've  'tis"]
    got = tokenized(vocabularies.ByteVocabulary(vocabularies.content(A), special), texts, False)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_piece_vocabulary_is_the_librarys_on_every_character():
    library = SentencePieceProcessor(model_file=B)
    texts = [*TEXTS, "<s> x</s> <unk>", "a  b   c\n\n d", " x", "x ", "tab\t x"]
    got = tokenized(vocabularies.PieceVocabulary(vocabularies.content(B)), texts, True)
    assert [t for t, a, b in zip(texts, got, library.encode(texts), strict=True) if a != b] == []


def test_a_vocabulary_spells_its_bytes():
    for v in (vocabularies.byte_vocabulary(vocabularies.content(A), True), vocabularies.piece_vocabulary(vocabularies.content(B))):
        table, starts = v.table
        assert all(table[starts[k] : starts[k] + v.length[k]].tobytes() == v.bytes[k] for k in range(0, v.size, 997))
