import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(1)
    out = ["", "  ", None, "aaaa aaaaaaaaa bbb'sa I'LL don't <|endoftext|>x<|endoftext|><|startoftext|> y", "<|endoftext|>", "ΣΑΣ İstanbul ﬁ é ́x a b　c\x1cd\x85e", "12345 ½ ² ٣ 漢字 🎉🎉!!!???", "word " * 30000]
    out += ["".join(rng.choice("ab'sSdTé ́ !1漢🎉<|>") for _ in range(60)) for _ in range(400)]
    out += ["".join(rng.choice(["th", "e", "in", "g", " ", "an", "qu", "ou", ","]) for _ in range(80)) for _ in range(400)]
    return out


def test_equals_the_library(spark, library):
    rows = [(k, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").selectExpr("*", "'x' as ids", "'y' as decoded", "1 as tokens")
    vocabulary = spark.sparkContext.broadcast(bpe.vocabulary_bytes(PATH))
    got = bpe.decode(bpe.encode(df, vocabulary), vocabulary)
    assert got.columns == ["doc_id", "text", "tokens", "ids", "decoded"]
    for r in got.collect():
        want = library.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), vocabulary).count() == 0


def test_decoding_odd_ids(spark):
    vocabulary = spark.sparkContext.broadcast(bpe.vocabulary_bytes(PATH))
    df = spark.createDataFrame([(1, None), (2, []), (3, [49407, -1, 10**6, 320])], "k int, ids array<int>")
    assert [r.decoded for r in bpe.decode(df, vocabulary).orderBy("k").collect()] == ["", "", "<|endoftext|> a</w>"]


def test_every_class_of_characters_is_the_librarys(library):
    v = bpe.Vocabulary(bpe.vocabulary_bytes(PATH))
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000] + [*range(0x2B700, 0x2D000), *range(0x32300, 0x33500), *range(0x3D000, 0x110000, 97)]
    texts = ["a" + chr(c) + "b1" for c in points]
    got = bpe.encode_texts(v, pa.array(texts, pa.string()))
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [hex(c) for c, a, b in zip(points, got, want, strict=True) if a.as_py() != b.ids] == []
