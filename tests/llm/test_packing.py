import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandline.llm import packing, queries, vocabularies

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.sparkContext.broadcast(vocabularies.content(PATH))


def encoded(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def sequences_hold(rows, length):
    """Offsets of every sequence have no gaps, and a sequence that isn't full needs no padding."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length and (at == length or at & (at - 1) == 0)
    return by


def test_every_id_once(spark, library, vocabulary):
    texts = [None, "", "  ", "<|endoftext|>", "a<|endoftext|> <|endoftext|>  b", "word " * 900, "héé　x 漢字🎉", *[f"line {k} of some words" * (k % 30) for k in range(150)]]
    texts += ["the same text again"] * 60
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as tokens", "'x' as ids", "2 as key").repartition(3)
    for length in (64, 2048):
        rows = packing.pack(df, vocabulary, length=length).collect()
        sequences_hold(rows, length)
        by = defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
        assert len(by) == len(texts)
        for k, t in enumerate(texts):
            parts = sorted(by[k], key=lambda r: r.start)
            want = encoded(library, t)
            assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]]
            assert b"".join(bytes(r.ids) for r in parts) == want.tobytes() and {r.doc_tokens for r in parts} == {len(want)}


def test_repeated_and_null_keys(spark, vocabulary):
    df = spark.createDataFrame([(None, "a b"), (None, "c"), (1, "d e f"), (1, "d e f"), (1, None)], "doc_id long, text string")
    rows = packing.pack(df, vocabulary).collect()
    sequences_hold(rows, 2048)
    assert sum(r.length for r in rows) == 3 + 2 + 4 + 4 + 1
    assert packing.pack(df.limit(0), vocabulary).count() == 0


def test_given_documents(spark, library, sf_dir, vocabulary):
    rows = queries.op11_hilbert_curve_packing(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    by = sequences_hold(rows, 2048)
    total = 0
    for r in rows:
        ids = encoded(library, texts[r.doc_id])
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        total += r.length
    assert total == sum(len(encoded(library, t)) for t in texts.values())
    assert len(by) >= total / 2048


def test_many_ranges_keep_each_document(spark, library, vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_BYTES", 2000)
    df = spark.createDataFrame([(k, f"text {k} " * (k % 50)) for k in range(300)], "doc_id long, text string").repartition(4)
    rows = packing.pack(df, vocabulary, length=256).collect()
    sequences_hold(rows, 256)
    assert sum(r.length for r in rows) == sum(len(encoded(library, f"text {k} " * (k % 50))) for k in range(300))
    assert len({r.sequence_id >> 40 for r in rows}) > 5


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_neighbours_are_alike(spark, vocabulary):
    topics = ["river water boat sail tide", "flour bread oven yeast salt", "engine wheel road brake fuel", "chord song piano drum bass"]
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(topics[k % 4].split(), 60))) for k in range(200)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary).where("start = 0").collect()
    order = [r.doc_id % 4 for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))]
    assert sum(a == b for a, b in zip(order, order[1:])) > 150  # 50 by chance


def test_hashed_vectors_are_unit_or_zero():
    v = packing.hashed_vectors(np.array([5, 5, 9]), np.array([2, 2, 3]))
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0, 1])
    assert pa.array(v[0]).null_count == 0
