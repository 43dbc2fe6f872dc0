import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from strandline.llm import alignment, vocabularies

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def vocabulary_files(spark):
    return tuple(spark.sparkContext.broadcast(vocabularies.content(p)) for p in (A, B))


def brute_force(rows, libraries):
    """(key, text) rows by the libraries on whole texts and every pair of tokens."""
    t, p = libraries
    letters = vocabularies._byte_letters()
    done, pairs = [], Counter()
    for key, text in rows:
        groups, links, n = [], [], (0, 0)
        if text:
            want = (" " + text).encode()
            ids = [t.encode(" " + text, add_special_tokens=False).ids, p.encode(text)]
            spelt = [[bytes(letters[c] for c in t.id_to_token(k)) for k in ids[0]], []]
            spelt[1] = [bytes([int(p.id_to_piece(k)[3:5], 16)]) if p.is_byte(k) else p.id_to_piece(k).replace("▁", " ").encode() for k in ids[1]]
            if all(b"".join(s) == want for s in spelt):
                n = tuple(map(len, ids))
                spans = []
                for s in spelt:
                    at, out = 0, []
                    for x in s:
                        out.append((at, at + len(x)))
                        at += len(x)
                    spans.append(out)
                begin = 0
                for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
                    sides = [[i for i, (s, e) in enumerate(spans[k]) if begin <= s and e <= end] for k in (0, 1)]
                    groups.append("|".join(",".join(str(ids[k][i]) for i in sides[k]) for k in (0, 1)))
                    links += [(ids[0][i], ids[1][j]) for i in sides[0] for j in sides[1] if spans[0][i][0] < spans[1][j][1] and spans[1][j][0] < spans[0][i][1]]
                    begin = end
        pairs.update(links)
        done.append((key, n, groups, links))
    most = Counter()
    for (_, b), c in pairs.items():
        most[b] = max(most[b], c)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(
        (str(key), *n, len(groups), len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links), digest(groups))
        for key, n, groups, links in done
    )


def texts():
    rng = random.Random(3)
    fixed = [None, "", " ", "  ", "a", " a", "a ", "<|endoftext|> <s> x</s>", "under▁line", "a\x00b\tc\n\n d　e", "é ́x 漢字 🎉🎉 ﬁ", "don't I'LL unbelievably antidisestablishmentarianism", "x" * 3000]
    parts = ["th", "e", "in", "g", " ", " ", "an", "qu", "ou", ",", "\n", "é", "漢", "🎉", "12", "'s", "▁", " ", "pre", "ation"]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(150)] + ["the same words again"] * 3


@pytest.mark.parametrize("hot_share", [alignment.HOT_SHARE, 0.01, 2.0])
def test_equals_brute_force(spark, libraries, vocabulary_files, hot_share):
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_a", "'x' as pairs").repartition(3)
    got = alignment.report(df, *vocabulary_files, hot_share=hot_share).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == brute_force(rows, libraries)


def test_given_documents(spark, libraries, vocabulary_files, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 2500")
    got = alignment.report(df, *vocabulary_files).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == brute_force([(r.doc_id, r.text) for r in df.collect()], libraries)


def test_groups_are_given_whole(spark, libraries, vocabulary_files):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "k int, text string").selectExpr("*", "0 as a_ids")
    out = alignment.align(df, *vocabulary_files)
    assert out.columns == ["k", "text", "a_ids", "b_ids", "a_ends", "b_ends"]
    for r in out.collect():
        cut = lambda ids, ends: [ids[i:j] for i, j in zip([0, *ends], ends)]
        groups = [",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(cut(r.a_ids, r.a_ends), cut(r.b_ids, r.b_ends), strict=True)]
        want = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        assert want == brute_force([(r.k, r.text)], libraries)[0][-1]
    assert alignment.align(df.limit(0), *vocabulary_files).count() == 0
    assert alignment.report(df.limit(0), *vocabulary_files, key="k").count() == 0
