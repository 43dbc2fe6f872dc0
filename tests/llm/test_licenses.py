import re

from strandline.llm import licenses as x

TEXTS = [
    "MIT License mit license, Apache\nLicense general public license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software (the 'MIT license')",
    "licensed under the GNU General Public License, version 3 or later", None, "", "İ LİCENSE mit LICENSE", "mit license" * 3, "mit license " * 300, "plain words only", "plain words only",
    "x\x00mit_license-é mit licence BSD 3-Clause. Creative Commons Attribution ShareAlike 4.0 International license all rights reserved", "w " * 50000 + "apache license", "Copyright. All Rights Reserved",
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'c' as words", "1 as n_words", "2 as found", "3 as rule")
    got = {r.doc_id: r.asDict() for r in x.scan(df).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = x.brute_force(text)
        assert {k: got[i][k] for k in want} == want, text and text[:80]


def test_containment_and_priority(spark):
    df = spark.createDataFrame([(1, "licensed under the Apache License, Version 2.0")], "doc_id long, text string")
    r = x.scan(df).first()
    assert [(d["first"], d["after"], d["label"], d["priority"]) for d in r.detections] == [(0, 8, "apache", 4)]
    assert r.score == 1.0


def test_hundreds_of_rules_in_order_and_stems_cover_them():
    rules = x.rules()
    assert len(rules) > 300 and [r[2] for r in rules] == sorted((r[2] for r in rules), reverse=True)


def test_empty_table(spark):
    assert x.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def written(pattern, most):
    """A text that the pattern matches: optional parts left out or all taken, of alternatives the first or the last."""
    constants = re._constants

    def text(parsed):
        out = ""
        for op, value in parsed:
            if op is constants.LITERAL:
                out += chr(value)
            elif op is constants.MAX_REPEAT:
                out += text(value[2]) * (min(value[1], value[0] + 1) if most else value[0])
            elif op is constants.SUBPATTERN:
                out += text(value[3])
            elif op is constants.BRANCH:
                out += text(value[1][-1 if most else 0])
            elif op is constants.IN:
                kind, first = value[-1 if most else 0]
                out += "7" if kind is constants.CATEGORY else chr(first)
            else:
                raise AssertionError(op)
        return out

    made = text(re._parser.parse(pattern))
    assert re.fullmatch(pattern, made)
    return made


def test_every_rule_matches_a_text_made_from_its_pattern_alone(spark):
    rules = x.rules()
    texts = [written(pattern, most) for *_, pattern in rules for most in (False, True)]
    for k, t in enumerate(texts):
        assert rules[k // 2][1] in f" {t} ", (rules[k // 2], t)
        assert any(stem in f" {t} " for stem in x.STEMS), t
    got = {r.doc_id: r.asDict() for r in x.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        want = x.brute_force(t)
        assert want["labels"] and {c: got[k][c] for c in want} == want, t


def test_thousands_of_matches_in_one_text(spark):
    import time

    lines = [f"line {k} mit license and apache license version 2.0 all rights reserved" for k in range(5400)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:300]))], "doc_id long, text string")
    want = x.brute_force("\n".join(lines[:300]))
    got = x.scan(df.where("doc_id = 2")).first()
    assert all(got[k] == v for k, v in want.items())
    began = time.time()
    long = x.scan(df).where("doc_id = 1").first()
    assert time.time() - began < 20
    assert len(long.detections) == 18 * len(got.detections) >= 16_000 and long.n_base == 10_800 and long.labels == got.labels
    assert [d.first for d in long.detections[-3:]] == [d.first + 5100 * 13 for d in got.detections[-3:]]
