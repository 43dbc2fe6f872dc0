import corpus_pipeline
from strandline.llm.work import new_path, saved


def test_stages_on_the_small_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, sf_dir), name, new_path(spark, name))
        assert out.count() <= before
        if name != "bpe":
            assert out.columns == columns
        docs, before = out, out.count()
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and before


def test_stages_on_odd_rows(spark, sf_dir):
    passage = "\n".join(f"line {k} of a passage" for k in range(8))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, passage, "en", "s", 9), (4, passage, "en", None, 9), (5, "!!! 12", "en", "s", 6), (None, "no key here at all", "en", "s", 5), (6, "Ein Satz", "de", "s", 8), (6, "Ein Satz", "de", "s", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf_dir), name, new_path(spark, name))
        keys = sorted(r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None)
        if name == "language_id":
            assert keys == [3, 4, 6, 6]
        if name == "near_duplicates":
            assert keys == [3, 6] or keys == [3, 4, 6]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0


def test_different_texts_of_one_key_stay_and_null_keys_are_judged(spark, sf_dir):
    one, two, three = (" ".join(f"{w}{k}" for k in range(30)) for w in ("red", "green", "blue"))
    rows = [(7, one), (7, two), (7, two), (None, one), (None, three), (None, three), (9, two), (4, "a text apart from others")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(7, one), (7, two), (None, three), (4, "a text apart from others")], key=str)


def test_entry_names_every_operator():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
