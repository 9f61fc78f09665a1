import corpus_pipeline as cp

WORDS = "river stone garden window market bridge summer winter letter music paper silver".split()


def text(i, n=40):
    return " ".join(WORDS[(i * 7 + k * (i % 5 + 1) + k * k % 11) % 12] + str((i * 31 + k) % 97) for k in range(n)) + "."


def test_stages_on_a_small_folder(spark, tmp_path):
    docs = [(i, text(i), "en", f"s{i % 3}", 100) for i in range(60)]
    docs += [(100 + i, text(i) + " nastyword", "en", "s0", 100) for i in range(60, 90)]
    docs += [(200, text(1), "en", "s0", 100), (201, text(1), "en", "s0", 100), (300, "Intro here. " + text(777), "en", "s1", 100), (301, text(900) + " Write to a.b@mail.example.com now.", "en", "s1", 100)]
    docs += [(None, "a row without an id", None, None, None), (302, None, "en", "s0", None), (303, "", None, "s0", 0)]
    labels = [(r[0], 1 if r[0] % 2 else 0, int("nastyword" in r[1])) for r in docs if r[0] is not None and r[1]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text(777))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, rows, str(tmp_path))
        if name != "mixing":
            assert out.columns == rows.columns
        out.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in rows.collect()}
    ids = set(kept["toxicity"])
    assert not ids & set(range(160, 190)) and set(range(60)) <= ids and {None, 302, 303} <= ids
    assert {1} == set(kept["near_duplicates"]) & {1, 200, 201} and {None, 302, 303} <= set(kept["near_duplicates"])
    assert 300 not in kept["decontamination"] and set(range(60)) <= set(kept["decontamination"])
    assert "a.b@mail" not in kept["pii"][301]["text"] and kept["pii"][301]["n_chars"] == len(kept["pii"][301]["text"]) and kept["pii"][302]["text"] is None
    assert all(r["copies"] > 0 for r in kept["mixing"].values())


def test_stages_on_empty_tables(spark, tmp_path):
    schema = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, s in schema.items():
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_with_columns_of_any_type(spark):
    rows = [(1, text(1), {"a": 1}), (1, text(1), {"a": 2}), (2, text(1), None), (3, text(5), {}), (None, None, {"b": 1})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    got = cp.drop_near_duplicates(spark, docs, "")
    assert got.dtypes == docs.dtypes and sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "None"]
