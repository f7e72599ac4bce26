"""The pipeline's stages, each on its own input."""

import corpus_pipeline as pipeline
from panelmill.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_on_given_documents(spark):
    docs, columns = table(spark, SF, "documents"), table(spark, SF, "documents").columns
    for name, stage in pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF))
        assert out.columns == columns, name
        before, after = ({r[0] for r in d.select("doc_id").collect()} for d in (docs, out))
        assert after and after <= before
        docs = out
    packed = pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == after
    assert all(r["offset"] + r["length"] <= 2048 for r in packed)


def test_odd_rows(spark):
    clean = [" ".join(f"{w}{i}{k}" for k, w in enumerate(["sun", "sea", "road"] * 30)) for i in range(6)]
    rows = [(i, t, "en", "s", len(t), True, "k") for i, t in enumerate(clean)]
    rows += [rows[2], (100, clean[3] + " end", "en", "s", 1, None, None), (None, clean[4] + " x", None, None, None, None, None), (101, None, "en", "s", 0, True, "k"), (102, "", None, None, 0, True, "k"), (103, "call +1 (017) 555-7713 " + clean[5][9:], "en", None, 5, True, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _row string")
    stages = dict(pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, SF)
    ids = sorted((r["doc_id"] for r in good.collect()), key=str)
    assert ids == sorted([0, 1, 2, 2, 3, 4, 5, 100, 103, None], key=str) and good.columns == docs.columns
    near = stages["near_duplicates"](spark, docs, SF).collect()
    assert sorted((r["doc_id"] for r in near), key=str) == sorted([0, 1, 2, 3, 4, 5, 101, 102, None], key=str)
    safe = {r["doc_id"]: r for r in stages["personal_data"](spark, docs, SF).collect()}
    assert "555-7713" not in safe[103]["text"] and safe[0]["text"] == clean[0] and safe[101]["text"] is None and safe[0]["_row"] == "k"
    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns and not {101, 102} & {r["doc_id"] for r in mixed.collect()}
    assert stages["packing"](spark, docs, SF).count() >= len(rows)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
