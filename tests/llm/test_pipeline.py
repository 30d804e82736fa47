"""The pipeline's stages one after the other, and what the registered queries promise."""

import pytest

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, count = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            docs = out
        count.append(out.count())
    assert count[1] <= count[0] and count[2] < count[1] and count[3] <= count[2] and count[5] == count[4] > 0
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0")
    before = spark.read.parquet(str(tmp_path / "2")).join(clean, "doc_id", "left_semi")
    after = spark.read.parquet(str(tmp_path / "3")).join(clean, "doc_id", "left_semi")
    assert after.select("doc_id").distinct().count() >= 0.97 * before.count()


@pytest.mark.parametrize("name", ["op2_language_id"])
def test_held_out_accuracy(spark, name):
    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = got.join(docs, "doc_id").where("held_out")
    assert joined.where("lang_pred = lang").count() >= 0.97 * joined.count() > 0


def test_stages_of_odd_documents(spark):
    """Nulls, empty and repeated rows, rows that share a doc_id, extra columns with names that operators use; and no rows."""
    fill = " ".join(f"word{i}" for i in range(40))
    rows = [(1, fill, "en", "s", 1, "x"), (1, fill, "en", "s", 1, "x"), (2, fill, None, None, None, None), (3, None, "en", "s", 0, None), (4, "", "en", "s", 0, "y"), (None, fill + " more", "en", "s", 9, "z"), (5, "!!! 12", "en", "s", 6, None), (5, fill.upper(), "en", "t", 3, "q")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= max(1, len(data)), name
            known = {tuple(r) for r in docs.collect()}
            assert all(tuple(r) in known for r in out.collect()), name  # rows stay as they are
        distinct = [tuple(r) for r in corpus_pipeline.distinct_texts(spark, docs, SF).collect()]
        assert len(distinct) == len({r[1] or "" for r in data})
        ids = corpus_pipeline.token_ids(spark, docs, SF).collect()
        assert len(ids) == len(data) and all((r["n_tokens"] == 0) == (r["doc_id"] in (3, 4)) for r in ids)
    assert not {3, 4} & {r["doc_id"] for r in corpus_pipeline.known_language(spark, spark.createDataFrame(rows, schema), SF).collect()}
