import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_minhash_dedup import brute
from tracklake.llm.mixing import mix_sources
from tracklake.llm.toxicity import fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.001"


def test_against_plain_python(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in score_toxicity(docs, fit_toxicity(docs, labels)).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\v\f\r"), []).append((-len(t or ""), i))
    texts = dict(rows)
    exact = {min(g)[1] for g in groups.values()}
    parts = brute([(i, texts[i]) for i in sorted(exact)], 5, 80)
    want = {i for i, (_, component) in parts.items() if i == component}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {g.doc_id for g in got} == want and toxic
    assert all(sum(g.length for g in got if g.doc_id == i) == next(g.doc_tokens for g in got if g.doc_id == i) for i in want)


def test_mixing_orders_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.mixing(spark, docs, SF)
    assert out.columns == docs.columns
    out.write.parquet(str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m")).select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    want = [r.doc_id for r in mix_sources(docs.select("doc_id", "source")).orderBy("position").collect()]
    assert [r.doc_id for r in back] == want


def test_stages_take_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here and there now", None, "b", 1), (3, "x" * 300_000, "en", "a", 1), (4, "a b c d e f g", "en", None, 1), (4, "a b c d e f g", "en", None, 1), (5, "a b  c d e f g", "en", "a", 1)]
    for n, own in enumerate((rows, [])):
        docs = spark.createDataFrame(own, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{n}-{k}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            if k == 1:
                assert sorted((r.doc_id or 0) for r in docs.collect()) == ([0, 1, 3, 5] if own else [])
        assert docs.select(F.count_distinct("sequence_id")).first()[0] == (docs.count() and docs.select("sequence_id").distinct().count())
        assert {r.doc_id for r in docs.collect()} == ({None, 1, 3, 5} if own else set())
