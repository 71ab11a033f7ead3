import corpus_pipeline
import __spark_entry__ as contract
from plumbgauge.llm import queries
from tests.llm.conftest import documents

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = {"pipeline", *queries.queries()}
    assert {n.split("_")[0] for n in names} == {"pipeline", *(f"op{i}" for i in range(1, 14))} and names <= set(contract.queries())


def test_stages_of_the_run_equal_those_applied_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        got = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert got <= ids and (name != "line dedup" or len(got) > 0.9 * len(ids))
        ids = got
        counts.append(docs.count())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    rows = packed.drop("sequence_id", "offset")
    again = corpus_pipeline.run(spark, FOLDER).drop("sequence_id", "offset")
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, again.collect()))


def test_odd_rows_pass_every_stage(spark):
    for docs in (documents(spark), documents(spark).where("doc_id = -1")):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, FOLDER)
            assert name == "packing" or out.columns == docs.columns
            out.count()
        assert corpus_pipeline.classifier_stage(spark, docs, FOLDER).columns == docs.columns
