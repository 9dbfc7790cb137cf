import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_near_copies import brute  # noqa: E402

from tessera.llm import common, decontam, language_id, line_dedup  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, DATA), name)
        made[name] = docs
    return made


def test_stages_work_on_what_came_before(spark, stages):
    order = list(stages)
    assert order == ["documents", "language_id", "line_dedup", "simhash", "decontamination", "sentencepiece"]
    for name in order[1:-1]:
        assert stages[name].columns == stages["documents"].columns
    ids = {n: {r["doc_id"] for r in f.select("doc_id").collect()} for n, f in stages.items()}
    rejected = {r["doc_id"] for r in language_id.document_report(stages["documents"]).where("not accepted").collect()}
    assert ids["language_id"] == ids["documents"] - rejected
    assert ids["line_dedup"] == ids["language_id"]
    report = {r["doc_id"]: r["kept_sha256"] for r in line_dedup.dedup_report(stages["language_id"]).collect()}
    import hashlib

    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in stages["line_dedup"].collect()} == report
    copies = {d for d, first in brute([(r["doc_id"], r["text"]) for r in stages["line_dedup"].collect()]) if d != first}
    assert ids["simhash"] == ids["line_dedup"] - copies
    leaks = {r["doc_id"] for r in decontam.find_leaks(stages["simhash"], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert ids["decontamination"] == ids["simhash"] - leaks
    assert ids["sentencepiece"] == ids["decontamination"]
    assert stages["sentencepiece"].where("not exact").count() == 0
    assert stages["line_dedup"].where("n_chars <> length(text)").count() == 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, DATA), name)
    assert docs.count() == 0


def test_rows_without_an_id_shared_ids_and_clashing_columns(spark):
    real = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en' and n_chars > 200").select("text").distinct().limit(12).collect()]
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    rows = [(i, t, "en", "s", 0, "x", "y", "z") for i, t in enumerate(real)]
    odd = [(None, real[0]), (None, "$$ 12 !!"), (3, "$$ 12 !!"), (3, leak), (None, None), (None, f"{real[1]} {leak}")]
    docs = spark.createDataFrame([*rows, *((i, t, "en", "s", 0, "x", "y", "z") for i, t in odd)], "doc_id long, text string, lang string, source string, n_chars long, ids string, n_pieces string, row_key string")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.staged(spark, lambda: stage(spark, docs, DATA), name)
    assert docs.columns[-3:] == ["ids_", "n_pieces_", "exact"]
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(len(real)))  # each clean row once, and no odd one
