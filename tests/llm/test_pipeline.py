"""Each stage against its operator's plain rules, and the stages one after the other."""

import corpus_pipeline
import __spark_entry__ as entry
from newsloom.llm import load
from tests.compare import connect, difference
from tests.llm.frames import frame, odd_rows, prose
from tests.llm.test_exact import plain
from tests.llm.test_packing import check
from tests.llm.test_simhash import plain_components, plain_print
from tests.llm.test_toxicity import labelled

import public_tokenizers
import pytest
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    toxic_rows, labels = labelled(300)
    toxic_rows, labels = [(i + 20_000, t) for i, t in toxic_rows], [(i + 20_000, q, t) for i, q, t in labels]
    near = prose(5, 600).split()
    rows = toxic_rows + odd_rows() + [(5000 + i, " ".join([*near[:300], f"w{i}", *near[300:]]), "b") for i in range(4)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs.collect())
        assert name == "best_fit_packing" or docs.columns == columns
    ids = lambda rows_: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows_)

    before, after = seen["toxicity"]
    truth = {i: t for i, _, t in labels}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert gone == {i for i, t in truth.items() if t}

    before, after = seen["exact_dedup"]
    kept = [(i, d) for i, _, _, k, d in plain([(r["doc_id"], r["text"]) for r in before]) if k]
    assert len(after) == len(kept) and {r["doc_id"] for r in after} == {i for i, _ in kept}

    before, after = seen["simhash_near_dedup"]
    low = plain_components([plain_print(r["text"]) for r in before], [r["doc_id"] for r in before])
    assert len(after) == len(set(low)) and {5001, 5002, 5003}.isdisjoint(r["doc_id"] for r in after)

    before, after = seen["mix_sources"]
    words = lambda rows_: sum(len((r["text"] or "").split()) for r in rows_)
    assert abs(words(after) - words(before)) <= 3 and ids(after) != ids(before)

    before, after = seen["best_fit_packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check(after, [(r["doc_id"], r["text"]) for r in before], tokenizer, 1024)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


REGISTERED = load()


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTERED.items() if sql))
def test_queries_with_sql(spark, name):
    build, sql = REGISTERED[name]
    assert difference(build(spark, SMALL), connect(SMALL), sql) is None


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
