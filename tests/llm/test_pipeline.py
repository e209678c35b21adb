import duckdb
import pytest

import corpus_pipeline
from tessera.llm import jaccard_join, pii, sql

from .test_jaccard_join import brute
from .test_packing import check

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before the first stage and after each."""
    folder, docs, found = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{D}/documents.parquet"), []
    found.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        found.append(docs)
    return found


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_language(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
    assert sum(after[i].lang == before[i].lang for i in after) >= 0.97 * len(after)


def test_near_duplicates(stages):
    before, after = rows(stages[1]), rows(stages[2])
    found = brute({i: r.text for i, r in before.items()}, jaccard_join.Rule(5, 80, 100))
    assert set(after) == {i for i, (_, c) in found.items() if c == i}


def test_decontamination(spark, stages):
    before, after = rows(stages[2]), rows(stages[3])
    con = duckdb.connect()
    con.register("given", stages[2].toPandas())
    con.execute(f"create view documents as select * from given; create view benchmark as select * from '{D}/benchmark.parquet'")
    leaks = {r[0] for r in con.execute(sql.OP1).fetchall()}
    assert leaks and set(after) == set(before) - leaks


def test_personal_data(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(after) == set(before)
    assert not any(pii.base_spans(r.text) for r in after.values())
    for i, r in before.items():
        if not any(c.isdigit() or c == "@" for c in r.text):
            assert after[i].text == r.text
        assert after[i].n_chars == len(after[i].text)


def test_packing(stages):
    check([r.asDict() for r in stages[5].collect()], {r.doc_id: r.text for r in stages[4].collect()})


def test_run_is_the_stages_in_order(spark, stages):
    digest = lambda df: sorted((r.doc_id, r.piece, bytes(r.ids)) for r in df.collect())
    assert digest(corpus_pipeline.run(spark, D)) == digest(stages[5])


def test_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, D)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, D).count() >= docs.count()
    kept = corpus_pipeline.personal_data(spark, edge_docs, D)
    assert kept.select("spans", "score").distinct().collect()[0] == (1, "s")


def test_texts_of_thousands_of_letters_and_no_languages(spark, edge_docs):
    texts = ["".join(chr(0x4E00 + (i * 7919 + k * k * 31) % 20_000) for k in range(400)) for i in range(40)]
    rows = [(100 + i, t, "zh" if i % 2 else None, None, len(t), "k", "s", 3, "h", "t", "p", 1, "q", "b") for i, t in enumerate([*texts, texts[0]])]
    docs = edge_docs.union(spark.createDataFrame(rows, edge_docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, D)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert set(range(100, 140)) <= ids and (140 in ids) == (name == "language_identification"), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D).select("doc_id").distinct().count()
    assert packed == docs.select("doc_id").distinct().count()
    none = edge_docs.selectExpr(*("CAST(NULL AS string) AS lang" if c == "lang" else c for c in edge_docs.columns))
    assert corpus_pipeline.language_identification(spark, none, D).count() == none.count()
