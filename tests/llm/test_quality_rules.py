import re
from collections import Counter

import duckdb

from tessera.llm import quality_rules as Q
from tessera.llm import sql


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_measures(sample, edge_docs):
    for docs in (sample, edge_docs.filter("doc_id <> 12 OR doc_id IS NULL")):
        rows = Q.measure(docs)
        for r in rows.collect():
            assert tuple(r[c] for c in COLUMNS) == brute(r.text), r.doc_id


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    rows = Q.op7_line_first_cleaning(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, con.execute(sql.OP7).df()[rows.columns].values.tolist()))


GOOD = [" ".join(f"word{i}{c}" for c in "abcdefghijkl") + "." for i in range(6)]


def test_lines(spark):
    junk = ["Home | About | News | Contact", "Accept all cookies to continue with this page.", "Menu", "#$%& ### *** && %%", GOOD[0], "BUY!! NOW!! OR!! NEVER!!"]
    docs = spark.createDataFrame([(1, "\n".join(GOOD + junk)), (2, "\n".join(GOOD)), (3, "\n".join(GOOD[:4] + ["Menu | Home | News | Contact | " + "more " * 60] * 3))], "doc_id long, text string")
    rows = {r.doc_id: r for r in Q.clean_lines(docs).collect()}
    assert rows[1].clean_text == rows[2].clean_text == "\n".join(GOOD)
    assert rows[1].kept and rows[2].kept
    assert not rows[3].kept and not Q.clean_lines(docs, max_loss=0.05).filter("doc_id = 1").first().kept


def test_clean_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1 AND toxic = 0")
    rows = Q.op7_line_first_cleaning(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("NOT base_failed").collect()
    assert len(rows) > 100 and sum(r.kept for r in rows) >= 0.99 * len(rows)


def test_no_python(sample):
    plan = Q.clean_lines(sample)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_edges(edge_docs, no_docs):
    rows = {r.doc_id: r for r in Q.clean_lines(edge_docs).collect()}
    assert (rows[1].n_words, rows[1].kept, rows[2].kept) == (0, False, False)
    assert rows[13].base_failed and rows[9].n_words > 25_000
    assert Q.clean_lines(edge_docs).count() == edge_docs.count() and Q.clean_lines(no_docs).count() == 0
