"""Registered queries against their SQL on documents that the small tables do not have."""

import duckdb
import pytest

from vellum.plans import all_oracles, all_queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def agrees(spark, tmp_path):
    def run(name, texts):
        rows = [(2 + 3 * i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        cur = con.execute(all_oracles()[name])
        names = [d[0] for d in cur.description]
        want = sorted([str(r[names.index(c)]) for c in sorted(names)] for r in cur.fetchall())
        df = all_queries()[name](spark, str(tmp_path))
        assert sorted([str(r[c]) for c in sorted(df.columns)] for r in df.collect()) == want
        return want

    return run


def test_summary_of_quoted_texts(agrees):
    agrees("clean_summary", ['token = "a"', "'it' is", " \n\"'b \n", "", "   ", '"', "\t c\t", "\x01\"d", "e\nf  ", "g\x01", " h "])


def test_notes_with_several_h1(agrees):
    """Texts that bring h1 headings of their own, before and after the first deeper section."""
    long = "word " * 400
    texts = ["# two\n" + long * 3, long * 3 + "\n# last\n" + long, "short", long + "\n## a\n" + long + "\n# b\n" + long + "\n### c\n" + long]
    rows = agrees("flatten_title_section", texts)
    notes = [r[1] for r in rows if "(intro)" in r]
    assert len(notes) > len(set(notes))  # a note with two intros
