"""What keeps the work in proportion to the input: where scores are made, how far texts are searched, what a batch or a state holds."""

import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import enrich, ranking

TEXTS = ["alpha beta beta", "gamma", "", "alpha " * 70 + "beta", "x y", "Delta, alpha; BETA"]


@pytest.fixture
def tables(spark):
    asked = spark.createDataFrame([(i, q, "v" if i % 2 else "w") for i, q in enumerate(["alpha beta beta", "zz", "gamma delta", "a", "beta"])], "query_id long, query string, vault string")
    texts = spark.createDataFrame([("vw"[i % 2], f"n{i}", t) for i, t in enumerate(TEXTS)] + [("u", "n9", "beta")], "vault string, node_id string, text string")
    return asked, texts


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_scores_are_made_where_the_text_lies(spark, tables, monkeypatch):
    asked, texts = tables
    got = ranking.bm25_score(asked, texts, ["vault", "node_id"])
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ranking, "MOST_TOKENS", 0)
    assert rows(got) == rows(ranking.bm25_score(asked, texts, ["vault", "node_id"]))


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_candidates_by_scope(spark, tables, monkeypatch, cells):
    asked, texts = tables
    places = texts.select("vault", "node_id", F.regexp_extract("node_id", r"\d+", 0).cast("long").alias("position"))
    monkeypatch.setattr(ranking, "CELLS", cells)
    got = rows(ranking.rank_scoped(asked, texts, ["vault", "node_id"], "vault", places))
    assert len(got) == 15
    assert got == rows(ranking.rank_candidates(asked.drop("vault"), texts.join(asked.select("query_id", "vault"), "vault").join(places, ["vault", "node_id"]), ["vault", "node_id"]))


def test_first_line_is_found_without_cutting_all_lines(spark):
    texts = ["# a\n\n \t b \r\nc", "\n\n#x\x1c y\x1d#z", "", " \x85#q", "one", " \x0b two", "x" * 200, "y" * 159 + "  z", "#\n \x1c"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(tx.fallback_summary(F.col("t"))).collect()]
    want = []
    for t in texts:
        line = next((x for x in (y.strip(" \t\xa0\n\r\x0b\x0c\x85  ") for y in re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", t)) if x and x[0] != "#"), "")
        want.append(line[:160].rstrip() + "…" if len(line) > 160 else line)
    assert got == want
    plan = spark.range(1).select(tx.fallback_summary(F.lit("a").cast("string")))._jdf.queryExecution().logical().toString()
    assert "split(" not in plan


def test_only_text_tells(spark):
    got = spark.createDataFrame([(" \t\n\xa0 ",), ("",), (" a ",), (None,)], "t string").select(tx.has_text(F.col("t"))).collect()
    assert [r[0] for r in got] == [False, False, True, None]


def test_a_model_gets_few_prompts_at_a_time(spark):
    prompts = spark.range(1300).coalesce(1).select(F.col("id").alias("k"), F.concat(F.lit("p"), "id").alias("prompt_text"))
    said = enrich.ask(prompts, lambda batch: [str(len(batch))] * len(batch), "p", ["k"])
    assert sorted(int(r.response) for r in said.collect()) == [300] * 300 + [500] * 1000
