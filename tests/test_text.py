"""Golden values of the scalar functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import frontmatter as fm
from vellum.functions import responses as rs
from vellum.functions import text as tx


def one(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_tiers(spark):
    assert one(spark, [0, 499, 500, 2999, 3000], tx.classify_tier, "long") == ["micro", "micro", "atomic", "atomic", "long"]
    assert one(spark, ["", "abcdef", "ab"], tx.estimate_tokens) == [1, 2, 1]
    assert one(spark, ["", "ab"], lambda c: tx.estimate_tokens(c, 0)) == [0, 1]


def test_links(spark):
    texts = ["see [[Rhubarb]]", "[[Rhubarb|pie]] and", "[[Rhubarb#Storage]]", "x[[Rhubarb#Storage|how]]y", "[[ ]] [[Leek# ]] [c]", "none here"]
    got = one(spark, texts, tx.extract_links_anchored)
    assert [[tuple(p) for p in r] for r in got] == [[("Rhubarb", None)], [("Rhubarb", None)], [("Rhubarb", "Storage")], [("Rhubarb", "Storage")], [("Leek", None)], []]


@pytest.mark.parametrize(
    ("body", "tags", "date", "aliases"),
    [
        ("Plain text\nwithout a block", [], None, []),
        ("---\ndate: 1999-07-04\ntags: [soup, winter stew]\n---\nStir.", ["soup", "winter stew"], "1999-07-04", []),
        ("---\ntags:\n  - sour\n  - 'sweet'\n---\n", ["sour", "sweet"], None, []),
        ("---\naliases: ['Pie Plant', \"Rheum\"]\n---\n", [], None, ["Pie Plant", "Rheum"]),
        ("---\ntag: garden\n---\n", ["garden"], None, []),
        ("---\ntags: [never closed]\nStir.", [], None, []),
        ("---\n---\n", [], None, []),
        ("---\ndate: 1999\n---\n", [], "1999", []),
        ("---\ntags:\n  - old\nDate: noon\ntags: [new]\n---\n", ["new"], "noon", []),
    ],
)
def test_frontmatter(spark, body, tags, date, aliases):
    f, g = one(spark, [body, body], lambda c: fm.frontmatter_fields(fm.frontmatter_raw(c)))
    assert (f.tags, f.date, f.aliases) == (tags, date, aliases) and f == g
    assert one(spark, [body], fm.note_fields) == [f]


def test_tokenize(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abC ,.;:!?-()[]{}\"'`/\\\n\t　é한") for _ in range(40)) for _ in range(50)] + ["a b c", ""]
    want = [[p for p in re.split(r"[\s,.;:!?\-()\[\]{}\"'`/\\]+", t.lower()) if len(p) >= 2] for t in texts]
    assert one(spark, texts, tx.tokenize) == want


def test_summaries(spark):
    long = "x" * 200
    assert one(spark, ["# T\n\n body \nmore", long, "", "# only"], tx.fallback_summary) == ["body", "x" * 160 + "…", "", ""]
    assert one(spark, [' "said" \n', "'a'"], tx.clean_summary) == ["said", "a"]
    assert one(spark, ["C++ & Co.  Ltd"], tx.file_slug) == ["C-Co-Ltd.md"]


def test_entities(spark):
    got = one(spark, ["x\nENTITY: A b | Person |  one \nENTITY: bad\nENTITY:C|D|e|f", "NONE", "", " none "], rs.parse_entities)
    assert [[tuple(e) for e in r] for r in got] == [[("A b", "person", "one"), ("C", "d", "e|f")], [], [], []]


def test_split_budget(spark):
    rows = spark.createDataFrame([("1:1:2", 100), ("1:x:2", 100), ("1:2", 100), ("0:0:0", 100), ("-1:1:1", 100), ("1:1:1", 0), ("0:0:1", 5)], "r string, t long")
    got = [tuple(r.b) for r in rows.select(tx.split_budget(F.col("r"), F.col("t")).alias("b")).collect()]
    assert got[0] == (25, 25, 50, None) and got[6] == (1, 1, 5, None)
    assert all(g[0] is None and g[3] for g in got[1:6])


def test_json_parsers(spark):
    answers = ['{"action": "select", "node": "a"}', '```json\n{"action":"DONE","message":"m"}\n```', "{bad", '{"action":"SELECT"}', '{"action":"go"}', "none"]
    got = [tuple(x) for x in one(spark, answers, rs.parse_select_json)]
    assert got[:2] == [("SELECT", "a", None), ("DONE", "m", None)]
    assert all(g[:2] == (None, None) and g[2] for g in got[2:])


def test_token_counts(spark):
    rng = random.Random(5)
    texts = [None, "", " ,; ", "a", "aa", "aa AA, aa-bb", "é É éé (éé)"] + [" ".join(rng.choice(["to", "of", "x", "data", "Data", "[mix]"]) for _ in range(rng.randrange(400))) for _ in range(20)]
    got = one(spark, texts, tx.token_counts)
    for text, r in zip(texts, got, strict=True):
        if text is None:
            assert r is None
            continue
        tokens = [t for t in re.split(tx.TOKEN_SEPARATORS.removeprefix("(?U)"), text.lower()) if len(t) >= 2]
        assert r.len == len(tokens) and len(r.counts) == len(set(tokens))
        assert {c.token: c.tf for c in r.counts} == {t: tokens.count(t) for t in tokens}
