"""Near-dedup takes the components of SimHash as candidates."""

from vellum.llm import near_copies


def test_simhash_is_a_step(spark, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(reversed(words)), "", None, "one", "One"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    seen, plain = [], near_copies.simhash_groups

    def spy(docs, id_col):
        out = plain(docs, id_col)
        seen.append({r.doc_id: r.component_id for r in out.collect()})
        return out

    monkeypatch.setattr(near_copies, "simhash_groups", spy)
    got = {r.row_id: r.group_id for r in near_copies.row_groups(rows).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5}
    assert set(seen[0]) == set(range(7)) and seen[0][5] == seen[0][6]
