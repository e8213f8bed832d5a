"""Rounds of a large component: what is written grows with the ideas, not with ideas times rounds."""

from loomgraph.operators import ideas as I


def test_a_row_is_written_again_as_often_as_sizes_double(spark, monkeypatch):
    written, scratch = [], I.scratch

    def counting(session):
        write = scratch(session)

        def told(df, name):
            out = write(df, name)
            if name.startswith("done"):
                written.append(out.count())
            return out

        return told

    monkeypatch.setattr(I, "scratch", counting)
    n = 64
    ideas = spark.createDataFrame([("v", i, f"word{i}", 0) for i in range(n)], "vault string, id long, statement string, level int")
    near = spark.createDataFrame([(i, i - 1, 0.7, False) for i in range(1, n)], "id long, candidate long, score double, cut boolean")
    found = I.fold_components(ideas, near, lambda idea, ranked: {"decision": "link", "target": ranked[0][0]}, 0.8, 3, 8)
    assert {r["id"]: r["target"] for r in found.collect()} == {0: None} | {i: i - 1 for i in range(1, n)}
    assert sum(written) <= 5 * n  # 16 rounds: once, and again for 2, 4, 8 and 16 of them
