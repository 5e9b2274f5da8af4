"""Operator 4 with templates longer than half a block of 64 words."""
from quarry.llm import licenses


def test_templates_longer_than_half_a_block(spark):
    templates = {"long": " ".join(f"l{i}" for i in range(100)), "straddling": " ".join(f"s{i}" for i in range(45))}
    rows = [(i, "x " * i + templates["long"] + " y" * 90) for i in (0, 17, 50)]
    rows += [(100 + i, "x " * i + templates["straddling"] + " y" * 90) for i in (0, 20, 41)] + [(200, "x " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_scan(df, templates=templates).collect()}
    assert got == {i: "long" if i < 100 else "straddling" if i < 200 else "" for i, _ in rows}
