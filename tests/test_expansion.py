"""Concept expansion and variants, case by case."""

from lumenark.operators.expansion import expanded, known_concepts, query_variants

QUESTION = "id long, query string, intent string, terms array<string>, clauses array<struct<text: string, canonical: string, polarity: string>>"


def test_expansion(spark):
    rows = [
        (1, "My Birthday photos", "FIND", ["Birthday", "cake"], [("red hat", "Red Hat", "POSITIVE"), ("dog", None, "NEGATIVE"), ("my birthday PHOTOS", None, "POSITIVE")]),
        (2, "total", "SUM", ["total"], []), (3, "total", "SUM", ["total"], [("xx y", None, "POSITIVE"), ("!", None, "POSITIVE")]), (4, "hello", "FIND", [], []), (5, " ", "FIND", None, None), (6, "q", "FIND", [f"t{i}" for i in range(40)], None),
        (7, "many", "FIND", ["birthday"], [(f"c{i}a", f"d{i}b", "POSITIVE") for i in range(6)]),
    ]
    df = spark.createDataFrame(rows, QUESTION)
    got = {r.id: r for r in expanded(df, known_concepts(spark)).collect()}
    assert got[1].evidence_terms == ["Birthday", "cake", "candle", "candles", "balloon", "balloons", "party", "celebration"]
    assert got[1].concept_queries == ["birthday cake", "birthday candles", "birthday party", "birthday celebration"]
    assert got[6].evidence_terms == [f"t{i}" for i in range(32)] and got[5].evidence_terms == []
    found = {}
    for r in query_variants(df, known_concepts(spark)).orderBy("id", "place").collect():
        found.setdefault(r.id, []).append(r.variant)
    assert found == {
        1: ["My Birthday photos", "red hat", "birthday cake", "birthday candles", "birthday party", "birthday celebration"], 3: ["total", "xx y"], 6: ["q"],
        7: ["many", "c0a", "d0b", "c1a", "d1b", "c2a", "d2b", "c3a"],
    }
