"""Claims against their evidence, case by case."""

from lumenark.operators.grounding import MOST_EVIDENCE, judged_claims, packet_evidence

EVIDENCE = "packet_id long, evidence_id string, text string, priority int, confidence double, uncertain boolean"
CLAIM = "claim_id long, packet_id long, text string, evidence_ids array<string>"


def test_verdicts(spark):
    packets = spark.createDataFrame([(1, "red hats in June", "Found 12 photos", "on 5 June"), (2, None, None, None)], "packet_id long, query string, headline string, detail string")
    evidence = [(1, "a", "Ann wears a hat, 1,200.50 EUR, file //x", 0, 0.9, False), (1, "b", "A dog on the beach in July", 1, 0.5, True), (1, "a", "repeated", 5, 0.1, False), (2, "a", None, 0, None, False)]
    claims = [
        (1, "Ann wears hats", ["a"], "GROUNDED", None), (2, "Ann and a dog", ["a"], "UNSUPPORTED_WORD", "dog"), (3, "Possibly a dog", ["b"], "UNSUPPORTED_WORD", "possibly"), (4, "dog", ["b"], "UNCERTAINTY_LOST", None),
        (5, "Ann 1,200.5 and 12.0", ["a"], "GROUNDED", None), (6, "Ann 13", ["a"], "UNSUPPORTED_NUMBER", "13"), (7, "Ann in July", ["a"], "UNSUPPORTED_WORD", "july"), (8, "hats", ["a", "z"], "UNKNOWN_EVIDENCE", "z"), (9, "hats", [], "UNKNOWN_EVIDENCE", None),
        (10, "hats", None, "UNKNOWN_EVIDENCE", None), (11, "verified", ["a"], "UNCONNECTED", None), (12, None, ["a"], "UNCONNECTED", None), (13, "hats may be red", ["b"], None, None), (14, "red hats /../x", ["a"], "PATH", None),
        (15, "red hats in May", ["a"], "UNSUPPORTED_WORD", "may"), (16, "hats -5 +5", ["a"], "UNSUPPORTED_NUMBER", "-5"), (17, "red June 5", ["a"], "GROUNDED", None),
    ]
    got = {r.claim_id: (r.verdict, r.token) for r in judged_claims(spark.createDataFrame([(i, 1, t, e) for i, t, e, *_ in claims] + [(30, 2, "x", ["a"]), (31, 9, "x", ["a"])], CLAIM), packets, spark.createDataFrame(evidence, EVIDENCE)).collect()}
    want = {i: (v, t) for i, _, _, v, t in claims} | {13: ("UNSUPPORTED_WORD", "may"), 30: ("UNCONNECTED", None), 31: ("UNKNOWN_EVIDENCE", "a")}
    assert got == want


def test_the_strongest_pieces_count(spark):
    rows = [(1, f"e{i:02}", "t", i % 3, i / 100, False) for i in range(60)] * 2
    kept = [r.evidence_id for r in packet_evidence(spark.createDataFrame(rows, EVIDENCE)).collect()]
    want = sorted({(r[3], -r[4], r[1]) for r in rows})[:MOST_EVIDENCE]
    assert sorted(kept) == sorted(w[2] for w in want)


def test_empty(spark):
    none = spark.createDataFrame([], CLAIM)
    assert judged_claims(none, spark.createDataFrame([], "packet_id long, query string, headline string, detail string"), spark.createDataFrame([], EVIDENCE)).count() == 0
