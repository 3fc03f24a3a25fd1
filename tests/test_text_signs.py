"""Plain searches that spare texts a pattern: no match is lost, and each is tried only where it may match."""

import random

from pyspark.sql import functions as F

from lumenark.functions import text as T

PARTS = ["₹", "RS.", "Inr ", "usd", "$", "€", "5", "1,248.50", "4111 1111 1111 1111", "2024-05-06", "12 March 2024", "a.b@C.example", "HTTPS://x.y", "WWW.z", "+44 20 7946 0958", "Order", "ref", "Booking no: ", "QX7-991", "flight", "AG 204",
         "Departure time ", "18:45", "WiFi password: ", "passcode is ", "pin", "SSN", "account number", "e-mail", "Tel: ", "mobile", "Total: ", "subtotal", "amount paid", "balance due", "İ", "K", "ſ", "\n", ", ", ". ", " ", "x", ""]


def texts(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", " "]).join(rng.choices(PARTS, k=rng.randrange(9)))) for i in range(3_000)] + [(3_000, None), (3_001, " ")]
    return spark.createDataFrame(rows, "id long, text string").repartition(4)


def test_no_match_is_lost(spark):
    t = F.col("text")
    wanted = [(p, T.FACT_SIGNS[kind]) for kind, p, *_ in T.FACTS] + [(T.SENSITIVE_WORDS, T.SENSITIVE_SIGNS), (T.CREDENTIAL, T.CREDENTIAL_SIGNS), (T.CONTACT, T.CONTACT_SIGNS), (T.CURRENCY_AMOUNT, T.CURRENCY_SIGNS), (T.LABELED_AMOUNT, T.LABELED_SIGNS), (T.CARD, ((T.DIGIT,),))]
    counts = texts(spark).agg(*[F.count_if(t.rlike(p)).alias(f"m{n}") for n, (p, _) in enumerate(wanted)], *[F.count_if(t.rlike(p) & ~T.may_have(t, signs)).alias(f"lost{n}") for n, (p, signs) in enumerate(wanted)]).first().asDict()
    assert not {p: counts[f"lost{n}"] for n, (p, _) in enumerate(wanted) if counts[f"lost{n}"]}
    assert not [p for n, (p, _) in enumerate(wanted) if not counts[f"m{n}"]]


def test_redaction_is_the_chain_of_all_patterns(spark):
    out = F.col("text")
    for p, by in ((T.CREDENTIAL, "$1: [REDACTED]"), (T.CONTACT, "$1: [REDACTED]"), (T.EMAIL, "[REDACTED_EMAIL]"), (T.LABELED_AMOUNT, "$1: [REDACTED_AMOUNT]"), (T.CURRENCY_AMOUNT, "[REDACTED_AMOUNT]")):
        out = F.regexp_replace(out, p, by)
    rows = texts(spark).select("text", out.alias("chain"), F.regexp_extract_all(out, F.lit(T.CARD), F.lit(0)).alias("cards"), T.redact(F.col("text")).alias("got"), T.sensitive(F.col("text")).alias("s")).collect()
    plain = [r for r in rows if not r.cards]
    assert len(plain) > 1_500
    for r in plain:
        want = r.text if r.text is not None and not r.text.strip(" ") else "[REDACTED_SENSITIVE_OCR]" if r.s and r.chain == r.text else r.chain
        assert r.got == want, r.text
    assert any("[REDACTED_CARD]" in r.got for r in rows if r.cards)


def test_facts_of_some_kinds(spark):
    blocks = texts(spark).selectExpr("id as media_id", "0L as block_id", "text", "0.9D as confidence")
    every = {tuple(r) for r in T.typed_facts(blocks).collect()}
    assert {tuple(r) for r in T.typed_facts(blocks, ["PHONE"]).collect()} == {r for r in every if r[2] == "PHONE"} and len({r[2] for r in every}) == len(T.FACTS)
    assert "order" not in T.typed_facts(blocks, ["PHONE"])._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_read_as_they_come(spark):
    """No group of pandas for each caption, and a caption that goes over several batches is one."""
    rows = [(i, " ".join(f"w{i} v{k} u{k % 9}." for k in range(60))) for i in range(300)] + [(7, "Another row of seven. w7 v0 u0."), (None, "No id. Nothing else here.")]
    df = spark.createDataFrame(rows, "caption_id long, text string").repartition(3)
    kept = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = T.caption_chunks(df)
        got = {}
        for r in out.collect():
            got.setdefault(r.caption_id, []).append(r.n)
        assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(got) == 301 and all(sorted(n) == list(range(len(n))) and len(n) <= T.PIECES for n in got.values()) and len(got[3]) == T.PIECES and len(got[None]) == 2
