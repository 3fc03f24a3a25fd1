"""Operators that SQL cannot express, and edge cases, on small tables."""

import re

from pyspark.sql import functions as F

from lumenark.functions import ids
from lumenark.functions import text as T
from lumenark.operators import answers, events, filters, identity, ingest, metrics, retrieval
from lumenark.operators.components import components
from lumenark.operators.duplicates import duplicate_links, pick_diverse, selected_diverse, thinned_frames
from lumenark.sources.tables import captures, load, media


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)]
    nodes = spark.range(200)
    got = {r.id: r.component for r in components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 130)) and got[0] == 0 and got[150] == 150


SAMPLES = [
    (1, 1, "Blue Cafe", 0.05, 0.9), (1, 2, "Receipt", 0.1, 0.95), (1, 3, "Subtotal INR 1,100.00", 0.5, 0.9), (1, 4, "Tax INR 148", 0.6, 0.9), (1, 5, "Grand Total INR 1,248", 0.8, 0.9), (1, 6, "12 March 2024", 0.2, 0.9),
    (2, 1, "Flight AG 204 departure time 18:45", 0.1, 0.8), (2, 2, "Order no: QX7-991 www.example.com/x", 0.2, 0.8), (3, 1, "WiFi password: s3cret, call phone +44 20 7946 0958", 0.3, 0.7), (3, 2, "visit https://a.example/b on 2024-05-06", 0.4, 0.7),
    (4, 1, "Card 4111 1111 1111 1111 paid $12.50", 0.5, 0.6), (4, 2, "Total 950", 0.9, 0.6), (4, 3, "at 1700000000000 ms", 0.9, 0.6), (5, 1, "INR 5 or Rs 5.00, inr 5", 0.9, 0.6), (5, 2, None, None, 0.5),
]


def blocks(spark):
    return spark.createDataFrame(SAMPLES, "media_id long, block_id long, text string, top double, confidence double")


def test_totals_and_merchants(spark):
    totals = {r.media_id: (r.raw_text, float(r.value), r.label, r.score, r.confidence) for r in T.receipt_totals(blocks(spark)).where("media_id < 5").collect()}
    assert totals == {1: ("INR 1,248", 1248.0, "grand_total", 13, 0.945), 4: ("Total 950", 950.0, "total", 5, 0.87)}
    assert {r.media_id: r.raw_text for r in T.merchants(blocks(spark)).collect()} == {1: "Blue Cafe", 2: "Flight AG 204 departure time 18:45", 3: "WiFi password: s3cret, call phone +44 20 7946 0958"}
    assert {(r.raw_text, r.normalized_value) for r in T.typed_facts(blocks(spark)).where("media_id = 5").collect()} == {("INR 5", "5.00")}  # the first of equal facts


def test_sensitive_content_against_python(spark, sf_dir):
    import re

    from lumenark.plans.documents import blocks as table_blocks
    from lumenark.plans.documents import sensitive_content

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def card(raw):
        d = re.sub(r"[^0-9]", "", raw)
        return 13 <= len(d) <= 19 and luhn(d) and not (len(d) == 13 and T.EPOCH_MS[0] <= int(d) <= T.EPOCH_MS[1])

    patterns = [re.compile(p, re.ASCII) for p in (T.SENSITIVE_WORDS, T.EMAIL, T.CONTACT, T.CURRENCY_AMOUNT, T.LABELED_AMOUNT)]
    text = {(r.media_id, r.block_id): r.text for r in table_blocks(spark, sf_dir).collect()}
    n = 0
    for r in sensitive_content(spark, sf_dir).collect():
        t = text[r.media_id, r.block_id]
        want = bool(t.strip(" ")) and (any(p.search(t) for p in patterns) or any(card(m[0]) for m in re.finditer(T.CARD, t, re.ASCII)))
        assert r.labelled == want, t
        n += want
    assert n > 1_000
    assert spark.createDataFrame([("pin 1234",), ("a tree",)], "t string").select(T.searchable(F.col("t"))).collect() == [("pin: [REDACTED]",), ("a tree",)]


def test_typed_facts(spark):
    got = {(r.media_id, r.entity_type, r.normalized_value) for r in T.typed_facts(blocks(spark)).collect()}
    assert {(1, "AMOUNT", "1248.00"), (1, "DATE", "12 MARCH 2024"), (2, "FLIGHT_NUMBER", "AG204"), (2, "FLIGHT_TIME", "18:45"), (2, "ORDER_ID", "QX7-991"), (2, "URL", "www.example.com/x"), (3, "PASSWORD", "s3cret,"), (3, "PHONE", "442079460958"), (3, "URL", "https://a.example/b"), (3, "DATE", "2024-05-06"), (4, "AMOUNT", "12.50")} <= got


def test_cards_and_redaction(spark):
    rows = ["Card 4111 1111 1111 1111 ok", "Card 4111 1111 1111 1112 no", "1700000000000", "call phone 555 1234, later", "mail a.b@c.example now", "Total: $12.50", "the pin is 1234; fine", "plain words", ""]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "text string").select(T.redact(F.col("text"))).collect()]
    assert got == ["Card [REDACTED_CARD]ok", rows[1], rows[2], "call phone: [REDACTED], later", "mail [REDACTED_EMAIL] now", "Total: [REDACTED_AMOUNT]", "the pin: [REDACTED]; fine", "plain words", ""]


def test_luhn(spark, sf_dir):
    from lumenark.plans.documents import luhn_cards

    def right(d):
        total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0 and not (len(d) == 13 and 946684800000 <= int(d) <= 4102444800000)

    rows = luhn_cards(spark, sf_dir).collect()
    assert rows and all(r.valid == right(r.digits) for r in rows)


def test_caption_chunks_are_greedy(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").where("doc_id < 60").select(F.col("doc_id").alias("caption_id"), "text")
    pieces = {}
    for r in T.caption_pieces(docs).where(~T.sensitive(F.col("text"))).orderBy("caption_id", "s", "p").collect():
        pieces.setdefault(r.caption_id, []).append(r)
    want = {}
    for k, rows in pieces.items():
        kept = []
        for r in rows:
            a = set(r.normal.split())
            if r.normal and not any(r.normal in o.normal or o.normal in r.normal or len(a & set(o.normal.split())) / len(a | set(o.normal.split())) >= 0.88 for o in kept):
                kept.append(r)
        want[k] = [r.text for r in kept[:24]]
    got = {}
    for r in T.caption_chunks(docs).orderBy("caption_id", "n").collect():
        got.setdefault(r.caption_id, []).append(r.text)
    assert got == {k: v for k, v in want.items() if v}
    assert max(len(t.split()) for v in got.values() for t in v) <= 40


def test_frames_kept(spark):
    rows = [(1, t, h) for t, h in enumerate([0, 1, 255, 256, 511, 0])]
    got = [r.at_ms for r in thinned_frames(spark.createDataFrame(rows, "media_id long, at_ms long, phash long")).orderBy("at_ms").collect()]
    last, want = None, []
    for _, t, h in rows:
        if last is None or bin(h ^ last).count("1") >= 8:
            want.append(t)
            last = h
    assert got == want


def test_diverse_choice_prefers_quality_then_distance():
    import pandas as pd

    pdf = pd.DataFrame({"id": range(4), "quality": [0.9, 0.8, 0.1, 0.5], "phash": [0, 0, 2**40 - 1, 0], "captured_ms": [0, 0, 10**9, 0], "faces": [0, 0, 4, 0], "has_text": [True, True, False, True], "frame": [1.0] * 4})
    assert pick_diverse(pdf, 2) == [0, 2]
    assert pick_diverse(pdf, 9) == [0, 1, 3, 2]


def test_diverse_choice_is_greedy_over_whole_groups(spark):
    import random

    import pandas as pd

    rng = random.Random(5)
    slices = {0: [], 1: []}  # ids by a hash, so that many of a group share it
    for r in spark.range(40_000).select("id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("s")).where("s < 2").collect():
        slices[r.s].append(r.id)
    a, (first, *_) = slices[0][:302], slices[1]
    rows = [("hot", first, 1.0, 0, 0, 0, False, 1.0), ("hot", a[0], 0.91, -1 ^ 0b111111, 0, 0, False, 1.0), ("hot", a[1], 0.9, -1, 0, 0, False, 1.0)]
    rows += [("hot", i, 0.89, rng.getrandbits(63), 0, 0, False, 1.0) for i in a[2:]]
    some = lambda *xs: rng.choice([None, *xs])
    for g, n in (("x", 1), ("y", 3), (None, 5), ("z", 60)):
        rows += [(g, 1000 + i, some(0.2, 0.5, 0.9), some(0, 7, 2**60 - 1, rng.getrandbits(63)), some(0, 10**7, 10**9), rng.randrange(6), rng.random() < 0.5, rng.choice([0.5, 1.0, 1.5])) for i in range(n)]
    df = spark.createDataFrame(rows, "album string, id long, quality double, phash long, captured_ms long, faces long, has_text boolean, frame double").repartition(5)
    got = {(r.album, r.place): r.id for r in selected_diverse(df, "album", 3).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        columns = dict(zip(df.columns, zip(*own, strict=True), strict=True))
        pdf = pd.DataFrame(columns | {"phash": pd.array(columns["phash"], "Int64"), "quality": pd.Series(columns["quality"], dtype=float), "captured_ms": pd.Series(columns["captured_ms"], dtype=float)})
        want |= {(g, place): own[i][1] for place, i in enumerate(pick_diverse(pdf, 3))}
    assert got == want and got["hot", 1] == a[1]


def test_clips_are_short(spark, sf_dir):
    from lumenark.plans.events import keyframes_kept

    rows = keyframes_kept(spark, sf_dir).collect()
    assert {r.media_id for r in rows} == {r[0] // 12 for r in load(spark, sf_dir, "embeddings").select("vec_id").collect()}
    assert all(r.media_id == r.at_ms // 12 for r in rows)


def test_duplicate_links_near_and_equal(spark):
    rows = [(1, "IMAGE", "", 0b1111, 0), (2, "IMAGE", "", 0b0011, 14_000), (3, "IMAGE", "", 0b0011, 60_000), (4, "VIDEO", "", 0b1111, 0), (5, "IMAGE", "x", 0b1111, 0), (6, "IMAGE", "", 2**50 - 1, 0), (7, "IMAGE", "", None, 0)]
    got = {(r.a, r.b) for r in duplicate_links(spark.createDataFrame(rows, "id long, kind string, text string, phash long, captured_ms long")).collect()}
    assert got == {(1, 2), (2, 3)}


def test_sessions_and_corrections(spark, sf_dir):
    s = events.sessionize(captures(spark, sf_dir))
    groups = {}
    for r in s.select("id", "user_id", "session").collect():
        groups.setdefault((r.user_id, r.session), set()).add(r.id)
    groups = list(groups.values())
    for op, mine in (("MERGE", {0, 1, 2}), ("SPLIT", {1}), ("MERGE", {1, 5})):
        if op == "MERGE":
            hit = [g for g in groups if g & mine]
            if len(hit) > 1:
                groups = [g for g in groups if not g & mine] + [set().union(*hit)]
        else:
            groups = [g for g in ([h - mine for h in groups]) if g] + [mine]
    got = {}
    for r in events.corrected(s, [("MERGE", [0, 1, 2]), ("SPLIT", [1]), ("MERGE", [1, 5])]).select("id", "grp").collect():
        got.setdefault(r.grp, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))


def test_event_ids(spark):
    import hashlib

    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(50)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in h], "h string").select(ids.signless_long(F.col("h"))).collect()]
    assert got == [max(1, int(x[:16], 16) & (2**63 - 1)) for x in h]


def test_uuid_v3(spark):
    import hashlib
    import uuid

    names = ["", "a", "zoë", "burst:x:1"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in names], "t string").select(ids.uuid_v3(F.col("t"))).collect()]
    assert got == [str(uuid.UUID(bytes=hashlib.md5(x.encode()).digest(), version=3)) for x in names]


def test_rouge(spark):
    rows = [("a b c d", "a c d x"), ("", "a"), ("the cat sat on the mat", "the cat the mat sat"), ("x", "x")]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    got = metrics.rouge_scores(spark.createDataFrame(rows, "reference string, answer string")).select("reference", "answer", "rouge.rougeL").collect()
    for r in got:
        a, b = re.findall(r"\w+", r.reference), re.findall(r"\w+", r.answer)
        assert metrics.longest_common(a, b) == common(a, b)
        assert abs(r.rougeL - (2 * common(a, b) / (len(a) + len(b)) if a and b else 0)) < 1e-9


def test_filters_with_unknown_values(spark):
    rows = [(1, None, "IMAGE"), (2, 5, "IMAGE"), (3, 5, "PDF")]
    df = spark.createDataFrame(rows, "id long, captured_ms long, kind string")
    assert [r.id for r in df.where(filters.time_range(None, None)).collect()] == [2, 3]
    assert [r.id for r in df.where(filters.all_of(filters.time_range(5, 5), filters.kind_is("PDF"))).collect()] == [3]
    assert df.where(filters.all_of()).count() == 3


def test_filter_comes_before_top_k(spark, sf_dir):
    items = filters.eligible(media(spark, sf_dir), filters.Scope(kind="PDF"))
    best = retrieval.top(retrieval.field_score(items, ("src1",)), "score", 5)
    assert best.count() == 5 and best.join(items, "id", "left_anti").count() == 0


def test_vectors_that_have_no_cosine(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None), (5, [1.0]), (6, [-2.0, 0.0])]
    got = {r.id: round(r.score, 6) for r in retrieval.cosine(spark.createDataFrame(rows, "id long, embedding array<float>"), [3.0, 0.0]).collect()}
    assert got == {1: 1.0, 6: -1.0}


def test_partial_coverage_is_never_exact(spark):
    yes, no = F.lit(True), F.lit(False)
    for status in ("SUCCESS", "PARTIAL", "NOT_REQUIRED"):
        assert spark.range(1).select(answers.exactness(no, yes, F.lit(status), no, yes, yes)).first()[0] == "PARTIAL_INDEX"
    facts = spark.createDataFrame([(1, 1, "", "INR 5")], "media_id long, position long, content_digest string, raw_text string")
    row = answers.total(facts, complete=False).first()
    assert row.status == "PARTIAL_COVERAGE" and row.value is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string, title string, location string, description string, tags array<string>")
    assert retrieval.field_score(none, ("x",)).count() == 0 and retrieval.bm25(none, ("x",)).count() == 0
    assert answers.extremes(spark.createDataFrame([], "media_id long, position long, content_digest string, raw_text string")).first().documents == 0


def test_identity_decision(spark):
    rows = [(1, i, 7, s) for i, s in enumerate([0.5, 0.41])] + [(2, 9, 7, 0.5)] + [(3, 9, 7, 0.6), (3, 8, 8, 0.57)] + [(4, 9, 7, 0.6), (4, 8, 8, 0.5)]
    got = {r.query_id: r.cluster_id for r in identity.nearest_clusters(spark.createDataFrame(rows, "query_id long, face_id long, cluster_id long, score double")).collect()}
    assert got == {1: 7, 2: None, 3: None, 4: 7}


def test_corrections_of_faces_stay(spark):
    box = "box struct<left:double,top:double,right:double,bottom:double>"
    new = spark.createDataFrame([(1, 1, 5, (0.0, 0.0, 1.0, 1.0)), (1, 2, 5, (0.0, 0.0, 1.5, 1.0)), (1, 3, 6, (0.1, 0.1, 0.2, 0.2))], f"media_id long, face_id long, cluster_id long, {box}")
    old = spark.createDataFrame([(1, 9, True), (3, 8, False)], "face_id long, cluster_id long, corrected boolean")
    assert {(r.face_id, r.cluster_id, r.corrected) for r in identity.kept_corrections(new, old).collect()} == {(1, 9, True), (3, 6, False)}
    c = spark.createDataFrame([(1, "A", ["x", "y"]), (2, "B", ["y", "z"])], "cluster_id long, label string, aliases array<string>")
    r = identity.merged_clusters(c, F.lit(2), F.lit(1)).first()
    assert (r.cluster_id, r.label, r.aliases) == (1, "A", ["x", "y", "z"])


def test_exif(spark):
    rows = [("2024:02:30 10:00:00", None), ("2024:02:03 10:00:00", None), ("2024-02-03 10:00:00", None), ("2024:02:03 10:00:00", "+05:30"), ("1960:01:01 00:00:00", None), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string, o string").select(ingest.exif_ms(F.col("v"), F.col("o"))).collect()]
    assert got[1] == 1706954400000 and got[3] == 1706954400000 - 19_800_000 and got[0] is None and got[2] is None and got[4] is None and got[5] is None


def test_scan_hashes_follow_the_sets(spark):
    a, b = spark.range(10), spark.range(11)
    one = ingest.scan_state(a, a, a, "q", "m").first()
    assert one.status == "COMPLETE" and one == ingest.scan_state(a.orderBy(F.desc("id")), a, a, "q", "m").first()
    two = ingest.scan_state(b, a, a, "q", "m").first()
    assert two.status == "PARTIAL" and two.scope_hash != one.scope_hash and two.coverage_hash == one.coverage_hash
