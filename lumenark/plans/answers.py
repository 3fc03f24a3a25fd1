"""Answers, coverage and exactness over the driver's tables.

Orders stand for documents with a total: ``raw_text`` is the price with a currency, and the order key is the position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import filters as P
from ..registry import query
from ..sources.tables import MEDIA_SQL, load, media

STAGES, STATUSES = ("OCR", "EMBEDDING", "FACES"), ("PENDING", "RUNNING", "COMPLETE", "SKIPPED", "FAILED_RETRYABLE")
FACTS_SQL = """facts AS (SELECT o_orderkey AS media_id, o_orderkey AS position, CASE WHEN o_custkey % 3 = 0 THEN 'digest' || (o_orderkey // 2) ELSE '' END AS content_digest,
    CASE WHEN o_orderkey % 5 = 0 THEN 'USD ' ELSE 'INR ' END || o_totalprice::DECIMAL(38,2) AS raw_text, o_totalprice::DECIMAL(38,2) AS value FROM orders),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN trim(content_digest) <> '' THEN 'digest:' || trim(content_digest) ELSE 'media:' || media_id END ORDER BY position, media_id) AS n FROM facts {where}) WHERE n = 1)"""


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    digest = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("digest"), F.floor(F.col("o_orderkey") / 2).cast("string"))).otherwise("")
    money = F.when(F.col("o_orderkey") % 5 == 0, "USD ").otherwise("INR ")
    return o.select(F.col("o_orderkey").alias("media_id"), F.col("o_orderkey").alias("position"), digest.alias("content_digest"), F.concat(money, F.col("o_totalprice").cast(A.MONEY).cast("string")).alias("raw_text"))


@query(f"WITH {FACTS_SQL.format(where='')} SELECT NULL::DECIMAL(38,2) AS value, count(*) AS documents, NULL::VARCHAR AS currency, 'MIXED_CURRENCIES' AS status FROM once")
def sum_mixed_currencies(spark, sf_dir) -> DataFrame:
    return A.total(order_facts(spark, sf_dir), complete=True)


@query("WITH " + FACTS_SQL.format(where="WHERE raw_text LIKE 'INR%'") + " SELECT sum(value)::DECIMAL(38,2) AS value, count(*) AS documents, 'INR' AS currency, 'OK' AS status FROM once")
def sum_totals(spark, sf_dir) -> DataFrame:
    return A.total(order_facts(spark, sf_dir).where("raw_text like 'INR%'"), complete=True)


@query("WITH " + FACTS_SQL.format(where="") + """ SELECT min(value) AS min_value, (SELECT media_id FROM once ORDER BY value, position, media_id LIMIT 1) AS min_id, max(value) AS max_value,
    (SELECT media_id FROM once ORDER BY value DESC, position, media_id LIMIT 1) AS max_id, count(*) AS documents FROM once""")
def min_max_totals(spark, sf_dir) -> DataFrame:
    return A.extremes(order_facts(spark, sf_dir))


@query("""SELECT CASE o_orderkey % 4 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' WHEN 2 THEN 'INR' ELSE 'UNSPECIFIED' END AS currency, count(*) AS n, sum(o_totalprice::DECIMAL(38,2)) AS value FROM orders GROUP BY 1""")
def currency_of_text(spark, sf_dir) -> DataFrame:
    text = F.concat(F.element_at(F.array(F.lit("₹ "), F.lit("usd "), F.lit("Rs. "), F.lit("sum ")), (F.col("o_orderkey") % 4 + 1).cast("int")), F.format_number("o_totalprice", 2))
    facts = load(spark, sf_dir, "orders").select(text.alias("t"))
    return facts.groupBy(A.currency(F.col("t")).alias("currency")).agg(F.count("*").alias("n"), F.sum(A.first_number(F.col("t"))).alias("value"))


@query("""WITH v AS (SELECT n_name AS value, min(c_custkey) AS first_at, count(*) AS items FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT value, first_at, items, (SELECT count(*) FROM v) AS distinct_values FROM v ORDER BY first_at, value LIMIT 20""")
def list_places(spark, sf_dir) -> DataFrame:
    items = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.col("c_custkey").alias("position"))
    return A.distinct_list(items, F.col("n_name"))


@query(f"WITH {MEDIA_SQL} SELECT strftime(make_timestamp(captured_ms * 1000), '%Y-%m-%d') AS day, count(*) AS items FROM media WHERE captured_ms IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 20")
def timeline_by_day(spark, sf_dir) -> DataFrame:
    return A.timeline(media(spark, sf_dir))


@query(f"WITH {MEDIA_SQL} SELECT location, count(*) AS items, min(captured_ms) AS first_ms, max(captured_ms) AS last_ms FROM media GROUP BY location ORDER BY items DESC, min(id) LIMIT 2")
def compare_largest(spark, sf_dir) -> DataFrame:
    return A.compare_groups(media(spark, sf_dir).withColumn("position", F.col("id")), "location")


@query(f"""WITH {MEDIA_SQL}, s AS (SELECT * FROM (VALUES (0, 'no such place'), (1, 'src7'), (2, 'nation_3'), (3, 'src1')) t(place, scope)),
    h AS (SELECT s.place, s.scope, m.id, m.captured_ms FROM s JOIN media m ON contains(lower(m.location || chr(31) || m.album || chr(31) || m.title || chr(31) || m.filename || chr(31) || m.description || chr(31) || array_to_string(m.tags, chr(31))), s.scope))
    SELECT scope, count(DISTINCT id) AS items, min(captured_ms) AS first_ms, max(captured_ms) AS last_ms FROM h GROUP BY place, scope ORDER BY place LIMIT 2""")
def compare_scopes(spark, sf_dir) -> DataFrame:
    return A.compare_scopes(media(spark, sf_dir), ["no such place", "src7", "nation_3", "src1"])


@query(f"""WITH {MEDIA_SQL}, ev AS (SELECT user_id AS event_id, 'Visit ' || user_id % 5 AS title, 'Hall ' || user_id % 7 AS location, string_agg(DISTINCT event_type, ' ') AS search_text FROM events GROUP BY user_id),
    s AS (SELECT * FROM (VALUES (0, 'visit 99'), (1, 'hall 3'), (2, 'src7')) t(place, scope)),
    h AS (SELECT s.place, s.scope, m.id, m.captured_ms FROM s, media m LEFT JOIN ev ON ev.event_id = m.id % 40 WHERE contains(lower(concat_ws(chr(31), m.location, m.album, m.title, m.filename, m.description, array_to_string(m.tags, chr(31)))), s.scope)
      OR coalesce(contains(lower(concat_ws(chr(31), ev.title, ev.location, ev.search_text)), s.scope), false))
    SELECT scope, count(DISTINCT id) AS items, min(captured_ms) AS first_ms, max(captured_ms) AS last_ms FROM h GROUP BY place, scope ORDER BY place LIMIT 2""")
def compare_scopes_of_events(spark, sf_dir) -> DataFrame:
    """Scopes that are found in the events of items; that an item belongs to the event of its number modulo 40 is synthetic."""
    u = F.col("user_id")
    ev = load(spark, sf_dir, "events").groupBy(u.alias("event_id")).agg(F.array_join(F.collect_set("event_type"), " ").alias("search_text"))
    ev = ev.select("event_id", F.concat(F.lit("Visit "), (F.col("event_id") % 5).cast("string")).alias("title"), F.concat(F.lit("Hall "), (F.col("event_id") % 7).cast("string")).alias("location"), "search_text")
    return A.compare_scopes(media(spark, sf_dir).withColumn("event_id", F.col("id") % 40), ["visit 99", "hall 3", "src7"], events=ev)


@query("""SELECT o_orderkey AS media_id, 'P' || l_returnflag AS entity_type, l_linenumber AS fact_id, l_discount AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_discount DESC, l_linenumber, l_extendedprice) AS r FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE r = 1""")
def first_fact_per_doc(spark, sf_dir) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.concat(F.lit("P"), F.col("l_returnflag")).alias("entity_type"), F.col("l_linenumber").alias("fact_id"), F.col("l_discount").alias("confidence"))
    found = A.best_fact(lines)
    return found.join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media_id")), "media_id", "left_semi")


def _line_facts(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "TOTAL").when(F.col("l_returnflag") == "A", "DATE").otherwise("MERCHANT")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("media_id"), kind.alias("entity_type"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.col("l_discount").alias("confidence"), F.col("l_extendedprice").alias("raw")
    )


LINE_FACTS = """f AS (SELECT l_orderkey AS media_id, CASE l_returnflag WHEN 'R' THEN 'TOTAL' WHEN 'A' THEN 'DATE' ELSE 'MERCHANT' END AS entity_type, l_partkey * 10 + l_linenumber AS fact_id, l_discount AS confidence FROM lineitem)"""


@query(f"""WITH {LINE_FACTS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id, entity_type ORDER BY confidence DESC, fact_id) AS r FROM f) WHERE r = 1),
    d AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1)
    SELECT media_id, entity_type, fact_id, confidence FROM b JOIN d ON media_id = o_orderkey WHERE entity_type IN ('TOTAL', 'DATE') ORDER BY CASE entity_type WHEN 'TOTAL' THEN 1 ELSE 2 END LIMIT 1""")
def latest_document_fact(spark, sf_dir) -> DataFrame:
    hits = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.negative(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("position"))
    return A.document_fact(hits, _line_facts(spark, sf_dir).drop("raw"), ["TOTAL", "DATE"])


@query(f"""WITH {LINE_FACTS} SELECT entity_type, media_id, fact_id, confidence, place FROM (SELECT *, CASE entity_type WHEN 'TOTAL' THEN 1 WHEN 'DATE' THEN 2 ELSE 3 END AS place,
    row_number() OVER (PARTITION BY entity_type ORDER BY confidence DESC, fact_id) AS r FROM f WHERE media_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) WHERE r = 1""")
def document_details(spark, sf_dir) -> DataFrame:
    hits = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return A.document_details(hits, _line_facts(spark, sf_dir).drop("raw"), ["TOTAL", "DATE", "MERCHANT"]).withColumn("place", F.col("place").cast("int"))


def stage_rows(spark, sf_dir) -> DataFrame:
    """A work-queue state from the events: the item is the event, its type the status of a stage."""
    e = load(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "COMPLETE").when(F.col("event_type") == "view", "SKIPPED").when(F.col("event_type") == "error", "FAILED_RETRYABLE").otherwise("PENDING")
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select((F.col("event_id") % 2000).alias("id"), stage.alias("stage"), status.alias("status"), "event_id")


STAGE_SQL = """stages AS (SELECT event_id % 2000 AS id, ['OCR', 'EMBEDDING', 'FACES'][user_id % 3 + 1] AS stage, CASE event_type WHEN 'click' THEN 'COMPLETE' WHEN 'view' THEN 'SKIPPED' WHEN 'error' THEN 'FAILED_RETRYABLE' ELSE 'PENDING' END AS status, event_id FROM events)"""


@query(f"""WITH {STAGE_SQL}, m AS (SELECT id, arg_max(status, event_id) AS status FROM stages WHERE stage = 'OCR' GROUP BY id), j AS (SELECT d.doc_id, coalesce(status, 'PENDING') AS s FROM documents d LEFT JOIN m ON m.id = d.doc_id)
    SELECT count(*) AS eligible, count(*) FILTER (s IN ('COMPLETE', 'SKIPPED')) AS covered, count(*) FILTER (s LIKE 'FAILED%') AS failed, count(*) FILTER (s IN ('PENDING', 'RUNNING')) AS pending, count(*) FILTER (s IN ('COMPLETE', 'SKIPPED')) >= count(*) AS complete FROM j""")
def stage_coverage(spark, sf_dir) -> DataFrame:
    latest = stage_rows(spark, sf_dir).where("stage = 'OCR'").groupBy("id", "stage").agg(F.max_by("status", "event_id").alias("status"))
    return A.stage_coverage(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), latest, "OCR")


@query(f"""WITH {STAGE_SQL}, d AS (SELECT * FROM (VALUES ('OCR'), ('EMBEDDING'), ('FACES')) a(stage), (VALUES ('PENDING'), ('RUNNING'), ('COMPLETE'), ('SKIPPED'), ('FAILED_RETRYABLE')) b(status))
    SELECT d.stage, d.status, count(s.event_id) AS n FROM d LEFT JOIN stages s ON s.stage = d.stage AND s.status = d.status GROUP BY ALL""")
def coverage_matrix(spark, sf_dir) -> DataFrame:
    return A.coverage_matrix(stage_rows(spark, sf_dir), list(STAGES), list(STATUSES))


@query(f"""WITH {MEDIA_SQL} SELECT count(*) AS items, count(*) FILTER (kind = 'IMAGE') AS images, count(*) FILTER (kind = 'VIDEO') AS videos, count(*) FILTER (kind = 'PDF') AS documents, count(captured_ms) AS timed,
    count(quality) AS rated, count(*) FILTER (trim(text) <> '') AS with_text, count(DISTINCT CASE WHEN quality >= 1 THEN album END) AS good_albums, min(captured_ms) AS first_ms, max(captured_ms) AS last_ms FROM media""")
def catalogue_summary(spark, sf_dir) -> DataFrame:
    n = lambda c: F.count_if(c)
    return media(spark, sf_dir).agg(
        F.count("*").alias("items"), n(F.col("kind") == "IMAGE").alias("images"), n(F.col("kind") == "VIDEO").alias("videos"), n(F.col("kind") == "PDF").alias("documents"), F.count("captured_ms").alias("timed"),
        F.count("quality").alias("rated"), n(F.trim("text") != "").alias("with_text"), F.count_distinct(F.when(F.col("quality") >= 1, F.col("album"))).alias("good_albums"), F.min("captured_ms").alias("first_ms"), F.max("captured_ms").alias("last_ms"),
    )


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AS indexed, l_linestatus = 'F' AS exact, ['SUCCESS', 'PARTIAL', 'NOT_REQUIRED', 'FAILED'][l_partkey % 4 + 1] AS s, l_suppkey % 5 = 0 AS v, l_suppkey % 3 = 0 AS scan, l_partkey % 7 > 0 AS acc FROM lineitem)
    SELECT CASE WHEN NOT indexed OR NOT acc THEN 'PARTIAL_INDEX' WHEN v THEN 'ESTIMATED_FROM_RETRIEVAL' WHEN scan AND s = 'SUCCESS' THEN 'COMPLETE_PREDICATE_SCAN' WHEN exact THEN 'EXACT' WHEN s IN ('UNAVAILABLE', 'FAILED', 'PARTIAL') THEN 'PARTIAL_INDEX' ELSE 'ESTIMATED_FROM_RETRIEVAL' END AS exactness, count(*) AS n FROM c GROUP BY 1""")
def exactness_labels(spark, sf_dir) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("SUCCESS", "PARTIAL", "NOT_REQUIRED", "FAILED"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    label = A.exactness(F.col("l_returnflag") == "N", F.col("l_linestatus") == "F", status, F.col("l_suppkey") % 5 == 0, F.col("l_suppkey") % 3 == 0, F.col("l_partkey") % 7 > 0)
    return load(spark, sf_dir, "lineitem").groupBy(label.alias("exactness")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN c_custkey WHEN n > 12 THEN n WHEN c_acctbal > 5000 THEN c_nationkey ELSE coalesce(n, 0) END AS answer
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def count_precedence(spark, sf_dir) -> DataFrame:
    n = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = load(spark, sf_dir, "customer").join(n, "c_custkey", "left")
    pick = A.count_answer(F.when(F.col("c_custkey") % 11 == 0, F.col("c_custkey")), F.when(F.col("n") > 12, F.col("n")), F.when(F.col("c_acctbal") > 5000, F.col("c_nationkey").cast("long")), F.coalesce("n", F.lit(0)))
    return c.select("c_custkey", pick.alias("answer"))


@query(f"""WITH {STAGE_SQL}, c AS (SELECT stage, count(*) AS eligible, count(*) FILTER (status IN ('COMPLETE', 'SKIPPED')) AS covered, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status LIKE 'FAILED%') AS failed FROM stages GROUP BY stage)
    SELECT stage, CASE WHEN covered >= eligible THEN 'SUCCESS' WHEN covered > 0 THEN 'PARTIAL' ELSE 'UNAVAILABLE' END AS channel, CASE WHEN stage = 'FACES' THEN 'STOPPED_BY_USER' WHEN stage = 'OCR' AND pending > 0 THEN 'PAUSED_BY_USER' WHEN pending = 0 AND failed > 0 THEN 'DEGRADED' WHEN pending = 0 THEN 'COMPLETE' ELSE 'BACKOFF' END AS state,
      round(covered * 60000.0::DOUBLE / 3600000, 6) AS per_minute FROM c""")
def channel_and_pipeline_state(spark, sf_dir) -> DataFrame:
    s = F.col("status")
    c = stage_rows(spark, sf_dir).groupBy("stage").agg(F.count("*").alias("eligible"), F.count_if(s.isin("COMPLETE", "SKIPPED")).alias("covered"), F.count_if(s == "PENDING").alias("pending"), F.count_if(s.startswith("FAILED")).alias("failed"))
    yes, no = F.lit(True), F.lit(False)
    state = A.pipeline_state(F.col("stage") != "FACES", F.col("stage") == "OCR", no, no, no, F.col("pending"), F.col("failed"), yes, yes, F.lit(1))
    rate, _ = A.progress(F.col("covered"), F.col("pending"), F.lit(3_600_000))
    return c.select("stage", A.channel_status(yes, F.col("eligible"), F.col("covered")).alias("channel"), state.alias("state"), F.round(rate, 6).alias("per_minute"))


@query("""WITH t AS (SELECT c_custkey % 40 AS event_id, c_custkey AS id, c_nationkey FROM customer)
    SELECT count(*) AS items, min(captured_ms) AS first_ms, max(captured_ms) AS last_ms,
      (SELECT list(location ORDER BY seen, location) FROM (SELECT 'NATION_' || c_nationkey AS location, min(id) AS seen FROM t GROUP BY 1 ORDER BY seen, 1 LIMIT 4)) AS places,
      (SELECT list(DISTINCT n_name ORDER BY n_name) FROM t JOIN nation ON c_nationkey = n_nationkey) AS people, (SELECT list(id ORDER BY id) FROM (SELECT id FROM t ORDER BY id LIMIT 4)) AS representatives
    FROM (SELECT id * 1000 AS captured_ms FROM t)""")
def event_summary(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    items = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("position"), (F.col("c_custkey") * 1000).alias("captured_ms"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("location"))
    people = c.join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("name"))
    return A.event_summary(items, people)


@query("SELECT l_partkey AS id, count(*) AS times FROM lineitem GROUP BY 1 ORDER BY times DESC, id LIMIT 15")
def frequently_retrieved(spark, sf_dir) -> DataFrame:
    return A.frequently_retrieved(load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")), 15)


@query(f"""WITH {MEDIA_SQL} SELECT strftime(make_timestamp(captured_ms * 1000), '%Y-%m-%d') AS day, coalesce(nullif(trim(album), ''), nullif(trim(location), ''), 'Other') AS shelf, count(*) AS items FROM media WHERE captured_ms IS NOT NULL GROUP BY 1, 2""")
def library_shelves(spark, sf_dir) -> DataFrame:
    return A.shelves(media(spark, sf_dir))


EVIDENCE_SQL = """ev AS (SELECT l_orderkey AS media_id, l_linenumber AS n, ['MEDIA', 'EVENT', 'VISUAL_GROUP', 'EXACT_DUPLICATE_GROUP', 'QUERY_VERIFICATION'][l_suppkey % 5 + 1] AS scope, ['CONTEXTUAL', 'SAFE_FOR_EXACT_DUPLICATES', 'EXACT_DUPLICATE_SHARED', 'POSSIBLE_INFERENCE', NULL, 'DIRECT'][l_partkey % 6 + 1] AS applicability,
    l_orderkey + l_partkey % 2 AS evidence_media_id, ['visual_verification', 'event', 'ocr'][l_partkey % 3 + 1] AS source_field FROM lineitem)"""


@query(f"""WITH {EVIDENCE_SQL} SELECT media_id, n, CASE WHEN coalesce(applicability, '') IN ('CONTEXTUAL', 'EVENT_CONTEXT_ONLY', 'GROUP_CONTEXT_ONLY') THEN false WHEN scope IN ('EVENT', 'VISUAL_GROUP') THEN false
      WHEN scope = 'EXACT_DUPLICATE_GROUP' THEN coalesce(applicability, '') IN ('SAFE_FOR_EXACT_DUPLICATES', 'EXACT_DUPLICATE_SHARED') ELSE media_id = evidence_media_id END AS direct,
    CASE WHEN applicability = 'POSSIBLE_INFERENCE' THEN 3 WHEN source_field = 'visual_verification' THEN 0 WHEN scope IN ('MEDIA', 'QUERY_VERIFICATION') THEN 1 ELSE 2 END AS priority,
    scope <> 'VISUAL_GROUP' AND (scope <> 'EXACT_DUPLICATE_GROUP' OR applicability IS NOT DISTINCT FROM 'EXACT_DUPLICATE_SHARED') AND scope <> 'EVENT' AND source_field <> 'event' AS allowed FROM ev""")
def evidence_rules(spark, sf_dir) -> DataFrame:
    """Whether evidence is direct, its priority, and whether a question that isn't about an event admits it."""
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    ev = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").alias("n"), pick(("MEDIA", "EVENT", "VISUAL_GROUP", "EXACT_DUPLICATE_GROUP", "QUERY_VERIFICATION"), s % 5).alias("scope"),
        pick(("CONTEXTUAL", "SAFE_FOR_EXACT_DUPLICATES", "EXACT_DUPLICATE_SHARED", "POSSIBLE_INFERENCE", None, "DIRECT"), p % 6).alias("applicability"), (F.col("l_orderkey") + p % 2).alias("evidence_media_id"), pick(("visual_verification", "event", "ocr"), p % 3).alias("source_field"),
    )
    return ev.select("media_id", "n", P.direct_evidence().alias("direct"), P.evidence_priority().alias("priority"), P.evidence_allowed(False).alias("allowed"))


@query(f"""WITH {MEDIA_SQL}, f AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber > 3) SELECT id FROM media WHERE id IN (FROM f) OR contains(lower(concat_ws(' ', filename, title, array_to_string(tags, ' '))), 'src1')""")
def sold_by_merchant(spark, sf_dir) -> DataFrame:
    """SRC1 stands for a merchant: it is in the identity of some items, and a fact of those with a returned line beyond the third."""
    name = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") > 3), "The SRC1 Shop").otherwise("other")
    facts = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.lit("MERCHANT").alias("entity_type"), name.alias("raw_text"), F.lower(name).alias("normalized_value"))
    return P.sold_by(media(spark, sf_dir), facts, " src1 ").select("id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'NOT_REQUIRED' WHEN o_custkey % 5 >= 3 THEN 'COMPLETE' WHEN o_custkey % 5 > 0 THEN 'PARTIAL' ELSE 'UNAVAILABLE' END AS access FROM orders""")
def access_states(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), A.access_coverage(F.col("o_orderkey") % 4 > 0, F.col("o_custkey") % 5, F.lit(3)).alias("access"))


GATE_NAMES = ("receipt_1.jpg", "Invoice-7.png", "document.jpg", "MENU.jpg", "ticket.png", "boarding.jpg", "my_pass.jpg", "application_form.jpg", "text_scan.jpg", "touchscreen.jpg", "Screenshot_1.png", "screen_shot.png", "wifi.jpg", "calendar.png", "confirmation.jpg", "img.jpg", "IMG_2.png")
GATE_TAGS = ("Receipt paper", "invoice", "documents", "menu card", "Ticket", "boarding gate", "passport", "platform", "texture", "screen", "sky", "wifi", "calendar")


@query(f"""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'PDF' ELSE 'IMAGE' END AS kind, lower({list(GATE_NAMES)}[p_partkey % {len(GATE_NAMES)} + 1]) AS filename, lower({list(GATE_TAGS)}[p_partkey % {len(GATE_TAGS)} + 1]) AS tag, 900 + p_partkey % 7 * 100 AS width, 1600 + p_partkey % 11 * 100 AS height, p_size / 200.0::DOUBLE AS edges FROM part)
    SELECT id, CASE WHEN kind = 'PDF' THEN 100 ELSE CASE WHEN regexp_matches(filename, 'receipt|invoice|document|menu|ticket|boarding|pass|form|text|screen|screenshot|screen_shot|wifi|calendar|confirmation') THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(tag, 'receipt|invoice|document|menu|ticket|boarding|pass|form|text|screen') THEN 3 ELSE 0 END + CASE WHEN greatest(width, height, 1)::DOUBLE / greatest(least(width, height), 1) BETWEEN 1.45 AND 2.4 AND width * height >= 700000 THEN 1 ELSE 0 END + CASE WHEN edges >= 0.16 THEN 2 ELSE 0 END END AS score FROM p""")
def recognition_gate(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    one_of = lambda names: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    p = load(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 5 == 0, "PDF").otherwise("IMAGE").alias("kind"), one_of(GATE_NAMES).alias("filename"),
        F.array(one_of(GATE_TAGS)).alias("tags"), (k % 7 * 100 + 900).alias("width"), (k % 11 * 100 + 1600).alias("height"), (F.col("p_size") / 200.0).alias("edges"),
    )
    return p.select("id", P.text_likelihood(F.col("edges")).alias("score"))


@query("""SELECT o_orderkey AS id, round(CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 * 60000.0::DOUBLE / 90000 END, 6) AS per_minute, CASE WHEN o_custkey % 5 > 0 THEN ceil(o_orderkey % 9 * 60000.0::DOUBLE / (o_custkey % 5 * 60000.0::DOUBLE / 90000))::BIGINT END AS left_ms FROM orders""")
def progress_eta(spark, sf_dir) -> DataFrame:
    rate, eta = A.progress(F.col("o_custkey") % 5, F.col("o_orderkey") % 9, F.lit(90_000))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(rate, 6).alias("per_minute"), eta.cast("long").alias("left_ms"))
