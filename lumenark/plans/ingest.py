"""Import, reconciliation, queues, result sets and metrics over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import retry_delay_ms, status_after_failure
from ..operators import ingest as G
from ..operators import metrics as M
from ..operators.retrieval import cosine
from ..registry import query
from ..sources.shared import remove, shared_folder, written
from ..sources.sinks import write_vectors
from ..sources.tables import epoch_ms, load, year_range
from ..streaming.scans import exhaustive_scan
from .answers import STAGE_SQL, stage_rows

NOW = 1_705_000_000_000
QUEUE_SQL = f"""queue AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'FAILED_RETRYABLE' ELSE 'RUNNING' END AS status, o_orderkey % 4 AS attempts, o_orderkey % 3 = 0 AS user_requested,
    CASE WHEN o_orderkey % 5 > 0 THEN {NOW} + (o_orderkey % 7 - 3) * 1000 END AS next_attempt_ms, CASE WHEN o_orderkey % 6 > 0 THEN {NOW} + (o_orderkey % 11 - 5) * 1000 END AS lease_ms, epoch_us(o_orderdate) // 1000 AS updated_ms,
    (o_custkey % 4 * 100)::INT AS priority, 'w' || o_custkey % 2 AS owner FROM orders)"""


def queue(spark, sf_dir) -> DataFrame:
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "F", "FAILED_RETRYABLE").otherwise("RUNNING").alias("status"), (k % 4).alias("attempts"), (k % 3 == 0).alias("user_requested"),
        F.when(k % 5 > 0, NOW + (k % 7 - 3) * 1000).alias("next_attempt_ms"), F.when(k % 6 > 0, NOW + (k % 11 - 5) * 1000).alias("lease_ms"), epoch_ms("o_orderdate").alias("updated_ms"),
        (F.col("o_custkey") % 4 * 100).cast("int").alias("priority"), F.concat(F.lit("w"), (F.col("o_custkey") % 2).cast("string")).alias("owner"),
    )


@query(f"""WITH {QUEUE_SQL} SELECT id, attempts + 1 AS attempts, 'RUNNING' AS status, 'worker-1' AS owner, {NOW} + 120000 AS lease_ms FROM queue WHERE status IN ('PENDING', 'FAILED_RETRYABLE') AND coalesce(next_attempt_ms, 0) <= {NOW}
    ORDER BY priority DESC, user_requested DESC, coalesce(next_attempt_ms, 0), updated_ms, id LIMIT 24""")
def queue_claim_order(spark, sf_dir) -> DataFrame:
    return G.claimed(queue(spark, sf_dir), "worker-1", NOW, 24).select("id", "attempts", "status", "owner", "lease_ms")


@query(f"""WITH {QUEUE_SQL}, l AS (SELECT *, status = 'RUNNING' AND (lease_ms IS NULL OR lease_ms <= {NOW}) AS lost FROM queue)
    SELECT id, CASE WHEN lost THEN 'PENDING' ELSE status END AS status, CASE WHEN lost THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts, CASE WHEN NOT lost THEN lease_ms END AS lease_ms FROM l""")
def queue_recovery(spark, sf_dir) -> DataFrame:
    return G.recovered(queue(spark, sf_dir), NOW).select("id", "status", "attempts", "lease_ms")


@query(f"""WITH {QUEUE_SQL}, f AS (SELECT o_orderkey AS id, 'w0' AS o, o_orderkey % 10 = 0 AS permanent FROM orders WHERE o_orderkey % 2 = 0), j AS (SELECT q.*, f.permanent, coalesce(q.owner = f.o, false) AS mine FROM queue q LEFT JOIN f USING (id)),
    s AS (SELECT *, CASE WHEN permanent THEN 'FAILED_PERMANENT' WHEN attempts >= 3 THEN 'FAILED_EXHAUSTED' ELSE 'FAILED_RETRYABLE' END AS new FROM j)
    SELECT id, CASE WHEN mine THEN new ELSE status END AS status, CASE WHEN mine AND new = 'FAILED_RETRYABLE' THEN {NOW} + 30000 * (1 << least(greatest(attempts - 1, 0), 2)::INT) ELSE next_attempt_ms END AS next_attempt_ms FROM s""")
def queue_failures(spark, sf_dir) -> DataFrame:
    q = queue(spark, sf_dir)
    f = q.where("id % 2 = 0").select("id", F.lit("w0").alias("owner"), (F.col("id") % 10 == 0).alias("permanent"))
    return G.failed(q, f, NOW).select("id", "status", "next_attempt_ms")


@query(f"""WITH {QUEUE_SQL} SELECT id, CASE WHEN id % 2 = 0 AND owner = 'w1' AND lease_ms > {NOW} AND status = 'RUNNING' THEN 'COMPLETE' ELSE status END AS status FROM queue""")
def queue_completion_fenced(spark, sf_dir) -> DataFrame:
    q = queue(spark, sf_dir)
    return G.completed(q, q.where("id % 2 = 0").select("id", F.lit("w1").alias("owner")), NOW).select("id", "status")


@query("""SELECT o_orderkey, 30000 * (1 << least(greatest(o_orderkey % 6 - 1, 0), 2)::INT) AS delay_ms, CASE WHEN o_orderkey % 9 = 0 THEN 'FAILED_PERMANENT' WHEN o_orderkey % 6 >= 3 THEN 'FAILED_EXHAUSTED' ELSE 'FAILED_RETRYABLE' END AS status FROM orders""")
def retry_backoff(spark, sf_dir) -> DataFrame:
    n = F.col("o_orderkey") % 6
    return load(spark, sf_dir, "orders").select("o_orderkey", retry_delay_ms(n).alias("delay_ms"), status_after_failure(n, F.col("o_orderkey") % 9 == 0).alias("status"))


@query("""SELECT c_custkey AS id, c_mktsegment AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'SEEN' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'DELETED' ELSE 'INACCESSIBLE' END AS state FROM customer""")
def reconcile_snapshot(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return G.reconcile(c, c.where("id % 3 = 0"), ["BUILDING", "MACHINERY"])


@query("""WITH o AS (SELECT c_custkey AS id, c_nationkey AS size FROM customer WHERE c_custkey % 4 < 3), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 8 = 1 THEN c_nationkey + 1 ELSE c_nationkey END AS size FROM customer WHERE c_custkey % 4 > 0)
    SELECT id, coalesce(n.size, o.size) AS size, CASE WHEN n.id IS NULL THEN 'KEPT' WHEN o.id IS NULL THEN 'INSERTED' WHEN o.size = n.size THEN 'TOUCHED' ELSE 'REPLACED' END AS action FROM o FULL JOIN n USING (id)""")
def upsert_import(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("size"))
    new = c.where("id % 4 > 0").withColumn("size", F.when(F.col("id") % 8 == 1, F.col("size") + 1).otherwise(F.col("size")))
    return G.upsert(c.where("id % 4 < 3"), new, "id", ["size"])


@query("""SELECT o_orderkey, 'uri-' || sha256('content/' || o_orderkey) AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE epoch_us(o_orderdate) // 1000 - CASE WHEN o_orderkey % 4 = 1 THEN 19800000 ELSE 0 END END AS captured_ms FROM orders""")
def import_ids_and_exif(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy:MM:dd HH:mm:ss")
    value, offset = F.when(k % 4 == 3, F.regexp_replace(text, ":", "-")).otherwise(text), F.when(k % 4 == 1, "+05:30")
    return load(spark, sf_dir, "orders").select("o_orderkey", G.imported_ids(F.concat(F.lit("content/"), k.cast("string"))).alias("id"), G.exif_ms(value, offset).alias("captured_ms"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 AND s_acctbal <= 5000 THEN 'INACCESSIBLE' WHEN s_suppkey % 3 = 0 THEN 'ACCESSIBLE' ELSE 'INACCESSIBLE' END AS access FROM supplier""")
def access_revoked(spark, sf_dir) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "ACCESSIBLE").otherwise("INACCESSIBLE").alias("access"), F.col("s_acctbal").alias("last_seen_ms"))
    return G.revoked(s, 5000).select("id", "access")


@query("SELECT c_custkey AS id, 'user' AS reason, 5::BIGINT AS removed_ms FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT c_custkey, 'left', 0 FROM customer WHERE c_custkey % 10 <> 1")
def delete_with_tombstones(spark, sf_dir) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    left, stones = G.removed(c, c.where("id % 10 = 1"), "user", 5)
    return stones.unionByName(left.select("id", F.lit("left").alias("reason"), F.lit(0).cast("long").alias("removed_ms")))


@query("""WITH s AS (SELECT unnest(['DISCOVERY', 'METADATA', 'THUMBNAIL', 'VIDEO_KEYFRAMES', 'EMBEDDING', 'OCR', 'FACES', 'EVENTS', 'ENRICHMENT']) AS stage)
    SELECT s_suppkey AS id, stage, 'PENDING' AS status FROM supplier, s WHERE NOT (s_suppkey % 2 = 0 AND stage IN ('OCR', 'FACES'))""")
def missing_stages(spark, sf_dir) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return G.missing_stages(s, s.where("id % 2 = 0").select("id", F.explode(F.array(F.lit("OCR"), F.lit("FACES"))).alias("stage")))


@query(f"""WITH {STAGE_SQL}, d AS (SELECT id, arg_max(status, event_id) AS status FROM stages WHERE stage = 'EMBEDDING' GROUP BY id) SELECT id, 'PENDING' AS status FROM d WHERE status IN ('COMPLETE', 'SKIPPED') AND id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)""")
def requeue_missing_vectors(spark, sf_dir) -> DataFrame:
    done = stage_rows(spark, sf_dir).where("stage = 'EMBEDDING'").groupBy("id").agg(F.max_by("status", "event_id").alias("status"))
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "v2").otherwise("v1").alias("producer_version"))
    return G.requeued(done, vectors, "v2")


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version, round(CASE WHEN vec_id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END, 6) AS first FROM embeddings WHERE label < 8""")
def vector_upsert(spark, sf_dir) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("version"), "embedding", "label")
    new = v.where("id % 3 = 0").select("id", F.lit(2).alias("version"), F.transform("embedding", lambda x: -x).alias("embedding"))
    out = G.latest_vectors(v.drop("label"), new, v.where("label < 8"))
    return out.select("id", "version", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query("""SELECT conv_id AS session_id, turn AS set_id FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn * 10 DESC, turn DESC) <= 3""")
def result_sets_kept(spark, sf_dir) -> DataFrame:
    s = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("set_id"), (F.col("turn") * 10).alias("created_ms"))
    return G.kept_result_sets(s, 3).select("session_id", "set_id")


@query("""WITH l AS (SELECT conv_id, max(turn) AS latest FROM conversations GROUP BY 1) SELECT conv_id AS session_id, latest + 1 AS set_id, latest AS parent_id FROM l WHERE conv_id % 2 = 0""")
def result_set_compare_and_set(spark, sf_dir) -> DataFrame:
    s = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("set_id"), F.col("turn").alias("created_ms"))
    last = s.groupBy("session_id").agg(F.max("set_id").alias("m"))
    new = last.select("session_id", (F.col("m") + 1).alias("set_id"), F.when(F.col("session_id") % 2 == 0, F.col("m")).otherwise(F.col("m") - 1).alias("parent_id"))
    return G.accepted_results(s, new)


@query("""SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN 1000 WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 900 ELSE 800 END WHEN 2 THEN 600 WHEN 3 THEN 500 WHEN 4 THEN 400 ELSE CASE WHEN o_orderkey % 2 = 0 THEN 700 ELSE 100 END END::INT AS priority FROM orders""")
def job_priority(spark, sf_dir) -> DataFrame:
    reasons = F.array(*map(F.lit, ("interactive query", "personal_memory", "frequently_retrieved", "diverse_event_representative", "burst of frames", "other")))
    return load(spark, sf_dir, "orders").select("o_orderkey", G.priority(F.element_at(reasons, (F.col("o_custkey") % 6 + 1).cast("int")), F.col("o_orderkey") % 2 == 0).alias("priority"))


@query("""WITH j AS (SELECT 'event' AS source, o_custkey AS id, max(o_totalprice) AS score, 0 AS place FROM orders GROUP BY o_custkey UNION ALL SELECT 'burst', c_custkey, c_acctbal, 1 FROM customer UNION ALL SELECT 'outlier', s_suppkey, s_acctbal, 2 FROM supplier),
    k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, id) <= CASE source WHEN 'event' THEN 48 WHEN 'burst' THEN 20 ELSE 16 END)
    SELECT id, source, score, place FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, score DESC) = 1""")
def enrichment_plan(spark, sf_dir) -> DataFrame:
    ev = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("score")).withColumn("source", F.lit("event"))
    cu = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), F.lit("burst").alias("source"))
    su = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"), F.lit("outlier").alias("source"))
    return G.enrichment_plan(ev.unionByName(cu).unionByName(su), {"event": 48, "burst": 20, "outlier": 16})


@query("""SELECT (SELECT count(*) FROM orders) AS eligible, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS indexed, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 49) AS hits,
    CASE WHEN (SELECT count(DISTINCT l_orderkey) FROM lineitem) >= (SELECT count(*) FROM orders) THEN 'COMPLETE' ELSE 'PARTIAL' END AS status""")
def exhaustive_scan_state(spark, sf_dir) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_quantity")
    out = G.scan_state(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), lines.select("id"), lines.where("l_quantity > 49").select("id"), "all red cars", "m1")
    return out.drop("scope_hash", "coverage_hash")


@query("""SELECT o_orderkey AS media_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (3, 4)) THEN 'STALE' ELSE 'READY' END AS state FROM orders""")
def invalidation_cascade(spark, sf_dir) -> DataFrame:
    captions = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media_id"), F.lit("READY").alias("state"))
    refs = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.col("l_suppkey").alias("cluster_id"))
    return G.invalidated(captions, refs, refs.where("cluster_id in (3, 4)"))


RANKED_SQL = """ranked AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), rel AS (SELECT d.source AS query_id, d.doc_id AS id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1),
    per AS (SELECT w.query_id, coalesce(b.returned, 0) AS returned, coalesce(b.found, 0) AS found, w.relevant, b.first FROM (SELECT query_id, count(*) AS relevant FROM rel GROUP BY 1) w LEFT JOIN
      (SELECT r.query_id, count(*) AS returned, count(rel.id) AS found, min(CASE WHEN rel.id IS NOT NULL THEN rank END) AS first FROM ranked r LEFT JOIN rel ON rel.query_id = r.query_id AND rel.id = r.id WHERE rank <= 10 GROUP BY 1) b USING (query_id)),
    m AS (SELECT *, found / returned::DOUBLE AS p, found / relevant::DOUBLE AS r, coalesce(1.0::DOUBLE / first, 0) AS rr FROM per)"""


@query(f"""WITH {RANKED_SQL} SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1, round(avg(rr), 6) AS mrr,
    round(sum(found) / sum(returned)::DOUBLE, 6) AS micro_precision, round(sum(found) / sum(relevant)::DOUBLE, 6) AS micro_recall FROM m""")
def recall_mrr_f1(spark, sf_dir) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), place.alias("rank"))
    relevant = docs.join(labels.where("quality = 1"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"))
    out = M.summary(M.per_query(ranked, relevant)).drop("micro_f1")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95 FROM orders")
def latency_percentiles(spark, sf_dir) -> DataFrame:
    return M.nearest_rank(load(spark, sf_dir, "orders"), "o_totalprice", [0.5, 0.95])


@query(None)
def rouge_of_answers(spark, sf_dir) -> DataFrame:
    """ROUGE of each answer against the question before it; the tests hold it against a plain version."""
    c = load(spark, sf_dir, "conversations")
    asked = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    out = M.rouge_scores(c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(asked, ["conv_id", "turn"]))
    return out.select("conv_id", "turn", F.round("rouge.rouge1", 6).alias("rouge1"), F.round("rouge.rouge2", 6).alias("rouge2"), F.round("rouge.rougeL", 6).alias("rougeL"))


@query("""SELECT o_orderkey AS media_id, l_linenumber AS n, l_suppkey AS cluster_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT (l_suppkey IN (3, 4) AND o_orderkey % 2 = 0)""")
def invalidation_drops(spark, sf_dir) -> DataFrame:
    """Lines stand for person facts, references and chunks; an edit names clusters 3 and 4 in even items."""
    refs = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("cluster_id"))
    return G.without_person(refs, refs.where("cluster_id in (3, 4) and media_id % 2 = 0"))


@query("""SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 > 0 AND o_custkey > 0 THEN o_custkey END, CASE WHEN o_orderkey % 5 - 1 > 0 THEN o_orderkey % 5 - 1 END, CASE WHEN o_orderkey > 0 THEN o_orderkey END) AS captured_ms FROM orders""")
def capture_times(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(k.alias("id"), G.captured_at(F.when(k % 3 > 0, F.col("o_custkey")).otherwise(-1), k % 5 - 1, k).alias("captured_ms"))


@query("""SELECT o_orderpriority AS kind FROM orders GROUP BY 1 HAVING bool_and(o_orderkey > 0) AND bool_and(NOT (o_orderpriority = '5-LOW' AND o_custkey % 7 = 0))""")
def covered_kinds(spark, sf_dir) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    low = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_custkey") % 7 == 0)
    return G.covered_kinds(o.select(F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderkey") > 0, "FULL").otherwise("PARTIAL").alias("permission"), (~low).alias("completed")))


@query("""SELECT l_orderkey AS id, ['DISCOVERY', 'METADATA', 'OCR', 'FACES', 'EVENTS', 'EMBEDDING', 'ENRICHMENT'][l_linenumber] AS stage, CASE WHEN o_custkey % 3 = 0 AND l_linenumber > 1 THEN 'PENDING' ELSE 'COMPLETE' END AS status, CASE WHEN o_custkey % 3 = 0 AND l_linenumber > 1 THEN 0 ELSE l_linenumber END::INT AS attempts
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def reset_stages(spark, sf_dir) -> DataFrame:
    """Stages of replaced items start anew."""
    names = F.array(*map(F.lit, ("DISCOVERY", "METADATA", "OCR", "FACES", "EVENTS", "EMBEDDING", "ENRICHMENT")))
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.element_at(names, F.col("l_linenumber").cast("int")).alias("stage"), F.lit("COMPLETE").alias("status"), F.col("l_linenumber").cast("int").alias("attempts"))
    changed = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 == 0, "REPLACED").otherwise("TOUCHED").alias("action"))
    return G.reset_stages(rows, changed)


@query("""WITH gone AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey % 10 = 1)
    SELECT 'item' AS what, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders WHERE o_orderkey NOT IN (FROM gone) UNION ALL SELECT 'posting', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (FROM gone)
    UNION ALL SELECT 'member', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_linenumber = 1 AND l_orderkey NOT IN (FROM gone) UNION ALL SELECT 'tombstone', count(*), sum(id)::BIGINT FROM gone""")
def removal_everywhere(spark, sf_dir) -> DataFrame:
    """What is left of items, postings and event members, and the tombstones."""
    items, line = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    parts = G.removed_everywhere(items, line, line.where("l_linenumber = 1"), items.where("o_custkey % 10 = 1"), "USER", NOW)
    counts = [p.agg(F.lit(name).alias("what"), F.count("*").alias("n"), F.sum("id").alias("ids")) for name, p in zip(("item", "posting", "member", "tombstone"), parts, strict=True)]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("""WITH jobs AS (SELECT o_orderkey AS id, ['PENDING', 'COMPLETE', 'FAILED', 'RUNNING'][o_custkey % 4 + 1] AS status, o_custkey % 5 = 0 AS user_requested, o_custkey % 3 AS attempts FROM orders),
    plan AS (SELECT DISTINCT l_partkey AS id, l_partkey % 2 = 0 AS asked FROM lineitem)
    SELECT coalesce(j.id, p.id) AS id, CASE WHEN j.id IS NULL OR (coalesce(asked, false) AND status IN ('COMPLETE', 'FAILED')) THEN 'PENDING' ELSE status END AS status, coalesce(user_requested, false) OR coalesce(asked, false) AS user_requested,
      CASE WHEN j.id IS NULL OR (coalesce(asked, false) AND status IN ('COMPLETE', 'FAILED')) THEN 0 ELSE attempts END AS attempts FROM jobs j FULL JOIN plan p ON j.id = p.id""")
def replanned_jobs(spark, sf_dir) -> DataFrame:
    c = F.col("o_custkey")
    states = F.array(*map(F.lit, ("PENDING", "COMPLETE", "FAILED", "RUNNING")))
    jobs = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(states, (c % 4 + 1).cast("int")).alias("status"), (c % 5 == 0).alias("user_requested"), (c % 3).alias("attempts"))
    plan = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_partkey") % 2 == 0).alias("user_requested")).distinct()
    return G.replanned(jobs, plan)


@query(f"""WITH {QUEUE_SQL}, ok AS (SELECT id, id % 3 AS generation FROM queue WHERE status = 'RUNNING' AND lease_ms > {NOW} AND owner = 'w1')
    SELECT 'facts' AS what, id, generation, 'f' || n AS value FROM ok, (VALUES (1), (2)) v(n) UNION ALL SELECT 'captions', id, generation, 'c' || id FROM ok UNION ALL SELECT 'refs', id, generation, 'r' FROM ok
    UNION ALL SELECT 'chunks', id, generation, 'k' FROM ok UNION ALL SELECT 'stages', id, generation, 'COMPLETE' FROM ok""")
def completed_enrichment(spark, sf_dir) -> DataFrame:
    """Worker w1 hands in results for all jobs; only those that it runs under a valid lease are written."""
    q, one = queue(spark, sf_dir), lambda x: F.array(F.lit(x))
    results = q.select("id", F.lit("w1").alias("owner"), (F.col("id") % 3).alias("generation"), F.array(F.lit("f1"), F.lit("f2")).alias("facts"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("caption"), one("r").alias("refs"), one("k").alias("chunks"))
    out = None
    for name, rows in G.completion_frames(q, results, NOW).items():
        part = rows.select(F.lit(name).alias("what"), "id", "generation", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {QUEUE_SQL} SELECT id AS chunk_id, CASE WHEN status = 'RUNNING' AND lease_ms > {NOW} AND owner = 'w1' AND id % 3 = id % 2 THEN 'COMPLETE' ELSE status END AS status FROM queue""")
def chunk_completion_fence(spark, sf_dir) -> DataFrame:
    """Owner and version must both agree."""
    version = lambda n: F.concat(F.lit("v"), (F.col("id") % n).cast("string")).alias("producer_version")
    q = queue(spark, sf_dir)
    chunks = q.select(F.col("id").alias("chunk_id"), "status", "owner", "lease_ms", version(3))
    return G.versioned_completion(chunks, q.select(F.col("id").alias("chunk_id"), F.lit("w1").alias("owner"), version(2)), NOW).select("chunk_id", "status")


ASKED_SQL = """asked AS (SELECT l_orderkey AS concept, ['en', 'hi', 'mixed'][l_linenumber % 3 + 1] AS lang, CASE WHEN l_suppkey % 9 > 0 THEN l_partkey % 12 + 1 END AS rank FROM lineitem)"""


def asked(spark, sf_dir) -> DataFrame:
    """Lines stand for questions: an order is asked for in several languages, and found at a rank, or not."""
    lang = F.element_at(F.array(F.lit("en"), F.lit("hi"), F.lit("mixed")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("concept"), lang.alias("lang"), F.when(F.col("l_suppkey") % 9 > 0, F.col("l_partkey") % 12 + 1).alias("rank"))


@query(f"WITH {ASKED_SQL} SELECT lang, round(avg((coalesce(rank, 6) <= 5)::INT), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM asked GROUP BY lang")
def recall_by_language(spark, sf_dir) -> DataFrame:
    return M.by_language(asked(spark, sf_dir)).select("lang", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query(f"WITH {ASKED_SQL} SELECT concept, CASE WHEN count(*) = count(rank) THEN max(rank) - min(rank) END AS spread FROM asked GROUP BY concept")
def language_rank_spread(spark, sf_dir) -> DataFrame:
    return M.rank_spread(asked(spark, sf_dir))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders), r AS (SELECT year, epoch_ms(make_timestamp(year, 1, 1, 0, 0, 0.0)) - 19800000 AS start_ms, epoch_ms(make_timestamp(year + 1, 1, 1, 0, 0, 0.0)) - 19800000 AS end_ms FROM y)
    SELECT year, start_ms, end_ms, count(o_orderkey) AS items FROM r LEFT JOIN orders ON epoch_ms(o_orderdate::TIMESTAMP) >= start_ms AND epoch_ms(o_orderdate::TIMESTAMP) < end_ms GROUP BY ALL""")
def calendar_years(spark, sf_dir) -> DataFrame:
    """Orders of each calendar year of a clock in India, five and a half hours ahead."""
    o = load(spark, sf_dir, "orders")
    start, end = year_range(F.col("year"), "Asia/Kolkata")
    years = o.select(F.year("o_orderdate").alias("year")).distinct().select("year", start.alias("start_ms"), end.alias("end_ms"))
    ms = epoch_ms("o_orderdate")
    local = F.year(F.from_utc_timestamp(F.timestamp_millis(ms), "Asia/Kolkata"))  # an equi-join: the year of the same clock
    n = o.groupBy(local.alias("year")).agg(F.count("*").alias("items"))
    return years.join(n, "year", "left").select("year", "start_ms", "end_ms", F.coalesce("items", F.lit(0).cast("long")).alias("items"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)), 6) AS score FROM embeddings, q
    WHERE vec_id % 3 > 0 AND list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)) >= 0.1""")
def resumed_scan(spark, sf_dir) -> DataFrame:
    """All vectors of a scope that match a question, by a scan that is stopped early and gone on with."""
    folder = f"{shared_folder(spark)}/lumenark-scan-{uuid.uuid4().hex}"
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    write_vectors(vectors, f"{folder}/vectors", 8)
    asked = [float(x) for x in vectors.where("id = 0").first().embedding]
    matching = lambda rows: cosine(rows, asked).where("score >= 0.1").select("id", "score")
    scan = lambda **k: exhaustive_scan(f"{folder}/scans", f"{folder}/vectors", vectors.where("id % 3 > 0").select("id"), matching, "like the first", "m1", files_a_batch=2, **k)
    scan(most_batches=1)
    found = written(scan().hits.select("id", F.round("score", 6).alias("score")), "hits")
    remove(spark, folder)
    return found
