"""Identity clusters over ``embeddings`` (label = cluster), and people of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc
from ..operators import identity as I
from ..operators.sets import (
    chunk_targets, closed_citations, content_classes, exact_siblings, index_state, match_faces, merged_evidence, resolve_people, reusable, shared_facts, vector_ids,
)
from ..registry import query
from ..sources.tables import load

FACE_SQL = """face AS (SELECT vec_id AS face_id, vec_id // 3 AS media_id, label AS cluster_id, embedding::DOUBLE[] AS vector, vec_id % 100 = 0 AS asked FROM embeddings)"""


def faces(spark, sf_dir) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("face_id"), F.floor(F.col("vec_id") / 3).alias("media_id"), F.col("label").alias("cluster_id"), F.col("embedding").alias("vector"))


@query(f"""WITH {FACE_SQL}, s AS (SELECT q.face_id AS query_id, f.face_id, f.cluster_id, round(list_dot_product(f.vector, q.vector), 6) AS score FROM face f JOIN face q ON q.asked WHERE f.face_id <> q.face_id),
    near AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, face_id) <= 12),
    c AS (SELECT query_id, cluster_id, max(score) AS best, count(*) FILTER (score >= 0.40) AS support FROM near GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, cluster_id) AS r, lead(best) OVER (PARTITION BY query_id ORDER BY best DESC, cluster_id) AS second FROM c)
    SELECT query_id, best, support, CASE WHEN best >= 0.45 AND (support >= 2 OR best >= 0.58) AND coalesce(best - second >= 0.05, true) THEN cluster_id END AS cluster_id FROM r WHERE r = 1""")
def resolve_face_cluster(spark, sf_dir) -> DataFrame:
    f = faces(spark, sf_dir)
    asked = f.where("face_id % 100 = 0").select(F.col("face_id").alias("query_id"), "vector")
    return I.nearest_clusters(I.nearest_faces(asked, f))


@query(f"""WITH {FACE_SQL}, s AS (SELECT q.face_id AS query_id, f.face_id, round(list_dot_product(f.vector, q.vector), 6) AS score FROM face f JOIN face q ON q.asked WHERE f.face_id <> q.face_id)
    SELECT query_id, arg_max(face_id, (score, -face_id)) AS face_id, max(score) AS score FROM s GROUP BY 1""")
def nearest_face(spark, sf_dir) -> DataFrame:
    f = faces(spark, sf_dir)
    asked = f.where("face_id % 100 = 0").select(F.col("face_id").alias("query_id"), "vector")
    return I.nearest_face(I.nearest_faces(asked, f, 1))


@query(f"""WITH {FACE_SQL} SELECT face_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY face_id * 37 % 101 DESC, face_id) AS place FROM face QUALIFY place <= 3""")
def first_faces(spark, sf_dir) -> DataFrame:
    return I.first_faces(faces(spark, sf_dir).withColumn("quality", F.col("face_id") * 37 % 101), 3).select("face_id", "cluster_id", "place")


@query(f"""WITH {FACE_SQL} SELECT face_id FROM face WHERE cluster_id = 1 ORDER BY face_id * 37 % 101 DESC, face_id LIMIT 5 OFFSET 4""")
def face_page(spark, sf_dir) -> DataFrame:
    return I.face_page(faces(spark, sf_dir).withColumn("quality", F.col("face_id") * 37 % 101), 1, limit=5, offset=4).select("face_id")


@query("""WITH c AS (SELECT s_suppkey AS id, s_name AS label, CASE WHEN s_suppkey = 5 THEN 'Me' WHEN s_suppkey % 3 = 0 THEN 'friend' END AS rel, s_suppkey % 2 = 0 AS reviewed, s_suppkey % 11 = 0 AS hidden, ['REVIEW', 'HIDE', 'UNLABEL', NULL][s_nationkey % 4 + 1] AS action, s_suppkey % 10 = 8 AS me FROM supplier),
    t AS (SELECT max(id) AS me FROM c WHERE action = 'REVIEW' AND c.me)
    SELECT c.id AS cluster_id, CASE action WHEN 'REVIEW' THEN 'new ' || c.id WHEN 'UNLABEL' THEN NULL ELSE label END AS label, CASE WHEN action = 'REVIEW' AND NOT (c.me AND c.id <> t.me) THEN CASE WHEN c.me THEN 'me' ELSE 'family' END
      WHEN action IN ('REVIEW', 'UNLABEL') THEN NULL WHEN t.me IS NOT NULL AND t.me <> c.id AND lower(rel) = 'me' THEN NULL ELSE rel END AS relationship,
      CASE action WHEN 'REVIEW' THEN true WHEN 'UNLABEL' THEN false ELSE reviewed END AS reviewed, hidden OR coalesce(action = 'HIDE', false) AS hidden FROM c, t""")
def edited_clusters(spark, sf_dir) -> DataFrame:
    """Of several reviews as ``me`` that of the greatest id holds; the cluster that was ``me`` is so no longer."""
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    clusters = s.select(k.alias("cluster_id"), F.col("s_name").alias("label"), F.when(k == 5, "Me").when(k % 3 == 0, "friend").alias("relationship"), (k % 2 == 0).alias("reviewed"), (k % 11 == 0).alias("hidden"))
    action = F.element_at(F.array(F.lit("REVIEW"), F.lit("HIDE"), F.lit("UNLABEL"), F.lit(None)), (F.col("s_nationkey") % 4 + 1).cast("int"))
    edits = s.select(k.alias("cluster_id"), action.alias("action"), F.concat(F.lit("new "), k.cast("string")).alias("label"), F.when(k % 10 == 8, "me").otherwise("family").alias("relationship")).where("action is not null")
    return I.edited_clusters(clusters, edits)


@query(f"""WITH {FACE_SQL} SELECT face_id, CASE WHEN face_id % 6 = 1 THEN face_id % 4 ELSE cluster_id END AS cluster_id, face_id % 17 = 0 OR face_id % 6 = 1 AS corrected FROM face""")
def moved_faces(spark, sf_dir) -> DataFrame:
    f = faces(spark, sf_dir).select("face_id", "cluster_id", (F.col("face_id") % 17 == 0).alias("corrected"))
    return I.moved_faces(f, f.where("face_id % 6 = 1").select("face_id", (F.col("face_id") % 4).alias("target")))


@query(f"""WITH {FACE_SQL}, seed AS (SELECT * FROM face WHERE cluster_id = 1 ORDER BY face_id LIMIT 8), one AS (SELECT vector AS o FROM seed WHERE face_id = (SELECT min(face_id) FROM seed)), near AS (SELECT face_id, CASE WHEN face_id % 7 = 2 THEN list_transform(list_zip(vector, o), lambda x: (x[1] + x[2]) / 1.5::DOUBLE) ELSE vector END AS vector FROM face, one),
    s AS (SELECT f.face_id, round(list_dot_product(f.vector, s.vector), 6) AS score FROM near f, seed s WHERE f.face_id NOT IN (SELECT face_id FROM seed)),
    t AS (SELECT face_id, list(score ORDER BY score DESC) AS l FROM s GROUP BY 1)
    SELECT face_id, l[1] AS best FROM t WHERE l[1] >= 0.58 OR (l[2] >= 0.46 AND (l[1] + l[2]) / 2 >= 0.50)""")
def identity_expand(spark, sf_dir) -> DataFrame:
    f = faces(spark, sf_dir)
    seeds = f.where("cluster_id = 1").orderBy("face_id").limit(I.SEEDS)
    # every seventh face is brought near the first seed, so that there is something to find
    one = F.broadcast(seeds.orderBy("face_id").limit(1).select(F.col("vector").alias("o")))
    f = f.crossJoin(one).withColumn("vector", F.when(F.col("face_id") % 7 == 2, F.zip_with("vector", "o", lambda x, y: ((x.cast("double") + y.cast("double")) / 1.5).cast("double"))).otherwise(F.col("vector").cast("array<double>"))).drop("o")  # a row
    scores = I.similarities(seeds.select(F.col("face_id").alias("query_id"), "vector"), f.join(F.broadcast(seeds.select("face_id")), "face_id", "left_anti"))
    return I.expansion(scores.withColumn("score", F.round("score", 6)))


@query(f"""WITH {FACE_SQL}, r AS (SELECT cluster_id, min(face_id) AS representative FROM face GROUP BY 1), s AS (SELECT f.face_id, f.cluster_id, r.representative, f.face_id % 17 = 0 AS corrected, CASE WHEN f.face_id % 5 > 0 THEN round(list_dot_product(f.vector, g.vector), 6) END AS score
      FROM face f JOIN r USING (cluster_id) JOIN face g ON g.face_id = r.representative)
    SELECT face_id, kept, CASE WHEN kept THEN cluster_id::VARCHAR ELSE 'quarantine:' || cluster_id END AS cluster_id FROM (SELECT *, face_id = representative OR corrected OR score IS NULL OR score >= 0.42 AS kept FROM s)""")
def cluster_refinement(spark, sf_dir) -> DataFrame:
    f = faces(spark, sf_dir)
    head = f.groupBy("cluster_id").agg(F.min("face_id").alias("representative"), F.min_by("vector", "face_id").alias("r"))
    m = f.join(head, "cluster_id").select("face_id", "cluster_id", "representative", (F.col("face_id") % 17 == 0).alias("corrected"), F.when(F.col("face_id") % 5 > 0, F.round(I.dot(F.col("vector"), F.col("r")), 6)).alias("score"))
    return I.refined(m).select("face_id", "kept", "cluster_id")


def _clusters(spark, sf_dir) -> DataFrame:
    c = faces(spark, sf_dir).select("cluster_id").distinct()
    return c.select("cluster_id", F.concat(F.lit("Person "), F.col("cluster_id").cast("string")).alias("label"), (F.col("cluster_id") % 2 == 0).alias("reviewed"), (F.col("cluster_id") % 7 == 6).alias("hidden"))


@query(f"""WITH {FACE_SQL}, b AS (SELECT cluster_id, count(*) AS faces, count(DISTINCT media_id) AS items, arg_max(media_id, (face_id * 10, media_id)) AS latest_id FROM face GROUP BY 1)
    SELECT cluster_id, 'Person ' || cluster_id AS label, cluster_id % 2 = 0 AS reviewed, faces, items, latest_id FROM b WHERE cluster_id % 7 <> 6 AND (cluster_id % 2 = 0 OR items >= 5)""")
def cluster_summaries(spark, sf_dir) -> DataFrame:
    return I.cluster_summaries(faces(spark, sf_dir).withColumn("captured_ms", F.col("face_id") * 10), _clusters(spark, sf_dir))


@query(f"""WITH {FACE_SQL} SELECT media_id, cluster_id, 'Person ' || cluster_id AS label, count(*) AS faces FROM face WHERE cluster_id % 2 = 0 AND cluster_id % 7 <> 6 GROUP BY ALL""")
def people_of_media(spark, sf_dir) -> DataFrame:
    return I.people_of_media(faces(spark, sf_dir), _clusters(spark, sf_dir))


@query(f"""WITH {FACE_SQL}, x AS (SELECT *, ((face_id * 37) % 100) / 100.0::DOUBLE AS l, cluster_id % 2 = 0 AS reviewed FROM face),
    f AS (SELECT *, CASE WHEN reviewed THEN min((l, face_id)) OVER (PARTITION BY media_id, reviewed, cluster_id) ELSE (l, face_id) END AS k FROM x)
    SELECT media_id, face_id, CASE WHEN reviewed THEN 'P' ELSE 'U' END || dense_rank() OVER (PARTITION BY media_id, reviewed ORDER BY k) AS name FROM f""")
def verification_labels(spark, sf_dir) -> DataFrame:
    f = faces(spark, sf_dir).withColumn("left", (F.col("face_id") * 37 % 100) / 100.0).withColumn("reviewed", F.col("cluster_id") % 2 == 0)
    return I.verification_labels(f)


@query("""SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 3 AND l_linenumber < 5 AND l_orderkey % 2 = 0""")
def media_of_person(spark, sf_dir) -> DataFrame:
    clusters = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("cluster_id"), "s_name", F.lit("friend").alias("relationship"), F.array(F.concat(F.lit(" Nation "), F.col("s_nationkey").cast("string"))).alias("aliases"), F.lit(True).alias("reviewed"), F.lit(False).alias("hidden")
    ).withColumnRenamed("s_name", "label")
    shown = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster_id"), F.col("l_orderkey").alias("id"), (F.col("l_linenumber") < 5).alias("usable"))
    items = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2 == 0).alias("accessible"))
    return resolve_people("NATION 3", clusters, shown, items)


BOX = "box AS (SELECT l_orderkey AS media_id, l_linenumber AS face_id, (l_extendedprice % 1000) / 2500.0::DOUBLE AS x, (l_extendedprice % 777) / 2500.0::DOUBLE AS y, l_suppkey % 2 AS side FROM lineitem)"


@query(f"""WITH {BOX}, p AS (SELECT a.media_id, a.face_id, b.face_id AS detected_id, greatest(0, least(a.x, b.x) + 0.3 - greatest(a.x, b.x)) * greatest(0, least(a.y, b.y) + 0.3 - greatest(a.y, b.y)) AS i FROM box a JOIN box b USING (media_id) WHERE a.side = 0 AND b.side = 1)
    SELECT media_id, face_id, detected_id, round(i / (0.18 - i), 4) AS iou FROM p WHERE i / (0.18 - i) >= 0.35 QUALIFY row_number() OVER (PARTITION BY media_id, face_id ORDER BY round(i / (0.18 - i), 9) DESC, detected_id) = 1""")
def face_overlap_match(spark, sf_dir) -> DataFrame:
    x, y = F.col("l_extendedprice") % 1000 / 2500.0, F.col("l_extendedprice") % 777 / 2500.0
    b = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").alias("face_id"), (F.col("l_suppkey") % 2).alias("side"), F.struct(x.alias("left"), y.alias("top"), (x + 0.3).alias("right"), (y + 0.3).alias("bottom")).alias("box")
    )
    return match_faces(b.where("side = 0"), b.where("side = 1")).withColumn("iou", F.round("iou", 4))


def contents(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"), "lang")


@query("""SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS class FROM documents WHERE text IS NOT NULL""")
def content_classes_of(spark, sf_dir) -> DataFrame:
    return content_classes(contents(spark, sf_dir))


@query("""SELECT d.doc_id AS id, s.doc_id AS sibling FROM documents d JOIN documents s ON d.text = s.text WHERE d.doc_id % 100 = 0""")
def exact_siblings_of(spark, sf_dir) -> DataFrame:
    """The siblings of the items that are asked for, one in a hundred, against all items."""
    return exact_siblings(content_classes(contents(spark, sf_dir)), contents(spark, sf_dir).where("id % 100 = 0"))


@query("""WITH c AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY text) AS class FROM documents WHERE text IS NOT NULL)
    SELECT class, 'lang' AS predicate, lang AS value, min(doc_id) AS given_by, 'EXACT_DUPLICATE_SHARED' AS applicability FROM c WHERE doc_id % 2 = 0 GROUP BY class, lang""")
def facts_of_siblings(spark, sf_dir) -> DataFrame:
    """Facts by class of content; who is in a class is in ``content_classes_of``."""
    docs = contents(spark, sf_dir)
    facts = docs.select("id", F.lit("lang").alias("predicate"), F.col("lang").alias("value"), F.when(F.col("id") % 2 == 0, "SAFE_FOR_EXACT_DUPLICATES").otherwise("MEDIA_ONLY").alias("applicability"), F.lit("MEDIA").alias("scope"))
    return shared_facts(facts, content_classes(docs))


BINDINGS = """[{'label': 'P1', 'cluster_id': o_custkey % 2, 'box': {'left': 0.1::DOUBLE, 'top': 0.2::DOUBLE, 'right': 0.5::DOUBLE, 'bottom': 0.6 + o_orderkey % 3 / 20000.0::DOUBLE}}]"""


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_custkey // 4 AS digest, o_orderkey % 2 = 0 AS done, o_orderkey % 100 AS updated_ms, {BINDINGS} AS b FROM orders),
    p AS (SELECT t.id, s.id AS source_id, s.updated_ms FROM o t JOIN o s ON t.digest = s.digest AND NOT t.done AND s.done AND t.b[1].cluster_id = s.b[1].cluster_id AND abs(t.b[1].box.bottom - s.b[1].box.bottom) <= 1e-4)
    SELECT id, arg_max(source_id, (updated_ms, -source_id)) AS source_id FROM p GROUP BY id""")
def reused_enrichment(spark, sf_dir) -> DataFrame:
    o, k, c = load(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    box = F.struct(F.lit(0.1).alias("left"), F.lit(0.2).alias("top"), F.lit(0.5).alias("right"), (F.lit(0.6) + k % 3 / 20000.0).alias("bottom"))
    rows = o.select(k.alias("id"), F.floor(c / 4).cast("string").alias("digest"), (k % 2 == 0).alias("done"), (k % 100).alias("updated_ms"), F.array(F.struct(F.lit("P1").alias("label"), (c % 2).alias("cluster_id"), box.alias("box"))).alias("bindings"))
    return reusable(rows.where("not done"), rows.where("done"), content_classes(rows))


@query("""SELECT DISTINCT v FROM (SELECT doc_id::VARCHAR AS v FROM documents UNION ALL SELECT event_id || '#' || user_id FROM events)""")
def stored_vector_ids(spark, sf_dir) -> DataFrame:
    frames = load(spark, sf_dir, "events").select(F.col("event_id").alias("media_id"), F.col("user_id").alias("at_ms"))
    return vector_ids(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), frames).withColumnRenamed("vector_id", "v")


@query("""WITH i AS (SELECT vec_id AS id FROM embeddings), e AS (SELECT doc_id AS id FROM documents WHERE lang = 'en'), v AS (SELECT doc_id AS id FROM documents), x AS (SELECT doc_id AS id FROM labels), a AS (SELECT id FROM i UNION SELECT id FROM e UNION SELECT id FROM v UNION SELECT id FROM x)
    SELECT id, id IN (FROM i) AND id IN (FROM e) AS searchable, id IN (FROM i) AND id NOT IN (FROM v) AS orphan, id IN (FROM x) AND id NOT IN (FROM i) AS missing FROM a""")
def vector_index_state(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return index_state(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), d.where("lang = 'en'"), d, load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id * 1000 + turn AS ev, ['MEDIA', 'EXACT_DUPLICATE_GROUP', 'EVENT'][conv_id % 3 + 1] AS scope, conv_id AS scope_id FROM conversations)
    SELECT chunk_id, ev AS id FROM c WHERE scope IN ('MEDIA', 'EVENT') UNION SELECT chunk_id, s_suppkey FROM c JOIN supplier ON s_suppkey // 3 = scope_id WHERE scope = 'EXACT_DUPLICATE_GROUP' UNION SELECT chunk_id, c_custkey FROM c JOIN customer ON c_custkey // 5 = scope_id WHERE scope = 'EVENT'""")
def caption_chunk_targets(spark, sf_dir) -> DataFrame:
    """Every turn is a chunk; a conversation's group has three copies, or five members."""
    scope = F.element_at(F.array(F.lit("MEDIA"), F.lit("EXACT_DUPLICATE_GROUP"), F.lit("EVENT")), (F.col("conv_id") % 3 + 1).cast("int"))
    number = F.col("conv_id") * 1000 + F.col("turn")
    chunks = load(spark, sf_dir, "conversations").select(number.alias("chunk_id"), number.alias("evidence_media_id"), scope.alias("scope"), F.col("conv_id").alias("scope_id"))
    copies = load(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 3").alias("scope_id"), F.col("s_suppkey").alias("id"))
    members = load(spark, sf_dir, "customer").select(F.expr("c_custkey div 5").alias("scope_id"), F.col("c_custkey").alias("id"))
    return chunk_targets(chunks, copies, members)


EVIDENCE_SQL = """p AS (SELECT l_orderkey AS media_id, l_partkey AS evidence_id, 0 AS source FROM lineitem), s AS (SELECT l_orderkey AS media_id, l_suppkey AS evidence_id, 1 AS source FROM lineitem)"""
MERGED_SQL = "o AS (SELECT media_id, evidence_id, min(source) AS source FROM e GROUP BY ALL) SELECT media_id, count(*) AS evidence, sum(source)::BIGINT AS supplemental FROM o GROUP BY 1"


def _evidence(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    line = load(spark, sf_dir, "lineitem")
    one = lambda c, text: line.select(F.col("l_orderkey").alias("media_id"), F.col(c).alias("evidence_id"), F.concat(F.lit(text), "l_returnflag").alias("text"))
    return one("l_partkey", "p"), one("l_suppkey", "s")


def _sizes(merged: DataFrame) -> DataFrame:
    return merged.select("media_id", F.size("evidence").cast("long").alias("evidence"), F.aggregate("evidence", F.lit(0).cast("long"), lambda a, x: a + x["source"]).alias("supplemental"))


@query(f"WITH {EVIDENCE_SQL}, e AS (FROM p UNION ALL FROM s), {MERGED_SQL}")
def evidence_merge(spark, sf_dir) -> DataFrame:
    return _sizes(merged_evidence(*_evidence(spark, sf_dir)))


@query(f"WITH {EVIDENCE_SQL}, h AS (SELECT media_id FROM s WHERE evidence_id IN (3, 5)), e AS (FROM p UNION ALL (SELECT * FROM s WHERE media_id IN (FROM h))), {MERGED_SQL}")
def citation_closure(spark, sf_dir) -> DataFrame:
    primary, supplemental = _evidence(spark, sf_dir)
    return _sizes(closed_citations(primary, supplemental, supplemental.where("evidence_id in (3, 5)")))


@query("""SELECT c_custkey, lower(nfc_normalize(trim(regexp_replace(c_mktsegment, '\\s+', ' ', 'g')))) || ' ' || ['k2', 'fi', 'é 5', 'ｘ'][c_custkey % 4 + 1].replace('ｘ', 'x') AS name FROM customer""")
def normal_names(spark, sf_dir) -> DataFrame:
    """Names with compatibility forms: a superscript, a ligature, a combining accent with a full-width digit, a full-width letter."""
    odd = F.element_at(F.array(F.lit("  K\u00b2"), F.lit(" \ufb01 "), F.lit("\u00a0E\u0301 \uff15"), F.lit("\t\uff38")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", nfkc(F.concat("c_mktsegment", F.lit(" "), odd)).alias("name"))
