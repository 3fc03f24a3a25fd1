"""Filters, channels and fusion over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import filters, retrieval as R
from ..operators.sets import best_parent, corroborated, people_scope
from ..registry import query
from ..sources.tables import MEDIA_SQL, epoch_ms, load, media

START, END = 1704412800000, 1705276800000  # 2024-01-05 to 2024-01-15
TERMS = ("the", "and", "que", "der")
QUERY_VECTOR = "SELECT embedding AS q FROM embeddings WHERE vec_id = 0"


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The stand-in for an encoded question: one stored vector."""
    return [float(x) for x in load(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@query(f"""SELECT event_id, event_type, epoch_us(ts) // 1000 AS captured_ms FROM events
    WHERE ts IS NOT NULL AND epoch_us(ts) // 1000 BETWEEN {START} AND {END} AND lower(event_type) = 'click'""")
def filter_time_kind(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "event_type", epoch_ms("ts").alias("captured_ms"))
    return e.where(filters.time_range(START, END) & (F.lower("event_type") == "click"))


@query(f"""WITH {MEDIA_SQL} SELECT id, kind, album FROM media
    WHERE (kind = 'PDF' OR trim(text) <> '' OR regexp_matches(lower(filename || ' ' || title || ' ' || array_to_string(tags, ' ')), 'receipt|invoice|document|ticket|boarding|menu|screenshot|wifi|confirmation'))
      AND captured_ms IS NOT NULL AND captured_ms >= 1704067200000 AND lower(album) = 'src3'""")
def scope_documents_album(spark, sf_dir) -> DataFrame:
    scope = filters.Scope(media="DOCUMENTS", start_ms=1704067200000, album=" SRC3 ")
    return filters.eligible(media(spark, sf_dir), scope).select("id", "kind", "album")


@query(f"""WITH {MEDIA_SQL} SELECT id, filename FROM media
    WHERE regexp_matches(regexp_replace(lower(filename || ' ' || title || ' ' || album || ' ' || array_to_string(tags, ' ')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '\\b(?:screenshots?|screen\\s+shots?|screen\\s+captures?)\\b')
      AND (contains(lower(location), 'nation_1') OR contains(lower(album), 'nation_1') OR contains(lower(title), 'nation_1') OR contains(lower(filename), 'nation_1') OR list_contains(tags, 'nation_1'))""")
def scope_screenshots_place(spark, sf_dir) -> DataFrame:
    return filters.eligible(media(spark, sf_dir), filters.Scope(place="Nation_1", screenshots=True)).select("id", "filename")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)
    AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def scope_semi_anti(spark, sf_dir) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    out = load(spark, sf_dir, "orders").select("o_orderkey")
    out = out.join(lines.where("l_quantity >= 45").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return out.join(lines.where("l_returnflag = 'R'").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("""WITH p AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)
    SELECT l_orderkey AS id FROM p GROUP BY l_orderkey HAVING bool_or(l_suppkey % 10 IN (1, 2, 3)) AND bool_or(l_suppkey % 10 IN (4, 5)) AND NOT bool_or(l_suppkey % 10 = 7)""")
def people_and_or_not(spark, sf_dir) -> DataFrame:
    presence = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("person_id"), F.col("l_orderkey").alias("id"))
    clauses = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "a", True), (4, "b", True), (5, "b", True), (7, "c", False)], "person_id long, grp string, must boolean")
    return people_scope(presence, clauses)


@query("""SELECT o_orderkey, o_custkey, price, line FROM (SELECT o.o_orderkey, o.o_custkey, l.l_extendedprice AS price, l.l_linenumber AS line,
    row_number() OVER (PARTITION BY o.o_orderkey ORDER BY l.l_extendedprice DESC, l.l_linenumber) AS r FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey) WHERE r = 1""")
def keyframe_parent_best(spark, sf_dir) -> DataFrame:
    frames = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("price"), F.col("l_linenumber").alias("line"))
    return best_parent(frames, load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "price", "line")


def _points(term: str) -> str:
    fields = " + ".join(f"CASE WHEN contains(lower({c}), '{term}') THEN {w} ELSE 0 END" for c, w in (("location", 7), ("title", 4), ("description", 2), ("text", 10)))
    return f"(CASE WHEN list_contains(tags, '{term}') THEN 8 WHEN len(list_filter(tags, lambda x: contains(lower(x), '{term}') OR contains('{term}', lower(x)))) > 0 THEN 5 ELSE 0 END + {fields})"


def _any_token(terms) -> str:
    return f"list_has_any(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), {list(terms)})"


@query(f"""WITH {MEDIA_SQL}, s AS (SELECT id, title, {_points('src1')} + {_points('ention')} + CASE WHEN {_any_token(('src1', 'ention'))} THEN 3 ELSE 0 END AS points FROM media)
    SELECT id, points::DOUBLE AS score FROM s WHERE points > 0""")
def lexical_field_score(spark, sf_dir) -> DataFrame:
    items, terms = media(spark, sf_dir), ("src1", "ention")
    return R.field_score(items, terms, R.any_token(items, terms)).select("id", "score")


@query(f"""SELECT doc_id AS id FROM documents WHERE {_any_token(('hand', 'over', 'que'))}""")
def token_hits(spark, sf_dir) -> DataFrame:
    return R.any_token(load(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), ("hand", "over", "que"))


BM25_SQL = f"""words AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS w FROM documents),
    corpus AS (SELECT count(*) AS docs, greatest(floor(sum(len(w)) / count(*)), 1) AS mean FROM words),
    postings AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM words) WHERE term IN {TERMS} GROUP BY ALL),
    freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    bm25 AS (SELECT id, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(n, 1) / mean))) AS score
             FROM postings JOIN freq USING (term), corpus GROUP BY id)"""


@query(f"WITH {BM25_SQL} SELECT id, round(score, 6) AS score FROM bm25 ORDER BY score DESC, id LIMIT 50")
def bm25_topk(spark, sf_dir) -> DataFrame:
    scores = R.bm25(load(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), TERMS)
    return R.top(scores.withColumn("score", F.round("score", 6)), "score", 50)


COSINE_SQL = f"""cosine AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) AS score
    FROM embeddings, ({QUERY_VECTOR}))"""


@query(f"WITH {COSINE_SQL} SELECT id, round(score, 6) AS score FROM cosine ORDER BY score DESC, id LIMIT 20")
def cosine_topk(spark, sf_dir) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return R.top(R.cosine(vectors, query_vector(spark, sf_dir)).select("id", F.round("score", 6).alias("score")), "score", 20)


@query(f"WITH {COSINE_SQL} SELECT id, round(score, 6) AS score FROM cosine WHERE round(score, 6) >= 0.2")
def cosine_threshold_scan(spark, sf_dir) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return R.cosine(vectors, query_vector(spark, sf_dir)).select("id", F.round("score", 6).alias("score")).where("score >= 0.2")


@query(f"""WITH q AS (SELECT vec_id AS variant, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 3),
    s AS (SELECT variant, vec_id AS id, round(list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)), 6) AS score FROM embeddings, q),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY score DESC, id) AS r FROM s) WHERE r <= 50 AND score >= 0.1),
    f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS fused, max(score) AS best FROM k GROUP BY id)
    SELECT id, fused, best FROM f""")
def vector_variants_fused(spark, sf_dir) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    asked = [(r.id, [float(x) for x in r.embedding]) for r in vectors.where("id < 3").orderBy("id").collect()]  # a question's variants, at most eight
    out = R.search_variants(vectors, {str(v): q for v, q in asked}, 50, 0.1)
    return out.select("id", F.round("score", 9).alias("fused"), "best")


KEYFRAMES_SQL = """keyframes AS (SELECT doc_id // 2 AS id, [lang, source] AS labels, text FROM documents WHERE doc_id % 3 > 0)"""


def _frames(term: str) -> str:
    return f"CASE WHEN kind = 'VIDEO' AND coalesce(bool_or(contains(lower(k.text), '{term}') OR len(list_filter(labels, lambda x: contains(lower(x), '{term}') OR contains('{term}', lower(x)))) > 0), false) THEN 12 ELSE 0 END"


@query(f"""WITH {MEDIA_SQL}, {KEYFRAMES_SQL}, f AS (SELECT m.id, {_frames('src1')} + {_frames('ention')} AS frames FROM media m LEFT JOIN keyframes k ON k.id = m.id GROUP BY m.id, m.kind),
    s AS (SELECT id, {_points('src1')} + {_points('ention')} + frames AS points FROM media JOIN f USING (id)) SELECT id, points::DOUBLE AS score FROM s WHERE points > 0""")
def lexical_with_keyframes(spark, sf_dir) -> DataFrame:
    """Frames of a clip are the documents of twice its number; the link is synthetic."""
    d = load(spark, sf_dir, "documents")
    frames = d.where("doc_id % 3 > 0").select(F.expr("doc_id div 2").alias("id"), F.array("lang", "source").alias("labels"), "text")
    return R.field_score(media(spark, sf_dir), ("src1", "ention"), keyframes=frames).select("id", "score")


RRF_SQL = f"""WITH {BM25_SQL}, {COSINE_SQL},
    lex AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM bm25 QUALIFY r <= 100),
    vec AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM cosine QUALIFY r <= 100),
    f AS (SELECT id, sum(w / (60 + r)) AS score FROM (SELECT id, r, 1.0::DOUBLE AS w FROM lex UNION ALL SELECT id, r, 0.85::DOUBLE FROM vec) GROUP BY id)
    SELECT id, round(score, 9) AS score FROM f ORDER BY round(score, 9) DESC, id LIMIT 20"""


@query(RRF_SQL)
def rrf_two_channel(spark, sf_dir) -> DataFrame:
    """Lexical and vector channels fused; that a document and the vector of its number are one item is synthetic."""
    docs = load(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    lexical = R.top(R.bm25(docs, TERMS).withColumn("score", F.round("score", 6)), "score", 100).withColumn("channel", F.lit("lexical"))
    vectors = load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    semantic = R.top(R.cosine(vectors, query_vector(spark, sf_dir)).select("id", F.round("score", 6).alias("score")), "score", 100).withColumn("channel", F.lit("image_semantic"))
    fused = R.fuse(lexical.unionByName(semantic), R.channel_weights(spark))
    return R.top(fused.withColumn("score", F.round("score", 9)), "score", 20)


@query(f"""WITH {MEDIA_SQL}, {BM25_SQL}, {COSINE_SQL},
    lexical AS (SELECT id, ({_points('src1')})::DOUBLE AS score FROM media WHERE {_points('src1')} > 0),
    event AS (SELECT event_id AS id, value AS score FROM events WHERE event_type = 'purchase'),
    other AS (SELECT id, -score AS score FROM cosine),
    c AS (SELECT 'lexical' AS channel, 1.0::DOUBLE AS w, id, round(score, 6) AS score FROM lexical UNION ALL SELECT 'event', 0.95, id, round(score, 6) FROM event
          UNION ALL SELECT 'image_semantic', 0.85, id, round(score, 6) FROM cosine UNION ALL SELECT 'caption', 0.80, id, round(score, 6) FROM bm25 UNION ALL SELECT 'caption_vector', 0.75, id, round(score, 6) FROM other),
    r AS (SELECT channel, w, id, row_number() OVER (PARTITION BY channel ORDER BY score DESC, id) AS r FROM c QUALIFY r <= 100)
    SELECT id, round(sum(w / (60 + r)), 9) AS score FROM r GROUP BY id""")
def rrf_weighted_five(spark, sf_dir) -> DataFrame:
    items, docs = media(spark, sf_dir), load(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    near = R.cosine(load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), query_vector(spark, sf_dir)).select("id", "score")
    channels = {
        "lexical": R.field_score(items, ("src1",)), "event": load(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("value").alias("score")),
        "image_semantic": near, "caption": R.bm25(docs, TERMS), "caption_vector": near.withColumn("score", -F.col("score")),
    }
    hits = None
    for name, scores in channels.items():
        best = R.top(scores.select("id", F.round("score", 6).alias("score")), "score", 100).withColumn("channel", F.lit(name))
        hits = best if hits is None else hits.unionByName(best)
    return R.fuse(hits, R.channel_weights(spark)).withColumn("score", F.round("score", 9))


@query(f"""WITH {MEDIA_SQL}, {BM25_SQL} SELECT id, captured_ms, row_number() OVER (ORDER BY captured_ms DESC NULLS LAST, round(score, 6) DESC, id) AS place FROM bm25 JOIN media USING (id) QUALIFY place <= 30""")
def sort_by_capture_time(spark, sf_dir) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    hits = R.bm25(docs, TERMS).withColumn("score", F.round("score", 6)).join(media(spark, sf_dir).select("id", "captured_ms"), "id")
    first = R.sort_hits(hits, "CAPTURE_TIME_DESC").limit(30)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("captured_ms"), F.desc("score"), "id"))  # of the 30 rows
    return first.select("id", "captured_ms", place.alias("place"))


@query(f"""WITH {MEDIA_SQL}, {BM25_SQL} SELECT id, coalesce(quality, 0) AS quality FROM bm25 JOIN media USING (id) ORDER BY coalesce(quality, 0) DESC, round(score, 6) DESC, id LIMIT 25""")
def sort_by_quality(spark, sf_dir) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    hits = R.bm25(docs, TERMS).withColumn("score", F.round("score", 6)).join(media(spark, sf_dir).select("id", "quality"), "id")
    return R.sort_hits(hits, "QUALITY").limit(25).select("id", F.coalesce("quality", F.lit(0.0)).alias("quality"))


@query(f"""WITH {COSINE_SQL}, {MEDIA_SQL}, lex AS (SELECT id FROM media WHERE {_points('src1')} > 0), ev AS (SELECT event_id AS id FROM events WHERE event_type = 'purchase')
    SELECT id FROM cosine WHERE round(score, 6) >= 0 AND (id IN (SELECT id FROM lex) OR id IN (SELECT id FROM ev))""")
def followup_corroboration(spark, sf_dir) -> DataFrame:
    near = R.cosine(load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), query_vector(spark, sf_dir)).where("round(score, 6) >= 0").select("id")
    lexical = R.field_score(media(spark, sf_dir), ("src1",))
    return corroborated(near, lexical, load(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id")), scoped=True)
