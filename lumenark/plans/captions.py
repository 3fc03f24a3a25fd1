"""Caption search over the driver's tables: a document is a chunk and speaks for two items; every third is direct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import captions as K
from ..operators import expansion as E
from ..operators.retrieval import cosine
from ..registry import query
from ..sources.tables import load

ASKED = ("Show the Photos of tion", " the PHOTOS of TION ", "reont and haha", "please", "elle")
WORD = r"[\p{L}\p{M}\p{N}]+"


def _sql() -> str:
    """Postings, frequencies and scores of each variant's expressions."""
    asked = [(i, t) for i, t in enumerate(map(K.terms, K.variants(ASKED))) if t]
    rows = []
    for v, t in asked:
        shifted = ", ".join(f"w[{k + 1}:]" for k in range(len(t)))
        same = " AND ".join(f"x[{k + 1}] = '{y}'" for k, y in enumerate(t))
        expressions = ([f"len(list_filter(list_zip({shifted}), lambda x: {same}))"] if len(t) > 1 else []) + [f"len(list_filter(w, lambda x: starts_with(x, '{x}')))" for x in t]
        rows += [f"SELECT chunk_id, len(w) AS n, {v} AS variant, {e} AS expression, {x} AS tf FROM words" for e, x in enumerate(expressions)]
    return f"""words AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents),
    corpus AS (SELECT count(*) AS docs, greatest(sum(len(w)) // count(*), 1) AS mean FROM words),
    postings AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE tf > 0), frequency AS (SELECT variant, expression, count(*) AS df FROM postings GROUP BY ALL),
    found AS (SELECT chunk_id, variant, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(n, 1) / mean))) AS score
      FROM postings JOIN frequency USING (variant, expression), corpus GROUP BY ALL)"""


TARGETS_SQL = """targets AS (SELECT doc_id AS chunk_id, doc_id // 2 AS id, doc_id % 3 = 0 AS direct FROM documents UNION ALL SELECT doc_id, doc_id // 2 + 1, false FROM documents)"""
FUSED_SQL = """best AS (SELECT variant, id, round(max(score * CASE WHEN direct THEN 1.0::DOUBLE ELSE 0.72::DOUBLE END), 9) AS raw FROM found JOIN targets USING (chunk_id) WHERE id % 5 > 0 GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY raw DESC, id) AS place FROM best)
    SELECT id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score, max(raw) AS best FROM placed GROUP BY id ORDER BY 2 DESC, id LIMIT 500"""


def bound(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, the items they speak for, and the allowed items."""
    d = load(spark, sf_dir, "documents")
    half = F.expr("doc_id div 2")
    targets = d.select(F.col("doc_id").alias("chunk_id"), half.alias("id"), (F.col("doc_id") % 3 == 0).alias("direct")).unionByName(d.select(F.col("doc_id").alias("chunk_id"), (half + 1).alias("id"), F.lit(False).alias("direct")))
    return d.select(F.col("doc_id").alias("chunk_id"), "text"), targets, targets.where("id % 5 > 0").select("id")


@query(f"WITH {_sql()}, {TARGETS_SQL}, {FUSED_SQL}")
def caption_search(spark, sf_dir) -> DataFrame:
    return K.caption_search(*bound(spark, sf_dir), ASKED)


def _shares() -> str:
    asked = [(i, t) for i, t in enumerate(map(K.terms, K.variants(ASKED))) if t]
    return " UNION ALL ".join(f"SELECT doc_id AS chunk_id, {v} AS variant, ({' + '.join(f'''contains(lower(text), '{x}')::INT''' for x in t)}) / {len(t)}.0::DOUBLE AS score FROM documents" for v, t in asked)


@query(f"WITH found AS (SELECT * FROM ({_shares()}) WHERE score > 0), {TARGETS_SQL}, {FUSED_SQL}")
def caption_fallback(spark, sf_dir) -> DataFrame:
    chunks, targets, allowed = bound(spark, sf_dir)
    return K.search_or_fall_back(chunks, chunks, targets, allowed, ASKED, index_ok=False)[0]


CHUNKS_SQL = """chunks AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS caption_id, 'MEDIA' AS scope, conv_id AS scope_id, conv_id AS media_id, conv_id AS evidence_media_id, 'm' || conv_id % 2 AS caption_model_version, 'p1' AS caption_prompt_version,
      CASE WHEN turn % 2 = 0 THEN NULL ELSE 7 END AS generation_id, CASE WHEN turn % 5 = 4 THEN 'old' ELSE 'v1' END AS chunk_policy_version, CASE WHEN conv_id % 11 = 0 THEN 'STALE_PERSON_BINDING' ELSE 'DIRECT' END AS applicability, CASE WHEN turn % 3 = 0 THEN conv_id % 7 END AS cluster_id FROM conversations),
    captions AS (SELECT DISTINCT conv_id AS caption_id, 'MEDIA' AS scope, conv_id AS subject_id, conv_id AS evidence_media_id, 'm' || conv_id % 4 AS model_version, 'p1' AS prompt_version, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 7 END AS generation_id FROM conversations)"""


def caption_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t, c = load(spark, sf_dir, "conversations"), F.col("conv_id")
    name = lambda n: F.concat(F.lit("m"), (c % n).cast("string"))
    chunks = t.select(
        (c * 1000 + F.col("turn")).alias("chunk_id"), c.alias("caption_id"), F.lit("MEDIA").alias("scope"), c.alias("scope_id"), c.alias("media_id"), c.alias("evidence_media_id"), name(2).alias("caption_model_version"), F.lit("p1").alias("caption_prompt_version"),
        F.when(F.col("turn") % 2 == 1, 7).alias("generation_id"), F.when(F.col("turn") % 5 == 4, "old").otherwise("v1").alias("chunk_policy_version"), F.when(c % 11 == 0, K.STALE).otherwise("DIRECT").alias("applicability"), F.when(F.col("turn") % 3 == 0, c % 7).alias("cluster_id"),
    )
    captions = t.select(c.alias("caption_id"), F.lit("MEDIA").alias("scope"), c.alias("subject_id"), c.alias("evidence_media_id"), name(4).alias("model_version"), F.lit("p1").alias("prompt_version"), F.when(c % 3 > 0, 7).alias("generation_id")).distinct()
    return chunks, captions


@query(f"""WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks c JOIN captions k USING (caption_id) WHERE chunk_policy_version = 'v1' AND c.scope = k.scope AND c.scope_id = k.subject_id AND c.media_id = k.evidence_media_id AND c.evidence_media_id = k.evidence_media_id
    AND c.caption_model_version = k.model_version AND c.caption_prompt_version = k.prompt_version AND c.generation_id IS NOT DISTINCT FROM k.generation_id AND applicability <> 'STALE_PERSON_BINDING' AND (cluster_id IS NULL OR cluster_id IN (1, 2))""")
def current_chunks(spark, sf_dir) -> DataFrame:
    chunks, captions = caption_tables(spark, sf_dir)
    return K.searchable(K.current(chunks, captions, "v1"), (1, 2)).select("chunk_id")


@query(f"""WITH {CHUNKS_SQL} SELECT (EXISTS (SELECT 1 FROM captions WHERE caption_id % 3 = 5)) OR EXISTS (SELECT 1 FROM chunks WHERE applicability <> 'STALE_PERSON_BINDING' AND cluster_id = 3) AS backlog, EXISTS (SELECT 1 FROM chunks WHERE cluster_id = 99) AS none_left""")
def embedding_backlog(spark, sf_dir) -> DataFrame:
    chunks, captions = caption_tables(spark, sf_dir)
    captions = captions.withColumns({"chunk_policy_version": F.lit("v1"), "applicability": F.lit("DIRECT")})
    state = lambda n: chunks.withColumns({"embedding_state": F.when(F.col("cluster_id") == n, "PENDING").otherwise("COMPLETE"), "embedding_model_version": F.lit("e1")})
    return spark.createDataFrame([(K.has_backlog(captions, state(3), "v1"), K.has_backlog(captions, state(99), "v1"))], "backlog boolean, none_left boolean")


@query(f"""WITH {TARGETS_SQL}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    hits AS (SELECT vec_id AS chunk_id, round(list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)), 6) AS score FROM embeddings, q)
    SELECT id, round(max(score * CASE WHEN direct THEN 1.0::DOUBLE ELSE 0.72::DOUBLE END), 6) AS score FROM hits JOIN targets USING (chunk_id) WHERE id % 5 > 0 GROUP BY id""")
def caption_vector_hits(spark, sf_dir) -> DataFrame:
    _, targets, allowed = bound(spark, sf_dir)
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = [float(x) for x in vectors.where("chunk_id = 0").first().embedding]
    hits = cosine(vectors, asked).select("chunk_id", F.round("score", 6).alias("score"))
    return K.vector_hits(hits, targets, allowed).select("id", F.round("score", 6).alias("score"))


#: Questions of the conversations: their first words are terms, some with a concept, and some parts are clauses.
QUESTIONS_SQL = """t AS (SELECT conv_id * 1000 + turn AS id, trim(coalesce(text, '')) AS query, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w, (conv_id + turn) % 4 AS k FROM conversations),
    questions AS (SELECT id, query, CASE k WHEN 3 THEN 'SUM' ELSE 'FIND' END AS intent, CASE k WHEN 0 THEN ['Birthday'] || w[1:3] WHEN 1 THEN w[1:2] || ['holiday', 'birthday'] ELSE w[1:k] END AS terms,
      CASE k WHEN 0 THEN [{'text': 'Red ' || w[1], 'canonical': 'Canon ' || query, 'polarity': 'POSITIVE'}, {'text': 'no', 'canonical': NULL, 'polarity': 'NEGATIVE'}] WHEN 2 THEN [{'text': 'BIRTHDAY CAKE', 'canonical': NULL, 'polarity': 'POSITIVE'}] ELSE [] END AS clauses FROM t),
    concepts AS (SELECT 'birthday' AS term, unnest(range(4)) AS place, unnest(['birthday cake', 'birthday candles', 'birthday party', 'birthday celebration']) AS text UNION ALL SELECT 'holiday', 0, 'the sea')"""


@query(f"""WITH {QUESTIONS_SQL}, x AS (SELECT id, unnest(range(len(terms))) AS pos, unnest(terms) AS term FROM questions),
    e AS (SELECT id, list(text ORDER BY pos, place) AS queries FROM x JOIN concepts ON concepts.term = lower(x.term) GROUP BY id),
    a AS (SELECT id, list_filter(list_transform([query] || flatten(list_transform(list_filter(clauses, lambda c: c.polarity = 'POSITIVE'), lambda c: list_filter([c.text, c.canonical], lambda y: y IS NOT NULL))) || coalesce(queries, []), lambda y: trim(y)), lambda y: y <> '') AS v
      FROM questions LEFT JOIN e USING (id) WHERE (len(terms) > 0 OR len(clauses) > 0) AND NOT (intent = 'SUM' AND len(clauses) = 0)),
    d AS (SELECT id, list_filter(v, lambda y, i: list_position(list_transform(v, lambda z: lower(z)), lower(y)) = i)[1:8] AS v FROM a)
    SELECT id, unnest(range(len(v)))::INT AS place, sha256(unnest(v)) AS variant FROM d""")
def question_variants(spark, sf_dir) -> DataFrame:
    t, k = load(spark, sf_dir, "conversations"), (F.col("conv_id") + F.col("turn")) % 4
    w, body = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), F.trim(F.coalesce("text", F.lit("")))
    first = lambda n: F.slice(w, F.lit(1), F.least(F.lit(n), F.size(w)))
    terms = F.when(k == 0, F.concat(F.array(F.lit("Birthday")), first(3))).when(k == 1, F.concat(first(2), F.array(F.lit("holiday"), F.lit("birthday")))).otherwise(F.slice(w, F.lit(1), k.cast("int")))
    clause = lambda text, canonical, polarity: F.struct(text.alias("text"), canonical.cast("string").alias("canonical"), F.lit(polarity).alias("polarity"))
    none = F.lit(None)
    clauses = F.when(k == 0, F.array(clause(F.concat(F.lit("Red "), F.get(w, F.lit(0))), F.concat(F.lit("Canon "), body), "POSITIVE"), clause(F.lit("no"), none, "NEGATIVE"))).when(k == 2, F.array(clause(F.lit("BIRTHDAY CAKE"), none, "POSITIVE"))).otherwise(F.array().cast("array<struct<text:string,canonical:string,polarity:string>>"))
    questions = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), body.alias("query"), F.when(k == 3, "SUM").otherwise("FIND").alias("intent"), terms.alias("terms"), clauses.alias("clauses"))
    concepts = E.known_concepts(spark).unionByName(spark.createDataFrame([("holiday", 0, "QUERY", "the sea")], E.CONCEPT))
    return E.query_variants(questions, concepts).select("id", "place", F.sha2("variant", 256).alias("variant"))
