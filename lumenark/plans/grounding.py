"""Claims over the conversations: each turn gives claims about the turn before, right ones and such that say more."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import grounding as G
from ..operators.patches import active_plans
from ..registry import query
from ..sources.tables import load

_CLAIMS_SQL = """t AS (SELECT conv_id AS packet_id, turn, max(text) AS text FROM conversations GROUP BY ALL),
    packets AS (SELECT packet_id, 'photos with hats in May' AS query, 'Verified 3 results' AS headline, max(text) FILTER (turn = 0) AS detail FROM t GROUP BY packet_id),
    evidence AS (SELECT packet_id, 'T' || turn AS evidence_id, text, turn % 3 AS priority, 1 - turn / 100.0::DOUBLE AS confidence, turn % 5 = 4 AS uncertain FROM t),
    claims AS (SELECT packet_id * 1000 + turn AS claim_id, packet_id, k, CASE k WHEN 0 THEN before WHEN 1 THEN text WHEN 2 THEN before || ' 42.50' WHEN 3 THEN 'Possibly 3.0 hats in May, ' || before WHEN 4 THEN before || ' on Friday' ELSE 'Hats ' || before || ' file://x' END AS text,
      CASE WHEN packet_id % 11 = 3 THEN ['T' || turn - 1, 'X'] ELSE ['T' || turn - 1] END AS evidence_ids
      FROM (SELECT *, lag(text) OVER (PARTITION BY packet_id ORDER BY turn) AS before, (packet_id + turn) % 6 AS k FROM t) WHERE before IS NOT NULL)"""


def _sql() -> str:
    words = lambda c: f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '{G.WORD}'), lambda w: length(w) >= 3 AND w NOT IN {G.STOP_WORDS})"
    numbers = lambda c: rf"regexp_extract_all(coalesce({c}, ''), '(?:^|[^\p{{L}}\p{{N}}])([-+]?\d[\d,]*(?:\.\d+)?)', 1)"
    dates = lambda c: f"list_transform(regexp_extract_all(coalesce({c}, ''), '{G.CALENDAR}'), lambda w: lower(w))"
    key = "coalesce(TRY_CAST(replace({0}, ',', '') AS DECIMAL(38,12))::VARCHAR, replace({0}, ',', ''))"
    said = lambda f: f"SELECT claim_id, packet_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT *, {f('text')} AS w FROM claims)"
    paths = " OR ".join(f"regexp_matches(text, '{p}')" for p in G.PATHS)
    return f"""WITH {_CLAIMS_SQL},
    pieces AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY packet_id ORDER BY priority, confidence DESC, evidence_id) <= 24),
    cited AS (SELECT claim_id, packet_id, unnest(range(len(evidence_ids))) AS pos, unnest(evidence_ids) AS evidence_id FROM claims),
    said AS ({said(words)}), general AS (SELECT DISTINCT packet_id, unnest({words('query')} || {words('headline')}) AS token FROM packets), own AS (SELECT DISTINCT packet_id, evidence_id, unnest({words('text')}) AS token FROM pieces),
    sourced AS (SELECT claim_id, token FROM said JOIN general USING (packet_id, token) UNION SELECT s.claim_id, s.token FROM said s JOIN cited c USING (claim_id) JOIN own o ON o.packet_id = s.packet_id AND o.evidence_id = c.evidence_id AND o.token = s.token),
    texts AS (SELECT packet_id, concat_ws(' ', query, headline, detail) AS text FROM packets UNION ALL SELECT packet_id, text FROM pieces),
    numbers AS (SELECT DISTINCT packet_id, {key.format('n')} AS key FROM (SELECT packet_id, unnest({numbers('text')}) AS n FROM texts)), dates AS (SELECT DISTINCT packet_id, unnest({dates('text')}) AS key FROM texts),
    faults AS (SELECT claim_id, 0 AS v, arg_min(evidence_id, pos) AS token FROM cited WHERE (packet_id, evidence_id) NOT IN (SELECT packet_id, evidence_id FROM pieces) GROUP BY claim_id
      UNION ALL SELECT claim_id, 1, NULL FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM sourced)
      UNION ALL SELECT claim_id, 2, arg_min(token, pos) FROM said WHERE token NOT IN {G.SAFE_WORDS} AND (claim_id, token) NOT IN (SELECT claim_id, token FROM sourced) GROUP BY claim_id
      UNION ALL SELECT claim_id, 3, NULL FROM claims WHERE NOT regexp_matches(text, '{G.UNCERTAIN}') AND claim_id IN (SELECT claim_id FROM cited JOIN pieces USING (packet_id, evidence_id) WHERE uncertain)
      UNION ALL SELECT claim_id, 4, arg_min(token, pos) FROM ({said(numbers)}) WHERE (packet_id, {key.format('token')}) NOT IN (SELECT packet_id, key FROM numbers) GROUP BY claim_id
      UNION ALL SELECT claim_id, 5, arg_min(token, pos) FROM ({said(dates)}) WHERE (packet_id, token) NOT IN (SELECT packet_id, key FROM dates) GROUP BY claim_id
      UNION ALL SELECT claim_id, 6, NULL FROM claims WHERE {paths}),
    f AS (SELECT claim_id, min(v) AS v FROM faults GROUP BY claim_id)
    SELECT c.claim_id, CASE WHEN f.v IS NULL THEN 'GROUNDED' ELSE {list(G.VERDICTS)}[f.v + 1] END AS verdict, (SELECT max(x.token) FROM faults x WHERE x.claim_id = c.claim_id AND x.v = f.v) AS token FROM claims c LEFT JOIN f USING (claim_id)"""


def tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims, packets and evidence."""
    t = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("packet_id"), "turn").agg(F.max("text").alias("text"))
    packets = t.groupBy("packet_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("detail")).withColumns({"query": F.lit("photos with hats in May"), "headline": F.lit("Verified 3 results")})
    piece = lambda n: F.concat(F.lit("T"), n.cast("string"))
    evidence = t.select("packet_id", piece(F.col("turn")).alias("evidence_id"), "text", (F.col("turn") % 3).alias("priority"), (1 - F.col("turn") / 100.0).alias("confidence"), (F.col("turn") % 5 == 4).alias("uncertain"))
    k, before = (F.col("packet_id") + F.col("turn")) % 6, F.col("before")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = F.when(k == 0, before).when(k == 1, F.col("text")).when(k == 2, say(before, " 42.50")).when(k == 3, say("Possibly 3.0 hats in May, ", before)).when(k == 4, say(before, " on Friday")).otherwise(say("Hats ", before, " file://x"))
    claims = t.withColumn("before", F.lag("text").over(Window.partitionBy("packet_id").orderBy("turn"))).where("before is not null")
    ids = F.when(F.col("packet_id") % 11 == 3, F.array(piece(F.col("turn") - 1), F.lit("X"))).otherwise(F.array(piece(F.col("turn") - 1)))
    return claims.select((F.col("packet_id") * 1000 + F.col("turn")).alias("claim_id"), "packet_id", text.alias("text"), ids.alias("evidence_ids")), packets, evidence


@query(_sql())
def grounded_claims(spark, sf_dir) -> DataFrame:
    return G.judged_claims(*tables(spark, sf_dir))


@query("""WITH RECURSIVE p AS (SELECT conv_id AS session_id, turn AS set_id, turn AS created_ms, CASE WHEN turn = 0 THEN NULL WHEN turn % 4 = 3 THEN turn - 2 WHEN turn % 4 = 0 THEN turn - 2 ELSE turn - 1 END AS parent_id, ['TIME', 'PLACE', 'SORT'][turn % 3 + 1] AS field,
      CASE turn % 5 WHEN 4 THEN 'REMOVE' WHEN 3 THEN 'REPLACE' ELSE 'ADD' END AS type, md5(max(text)) AS value FROM conversations GROUP BY ALL),
    c AS (SELECT session_id, arg_min(set_id, created_ms) AS set_id, 0 AS depth FROM p WHERE parent_id IS NULL GROUP BY session_id
      UNION ALL SELECT c.session_id, (SELECT arg_min(x.set_id, x.created_ms) FROM p x WHERE x.session_id = c.session_id AND x.parent_id = c.set_id AND x.created_ms > c.set_id), c.depth + 1 FROM c WHERE c.set_id IS NOT NULL),
    o AS (SELECT session_id, p.field, arg_max(p.type, depth) AS type, arg_max(p.value, depth) AS value, arg_max(p.set_id, depth) AS set_id FROM c JOIN p USING (session_id, set_id) GROUP BY ALL)
    SELECT session_id, field, value, set_id FROM o WHERE type <> 'REMOVE'""")
def patched_plans(spark, sf_dir) -> DataFrame:
    """The conversations as sessions whose turns patch the plan; some refer to a set that is no longer the latest."""
    turn = F.col("turn")
    t = load(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    parent = F.when(turn == 0, None).when(turn % 4 == 3, turn - 2).when(turn % 4 == 0, turn - 2).otherwise(turn - 1)
    one = F.struct(F.when(turn % 5 == 4, "REMOVE").when(turn % 5 == 3, "REPLACE").otherwise("ADD").alias("type"), F.get(F.array(F.lit("TIME"), F.lit("PLACE"), F.lit("SORT")), (turn % 3).cast("int")).alias("field"), F.md5("text").alias("value"))
    return active_plans(t.select(F.col("conv_id").alias("session_id"), turn.alias("set_id"), parent.alias("parent_id"), turn.alias("created_ms"), F.array(one).alias("operations")))
