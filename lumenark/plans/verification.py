"""Verdicts that are used again, people whom questions name, and answers within other words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.objects import first_object
from ..operators import coverage as C
from ..operators import people_references as P
from ..operators import verification as V
from ..registry import query
from ..sources.tables import load


@query("""WITH facts AS (SELECT l_orderkey * 10 + l_linenumber AS fact_id, l_orderkey AS media_id, l_suppkey % 3 AS cluster_id, CASE l_partkey % 2 WHEN 0 THEN 'Red  Hat' ELSE 'blue coat' END AS predicate, CASE WHEN l_quantity > 25 THEN 'VERIFIED_TRUE' ELSE 'VERIFIED_FALSE' END AS verdict, l_discount AS confidence,
      l_partkey % 37 / 40.0::DOUBLE AS x, l_suppkey % 7 / 80.0::DOUBLE AS y, l_linenumber % 4 AS updated_ms, CASE WHEN l_linenumber % 5 = 0 THEN 'POSSIBLE' ELSE 'CONFIDENT' END AS association, 'm' || l_partkey % 2 AS model_version FROM lineitem),
    bindings AS (SELECT media_id, cluster_id, min(x) + 0.01::DOUBLE AS x, min(y) + 0.01::DOUBLE AS y FROM facts GROUP BY ALL),
    conditions AS (SELECT media_id, cluster_id, k AS condition_id, CASE k WHEN 0 THEN 'red hat' ELSE 'Blue, coat!' END AS predicate FROM bindings, range(2) r(k)),
    pairs AS (SELECT c.media_id, c.condition_id, c.cluster_id, f.* EXCLUDE (media_id, cluster_id) FROM conditions c JOIN bindings b USING (media_id, cluster_id) JOIN facts f ON f.media_id = c.media_id AND f.cluster_id = c.cluster_id AND lower(replace(f.predicate, '  ', ' ')) = lower(replace(replace(c.predicate, ',', ''), '!', ''))
      WHERE abs(f.x - b.x) <= 0.02 AND abs(f.y - b.y) <= 0.02 AND abs(f.x + 0.1::DOUBLE - (b.x + 0.1::DOUBLE)) <= 0.02 AND abs(f.y + 0.1::DOUBLE - (b.y + 0.1::DOUBLE)) <= 0.02 AND association = 'CONFIDENT')
    SELECT media_id, media_id * 100 + cluster_id * 10 + condition_id AS condition_id, verdict, confidence, model_version, fact_id FROM pairs QUALIFY row_number() OVER (PARTITION BY media_id, cluster_id, condition_id ORDER BY updated_ms DESC, fact_id, confidence DESC, verdict DESC, model_version DESC) = 1""")
def reused_verifications(spark, sf_dir) -> DataFrame:
    k = F.col
    box = lambda x, y: [x.alias("left"), y.alias("top"), (x + 0.1).alias("right"), (y + 0.1).alias("bottom")]
    line = load(spark, sf_dir, "lineitem")
    facts = line.select(
        (k("l_orderkey") * 10 + k("l_linenumber")).alias("fact_id"), k("l_orderkey").alias("media_id"), (k("l_suppkey") % 3).alias("cluster_id"), F.when(k("l_partkey") % 2 == 0, "Red  Hat").otherwise("blue coat").alias("predicate"),
        F.when(k("l_quantity") > 25, "VERIFIED_TRUE").otherwise("VERIFIED_FALSE").alias("verdict"), k("l_discount").alias("confidence"), *box(k("l_partkey") % 37 / 40.0, k("l_suppkey") % 7 / 80.0), (k("l_linenumber") % 4).alias("updated_ms"),
        F.lit("v2").alias("prompt_version"), F.lit("b1").alias("region_version"), F.when(k("l_linenumber") % 5 == 0, "POSSIBLE").otherwise("CONFIDENT").alias("association"), F.concat(F.lit("m"), (k("l_partkey") % 2).cast("string")).alias("model_version"),
    )
    low = facts.groupBy("media_id", "cluster_id").agg((F.min("left") + 0.01).alias("x"), (F.min("top") + 0.01).alias("y"))
    bindings = low.select("media_id", "cluster_id", *box(k("x"), k("y")))
    kinds = F.array(F.struct(F.lit(0).alias("n"), F.lit("red hat").alias("text")), F.struct(F.lit(1).alias("n"), F.lit("Blue, coat!").alias("text")))
    conditions = low.select("media_id", "cluster_id", F.explode(kinds).alias("c")).select("media_id", "cluster_id", (k("media_id") * 100 + k("cluster_id") * 10 + k("c.n")).alias("condition_id"), "c.text")
    return V.reusable_verdicts(conditions, bindings, facts, "v2", "b1")


_ASKED = ("show me", "photos I took of my wife and", "my wife without", "not me and my sister,", "find me wearing", "मेरे भाई बिना", "Customer 7 and", "main")


def _references_sql() -> str:
    runs = " UNION ALL ".join(f"SELECT id, array_to_string(w[i:i + {n - 1}], ' ') AS run, w[greatest(i - 3, 1):i - 1] AS before, w[i + {n}:i + {n + 3}] AS behind FROM words, unnest(range(1, len(w) - {n - 1} + 1)) AS r(i)" for n in range(1, P.LONGEST + 1))
    names = ", ".join(f"('{n}', '{n}')" for n in P.REFERENCES) + ", " + ", ".join(f"('{n}', 'me')" for n in P.FIRST_PERSON)
    some = lambda c, of: f"list_has_any({c}, {list(of)})"
    return rf"""WITH names AS (SELECT * FROM (VALUES {names}) n(name, person_id) UNION SELECT 'customer ' || c_custkey, 'c' || c_custkey FROM customer),
    words AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(lower({list(_ASKED)}[(conv_id + turn) % {len(_ASKED)} + 1] || ' ' || coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM conversations),
    hits AS (SELECT id, run, before, behind, person_id FROM ({runs}) JOIN names ON name = run)
    SELECT DISTINCT id, person_id, NOT {some('before', P.NEGATIONS)} AND NOT {some('behind[1:3]', P.TRAILING_NEGATIONS)} AS present FROM hits
    WHERE NOT (run IN {P.FIRST_PERSON} AND {some('behind', P.CAPTURE_VERBS)}) AND NOT (run = 'me' AND coalesce(before[-1], '') IN {P.REQUEST_VERBS} AND coalesce(behind[1], '') NOT IN {P.CONTINUATIONS})"""


@query(_references_sql())
def people_references(spark, sf_dir) -> DataFrame:
    t, n = load(spark, sf_dir, "conversations"), (F.col("conv_id") + F.col("turn")) % len(_ASKED)
    asked = F.get(F.array(*map(F.lit, _ASKED)), n.cast("int"))
    questions = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(asked, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    customers = load(spark, sf_dir, "customer").select(F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("person_id"))
    return P.person_clauses(questions, P.well_known(spark).unionByName(customers))


@query("""SELECT conv_id, turn, sha256(coalesce(text, '')) AS claim, role AS answer FROM conversations WHERE (conv_id + turn) % 4 < 3""")
def answers_in_text(spark, sf_dir) -> DataFrame:
    """Answers that stand among other words, with braces and quotes in them; a fourth of them is cut off and has none."""
    t = load(spark, sf_dir, "conversations")
    claims = F.array(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.array("role").alias("evidence_ids"))).alias("claims")
    whole = F.to_json(F.struct(claims, F.col("role").alias("answer")))
    said = F.when((F.col("conv_id") + F.col("turn")) % 4 == 3, F.concat(F.lit("} well: "), F.expr("left(j, length(j) - 1)"))).otherwise(F.concat(F.lit('} Here "it" is: '), F.col("j"), F.lit(' and {"more": 1}')))
    found = t.withColumn("j", whole).select("conv_id", "turn", C.decoded_claims(first_object(said)).alias("d")).where("d is not null")
    return found.select("conv_id", "turn", F.sha2(F.get("d.claims", F.lit(0))["text"], 256).alias("claim"), F.col("d.answer").alias("answer"))
