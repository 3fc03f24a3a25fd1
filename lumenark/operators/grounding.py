"""Whether claims say no more than what they cite: a containment join of their words, numbers and calendar words with their sources.

A packet is a question with a first answer (packet_id, query, headline, detail) and its evidence, of which the 24 strongest
pieces count. A claim (claim_id, packet_id, text, evidence_ids) is tested in the order of ``VERDICTS``: its ids must be known, some
word must occur in the question, the headline or the cited pieces, and so must every word that isn't harmless; a claim on
uncertain evidence must sound uncertain; numbers and calendar words must occur somewhere in the packet; and no path may be
named. Words are joined one by one, so a long text or a packet with many claims is spread over tasks.

Defined results: null texts are empty; a claim without ids, or with one that is null, cites something unknown; repeated
claims are judged once for each claim_id, which should be unique; repeated pieces of evidence count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_EVIDENCE = 24
WORD, NUMBER = r"[\p{L}\p{N}]+", r"(?<![\p{L}\p{N}])[-+]?\d[\d,]*(?:\.\d+)?"
# Words that need no source, words that say nothing, calendar words, marks of uncertainty, and paths.
SAFE_WORDS = (
    "verified", "local", "locally", "visible", "photo", "photos", "result", "results", "candidate", "candidates",
    "condition", "conditions", "required", "supported", "ranked", "wears", "wearing", "satisfied", "checked",
)
STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "was", "were", "are", "has", "have", "had",
    "your", "you", "found", "match", "matches", "answer", "evidence", "appears", "shows", "show", "image",
)
CALENDAR = r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
UNCERTAIN = r"(?i)\b(?:possible|possibly|may|might|suggest|suggests|suggesting|appears|likely|could)\b"
PATHS = (r"(?i)content://", r"(?i)file://", r"(?i)(?:^|\s)/(?:data|storage|sdcard|system)/", r"[A-Za-z]:\\", r"(?:^|[/\\])\.\.(?:[/\\]|$)")
#: What can be wrong with a claim, in the order in which it is looked for.
VERDICTS = ("UNKNOWN_EVIDENCE", "UNCONNECTED", "UNSUPPORTED_WORD", "UNCERTAINTY_LOST", "UNSUPPORTED_NUMBER", "UNSUPPORTED_DATE", "PATH")


def packet_evidence(evidence: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """The pieces (packet_id, evidence_id, text, priority, confidence, uncertain) that count: each id once, the strongest of a packet."""
    strength = ["priority", F.desc("confidence"), "evidence_id"]
    once = evidence.groupBy("packet_id", "evidence_id").agg(F.min(F.struct("priority", F.negative("confidence").alias("c"), "text", "uncertain")).alias("e"))
    once = once.select("packet_id", "evidence_id", "e.text", "e.priority", F.negative("e.c").alias("confidence"), "e.uncertain")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("packet_id").orderBy(*strength))).where(F.col("n") <= most).drop("n")


def _words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))


def _numbers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))


def number_key(raw: Column) -> Column:
    """What numbers are compared by: their value, however it is written."""
    plain = F.regexp_replace(raw, ",", "")
    return F.coalesce(plain.try_cast("decimal(38,12)").cast("string"), plain)


def _calendar(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CALENDAR), F.lit(0)), F.lower)


def _first(tokens: DataFrame, verdict: str) -> DataFrame:
    """The first offending token of each claim."""
    return tokens.groupBy("claim_id").agg(F.min_by("token", "at").alias("token")).select("claim_id", F.lit(VERDICTS.index(verdict)).alias("v"), "token")


def judged_claims(claims: DataFrame, packets: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, verdict, token): GROUNDED, or what is wrong first and the first word, number or id that shows it."""
    pieces = packet_evidence(evidence)
    c = claims.select("claim_id", "packet_id", F.coalesce("text", F.lit("")).alias("text"), "evidence_ids")
    cited = c.select("claim_id", "packet_id", F.posexplode_outer("evidence_ids").alias("at", "evidence_id"))
    known = pieces.select("packet_id", "evidence_id", "uncertain")
    faults = []
    unknown = cited.join(known.select("packet_id", "evidence_id"), ["packet_id", "evidence_id"], "left_anti")
    faults.append(_first(unknown.select("claim_id", F.coalesce("at", F.lit(0)).alias("at"), F.col("evidence_id").cast("string").alias("token")), "UNKNOWN_EVIDENCE"))

    # words: of the question and the headline, or of a cited piece
    said = c.select("claim_id", "packet_id", F.posexplode(_words(F.col("text"))).alias("at", "token"))
    general = packets.select("packet_id", F.explode(F.concat(_words(F.col("query")), _words(F.col("headline")))).alias("token")).distinct()
    own = pieces.select("packet_id", "evidence_id", F.explode(_words(F.col("text"))).alias("token")).distinct()
    by_piece = said.join(cited.select("claim_id", "evidence_id").where("evidence_id is not null"), "claim_id").join(own, ["packet_id", "evidence_id", "token"], "left_semi")
    sourced = by_piece.select("claim_id", "token").union(said.join(general, ["packet_id", "token"], "left_semi").select("claim_id", "token")).distinct()
    without = c.join(sourced.select("claim_id").distinct(), "claim_id", "left_anti")
    faults.append(without.select("claim_id", F.lit(VERDICTS.index("UNCONNECTED")).alias("v"), F.lit(None).cast("string").alias("token")))
    faults.append(_first(said.where(~F.col("token").isin(*SAFE_WORDS)).join(sourced, ["claim_id", "token"], "left_anti"), "UNSUPPORTED_WORD"))

    sure = c.where(~F.col("text").rlike(UNCERTAIN)).join(cited.join(known.where("uncertain"), ["packet_id", "evidence_id"]).select("claim_id").distinct(), "claim_id", "left_semi")
    faults.append(sure.select("claim_id", F.lit(VERDICTS.index("UNCERTAINTY_LOST")).alias("v"), F.lit(None).cast("string").alias("token")))

    # numbers and calendar words: of the whole packet
    texts = packets.select("packet_id", F.concat_ws(" ", "query", "headline", "detail").alias("text")).union(pieces.select("packet_id", "text"))
    for find, key, verdict in ((_numbers, number_key, "UNSUPPORTED_NUMBER"), (_calendar, lambda t: t, "UNSUPPORTED_DATE")):
        there = texts.select("packet_id", F.explode(find(F.col("text"))).alias("token")).select("packet_id", key(F.col("token")).alias("key")).distinct()
        asked = c.select("claim_id", "packet_id", F.posexplode(find(F.col("text"))).alias("at", "token")).withColumn("key", key(F.col("token")))
        faults.append(_first(asked.join(there, ["packet_id", "key"], "left_anti"), verdict))
    path = reduce(lambda a, b: a | b, (F.col("text").rlike(p) for p in PATHS))
    faults.append(c.where(path).select("claim_id", F.lit(VERDICTS.index("PATH")).alias("v"), F.lit(None).cast("string").alias("token")))
    first = reduce(DataFrame.union, faults).groupBy("claim_id").agg(F.min(F.struct("v", "token")).alias("f"))
    name = F.coalesce(F.get(F.array(*map(F.lit, VERDICTS)), F.col("f.v")), F.lit("GROUNDED"))
    return claims.select("claim_id").distinct().join(first, "claim_id", "left").select("claim_id", name.alias("verdict"), F.col("f.token").alias("token"))
