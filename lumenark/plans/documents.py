"""Typed facts, sensitive content, redaction and caption chunks over the driver's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..registry import query
from ..sources.tables import load

#: Blocks of text of the tables: the lines of documents, the turns of conversations, and a receipt for each order.
RECEIPT_SQL = r"""(SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents, '20' || strftime(o_orderdate, '%y-%m-%d') AS day, o_custkey FROM orders)"""
BLOCKS_SQL = rf"""lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    priced AS (SELECT *, cents // 100 || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS price FROM {RECEIPT_SQL}),
    receipts AS (SELECT 1000000000 + o_orderkey AS media_id, ['Cafe ' || o_custkey % 50, 'Receipt', 'Date ' || day, 'Subtotal INR ' || cents // 200, 'Tax INR 148',
      CASE o_orderkey % 3 WHEN 0 THEN 'Grand Total INR ' || price WHEN 1 THEN 'Amount paid: ' || price ELSE 'Balance due $' || price END,
      'Order no: QX' || o_orderkey || ' www.shop' || o_custkey % 9 || '.example/x', 'Flight AG ' || 100 + o_orderkey % 900 || ' departure time ' || 10 + o_orderkey % 10 || ':45',
      'WiFi password: s' || o_orderkey || ', call +44 20 7946 ' || 1000 + o_orderkey % 9000] AS l FROM priced),
    blocks AS (SELECT doc_id AS media_id, i::BIGINT AS block_id, l[i + 1] AS text, i / len(l)::DOUBLE AS top, 0.9::DOUBLE AS confidence FROM lines, unnest(range(len(l))) AS r(i)
      UNION ALL SELECT -(conv_id * 100 + turn) - 1, 0, text, 0.0, 0.7 FROM conversations
      UNION ALL SELECT media_id, i, l[i + 1], i / 10.0::DOUBLE, 0.85 FROM receipts, unnest(range(len(l))) AS r(i))"""


def blocks(spark, sf_dir) -> DataFrame:
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    k, say = F.col("o_orderkey"), lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", cents.alias("cents"), say("20", F.date_format("o_orderdate", "yy-MM-dd")).alias("day"))
    price = say(text(F.expr("cents div 100")), ".", F.lpad(text(F.col("cents") % 100), 2, "0"))
    total = F.when(k % 3 == 0, say("Grand Total INR ", price)).when(k % 3 == 1, say("Amount paid: ", price)).otherwise(say("Balance due $", price))
    receipt = F.array(
        say("Cafe ", text(F.col("o_custkey") % 50)), F.lit("Receipt"), say("Date ", F.col("day")), say("Subtotal INR ", text(F.expr("cents div 200"))), F.lit("Tax INR 148"), total,
        say("Order no: QX", text("o_orderkey"), " www.shop", text(F.col("o_custkey") % 9), ".example/x"), say("Flight AG ", text(100 + k % 900), " departure time ", text(10 + k % 10), ":45"),
        say("WiFi password: s", text("o_orderkey"), ", call +44 20 7946 ", text(1000 + k % 9000)),
    )
    lines = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.split("text", "\n", -1).alias("l"))
    lines = lines.select("media_id", F.size("l").alias("n"), F.posexplode("l").alias("at", "text")).select("media_id", F.col("at").cast("long").alias("block_id"), "text", (F.col("at") / F.col("n")).alias("top"), F.lit(0.9).alias("confidence"))
    turns = load(spark, sf_dir, "conversations").select((-(F.col("conv_id") * 100 + F.col("turn")) - 1).alias("media_id"), F.lit(0).cast("long").alias("block_id"), "text", F.lit(0.0).alias("top"), F.lit(0.7).alias("confidence"))
    receipts = o.select((1_000_000_000 + k).alias("media_id"), F.posexplode(receipt).alias("at", "text")).select("media_id", F.col("at").cast("long").alias("block_id"), "text", (F.col("at") / 10.0).alias("top"), F.lit(0.85).alias("confidence"))
    return lines.unionByName(turns).unionByName(receipts)


def _facts_sql() -> str:
    """The facts of blocks by each pattern; of telephone numbers the look-arounds change no digit of what is found."""
    normal = {"money": r"regexp_replace(regexp_extract(raw, '[0-9][0-9,]*(?:\.[0-9]{1,2})?'), ',', '', 'g')::DECIMAL(38,2)::VARCHAR", "upper": "upper(value)", "lower": "lower(value)", "digits": r"regexp_replace(raw, '\D', '', 'g')", "code": "upper(replace(value, ' ', ''))", "same": "value"}
    parts = []
    for kind, pattern, group, how, confidence in T.FACTS:
        pattern = pattern.replace(r"(?<!\d)", "").replace(r"(?!\d)", "").replace("'", "''")
        parts.append(f"SELECT media_id, block_id, '{kind}' AS entity_type, {normal[how]} AS normalized_value, least({confidence}::DOUBLE, confidence) AS confidence FROM (SELECT media_id, block_id, confidence, unnest(regexp_extract_all(text, '{pattern}')) AS raw, unnest(regexp_extract_all(text, '{pattern}', {group})) AS value FROM blocks)")
    return f"facts AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}))"


@query(f"WITH {BLOCKS_SQL}, {_facts_sql()} SELECT * FROM facts")
def typed_document_facts(spark, sf_dir) -> DataFrame:
    """All kinds of facts of the documents' lines, the turns and the receipts."""
    return T.typed_facts(blocks(spark, sf_dir)).drop("raw_text")


@query(r"""SELECT doc_id AS media_id, lower(unnest(list_distinct(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')))) AS normalized_value, 'EMAIL' AS entity_type, 0.96::DOUBLE AS confidence FROM documents""")
def email_facts(spark, sf_dir) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.lit(0).alias("block_id"), "text", F.lit(1.0).alias("confidence"))
    return T.typed_facts(docs, ["EMAIL"]).select("media_id", "normalized_value", "entity_type", "confidence")


@query(f"WITH {BLOCKS_SQL}, {_facts_sql()} SELECT media_id, list_sort(list(normalized_value)) AS phones FROM facts WHERE entity_type = 'PHONE' GROUP BY media_id")
def phone_facts(spark, sf_dir) -> DataFrame:
    """The telephone numbers of each item."""
    return T.typed_facts(blocks(spark, sf_dir), ["PHONE"]).groupBy("media_id").agg(F.array_sort(F.collect_list("normalized_value")).alias("phones"))


@query(None)
def luhn_cards(spark, sf_dir) -> DataFrame:
    """Card numbers that pass their checksum; the tests hold it against Python."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.CARD), F.lit(0))).alias("candidate"))
    return docs.select("doc_id", F.regexp_replace("candidate", r"\D", "").alias("digits"), T.is_card(F.col("candidate")).alias("valid"))


def _totals_sql() -> str:
    amount, plain = T.AMOUNT.replace("'", "''"), T.PLAIN_TOTAL.replace("'", "''")
    has = lambda w: f"contains(lower(text), '{w}')"
    score = " + ".join(f"CASE WHEN {has(w)} THEN {n} ELSE 0 END" for w, n in T.TOTAL_WORDS) + " - " + " - ".join(f"CASE WHEN {has(w)} THEN {n} ELSE 0 END" for w, n in T.NOT_TOTAL_WORDS)
    label = "CASE " + " ".join(f"WHEN {has(w)} THEN '{w.replace(' ', '_')}'" for w, _ in T.TOTAL_WORDS) + " ELSE 'total' END"
    return rf"""c AS (SELECT *, coalesce(nullif(regexp_extract(text, '{amount}'), ''), regexp_extract(text, '{plain}')) AS raw_text FROM blocks),
    s AS (SELECT *, ({score} + floor(top * 2)::INT + CASE WHEN regexp_matches(raw_text, '(?i)₹|rs|inr|usd|\$') THEN 1 ELSE 0 END)::INT AS score, {label} AS label FROM c WHERE raw_text <> ''),
    best AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY score DESC, top DESC, block_id) = 1)
    SELECT media_id, raw_text, replace(regexp_extract(raw_text, '[0-9][0-9,]*(?:\.[0-9]{{1,2}})?'), ',', '')::DECIMAL(38,2) AS value, label, score, round(least(0.98::DOUBLE, 0.72::DOUBLE + confidence * 0.25::DOUBLE), 4) AS confidence FROM best"""


@query(f"WITH {BLOCKS_SQL}, {_totals_sql()}")
def receipt_totals(spark, sf_dir) -> DataFrame:
    """The likely total of every receipt, and of whatever else has one."""
    return T.receipt_totals(blocks(spark, sf_dir))


def _merchants_sql() -> str:
    amount, date = T.AMOUNT.replace("'", "''"), T.DATE.replace("'", "''")
    return rf"""SELECT media_id, arg_min(text, block_id) AS raw_text, replace(upper(trim(arg_min(text, block_id))), 'ẞ', 'SS') AS normalized_value FROM blocks WHERE length(text) BETWEEN 3 AND 80 AND top < 0.35 AND NOT regexp_matches(lower(trim(text)), '{'|'.join(w for w, _ in T.TOTAL_WORDS)}')
    AND NOT regexp_matches(text, '{amount}') AND NOT regexp_matches(text, '{date}') AND lower(trim(text)) NOT IN ('synthetic test receipt', 'receipt', 'invoice') GROUP BY media_id"""


@query(f"WITH {BLOCKS_SQL} {_merchants_sql()}")
def merchants(spark, sf_dir) -> DataFrame:
    return T.merchants(blocks(spark, sf_dir))


def _sensitive_sql() -> str:
    return " OR ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for p in (T.SENSITIVE_WORDS, T.EMAIL, T.CONTACT, T.CURRENCY_AMOUNT, T.LABELED_AMOUNT))


@query(f"WITH {BLOCKS_SQL} SELECT media_id, count(*) AS blocks, count(*) FILTER (trim(text) <> '' AND ({_sensitive_sql()})) AS labelled FROM blocks GROUP BY media_id")
def sensitive_documents(spark, sf_dir) -> DataFrame:
    """How many blocks of each item are sensitive by their words, addresses, contacts or amounts."""
    return blocks(spark, sf_dir).groupBy("media_id").agg(F.count("*").alias("blocks"), F.count_if(T.sensitive_by_pattern(F.col("text"))).alias("labelled"))


@query(None)
def sensitive_content(spark, sf_dir) -> DataFrame:
    """The same with checked card numbers; the tests hold it against Python."""
    return blocks(spark, sf_dir).select("media_id", "block_id", T.sensitive(F.col("text")).alias("labelled"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(?i)\b(email|e-mail|phone|mobile|tel)\b\s*[:=]?\s*[^\r\n,;]+', '\1: [REDACTED]', 'g'), '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[REDACTED_EMAIL]', 'g')) AS digest FROM documents""")
def redact_contacts(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(T.without_contacts(F.col("text")), 256).alias("digest"))


@query(None)
def redact_documents(spark, sf_dir) -> DataFrame:
    """The whole chain of replacements, with the checked cards; the tests hold it against Python."""
    return load(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@query(r"""WITH s AS (SELECT doc_id AS caption_id, unnest(regexp_split_to_array(text, '[\r\n]+')) AS line FROM documents) SELECT caption_id, count(*) AS lines FROM s WHERE trim(line) <> '' GROUP BY 1""")
def caption_lines(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("caption_id"), F.explode(F.split("text", r"[\r\n]+")).alias("line")).where("trim(line) <> ''").groupBy("caption_id").agg(F.count("*").alias("lines"))


@query(None)
def caption_chunks(spark, sf_dir) -> DataFrame:
    """Chunks of the documents as captions; acceptance is order-dependent, held against Python in the tests."""
    return T.caption_chunks(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("caption_id"), "text"))


@query("""SELECT o_orderkey, sha256(concat_ws(chr(31), o_orderkey::VARCHAR, o_orderstatus)) AS id, md5(o_orderstatus || o_orderkey) AS name_digest, printf('%d:%02d', o_orderkey * 777 // 1000 // 60, o_orderkey * 777 // 1000 % 60) AS clock FROM orders""")
def derived_ids(spark, sf_dir) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    name = F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", I.sha256_of(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("id"), F.md5(name).alias("name_digest"), I.minutes_seconds(F.col("o_orderkey") * 777).alias("clock"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))) AS digest FROM documents""")
def normal_words(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.words_only(F.col("text"))).alias("digest"))


@query("""SELECT c_custkey, c_name = c_name AS same, sha256('k' || c_name) AS digest FROM customer""")
def protect_reveal(spark, sf_dir) -> DataFrame:
    """Values encrypted with AES-GCM and revealed again; a wrong key reveals nothing."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", T.sealed(F.col("c_name"), F.lit("test key")).alias("sealed"))
    plain, lost = T.revealed(F.col("sealed"), F.lit("test key")), T.revealed(F.col("sealed"), F.lit("another key")).isNull()
    return c.select("c_custkey", (plain == F.col("c_name")) & lost, F.sha2(F.concat(F.lit("k"), plain), 256)).toDF("c_custkey", "same", "digest")
