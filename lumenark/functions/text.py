"""Text functions: normal forms, typed facts, sensitive content, redaction and caption pieces."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and confidences of typed facts (group of the value; how the value is normalised).
AMOUNT = r"(?i)(?:₹|rs\.?|inr|usd|\$)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)|([0-9][0-9,]*(?:\.[0-9]{1,2})?)\s*(?:₹|inr|usd)"
DATE = (
    r"(?i)\b(?:20\d{2}[-/.](?:0?[1-9]|1[0-2])[-/.][0-3]?\d|[0-3]?\d[-/.](?:0?\d|1[0-2])[-/.](?:20)?\d{2}"
    r"|[0-3]?\d\s+(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+20\d{2})\b"
)
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
FACTS = (
    ("AMOUNT", AMOUNT, 0, "money", 0.88),
    ("DATE", DATE, 0, "upper", 0.86),
    ("EMAIL", EMAIL, 0, "lower", 0.96),
    ("URL", r"(?i)\bhttps?://[^\s]+|\bwww\.[^\s]+", 0, "lower", 0.94),
    ("PHONE", r"(?<!\d)(?:\+?\d[\d -]{7,}\d)(?!\d)", 0, "digits", 0.82),
    ("ORDER_ID", r"(?i)\b(?:order|booking|reference|ref)\s*(?:id|no|number)?\s*[:#-]?\s*([A-Z0-9][A-Z0-9-]{3,})", 1, "upper", 0.91),
    ("FLIGHT_NUMBER", r"(?i)\bflight\s*[:#-]?\s*([A-Z]{2,3}\s?\d{2,4})\b", 1, "code", 0.92),
    ("FLIGHT_TIME", r"(?i)\b(?:flight\s*time|departure(?:\s*time)?|boarding\s*time)\s*[:#-]?\s*([0-2]?\d:[0-5]\d(?:\s?[AP]M)?)\b", 1, "upper", 0.90),
    ("PASSWORD", r"(?i)\b(?:wi[\s-]*fi\s+)?(?:password|passcode)\s*(?:is|[:=-])\s*(\S+)", 1, "same", 0.94),
)
# What a text must hold, in lower case, for a fact of a kind; a digit is DIGIT. All of the lists, one of each.
DIGIT = "0-9"
FACT_SIGNS = {
    "AMOUNT": ((DIGIT,), ("₹", "rs", "inr", "usd", "$")), "DATE": ((DIGIT,),), "EMAIL": (("@",),), "URL": (("http", "www."),), "PHONE": ((DIGIT,),), "ORDER_ID": (("order", "booking", "ref"),),
    "FLIGHT_NUMBER": (("flight",), (DIGIT,)), "FLIGHT_TIME": (("flight", "departure", "boarding"), (DIGIT,)), "PASSWORD": (("password", "passcode"),),
}
PLAIN_TOTAL = r"(?i)\b(?:grand\s+total|amount\s+paid|net\s+payable|total|balance\s+due)\s*[:#-]?\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)\b"
# Weights of words near a receipt's total; matching is by substring and adds up.
TOTAL_WORDS = (("grand total", 7), ("amount paid", 7), ("net payable", 6), ("total", 4), ("balance due", 3))
NOT_TOTAL_WORDS = (("subtotal", 9), ("tax", 7), ("discount", 7), ("saving", 5), ("tip", 4))
# Sensitive content.
SENSITIVE_WORDS = r"(?i)\b(?:password|passcode|pin|cvv|account number|medical record|diagnosis|aadhaar|passport|social security|ssn)\b"
CREDENTIAL = r"(?i)\b(password|passcode|pin|cvv|account number|aadhaar|passport|social security|ssn)\b\s*[:=]?\s*[^\r\n,;]*?(?=(?:[,;]|[.!?](?:\s|$)|$))"
CONTACT = r"(?i)\b(email|e-mail|phone|mobile|tel)\b\s*[:=]?\s*[^\r\n,;]+"
MONEY_SIGN = r"(?:₹|rs\.?|inr|usd|eur|gbp|\$|€|£)"
CURRENCY_AMOUNT = rf"(?i){MONEY_SIGN}\s*[0-9][0-9,]*(?:\.[0-9]{{1,2}})?|[0-9][0-9,]*(?:\.[0-9]{{1,2}})?\s*{MONEY_SIGN}"
LABELED_AMOUNT = rf"(?i)\b(grand total|amount paid|net payable|balance due|receipt total|total)\b\s*[:=]?\s*{MONEY_SIGN}?\s*[0-9][0-9,]*(?:\.[0-9]{{1,2}})?"
CARD = r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
# The same for sensitive content.
CREDENTIAL_SIGNS = (("password", "passcode", "pin", "cvv", "account number", "aadhaar", "passport", "social security", "ssn"),)
SENSITIVE_SIGNS = ((*CREDENTIAL_SIGNS[0], "medical record", "diagnosis"),)
CONTACT_SIGNS = (("email", "e-mail", "phone", "mobile", "tel"),)
CURRENCY_SIGNS = ((DIGIT,), ("₹", "rs", "inr", "usd", "eur", "gbp", "$", "€", "£"))
LABELED_SIGNS = ((DIGIT,), ("total", "amount paid", "net payable", "balance due"))
EPOCH_MS = (946_684_800_000, 4_102_444_800_000)
# Kinds of caption pieces by the words they hold; the first that matches counts.
PIECE_KINDS = (
    ("OCCASION", ("birthday", "wedding", "celebration", "ceremony", "festival", "occasion")),
    ("PLACE_CONTEXT", ("location", "place", "venue", "beach", "park", "restaurant", "hotel")),
    ("ANIMALS", ("animal", "dog", "cat", "bird", "pet")),
    ("FOOD", ("food", "meal", "cake", "drink", "dish")),
    ("VEHICLES", ("car", "vehicle", "bus", "train", "airplane", "motorcycle")),
    ("BACKGROUND", ("background", "behind", "distant")),
    ("COMPOSITION", ("composition", "portrait", "selfie", "close-up", "wide shot", "group shot")),
    ("VISIBLE_TEXT_CATEGORY", ("visible text", "sign", "screen", "poster")),
    ("OBJECTS", ("object", "table", "chair", "furniture", "decoration", "holding")),
    ("SCENE", ("scene", "setting", "indoor", "outdoor", "lighting", "weather")),
)
PIECE_WORDS, PIECE_CHARS, PIECES = 40, 360, 24


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def may_have(text: Column, signs: Sequence[Sequence[str]]) -> Column:
    """Whether a text holds one of each of the lists: plain searches, which spare most texts a pattern that needs these."""
    low = F.lower(text)
    one = lambda w: text.rlike("[0-9]") if w == DIGIT else low.contains(w)
    return reduce(Column.__and__, [reduce(Column.__or__, map(one, some)) for some in signs])


def collapsed(text: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def words_only(text: Column) -> Column:
    """Everything but letters, marks and numbers is a blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def nfkc(column: Column) -> Column:
    """NFKC, collapsed and lower-cased; Spark has no normal forms, so this is for labels, not for long texts."""

    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).split()).lower())

    return F.pandas_udf(normal, "string")(column)


def fact_value(raw: Column, value: Column, how: str) -> Column:
    if how == "money":
        plain = F.regexp_replace(F.regexp_extract(raw, r"[0-9][0-9,]*(?:\.[0-9]{1,2})?", 0), ",", "")
        return plain.cast("decimal(38,2)").cast("string")
    return {"upper": F.upper(value), "lower": F.lower(value), "digits": F.regexp_replace(raw, r"\D", ""), "code": F.upper(F.regexp_replace(value, " ", "")), "same": value}[how]


def typed_facts(blocks: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Facts of text blocks (media_id, block_id, text, confidence): type, raw text, normal value and confidence; of some kinds only, if given.

    Of equal facts of a block the first stays. A pattern is tried on texts that hold what it needs.
    """
    def found(text: Column) -> Column:
        none = F.array().cast("array<struct<entity_type:string,raw_text:string,normalized_value:string,base:double>>")
        each = []
        for kind, pattern, group, how, confidence in FACTS:
            if kinds is not None and kind not in kinds:
                continue
            raw, put = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _fact_struct(kind, how, confidence)
            if group == 0:
                one = F.transform(raw, _of_raw(put))
            else:
                one = F.transform(F.arrays_zip(raw.alias("raw"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")), put)
            each.append(F.when(may_have(text, FACT_SIGNS[kind]), one).otherwise(none))
        return F.concat(*each)

    facts = blocks.select("media_id", "block_id", F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("confidence"))).alias("sure"), F.posexplode(let(F.col("text"), found)).alias("at", "f"))
    facts = facts.select("media_id", "block_id", F.col("f.entity_type"), F.col("f.normalized_value"), F.struct("at", F.col("f.raw_text").alias("raw_text"), F.least("f.base", "sure").alias("confidence")).alias("x"))
    return facts.groupBy("media_id", "block_id", "entity_type", "normalized_value").agg(F.min("x").alias("x")).select("media_id", "block_id", "entity_type", "x.raw_text", "normalized_value", "x.confidence")


def _of_raw(put: Callable[[dict], Column]) -> Callable[[Column], Column]:
    return lambda raw: put({"raw": raw, "value": raw})


def _fact_struct(kind: str, how: str, confidence: float):
    return lambda x: F.struct(F.lit(kind).alias("entity_type"), x["raw"].alias("raw_text"), fact_value(x["raw"], x["value"], how).alias("normalized_value"), F.lit(confidence).alias("base"))


def receipt_totals(blocks: DataFrame) -> DataFrame:
    """The most likely total of each receipt, from blocks (media_id, block_id, text, top, confidence)."""
    text, low = F.col("text"), F.lower("text")
    money, labeled = F.regexp_extract(text, AMOUNT, 0), F.regexp_extract(text, PLAIN_TOTAL, 0)
    raw = F.when(money != "", money).otherwise(labeled)
    score = sum((F.when(low.contains(w), n).otherwise(0) for w, n in TOTAL_WORDS), F.lit(0)) - sum((F.when(low.contains(w), n).otherwise(0) for w, n in NOT_TOTAL_WORDS), F.lit(0))
    score = score + F.floor(F.col("top") * 2).cast("int") + F.when(raw.rlike(r"(?i)₹|rs|inr|usd|\$"), 1).otherwise(0)
    number = F.regexp_replace(F.regexp_extract(raw, r"[0-9][0-9,]*(?:\.[0-9]{1,2})?", 0), ",", "")
    named = F.coalesce(*[F.when(low.contains(w), w.replace(" ", "_")) for w, _ in TOTAL_WORDS], F.lit("total"))
    cand = blocks.withColumn("raw", raw).where("raw <> ''").withColumn("score", score).where("score > 0")
    best = cand.select("media_id", F.struct("score", "top", F.negative("block_id").alias("b"), F.col("raw").alias("raw_text"), number.cast("decimal(38,2)").alias("value"), named.alias("label"), F.least(F.lit(0.98), 0.72 + F.col("confidence") * 0.25).alias("sure")).alias("s"))
    return best.groupBy("media_id").agg(F.max("s").alias("s")).select("media_id", "s.raw_text", "s.value", "s.label", "s.score", F.round("s.sure", 4).alias("confidence"))


def merchants(blocks: DataFrame) -> DataFrame:
    """The first block near the top that is neither a total, an amount, a date nor a heading."""
    low = F.lower(F.trim("text"))
    ok = F.length("text").between(3, 80) & (F.col("top") < 0.35) & ~low.rlike("|".join(w for w, _ in TOTAL_WORDS)) & ~F.col("text").rlike(AMOUNT) & ~F.col("text").rlike(DATE) & ~low.isin("synthetic test receipt", "receipt", "invoice")
    return blocks.where(ok).groupBy("media_id").agg(F.min_by("text", "block_id").alias("raw_text")).select("media_id", "raw_text", F.upper(F.trim("raw_text")).alias("normalized_value"))


def is_card(candidate: Column) -> Column:
    """13 to 19 digits with a right checksum; 13 digits that are a plausible time in milliseconds are none."""
    d = F.regexp_replace(candidate, r"\D", "")
    n = F.length(d)
    time = (n == 13) & F.substring(d, 1, 13).cast("long").between(*EPOCH_MS)
    return F.when(n.between(13, 19), F.call_function("luhn_check", d) & ~time).otherwise(F.lit(False))


def sensitive_by_pattern(text: Column) -> Column:
    """Whether a text has words, addresses, contacts or amounts that are not to be shown."""
    tests = ((SENSITIVE_WORDS, SENSITIVE_SIGNS), (EMAIL, FACT_SIGNS["EMAIL"]), (CONTACT, CONTACT_SIGNS), (CURRENCY_AMOUNT, CURRENCY_SIGNS), (LABELED_AMOUNT, LABELED_SIGNS))
    return (F.trim(text) != "") & reduce(Column.__or__, [may_have(text, signs) & text.rlike(pattern) for pattern, signs in tests])


def sensitive(text: Column) -> Column:
    """The same, or a card number that passes its checksum."""
    card = F.when(may_have(text, ((DIGIT,),)), F.exists(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), is_card)).otherwise(text.isNull() & F.lit(None))
    return sensitive_by_pattern(text) | card


def without_contacts(text: Column) -> Column:
    """Labelled contacts and addresses replaced, labels kept."""
    return replaced(replaced(text, CONTACT, "$1: [REDACTED]", CONTACT_SIGNS), EMAIL, "[REDACTED_EMAIL]", FACT_SIGNS["EMAIL"])


def replaced(text: Column, pattern: str, by: str, signs: Sequence[Sequence[str]]) -> Column:
    """``text`` with each match replaced; it is searched only if it holds what a match needs."""
    return let(text, lambda t: F.when(may_have(t, signs), F.regexp_replace(t, pattern, by)).otherwise(t))


def searchable(text: Column) -> Column:
    """What of a text may be searched: sensitive texts are redacted first."""
    return F.when(sensitive(text), redact(text)).otherwise(text)


def sealed(value: Column, key: Column) -> Column:
    """A value encrypted with AES-GCM under the digest of a key."""
    return F.aes_encrypt(value, F.substring(F.sha2(key, 256), 1, 32), F.lit("GCM"), F.lit("DEFAULT"))


def revealed(value: Column, key: Column) -> Column:
    """The value again; null under another key, or where it was changed."""
    return F.try_aes_decrypt(value, F.substring(F.sha2(key, 256), 1, 32), F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def redact(text: Column) -> Column:
    """Credentials, contacts, addresses, amounts and cards replaced, labels kept, in this order."""
    out = without_contacts(replaced(text, CREDENTIAL, "$1: [REDACTED]", CREDENTIAL_SIGNS))
    out = replaced(out, LABELED_AMOUNT, "$1: [REDACTED_AMOUNT]", LABELED_SIGNS)
    out = replaced(out, CURRENCY_AMOUNT, "[REDACTED_AMOUNT]", CURRENCY_SIGNS)

    def without_cards(t: Column) -> Column:
        # cards have to pass a check, so the text is cut at the candidates and put together again
        gaps, cards = F.split(t, CARD, -1), F.regexp_extract_all(t, F.lit(CARD), F.lit(0))
        parts = F.zip_with(gaps, cards, lambda g, c: F.concat(F.coalesce(g, F.lit("")), F.when(is_card(F.coalesce(c, F.lit(""))), "[REDACTED_CARD]").otherwise(F.coalesce(c, F.lit("")))))
        return F.when(may_have(t, ((DIGIT,),)), F.array_join(parts, "")).otherwise(t)

    shown = lambda t: F.when(F.trim(text) == "", text).when((t == text) & sensitive(text), "[REDACTED_SENSITIVE_OCR]").otherwise(t)
    return let(let(out, without_cards), shown)


def piece_kind(text: Column) -> Column:
    low, out = F.lower(text), None
    for kind, words in PIECE_KINDS:
        has = reduce(Column.__or__, [low.contains(w) for w in words])
        out = F.when(has, kind) if out is None else out.when(has, kind)
    return out.otherwise("OTHER")


def caption_pieces(captions: DataFrame) -> DataFrame:
    """Sentences and lines of captions (caption_id, text) in pieces of 40 words and 360 characters, with their kind; before near-duplicates go."""
    sentences = F.split(F.col("text"), r"(?<=[.!?])\s+|[\r\n]+")
    words = F.filter(F.split(F.trim(F.col("sentence")), r"\s+"), lambda w: w != "")
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words"), F.lit(PIECE_WORDS)))
    s = captions.where("trim(text) <> ''").select("caption_id", F.posexplode(sentences).alias("s", "sentence")).select("caption_id", "s", words.alias("words"))
    p = s.select("caption_id", "s", F.posexplode(F.transform(starts, lambda i: F.substring(F.array_join(F.slice("words", i, PIECE_WORDS), " "), 1, PIECE_CHARS))).alias("p", "text"))
    return p.where("text <> ''").select("caption_id", "s", "p", "text", piece_kind(F.col("text")).alias("kind"), words_only(F.col("text")).alias("normal"))


class Accepted:
    """Pieces that are not like an accepted one: equal, part of it or it of them, or 88 % of the words shared."""

    def __init__(self, most: int = PIECES) -> None:
        self.most = most
        self.pieces: list[tuple[str, frozenset]] = []

    def takes(self, normal: str) -> bool:
        """Accepts a piece in normal form if it is not like the others."""
        if not normal or len(self.pieces) == self.most:
            return False
        terms = frozenset(normal.split(" "))
        if any(normal in other or other in normal or len(terms & words) >= 0.88 * len(terms | words) for other, words in self.pieces):
            return False
        self.pieces.append((normal, terms))
        return True


def caption_chunks(captions: DataFrame) -> DataFrame:
    """The pieces of each caption that are accepted, in order, 24 at most.

    Acceptance depends on the order, so the pieces of a caption come to one task in their order; it reads them as they come and
    holds those that it has accepted of the caption at hand.
    """
    pieces = caption_pieces(captions).where(~sensitive(F.col("text")) & (F.col("normal") != ""))
    pieces = pieces.repartition("caption_id").sortWithinPartitions("caption_id", "s", "p").select("caption_id", "text", "kind", "normal")
    kind = captions.schema["caption_id"].dataType.simpleString()
    return pieces.mapInArrow(_accepted, f"caption_id {kind}, n int, text string, kind string")


def _accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The accepted of sorted pieces (caption_id, text, kind, normal), with their number in the caption."""
    caption, kept = None, Accepted()
    for batch in batches:
        at, numbers = [], []
        for i, (of, normal) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if of != caption:
                caption, kept = of, Accepted()
            if kept.takes(normal):
                at.append(i)
                numbers.append(len(kept.pieces) - 1)
        out = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([out.column(0), pa.array(numbers, pa.int32()), out.column(1), out.column(2)], names=["caption_id", "n", "text", "kind"])
