"""Sessionization, event search, diversity, duplicate and burst groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import hamming
from ..operators import events as E
from ..operators import retrieval as R
from ..operators.duplicates import collapse, duplicate_links, representatives, selected_diverse, thinned_frames
from ..registry import query
from ..sources.tables import CAPTURES_SQL, MEDIA_SQL, captures, load, media

SESSIONS_SQL = f"""{CAPTURES_SQL}, p AS (SELECT *, lag(captured_ms) OVER w AS pm, lag(album) OVER w AS pa, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM captures WINDOW w AS (PARTITION BY user_id ORDER BY captured_ms, id)),
    k AS (SELECT *, pow(sin(radians(latitude - plat) / 2), 2) + cos(radians(plat)) * cos(radians(latitude)) * pow(sin(radians(longitude - plon) / 2), 2) AS a FROM p),
    n AS (SELECT *, CASE WHEN pm IS NULL OR captured_ms - pm > 64800000 OR (captured_ms - pm > 2700000 AND trim(album) <> '' AND trim(pa) <> '' AND lower(trim(album)) <> lower(trim(pa)))
        OR (captured_ms - pm > 1800000 AND 6371.0::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a)) > 100) THEN 1 ELSE 0 END AS new FROM k),
    sessions AS (SELECT id, user_id, captured_ms, album, latitude, longitude, quality, sum(new) OVER (PARTITION BY user_id ORDER BY captured_ms, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM n)"""


@query(f"WITH {SESSIONS_SQL} SELECT id, user_id, session FROM sessions")
def sessionize_gap(spark, sf_dir) -> DataFrame:
    return E.sessionize(captures(spark, sf_dir)).select("id", "user_id", "session")


CORRECTIONS = [("MERGE", [0, 1, 2]), ("SPLIT", [1]), ("RENAME", [3], "First"), ("MERGE", [1, 5]), ("RENAME", [3], "Birthday  Trip"), ("RENAME", [0, 3], "Never"), ("LOCATION", [2], "Goa"), ("RENAME", [1, 5], "Both")]
MEMBERS_SQL = """members AS (SELECT s.*, CASE id % 4 WHEN 0 THEN 'IMG_Beach_' || id || '.jpg' WHEN 1 THEN album || '-day_v2.jpg' ELSE 'Sunset ' || album || '.x.png' END AS filename, 'Title ' || id % 10 AS title, CASE id % 6 WHEN 0 THEN ' Lake ' || user_id % 3 WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Old  Hotel' ELSE '' END AS location,
    CASE WHEN id % 5 = 0 THEN [album, 'sky'] END AS tags, CASE WHEN id % 7 = 0 THEN 'a  walk' END AS description, CASE WHEN id % 50 = 0 THEN 'PDF' ELSE 'IMAGE' END AS kind FROM sessions s)"""


def members(sessions: DataFrame) -> DataFrame:
    """Sessions with the fields of items; names and places are rules on the numbers, the same in both engines."""
    i, album, a = F.col("id"), F.col("album"), F.concat
    text = lambda c: c.cast("string")
    return sessions.withColumns({
        "filename": F.when(i % 4 == 0, a(F.lit("IMG_Beach_"), text(i), F.lit(".jpg"))).when(i % 4 == 1, a(album, F.lit("-day_v2.jpg"))).otherwise(a(F.lit("Sunset "), album, F.lit(".x.png"))),
        "title": a(F.lit("Title "), text(i % 10)), "location": F.when(i % 6 == 0, a(F.lit(" Lake "), text(F.col("user_id") % 3))).when(i % 6 == 1, "Unknown").when(i % 6 == 2, "Old  Hotel").otherwise(""),
        "tags": F.when(i % 5 == 0, F.array(album, F.lit("sky"))), "description": F.when(i % 7 == 0, "a  walk"), "kind": F.when(i % 50 == 0, "PDF").otherwise("IMAGE"),
    })


EVENTS_SQL = f"""{MEMBERS_SQL.replace('FROM sessions s', 'FROM {source} s')}, pl AS (SELECT grp, arg_min(p, (-n, p)) AS place FROM (SELECT grp, trim(location) AS p, count(*) AS n FROM members WHERE trim(location) <> '' AND lower(location) NOT IN ('unknown', 'unknown location') GROUP BY ALL) GROUP BY grp),
    g AS (SELECT grp, min(captured_ms) AS start_ms, max(captured_ms) AS end_ms, count(*) AS members, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude, count(DISTINCT nullif(trim(lower(album)), '')) AS albums,
      arg_max(id, (coalesce(quality, 0), captured_ms, id)) AS representative, bool_or(kind = 'PDF') AS papers FROM members GROUP BY grp),
    wd AS (SELECT grp, captured_ms, id, unnest(list_zip(range(len(w)), w)) AS x FROM (SELECT grp, captured_ms, id, list_filter(regexp_split_to_array(regexp_replace(filename, '\\.[^.]*$', ''), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, 'v[0-9]+|[0-9]+')) AS w FROM members)),
    wc AS (SELECT grp, lower(x[2]) AS low, count(*) AS n, min((captured_ms, id, x[1], x[2])) AS first FROM wd GROUP BY ALL),
    wp AS (SELECT grp, first, row_number() OVER (PARTITION BY grp ORDER BY first) AS place FROM wc JOIN g USING (grp) WHERE n >= CASE WHEN members <= 2 THEN 1 ELSE greatest(2, (members + 1) // 2) END AND low NOT IN ('img', 'image', 'photo', 'photos', 'picture', 'legacy', 'demo', 'synthetic')),
    ft AS (SELECT grp, string_agg(upper(first[4][1]) || first[4][2:], ' ' ORDER BY place) AS file_title FROM wp WHERE place <= 3 GROUP BY grp),
    mt AS (SELECT grp, string_agg(concat_ws(' ', filename, title, album, location, array_to_string(tags, ' '), description), ' ' ORDER BY captured_ms, id) AS words FROM members GROUP BY grp),
    j AS (SELECT g.*, coalesce(new_title, place, file_title, 'Gallery memory') AS title, coalesce(new_place, place) AS location, words, coalesce(touched, false) AS corrected FROM g LEFT JOIN pl USING (grp) LEFT JOIN ft USING (grp) LEFT JOIN mt USING (grp) LEFT JOIN {{labels}} USING (grp)),
    t AS (SELECT *, substr(trim(regexp_replace(lower(concat_ws(' ', title, location, words)), '\\s+', ' ', 'g')), 1, 8000) AS search_text FROM j)
    SELECT grp, start_ms, end_ms, members, latitude, longitude, title, location, CASE WHEN corrected THEN 1.0 WHEN members >= 2 AND albums <= 1 THEN 0.92 WHEN members >= 2 THEN 0.72 ELSE 0.58 END::DOUBLE AS confidence, corrected,
      CASE WHEN regexp_matches(search_text, 'travel|trip|singapore|goa|boarding|hotel') THEN 'TRIP' WHEN papers THEN 'DOCUMENT_SET' WHEN members = 1 THEN 'MOMENT' ELSE 'MEMORY' END AS event_type, sha256(search_text) AS search_text, representative FROM t"""


def events_sql(source: str, labels: str) -> str:
    return EVENTS_SQL.replace("{source}", source).replace("{labels}", labels)


def _shown(events: DataFrame) -> DataFrame:
    return events.withColumns({"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6), "confidence": F.col("confidence").cast("double"), "search_text": F.sha2("search_text", 256)})


@query(f"WITH {SESSIONS_SQL}, grouped AS (SELECT *, user_id || ':' || session AS grp FROM sessions), none AS (SELECT NULL::VARCHAR AS grp, NULL::VARCHAR AS new_title, NULL::VARCHAR AS new_place, false AS touched), {events_sql('grouped', 'none')}")
def event_attributes(spark, sf_dir) -> DataFrame:
    grouped = E.corrected(E.sessionize(captures(spark, sf_dir)), [])
    return _shown(E.compiled(members(grouped)))


def _replayed() -> str:
    """The corrections as a chain of table expressions, each a step of the replay; and the labels that they give."""
    steps, last = [], "c0"
    for n, (op, ids, *_) in enumerate(CORRECTIONS):
        hit = f"id IN ({', '.join(map(str, ids))})"
        if op in ("SPLIT", "MERGE"):
            other = f"(SELECT count(DISTINCT grp) FROM {last} WHERE {hit}) > 1 AND grp IN (SELECT grp FROM {last} WHERE {hit})"
            steps.append(f"c{n + 1} AS (SELECT * REPLACE (CASE WHEN {hit if op == 'SPLIT' else other} THEN '{op.lower()}-{n}' ELSE grp END AS grp) FROM {last})")
            last = f"c{n + 1}"
    rows = ", ".join(f"({n}, '{op}', {i}, {len(ids)}, {repr(more[0]) if more else 'NULL'})" for n, (op, ids, *more) in enumerate(CORRECTIONS) for i in ids)
    labels = f"""hits AS (SELECT grp, n, op, wanted, label, count(*) AS have FROM {last} JOIN (VALUES {rows}) AS k(n, op, id, wanted, label) USING (id) GROUP BY ALL),
    labels AS (SELECT grp, arg_max(label, n) FILTER (op = 'RENAME' AND have = wanted) AS new_title, arg_max(label, n) FILTER (op = 'LOCATION' AND have = wanted) AS new_place, bool_or(op IN ('MERGE', 'SPLIT') OR have = wanted) AS touched FROM hits GROUP BY grp)"""
    return f"{', '.join(steps)}, final AS (SELECT * FROM {last}), {labels}"


@query(f"WITH {SESSIONS_SQL}, c0 AS (SELECT *, user_id || ':' || session AS grp FROM sessions), {_replayed()}, {events_sql('final', 'labels')}")
def event_corrections(spark, sf_dir) -> DataFrame:
    """All kinds of corrections replayed over the sessions, and the events that come of them."""
    return _shown(E.compiled(members(E.corrected(E.sessionize(captures(spark, sf_dir)), CORRECTIONS)), CORRECTIONS))


def made_corrections(spark, sf_dir) -> DataFrame:
    """A correction for each order: merges of neighbours and of far items, splits and names, by its number."""
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    n = k % 10_007
    ids = F.when(k % 4 == 0, F.array(n, n + 1)).when(k % 4 == 1, F.array(n)).when(k % 4 == 2, F.array(n, F.col("o_custkey") % 5_003)).otherwise(F.array(n, n + 1, n + 2))
    operation = F.when(k % 4 == 1, "SPLIT").when(k % 4 == 3, "RENAME").otherwise("MERGE")
    return o.select(k.alias("number"), operation.alias("operation"), ids.alias("ids"), F.concat(F.lit("Title "), n.cast("string")).alias("label"))


@query()
def event_corrections_table(spark, sf_dir) -> DataFrame:
    """As many corrections as there are orders, replayed over the sessions; held against the plain loop by a test."""
    return E.corrected(E.sessionize(captures(spark, sf_dir)), made_corrections(spark, sf_dir)).select("id", "grp")


@query(f"""WITH {SESSIONS_SQL}, e AS (SELECT user_id, session, string_agg(DISTINCT album, ' ' ORDER BY album) AS title, min(captured_ms) AS start_ms FROM sessions GROUP BY ALL),
    s AS (SELECT *, (contains(lower(title), 'click')::INT + contains(lower(title), 'purchase')::INT) AS n FROM e)
    SELECT user_id, session, round(n / 2.0::DOUBLE + CASE WHEN n = 2 THEN 0.25 ELSE 0 END, 6) AS score FROM s WHERE n > 0 ORDER BY 3 DESC, start_ms DESC, user_id, session LIMIT 100""")
def event_search_score(spark, sf_dir) -> DataFrame:
    e = E.sessionize(captures(spark, sf_dir)).groupBy("user_id", "session").agg(F.array_join(F.array_sort(F.collect_set("album")), " ").alias("title"), F.min("captured_ms").alias("start_ms"))
    scored = E.search(e.withColumn("search_text", F.lit("")), ("click", "purchase")).withColumn("score", F.round("score", 6))
    return scored.orderBy(F.desc("score"), F.desc("start_ms"), "user_id", "session").limit(100).select("user_id", "session", "score")


@query(f"""WITH {SESSIONS_SQL}, r AS (SELECT id, user_id * 100000 + session AS event_id, row_number() OVER (ORDER BY quality DESC, id) AS rank FROM sessions QUALIFY rank <= 40),
    h AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY event_id) AS seen FROM r WHERE rank <= 20)
    SELECT id, rank::INT AS rank, event_id, row_number() OVER (ORDER BY turn, seen, id)::INT AS place FROM h UNION ALL SELECT id, rank::INT, event_id, rank::INT FROM r WHERE rank > 20""")
def event_diversity_top20(spark, sf_dir) -> DataFrame:
    s = E.sessionize(captures(spark, sf_dir)).select("id", "quality", (F.col("user_id") * 100000 + F.col("session")).alias("event_id"))
    best = R.top(s, "quality", 40)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("quality"), "id"))  # of 40 rows
    return R.diversify(best.withColumn("rank", rank))


@query(f"""WITH {SESSIONS_SQL}, hit AS (SELECT DISTINCT user_id, session FROM sessions WHERE album = 'purchase'), m AS (SELECT s.id FROM sessions s JOIN hit USING (user_id, session)) SELECT id FROM m WHERE id IN (SELECT id FROM captures WHERE quality > 20)""")
def event_expansion(spark, sf_dir) -> DataFrame:
    s = E.sessionize(captures(spark, sf_dir))
    hit = s.where("album = 'purchase'").select("user_id", "session").distinct()
    return E.expanded(s.join(hit, ["user_id", "session"], "left_semi").select("id"), s.where("quality > 20"), contextual=False)


@query(f"""WITH {SESSIONS_SQL}, g AS (SELECT user_id, session, sha256(string_agg(id::VARCHAR, chr(31) ORDER BY id::VARCHAR)) AS h FROM sessions GROUP BY ALL)
    SELECT user_id, session, h AS digest FROM g""")
def event_identity(spark, sf_dir) -> DataFrame:
    s = E.sessionize(captures(spark, sf_dir))
    return s.groupBy("user_id", "session").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), "\u001f"), 256).alias("digest"))


@query("""SELECT lower(event_type) AS place, epoch_us(ts) // 1000 // 1800000 AS bucket, count(*) AS members, min(event_id) AS first_id FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def burst_groups(spark, sf_dir) -> DataFrame:
    return E.bursts(captures(spark, sf_dir).withColumnRenamed("album", "location"))


@query("SELECT sha256(text) AS digest, count(*) AS members, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir) -> DataFrame:
    return E.exact_groups(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest")))


HASH = "conv(substring(sha2(cast(vec_id % 97 as string), 256), 1, 15), 16, 10)"


def picture_hashes(spark, sf_dir) -> DataFrame:
    """Stand-ins for pictures: a 60-bit hash shared by vectors of a residue, with a few bits turned; the kind is the label's parity."""
    v = load(spark, sf_dir, "embeddings")
    turned = F.expr("shiftleft(1L, cast(vec_id % 3 as int)) - 1")
    return v.select(
        F.col("vec_id").alias("id"), F.expr(HASH).cast("long").bitwiseXOR(turned).alias("phash"), F.when(F.col("label") % 2 == 0, "IMAGE").otherwise("VIDEO").alias("kind"),
        (F.col("vec_id") * 100).alias("captured_ms"), F.lit("").alias("text"), (F.col("vec_id") % 13 / 13.0).alias("quality"), (F.col("vec_id") % 5 * 100).alias("pixels"),
    )


PICTURES_SQL = """pictures AS (SELECT vec_id AS id, xor(('0x' || substr(sha256((vec_id % 97)::VARCHAR), 1, 15))::BIGINT, ((1::BIGINT << (vec_id % 3)::INT) - 1)) AS phash, CASE WHEN label % 2 = 0 THEN 'IMAGE' ELSE 'VIDEO' END AS kind,
    vec_id * 100 AS captured_ms FROM embeddings),
    pairs AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.phash, b.phash)) AS distance FROM pictures a JOIN pictures b ON a.id < b.id AND a.kind = b.kind
      WHERE (a.phash = b.phash AND a.id = (SELECT min(id) FROM pictures c WHERE c.kind = b.kind AND c.phash = b.phash)) OR (a.phash <> b.phash AND bit_count(xor(a.phash, b.phash)) <= 6 AND abs(a.captured_ms - b.captured_ms) <= 15000))"""


@query(f"WITH {PICTURES_SQL} SELECT a, b, distance::INT AS distance FROM pairs")
def hamming_pairs(spark, sf_dir) -> DataFrame:
    """Near-duplicate pairs, those of an equal hash with the least of them only."""
    p = picture_hashes(spark, sf_dir)
    links = duplicate_links(p)
    h = p.select("id", "phash")
    named = links.join(h.select(F.col("id").alias("a"), F.col("phash").alias("x")), "a").join(h.select(F.col("id").alias("b"), F.col("phash").alias("y")), "b")
    return named.select("a", "b", hamming(F.col("x"), F.col("y")).alias("distance"))


@query(f"""WITH RECURSIVE {PICTURES_SQL}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT id, id FROM pictures), reach(id, other) AS (SELECT a, b FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.other = e.a),
    c AS (SELECT id, min(other) AS component FROM reach GROUP BY id), x AS (SELECT *, (id % 13 / 13.0)::DOUBLE AS quality, id % 5 * 100 AS pixels, id * 7 % 1009 AS rank FROM c)
    SELECT component, arg_max(id, (coalesce(quality, 0), pixels, -rank, -id)) AS id, min(rank) AS rank, count(*) AS members FROM x GROUP BY component""")
def duplicate_representatives(spark, sf_dir) -> DataFrame:
    return representatives(collapse(picture_hashes(spark, sf_dir)).withColumn("rank", F.col("id") * 7 % 1009)).select("component", "id", "rank", "members")


@query(f"""WITH RECURSIVE {PICTURES_SQL}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT id, id FROM pictures), reach(id, other) AS (SELECT a, b FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.other = e.a)
    SELECT id, min(other) AS component FROM reach GROUP BY id""")
def duplicate_collapse(spark, sf_dir) -> DataFrame:
    return collapse(picture_hashes(spark, sf_dir)).select("id", "component")


@query(f"""WITH {MEDIA_SQL} SELECT id, unnest(list_transform(range(parts), lambda i: floor((i + 0.5::DOUBLE) * d / parts)::BIGINT)) AS at_ms FROM (SELECT id, (id % 60) * 1000 + 1 AS d, CASE WHEN (id % 60) * 1000 + 1 <= 30000 THEN least(greatest(ceil(((id % 60) * 1000 + 1) / 5000.0), 1), 6) ELSE 12 END::INT AS parts FROM media WHERE kind = 'VIDEO')""")
def keyframe_schedule(spark, sf_dir) -> DataFrame:
    clips = media(spark, sf_dir).where("kind = 'VIDEO'").select("id", (F.col("id") % 60 * 1000 + 1).alias("d"))
    return clips.select("id", F.explode(E.keyframe_times(F.col("d"))).alias("at_ms"))


@query(None)
def keyframes_kept(spark, sf_dir) -> DataFrame:
    """Frames that differ from the last kept one by 8 bits or more, of clips of 12 frames; order-dependent, held against Python in the tests."""
    p = picture_hashes(spark, sf_dir).select(F.expr("id div 12").alias("media_id"), F.col("id").alias("at_ms"), "phash")
    return thinned_frames(p)


@query(None)
def representative_greedy(spark, sf_dir) -> DataFrame:
    """Diverse representatives of each album, greedy by quality and distance; held against Python in the tests."""
    m = media(spark, sf_dir)
    phash = F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 15), 16, 10).cast("long")
    return selected_diverse(m.select("album", "id", "quality", phash.alias("phash"), "captured_ms", (F.col("id") % 4).alias("faces"), (F.trim("text") != "").alias("has_text"), ((F.col("id") % 3 + 1) / 2.0).alias("frame")), "album", 3)
