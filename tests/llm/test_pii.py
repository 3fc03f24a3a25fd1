"""Base spans against Python's re, the classifier's additions, and redaction."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from lumenark.llm import pii
from lumenark.llm.pii import KINDS, candidates, expectation_maximisation, fit, private_spans, redact_documents

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(BASE[k], text or "") if good(k, m[0])] for k in KINDS}


def test_base_spans(spark, docs, corpus):
    rng = random.Random(5)
    parts = ["a@b.c", "@", ".", "x.y%+", "+1", "(555)", " ", "-", "4111111111111111", "1", "23", "é😀", "0000", "255", "1.2.3.4", "\n", "256", "call", "(at)", "[dot]", "555-123-4567", "..", "a_", "d@e.f", "+49 30 1234567"]
    texts = [None, "", "1 " * 3000, "a" * 50_000, "1." * 2000, "9" * 20_000, "一" * 10 + "a@b.cc"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    rows = list(enumerate(texts)) + [(10_000 + r.doc_id, r.text) for r in corpus.where("doc_id < 300").collect()] + [(None, "a@b.cc"), (1, "")]
    text = dict(rows)
    got = private_spans(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = base_spans(text[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(spans[k]) for k in KINDS), text[r.doc_id]
        said = [f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",")) or not said
    assert private_spans(docs([])).count() == 0


def feature_code(value, before, after):
    """The classifier's own features, by plain Python."""
    d = re.sub("[^0-9]", "", value)
    n, marks = len(d), len(re.findall(r"[ .()-]", value))
    around = lambda c: 1 if re.fullmatch(r"[A-Za-z0-9_]", c) else 2 if c and c in "=/#$@:*+-" else 0
    values = [
        0 if n == 0 else 1 if n < 7 else 2 if n < 10 else 3 if n < 12 else 4 if n < 16 else 5 if n == 16 else 6,
        0 if marks == 0 else 1 if marks < 3 else 2 if marks < 5 else 3,
        1 if value[0] == "+" else 2 if value[0] == "(" else 3 if value[0].isascii() and value[0].isdigit() else 0,
        0 if n == 0 else 1 if d[0] < "2" else 2 if d[0] < "3" else 3 if d[0] < "7" else 4,
        1 if re.fullmatch(r"[^0-9]*[0-9]+", value) else 2 if re.fullmatch(r"[^0-9]{0,2}[0-9]{1,4}(?:[^0-9]{1,2}[0-9]{2,4})+", value) else 0,
        around(before[-1:]), around(after),
    ]
    code = 0
    for v, (_, size) in reversed(list(zip(values, pii.OWN, strict=True))):
        code = code * size + v
    return code


def vote_code(kind, value, before, after, strict):
    last, a = before[-1:], re.ASCII
    bounded_no = bool(last and re.search(r"[\w=/#$]", last, a)) or bool(re.search(r"\w", after, a))
    votes = [
        (1 if good(kind, value) else 2) if strict or kind == "card" else 0,
        1 if re.search(pii.GAZETTEER[kind], before, a) else 0, 2 if re.search(pii.AGAINST[kind], before, a) else 0,
        1 if re.search(pii.USUAL[kind], value, a) else 2, 2 if bounded_no else 1 if not last or re.search(r"[\s(<\[\"':,;]", last, a) else 0,
    ]
    return sum(v * 3**i for i, v in enumerate(votes))


def all_spans(text, model):
    """Base spans and additions of one text, candidate by candidate."""
    text, base, more = text or "", [], []
    for number, kind in enumerate(KINDS):
        for pattern, strict in ((BASE[kind], True), (pii.LOOSE[kind], False)):
            for m in re.finditer(pattern, text, re.ASCII):
                if strict and kind == "card" and len(re.sub("[^0-9]", "", m[0])) < 13:
                    continue
                if strict and good(kind, m[0]):
                    base.append((number, m.start(), m.end()))
                elif number in model.weights:
                    before, after = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 1]
                    votes = vote_code(kind, m[0], before, after, strict)
                    p = pii.probability(model.bias[number], model.weights[number], votes, feature_code(m[0], before, after))
                    if p >= model.thresholds[number] and votes % 3 != 2:
                        more.append((m.start(), number, m.end()))
    chosen = [(s, e) for _, s, e in base]
    out = list(base)
    for s, number, e in sorted(more):
        if not any(a < e and s < b for a, b in chosen):
            chosen.append((s, e))
            out.append((number, s, e))
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(out))


def planted(rng, n):
    """Texts with personal data that no strict pattern takes, and look-alikes: (id, text, the spans that are to be added)."""
    rows, fill = [], lambda k: " ".join(rng.choice(["the", "and", "one", "of", "heat", "on", "er"]) for _ in range(k))
    number = lambda: f"({rng.randint(201, 989)}) 555-{rng.randint(0, 9999):04d}"
    card = lambda: next(c for c in iter(lambda: f"4{rng.randrange(10**15):015d}", "") if good("card", c))
    for i in range(n):
        head, kind = fill(4), i % 8
        if kind == 0:
            rows.append((i, f"{head} +1 {number()} {fill(3)}", None))
        elif kind == 1:
            text = f"{head} my phone: "
            value = number()
            rows.append((i, f"{text}{value}, {fill(2)}", f"phone:{len(text)}:{len(text) + len(value)}"))
        elif kind == 2:
            text, value = f"{head} e-mail me: ", f"{rng.choice('abc')}x.{i} [at] mail{i}.org"
            rows.append((i, f"{text}{value} {fill(2)}", f"email:{len(text)}:{len(text) + len(value)}"))
        elif kind == 3:
            rows.append((i, f"{head} {card()} {fill(2)} mail{i}@site.org", None))
        elif kind == 4:  # a card swallowed by what follows
            c = card()
            rows.append((i, f"{head} {c} {rng.randint(100, 255)}.10.20.30 {fill(2)}", f"card:{len(head) + 1}:{len(head) + 17}"))
        elif kind == 5:
            rows.append((i, f"{head} order {next(c for c in iter(lambda: str(rng.randrange(10**15, 10**16)), '') if not good('card', c))} {fill(2)}", ""))
        elif kind == 6:
            rows.append((i, f"{head} part no. {rng.randint(100, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}-{i} and version 1.2.3.{300 + i}", ""))
        else:
            value = f"{number()[1:4]}"
            rows.append((i, f"{head} +1 ({value}) 555-0199 10.20.30.40 {fill(2)}", f"phone:{len(head) + 1}:{len(head) + 18}"))
    return rows


def test_what_is_added(docs):
    rows = planted(random.Random(4), 800)
    df = docs([r[:2] for r in rows])
    model = fit(df.select(candidates(F.col("text")).alias("candidates")))
    got = {r.doc_id: r for r in private_spans(df).collect()}
    missed, wrong, right = [], [], 0
    for i, text, want in rows:
        base = {f"{k}:{a}:{b}" for k in KINDS for a, b in base_spans(text)[k]}
        more = set(filter(None, got[i].spans.split(","))) - base
        if want is not None:
            right += bool(want) and want in more
            missed += [(text, want)] * (bool(want) and want not in more)
            wrong += [(text, m) for m in more - {want}]
        assert got[i].spans == all_spans(text, model), text
    assert right >= 0.95 * sum(bool(r[2]) for r in rows), (right, missed[:3])
    assert len(wrong) <= 0.05 * right, wrong[:5]
    assert all(0.5 < x < 1 for pairs in model.reliabilities.values() for p in pairs for x in p)


def test_additions_of_every_row_against_python(docs, corpus):
    rng = random.Random(6)
    parts = ["call ", "(212) 555-0199", " ", "a [at] b.org", "x(at)y (dot) net", "4111 1111 1111 1111", "4111111111111112", "+1 212 555 0199 1.2.3.4", "2001:db8:0:0:0:0:0:1", "v", "id=", "é", "\n", "1.2.3.999", "card ", "-", "7", "token", "\u2028", "İ"]
    rows = list(enumerate(["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(1500)])) + [(5000 + r.doc_id, r.text) for r in corpus.collect()] + [(-1, None), (-2, ""), (-3, "(212) 555-0199 " * 3000)]
    df = docs(rows)
    model = fit(df.select(candidates(F.col("text")).alias("candidates")))
    text, added = dict(rows), 0
    for r in private_spans(df).collect():
        assert r.spans == all_spans(text[r.doc_id], model), text[r.doc_id]
        added += len(list(filter(None, r.spans.split(",")))) > r.n_email + r.n_ip + r.n_card + r.n_phone
    assert added > 100


def test_em_finds_the_better_labeler():
    # labeler 0 agrees with 1 and 3 nearly always; labeler 4 is a coin
    counts = {}
    for truth in (1, 2):
        for flip in range(20):
            for coin in (1, 2):
                votes = [truth if flip else 3 - truth, truth, 0, truth, coin]
                code = sum(v * 3**i for i, v in enumerate(votes))
                counts[code] = counts.get(code, 0) + 50
    post, right = expectation_maximisation(counts)
    assert right[1][0] > right[4][0] + 0.2 and all((p > 0.9) == (code // 3 % 3 == 1) for code, p in post.items())


def test_redaction(docs):
    rows = [(1, "write a@b.cc or +1 212 555 0199 now é"), (2, "clean"), (3, None), (4, "4111 1111 1111 1111")]
    out = docs(rows, extra=True).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in redact_documents(out).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["write [EMAIL] or [PHONE] now é", "clean", None, "[CARD]"]
    assert got[1].n_chars == len(got[1].text) and got[1].candidates == "y" and redact_documents(out).columns == out.columns


def test_long_texts_full_of_matches(spark):
    rng = random.Random(9)
    some = lambda i: rng.choice([f"user{i}@mail{i % 7}.example.org", f"+1 415 555 {i % 10_000:04d}", f"10.0.{i % 256}.{i % 300}", "4111 1111 1111 1111", f"ann{i} [at] example [dot] org", f"+49 {i} 3333 4444.", "x"])
    short = [" ".join(some(j) for j in range(n)) for n in (1, 2, 63, 64, 65, 200)]
    long = "\n".join(some(j) + rng.choice(["", "\N{GRINNING FACE}é", "--"]) for j in range(6_000))
    rows = [*enumerate(short), (100, long), (101, "+" * 3_000 + "@" * 300_000), (102, "x@y.z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in private_spans(df).collect()}
    alike = private_spans(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.spans for r in alike.collect()} == {i: r.spans for i, r in got.items()}
    clean = {r.doc_id: r.text for r in redact_documents(df).collect()}
    for doc_id, text in rows:
        spans = [(a, b, k) for k, a, b in (x.split(":") for x in got[doc_id].spans.split(",") if x)]
        ordered = sorted((int(a), int(b), KINDS.index(k)) for a, b, k in spans)
        out, at = [], 0
        for a, b, k in ordered:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
                at = b
        assert clean[doc_id] == "".join(out) + text[at:], doc_id
        emails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        assert got[doc_id].n_email == len(emails) and set(emails) <= {(a, b) for a, b, k in ordered if k == 0}
    assert got[100].n_email > 800 and got[100].n_phone > 800
