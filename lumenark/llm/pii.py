"""Personal data by weak supervision, in DataFrame functions alone.

Candidates are spans of a text found by patterns of each kind, strict and loose. Labelers vote on each: whether a check
(checksum, range, number of digits) holds, whether words of a gazetteer stand before it, whether the surroundings look
like code or a measurement, whether the form is a usual one. Votes are counted by pattern; expectation-maximisation over
these counts estimates how reliable each labeler is for each kind. A span that fails its check is none.

A logistic span classifier is then trained on every candidate with the estimated labels. It sees the shape of a span and
its neighbours (number of digits, separators, opening, leading digit, grouping, characters around), and the votes, but
not that a check was passed: so it carries over from strict matches to spans that no strict pattern takes. Features are
small integers, so their combinations are counted and their number is bounded whatever the size of the corpus. Spans of
strict matches that pass their check (the base) always stay; of the other candidates those are added whose probability
reaches the threshold and that overlap neither a base span nor one added before, by start and then kind. The threshold
is the least at which the estimated labels of what is added are right in ``PRECISION`` of the cases.

Positions come from splitting a text at the matches of the pattern: gaps and matches alternate, so their lengths add up to
the places of the matches, in code points, end exclusive. Patterns take possessive repeats and look back where a start
within a failed run cannot match, so that matching is linear in the text. So is what follows: running sums and choices hand
a state on in chunks (``scanned``), overlaps are seen from the furthest end before and the next start behind, and parts of
a text are cut out of its pieces (``pages``). All is done within a row: a repeated row is
returned as often, and no row is joined with another.

Defined results: null and empty texts have no spans; an empty table gives an empty result; a text of any length is read
whole; of spans with equal starts the kind that comes first in ``KINDS`` goes first, then the shorter one; columns beyond
the named ones are ignored, and kept by ``redact_documents``, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

KINDS = ("email", "ip", "card", "phone")
#: What strict matches look like; a start inside a run that has failed cannot match, unless the last match ended there.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # from the first digit of a run; runs of under 13 digits can be skipped, as no start within them matches more
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?+){12}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates: addresses with written-out signs, IPv6 addresses, and card and telephone numbers within longer runs
#: or without a country prefix.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+ ?(?:[\[(]dot[\])] ?|\.)[A-Za-z]{2,24}+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.-])(?:[0-9]{13,19}+|[0-9]{4}+([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}+)(?![0-9-])",
    "phone": r"(?<![0-9+.()-])(?:\+[0-9]{1,3}+[ .-]?|(?<![0-9+] ))\(?[0-9]{3}\)?[ .-][0-9]{3}[-. ][0-9]{4}(?![0-9-])",
}
#: A text without these cannot have a match.
HINTS = {"email": "@", "ip": r"\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
LOOSE_HINTS = {"email": r"[\[(]at[\])]", "ip": r":[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{13}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}", "phone": r"[0-9]\)?[ .-][0-9]{3}[-. ][0-9]{4}"}
#: Words that announce a kind, in a few languages. ``END`` is the end of the text before a span.
END = r"(?![\s\S])"
GAZETTEER = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|kontakt|correo|courriel|adress\w*|mailto)\W*(?:\w+\W+){0,2}" + END,
    "ip": r"(?i)(?:\bip\b|address|host|server|client|login|logged|connection|serveur|servidor)\W*(?:\w+\W+){0,2}" + END,
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|carte|tarjeta|karte|payment)\W*(?:\w+\W+){0,2}" + END,
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|contact|reach|appel\w*|llam\w*|telefon\w*|t[eé]l[eé]phone|rufen)\W*(?:\w+\W+){0,2}" + END,
}
AGAINST = {
    "email": r"(?i)(?:git|ssh|rsync|scp)\W*" + END,
    "ip": r"(?i)(?:version|release|v|section|chapter|build)\W*" + END,
    "card": r"(?i)(?:isbn|order|invoice|serial|timestamp|hash|token|key|id)\W*" + END,
    "phone": r"(?i)(?:isbn|order|invoice|serial|version|score|part)\W*" + END,
}
USUAL = {
    "email": r"(?i)(?:@|\bat\b).*\.?[a-z]{2,24}" + END,
    "ip": r"^[1-9][0-9]{0,2}(\.[0-9]{1,3}){3}" + END + r"|^[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4}){7}" + END,
    "card": r"^(?:[3-6][0-9]{12,18}|[3-6][0-9]{3}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})" + END,
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}" + END,
}
LABELERS = ("checked", "gazetteer", "against", "shape", "bounded")
#: The classifier's own features, and how many values each has; after them come votes (0, 1, 2), of the check only that it failed.
OWN = (("digits", 7), ("separators", 4), ("opening", 4), ("leading", 5), ("grouping", 3), ("before", 3), ("after", 3))
CONTEXT, PRECISION, STEPS = 40, 0.9, 25
#: Items that are appended one by one, and code points of a piece of text.
CHUNK, PAGE = 64, 256


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a column that a function's body names would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def scanned(items: Column, state: Column, kind: str, step) -> Column:
    """What ``step``, (state, item) to (state, array of ``kind``), gives over the items in order, with the state handed on.

    Appending copies what there is, so it is done within chunks, and chunks are appended as wholes.
    """
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return once(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def over(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda i: F.slice(all_, i * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(all_) == 0, none).otherwise(F.aggregate(parts, F.struct(state.alias("state"), nones.alias("out")), chunk, lambda acc: F.flatten(acc["out"])))

    return once(items, over)


def pages(text: Column) -> Column:
    """The text in pieces of ``PAGE`` code points: a part of it is found without reading the text from its start."""
    return F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % PAGE), F.lit(0))


def part(pages_: Column, start: Column, n: Column) -> Column:
    """``n`` code points from ``start`` (0 is the first)."""
    first = F.floor(start / PAGE).cast("int")
    joined = F.array_join(F.slice(pages_, first + 1, F.floor((start + n) / PAGE).cast("int") - first + 1), "")
    return F.when((n > 0) & (first < F.size(pages_)), F.substring(joined, start - first * PAGE + 1, n)).otherwise("")


def matched(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost and without overlap: array of (skip, n, value), code points before and in each."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return once(found, lambda f: F.zip_with(F.slice(gaps, F.lit(1), F.size(f)), f, lambda gap, value: F.struct(F.length(gap).alias("skip"), F.length(value).alias("n"), value.alias("value"))))


def places(matches: Column, source: Column) -> Column:
    """Matches with their places: array of (source, start, end, value)."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["skip"]
        return start + x["n"], F.array(F.struct(source.alias("source"), start.alias("start"), (start + x["n"]).alias("end"), x["value"].alias("value")))

    return scanned(matches, F.lit(0), "struct<source:int,start:int,end:int,value:string>", step)


def passes(kind: str, value: Column) -> Column:
    """Whether a strict match passes its check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":

        def in_range(part: Column) -> Column:
            rest = F.ltrim(part, F.lit("0"))
            return (F.length(rest) <= 3) & (F.concat(F.lit("0"), F.substring(rest, 1, 3)).cast("int") <= 255)

        return F.forall(F.split(value, r"\."), in_range)
    digits = F.regexp_replace(value, r"[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", F.substring(digits, 1, 19))
    return F.length(digits).between(9, 15)


def _code(digits: list[tuple[Column, int]]) -> Column:
    """Small integers in one, the first least."""
    return reduce(lambda code, d: code * d[1] + d[0], reversed(digits), F.lit(0)).cast("int")


def _by_kind(kind: Column, of) -> Column:
    """``of`` the name of the kind with this number."""
    return reduce(lambda out, k: F.when(kind == k, of(KINDS[k])).otherwise(out), reversed(range(len(KINDS) - 1)), of(KINDS[-1]))


def _votes(kind: Column, value: Column, before: Column, after: Column, checked: Column) -> Column:
    """The labelers' votes: in base 3 by LABELERS; 0 abstains, 1 is for, 2 against."""
    last = F.right(before, F.lit(1))
    vote = lambda yes, no: F.when(no, 2).when(yes, 1).otherwise(0)
    none = F.lit(False)
    usual = _by_kind(kind, lambda k: value.rlike(USUAL[k]))
    votes = [
        checked,
        vote(_by_kind(kind, lambda k: before.rlike(GAZETTEER[k])), none),
        vote(none, _by_kind(kind, lambda k: before.rlike(AGAINST[k]))),
        vote(usual, ~usual),
        vote((last == "") | last.rlike(r"[\s(<\[\"':,;]"), (last != "") & last.rlike(r"[\w=/#$]") | after.rlike(r"\w")),
    ]
    return _code([(v, 3) for v in votes])


def _own(value: Column, before: Column, after: Column) -> Column:
    """The classifier's own features in one integer, by OWN."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    n, first = F.length(digits), F.substring(digits, 1, 1)
    marks = F.length(F.regexp_replace(value, r"[^ .()-]", ""))
    around = lambda c: F.when(c.rlike(r"[A-Za-z0-9_]"), 1).when(c.rlike(r"[=/#$@:*+-]"), 2).otherwise(0)
    values = [
        F.when(n == 0, 0).when(n < 7, 1).when(n < 10, 2).when(n < 12, 3).when(n < 16, 4).when(n == 16, 5).otherwise(6),
        F.when(marks == 0, 0).when(marks < 3, 1).when(marks < 5, 2).otherwise(3),
        F.when(value.startswith("+"), 1).when(value.startswith("("), 2).when(value.rlike(r"^[0-9]"), 3).otherwise(0),
        F.when(first == "", 0).when(first < "2", 1).when(first < "3", 2).when(first < "7", 3).otherwise(4),
        F.when(value.rlike(r"^[^0-9]*[0-9]+" + END), 1).when(value.rlike(r"^[^0-9]{0,2}[0-9]{1,4}(?:[^0-9]{1,2}[0-9]{2,4})+" + END), 2).otherwise(0),
        around(F.right(before, F.lit(1))), around(after),
    ]
    return _code([(v, size) for v, (_, size) in zip(values, OWN, strict=True)])


def _candidate(pages_: Column):
    """A match as a candidate span; sources are the kinds, each strict and loose."""

    def of(s: Column) -> Column:
        kind, strict = F.floor(s["source"] / 2).cast("int"), s["source"] % 2 == 0
        before = part(pages_, F.greatest(s["start"] - CONTEXT, F.lit(0)), F.least(s["start"], F.lit(CONTEXT)))
        passed = F.when(strict | (kind == KINDS.index("card")), _by_kind(kind, lambda k: passes(k, s["value"])))

        def judged(c: Column) -> Column:
            checked = F.when(c["passed"].isNull(), 0).when(c["passed"], 1).otherwise(2)
            votes, own = _votes(kind, s["value"], c["before"], c["after"], checked), _own(s["value"], c["before"], c["after"])
            return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), strict.alias("strict"), (strict & c["passed"]).alias("passed"), votes.alias("votes"), own.alias("own"))

        return once(F.struct(before.alias("before"), part(pages_, s["end"], F.lit(1)).alias("after"), passed.alias("passed")), judged)

    return of


def candidates(text: Column) -> Column:
    """All candidate spans of a text: array of (kind, start, end, strict, passed, votes, own), by kind and start."""
    text = F.coalesce(text, F.lit(""))
    no_match = F.array().cast("array<struct<skip:int,n:int,value:string>>")
    kind_of = "array<struct<kind:int,start:int,end:int,strict:boolean,passed:boolean,votes:int,own:int>>"
    sources = []
    for kind in KINDS:
        for pattern, hint in ((STRICT[kind], HINTS[kind]), (LOOSE[kind], LOOSE_HINTS[kind])):
            sources.append(F.when(text.contains(hint) if len(hint) == 1 else text.rlike(hint), matched(text, pattern)).otherwise(no_match))
    found = F.flatten(F.transform(F.array(*sources), lambda matches, source: places(matches, source)))

    def judged(at: Column) -> Column:
        some = once(pages(text), lambda p: F.transform(at, _candidate(p))).cast(kind_of)
        return F.when(F.size(at) == 0, F.array().cast(kind_of)).otherwise(F.array_sort(some))

    return once(found, judged)


@dataclass
class Model:
    """For each kind the weights of the span classifier (bias, then a table of weights for each feature) and a threshold."""

    bias: dict[int, float] = field(default_factory=dict)
    weights: dict[int, list[list[float]]] = field(default_factory=dict)
    thresholds: dict[int, float] = field(default_factory=dict)
    reliabilities: dict[int, list[tuple[float, float]]] = field(default_factory=dict)

    def wanted(self, kind: Column, votes: Column, own: Column) -> Column:
        """Whether the classifier reaches the threshold of the kind."""
        out = F.lit(False)
        digits, step = [], 1
        for _, size in OWN:
            digits.append(F.pmod(F.floor(own / step), F.lit(size)))
            step *= size
        digits += [F.pmod(F.floor(votes / 3**i), F.lit(3)) for i in range(len(LABELERS))]
        digits[len(OWN)] = F.when(digits[len(OWN)] == 2, 2).otherwise(0)  # of the check only that it failed
        for k, tables in self.weights.items():
            z = reduce(lambda z, x: z + F.element_at(F.expr(f"array({', '.join(f'{w!r}D' for w in x[0])})"), x[1].cast("int") + 1), zip(tables, digits, strict=True), F.lit(self.bias[k]))
            out = F.when(kind == k, 1 / (1 + F.exp(-z)) >= self.thresholds[k]).otherwise(out)
        return out


def _split_votes(code: int) -> list[int]:
    return [code // 3**i % 3 for i in range(len(LABELERS))]


def features_of(votes: int, own: int) -> list[int]:
    """The values of all features of a pattern; that a check was passed isn't among them."""
    out = []
    for _, size in OWN:
        out.append(own % size)
        own //= size
    checked, *rest = _split_votes(votes)
    return [*out, 2 * (checked == 2), *rest]


def failed(votes: int) -> bool:
    """Whether a check speaks against a span: such spans are labelled as none, and never added."""
    return votes % 3 == 2


def expectation_maximisation(counts: dict[int, int], steps: int = STEPS, none: frozenset[int] = frozenset()) -> tuple[dict[int, float], list[tuple[float, float]]]:
    """From counts of vote patterns: the probability of each pattern (0 for those of ``none``), and each labeler's (right on yes, right on no)."""
    votes = {p: _split_votes(p) for p in counts}
    # a check is taken to be right more often than a hint, before any vote is seen
    before = [(0.95, 0.95), *[(0.8, 0.8)] * (len(LABELERS) - 1)]
    prior, right = 0.5, before
    post: dict[int, float] = {}
    for _ in range(steps):
        for p, vs in votes.items():
            yes, no = math.log(prior), math.log(1 - prior)
            for v, (a, b) in zip(vs, right, strict=True):
                if v:
                    yes += math.log(a if v == 1 else 1 - a)
                    no += math.log(1 - b if v == 1 else b)
            post[p] = 0.0 if p in none else 1 / (1 + math.exp(max(-500, min(500, no - yes))))
        total = sum(counts.values())
        prior = min(0.99, max(0.01, (sum(post[p] * n for p, n in counts.items()) + 1) / (total + 2)))
        right = []
        for i in range(len(LABELERS)):
            a = b = 0.0
            yes = no = 0.0
            for p, n in counts.items():
                if (v := votes[p][i]) == 0:
                    continue
                yes, no = yes + n * post[p], no + n * (1 - post[p])
                a += n * post[p] * (v == 1)
                b += n * (1 - post[p]) * (v == 2)
            # ten times as sure before as one vote; better than chance
            p, q = before[i]
            right.append((min(0.99, max(0.55, (a + 10 * p) / (yes + 10))), min(0.99, max(0.55, (b + 10 * q) / (no + 10)))))
    return post, right


def _logistic(patterns: list[tuple[int, int, int]], target: dict[int, float], steps: int = 30) -> tuple[float, list[list[float]]]:
    """Bias and weights of all features for the estimated labels, by Newton steps on counted patterns (votes, own, n)."""
    sizes = [*(size for _, size in OWN), *[3] * len(LABELERS)]
    starts = np.concatenate(([1], 1 + np.cumsum(sizes)))
    x = np.zeros((len(patterns), int(starts[-1])))
    x[:, 0] = 1
    for row, (votes, own, _) in enumerate(patterns):
        x[row, starts[:-1] + features_of(votes, own)] = 1
    n, y = np.array([p[2] for p in patterns], float), np.array([target[p[0]] for p in patterns])
    n, w = n * min(1.0, 1e5 / n.sum()), np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (n * (y - p)) - 0.5 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    w = np.round(w, 6)
    return float(w[0]), [w[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]


def probability(bias: float, weights: list[list[float]], votes: int, own: int) -> float:
    z = bias + sum(w[f] for w, f in zip(weights, features_of(votes, own), strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _threshold(scored: list[tuple[float, float, int]], precision: float) -> float:
    """The least probability from which the estimated labels (probability, label, n) are right as often as wanted; 1.01 if there is none."""
    best, right, total = 1.01, 0.0, 0
    scored = sorted(scored, reverse=True)
    for i, (p, label, n) in enumerate(scored):
        right, total = right + n * label, total + n
        last = i + 1 == len(scored) or scored[i + 1][0] < p
        if last and p >= 0.5 and right >= precision * total:
            best = p
    return best - 1e-9


def fit(found: DataFrame, precision: float = PRECISION) -> Model:
    """A model from candidate spans (a column ``candidates``): only counts of patterns of bounded features reach the driver."""
    counted = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.own", "c.passed").agg(F.count("*").alias("n")).collect()
    model = Model()
    for kind in range(len(KINDS)):
        own = sorted((r.votes, r.own, r.passed, r.n) for r in counted if r.kind == kind)
        if not own:
            continue
        counts: dict[int, int] = {}
        for votes, _, _, n in own:
            counts[votes] = counts.get(votes, 0) + n
        post, model.reliabilities[kind] = expectation_maximisation(counts, none=frozenset(filter(failed, counts)))
        bias, weights = _logistic([(v, o, n) for v, o, _, n in own], post)
        model.bias[kind], model.weights[kind] = bias, weights
        model.thresholds[kind] = _threshold([(probability(bias, weights, v, o), post[v], n) for v, o, passed, n in own if not passed and not failed(v)], precision)
    return model


SPAN = "struct<start:int,kind:int,end:int>"


def spans(found: Column, model: Model) -> Column:
    """Base spans and those that the classifier adds: array of (kind, start, end, base), by kind and start."""
    kind_of, span = "struct<kind:int,start:int,end:int,base:boolean>", lambda c, base: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(base).alias("base"))
    usable = F.filter(found, lambda c: c["passed"] | (c["votes"] % 3 != 2) & model.wanted(c["kind"], c["votes"], c["own"]))
    # by start; at one start base spans first
    ordered = F.array_sort(F.transform(usable, lambda c: F.struct(c["start"].alias("start"), (~c["passed"]).alias("added"), c["kind"].alias("kind"), c["end"].alias("end"))))

    def forward(end: Column, c: Column) -> tuple[Column, Column]:
        """Whether a base span that began before, or here, reaches beyond the start."""
        base = ~c["added"]
        return F.when(base, F.greatest(end, c["end"])).otherwise(end), F.array(base | (end <= c["start"]))

    def backward(start: Column, c: Column) -> tuple[Column, Column]:
        """Whether a base span begins before the end."""
        base = ~c["added"]
        return F.when(base, c["start"]).otherwise(start), F.array(base | (start >= c["end"]))

    def greedy(end: Column, c: Column) -> tuple[Column, Column]:
        """Those that do not overlap what was added before."""
        fits = c["start"] >= end
        return F.when(fits, c["end"]).otherwise(end), F.when(fits, F.array(span(c, False)).cast(f"array<{kind_of}>")).otherwise(F.array().cast(f"array<{kind_of}>"))

    def chosen(all_: Column) -> Column:
        free = F.zip_with(scanned(all_, F.lit(0), "boolean", forward), F.reverse(scanned(F.reverse(all_), F.lit(2147483647), "boolean", backward)), lambda a, b: a & b)
        base = F.transform(F.filter(all_, lambda c: ~c["added"]), lambda c: span(c, True)).cast(f"array<{kind_of}>")
        open_ = F.filter(F.zip_with(all_, free, lambda c, ok: F.when(ok & c["added"], c)), lambda c: c.isNotNull())
        added = F.when(F.exists(all_, lambda c: c["added"]), scanned(open_, F.lit(0), kind_of, greedy)).otherwise(F.array().cast(f"array<{kind_of}>"))
        return F.array_sort(F.concat(base, added))

    return once(ordered, chosen)


def _joined(spans_: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def private_spans(documents: DataFrame) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): number of base spans of each kind, their digest, and all spans."""
    found = written(documents.select("doc_id", candidates(F.col("text")).alias("candidates")), "candidates")
    out = found.select("doc_id", spans(F.col("candidates"), fit(found)).alias("all"))
    base = F.filter("all", lambda s: s["base"])
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def redacted(text: Column, spans_: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    names = F.array(*map(lambda k: F.lit(f"[{k.upper()}]"), KINDS))
    ordered = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(all_: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            later = s["start"] < at
            piece = F.struct(at.alias("at"), (s["start"] - at).alias("n"), s["kind"].alias("kind"))
            return F.when(later, at).otherwise(s["end"]), F.when(later, F.array().cast(f"array<{piece_of}>")).otherwise(F.array(piece).cast(f"array<{piece_of}>"))

        piece_of = "struct<at:int,n:int,kind:int>"
        end = F.array(F.struct(F.lit(2147483647).alias("start"), F.lit(2147483647).alias("end"), F.lit(-1).alias("kind")))  # the rest of the text
        pieces = scanned(F.concat(all_, end), F.lit(0), piece_of, step)
        n = F.length(text)
        whole = lambda p: F.transform(pieces, lambda x: F.concat(part(p, x["at"], F.when(x["kind"] < 0, n - x["at"]).otherwise(x["n"])), F.when(x["kind"] < 0, "").otherwise(F.element_at(names, x["kind"] + 1))))
        return F.array_join(once(pages(text), whole), "")

    return F.when(F.size(spans_) == 0, text).otherwise(once(ordered, cut))


def redact_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with personal data in ``text`` replaced; ``n_chars``, where it is there, is counted anew."""
    # the row is kept in one column, so that no name of the table can clash with ours
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    found = written(documents.select(row, candidates(F.col("text")).alias("candidates")), "redaction")
    text = redacted(F.col("row.text"), spans(F.col("candidates"), fit(found)))
    columns = {c: F.col(f"row.`{c}`") for c in documents.columns} | {"text": text}
    out = found.select(*[v.alias(c) for c, v in columns.items()])
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out
