"""Prefixes, completions and masks against Python."""

import random

from lumenark.llm.preferences import TURNS, conversations_of, preference_pairs, with_other_replies


def text(turns):
    safe = lambda s: s.replace("<|", "< |")
    return "".join(f"<|{safe(t[1])}|>\n{safe(t[2])}<|end|>\n" for t in turns)


def mask(turns):
    out, at = [], 0
    for t in turns:
        own = text([t])
        if t[1] == "assistant":
            out.append((at + len("<|assistant|>\n"), at + len(own) - 1))
        at += len(own)
    return out


def test_random_pairs(spark):
    rng = random.Random(1)
    some = lambda: (0, rng.choice(["user", "assistant", "system"]), rng.choice(["", "a", "b <|end|>", "é😀", "<|assistant|>\nx"]))
    rows = []
    for i in range(300):
        shared = [some() for _ in range(rng.randrange(4))]
        rows.append((i, shared + [some() for _ in range(rng.randrange(3))], shared + [some() for _ in range(rng.randrange(3))]))
    rows.append((300, [], []))
    got = {r.pair_id: r for r in preference_pairs(spark.createDataFrame(rows, f"pair_id long, chosen {TURNS}, rejected {TURNS}")).collect()}
    for i, a, b in rows:
        n = 0
        while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
            n += 1
        r = got[i]
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.rejected) == (n, text(a[:n]), text(a[n:]), text(b[n:]))
        assert [tuple(m) for m in r.chosen_mask] == mask(a[n:]) and [tuple(m) for m in r.rejected_mask] == mask(b[n:])
        assert all(r.chosen[s:e].endswith("<|end|>") for s, e in r.chosen_mask)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, None, "z"), (None, 0, "user", "x"), (2, 1, "assistant", "b"), (2, None, "system", "s"), (3, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as pair_id")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in conversations_of(df).collect()}
    assert got == {1: [(0, "user", "q"), (1, "assistant", ""), (2, "unknown", "z")], 2: [(None, "system", "s"), (1, "assistant", "b")], 3: [(0, "user", "only")]}
    pairs = sorted(with_other_replies(conversations_of(df)).collect())
    assert [(r.pair_id, [t.text for t in r.chosen], [t.text for t in r.rejected]) for r in pairs] == [(1, ["q", ""], ["s", "b"]), (2, ["s", "b"], ["q", ""])]
    none = spark.createDataFrame([], df.schema)
    assert preference_pairs(with_other_replies(conversations_of(none))).count() == 0


def ring(rows):
    """(chosen, rejected) of each conversation, from one sorted list of all."""
    import hashlib

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    talks = {}
    for c, t, role, body in rows:
        talks.setdefault(c, []).append((t, role, body))
    cut = {}
    for c, turns in talks.items():
        turns.sort()
        replies = [i for i, t in enumerate(turns) if t[1] == "assistant"]
        if replies:
            cut[c] = turns[: replies[-1] + 1]
    order = sorted(cut, key=lambda c: (md5(f"{cut[c][0][1]}\x1f{cut[c][0][2]}"), md5(c), c))
    return {c: (cut[c], cut[order[(i + 1) % len(order)]]) for i, c in enumerate(order)}


def test_pairs_share_their_opening_at_any_number_of_ranges(spark):
    rng = random.Random(3)
    openings = ["hot"] * 6 + ["a", "b", "c"] + [f"own {i}" for i in range(300)]
    rows = []
    for i in range(400):
        opening = rng.choice(openings)
        rows += [(f"c{i}", t, "assistant" if t % 2 else "user", opening if t == 0 else rng.choice(["yes", "no"]) + ("x" * 100_000 if i == 5 else "")) for t in range(rng.randrange(1, 6))]
    want = ring(rows)
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    for parts in ("1", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.pair_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in with_other_replies(conversations_of(df)).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert got == want
    found = preference_pairs(with_other_replies(conversations_of(df))).collect()
    assert sum(r.n_prompt_turns > 0 for r in found) > 60 and len({r.n_prompt_turns for r in found}) > 3
    alone = with_other_replies(conversations_of(df.where(df.conv_id == min(want)))).first()
    assert alone.chosen == alone.rejected
