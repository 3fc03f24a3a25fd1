"""Repeated passages against a dictionary of all windows; the parse is the same in the interior of equal stretches."""

import hashlib
import random
import re

import numpy as np
import pytest

from lumenark.llm import substring_dedup as substring_dedup_module
from lumenark.llm.kernels import mix
from lumenark.llm.substring_dedup import AFTER, EDGE, WINDOW, anchors, recompressed, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """What is left of each row: (n_words, n_removed, digest) by place."""
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - 49 if d is not None else 0):
            first[tuple(w[i : i + 50])] = min(d, first.get(tuple(w[i : i + 50]), d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 49 if d is not None else 0):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def same(got, rows):
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == sorted(((d, *x) for (d, _), x in zip(rows, brute(rows), strict=True)), key=repr)


def rows_of(seed, n):
    rng = random.Random(seed)
    base = [rng.choice(["a", "b", "c", "dd", "é", "f g"]) for _ in range(4000)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.4:
                a = rng.randint(0, 3900)
                parts += base[a : a + rng.randint(20, 120)]
            elif kind < 0.6:
                parts += ["run"] * rng.randint(1, 130)
            elif kind < 0.7:
                parts += ["x", "y"] * rng.randint(1, 70)
            else:
                parts += [str(rng.random()) for _ in range(rng.randint(0, 30))]
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(parts) if parts or i % 2 else None))
    return rows


def test_against_all_windows(docs, corpus):
    rows = rows_of(4, 250) + [(1000 + r.doc_id, r.text) for r in corpus.where("doc_id < 400").collect()]
    rows += [(5000 + i, rows[i][1]) for i in range(40)] + [rows[3], (None, "a " * 100)]
    same(substring_dedup(docs(rows, extra=True)).collect(), rows)
    assert substring_dedup(docs([])).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_rows_that_repeat_an_id_are_judged_by_their_own_texts(docs, monkeypatch, few):
    monkeypatch.setattr(substring_dedup_module, "BROADCAST_IDS", few)
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(120))
    rows = [(1, a), (2, f"{a} {b[:300]}"), (2, "another text " * 40), (2, f"{b} more"), (2, f"{b} more"), (3, b), (3, a), (3, None), (4, f"x {b} y {a} z"), (4, "short")]
    rows += [(7, f"{i} {a if i % 2 else b} {' '.join(f'{i}w{j}' for j in range(70))}") for i in range(40)]  # one id for many texts
    rows += [(i // 3, t) for i, t in rows_of(8, 90)]
    same(substring_dedup(docs(rows)).collect(), rows)


def test_a_very_long_text(docs):
    rng = random.Random(6)
    long = " ".join(str(rng.randrange(9)) if i % 90_000 < 60_000 else "run" for i in range(200_000))
    rows = [(1, " ".join(long.split(" ")[1_000:1_080])), (2, long), (3, " ".join(long.split(" ")[150_000:150_200]))]
    same(substring_dedup(docs(rows)).collect(), rows)


def test_interior_of_equal_stretches_is_parsed_alike():
    rng = np.random.default_rng(3)
    for alphabet in (2, 4, 1000):
        middle = mix(rng.integers(0, alphabet, WINDOW).astype(np.uint64))
        seen = set()
        for _ in range(20):
            a, b = (mix(rng.integers(0, alphabet, rng.integers(0, 80)).astype(np.uint64)) for _ in range(2))
            words = np.concatenate((a, middle, b))
            symbol, start = recompressed(words, np.zeros(len(words), int))
            inner = [(int(s) - len(a), int(x)) for s, x in zip(start, symbol, strict=True) if len(a) + EDGE <= s < len(a) + WINDOW - EDGE - 8]
            seen.add(tuple(inner))
            at, keys = anchors(words, np.array([0, len(words)]))
            assert any(len(a) <= p - EDGE and p + AFTER <= len(a) + WINDOW for p in at), "each window has an anchor"
        assert len({s[:1] + s[-1:] for s in seen}) == 1
