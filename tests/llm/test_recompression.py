"""Global names: one name for one expansion, and equal stretches parsed alike inside."""

import random

from lumenark.llm.recompression import parsed
from lumenark.llm.substring_dedup import EDGE


def test_names_are_global_and_stretches_alike(spark):
    rng = random.Random(2)
    shared = [rng.choice(["a", "b", "c", "d", "dd"]) for _ in range(70)]
    texts = [[f"{i}w{rng.randrange(9)}" for _ in range(rng.randrange(40))] + shared + ["run"] * rng.randrange(9) + [f"z{rng.randrange(5)}" for _ in range(30)] for i in range(12)]
    df = spark.createDataFrame([(" ".join(t),) for t in texts] + [(None,), ("",)], "text string").coalesce(1)
    rows = {}
    for r in parsed(df).collect():
        rows.setdefault(r.row, []).append((r.at, r.symbol, r.span))
    expansion = {}
    assert len(rows) == len(texts)
    for row, symbols in rows.items():
        words, at = texts[row], 0
        for start, symbol, span in sorted(symbols):
            assert start == at  # symbols tile the text
            at += span
            assert expansion.setdefault(symbol, tuple(words[start : start + span])) == tuple(words[start : start + span])
        assert at == len(words)
    inner = set()
    for row, symbols in rows.items():
        low = next(i for i in range(len(texts[row])) if texts[row][i : i + 70] == shared)
        inner.add(tuple((s - low, x) for s, x, n in sorted(symbols) if low + EDGE <= s and s + n <= low + 70 - EDGE))
    assert len({x[1:-1] for x in inner}) == 1
    assert parsed(df.limit(0)).count() == 0
