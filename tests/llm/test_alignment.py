"""Alignment against the tokenizers' own libraries and a plain walk over all ends."""

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from lumenark.llm import alignment as module  # noqa: E402
from lumenark.llm.alignment import Aligner, alignment, byte_alphabet, token_groups  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = byte_alphabet()
    for text in texts:
        if not text:
            yield None
            continue
        raw, ids_a, ids_b = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        yield (ids_a, of_a, ids_b, of_b) if b"".join(of_a) == raw == b"".join(of_b) else None


def ends(pieces):
    out = []
    for p in pieces:
        out.append((out[-1] if out else 0) + len(p))
    return out


def plain(rows):
    parts, count = [], {}
    for (doc_id, _), found in zip(rows, tokens([t for _, t in rows]), strict=True):
        if found is None:
            parts.append((doc_id, None))
            continue
        ids_a, of_a, ids_b, of_b = found
        at_a, at_b = ends(of_a), ends(of_b)
        shared = sorted(set(at_a) & set(at_b))
        by_a, by_b = dict(zip(at_a, ids_a, strict=True)), dict(zip(at_b, ids_b, strict=True))
        pairs = [(by_a[e], by_b[e]) for e in shared]
        groups_a, groups_b = {e: [] for e in shared}, {e: [] for e in shared}
        for groups, at, ids in ((groups_a, at_a, ids_a), (groups_b, at_b, ids_b)):
            k = 0
            for e, i in zip(at, ids, strict=True):
                while e > shared[k]:
                    k += 1
                groups[shared[k]].append(i)
        text = ";".join(",".join(map(str, groups_a[e])) + "|" + ",".join(map(str, groups_b[e])) for e in shared)
        for p in pairs:
            count[p] = count.get(p, 0) + 1
        parts.append((doc_id, (len(ids_a), len(ids_b), pairs, hashlib.sha256(text.encode()).hexdigest())))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(
        ((i, 0, 0, 0, 0, 0, 0, "") if p is None else (i, p[0], p[1], len(p[2]), len(p[2]), sum(count[x] == most[x[1]] for x in p[2]), sum(count[x] for x in p[2]), p[3]) for i, p in parts), key=repr
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


ODD = [
    "a", " ", "  two  blanks ", "\n\n\ttab", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ low line", "café 漢字仮名 \U0001f600\U0001f468‍\U0001f469  x", "\x00\x01 nul", "don't we'll I'VE",
    "antidisestablishmentarianism " * 3, "1234567890" * 5, "...---...", "ﬁ ligature Å", "é combining", "x" * 2_000, "　ideographic　space", "\r\nline\r\n",
]


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_like_a_plain_walk(docs, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_BYTES", block)
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "".join(rng.choice(ODD)[:9] + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    rows += [(1, None), (None, ""), (None, "a null id"), (7, "another text"), *rows[:5]]
    assert rows_of(alignment(docs(rows, extra=True), A, B)) == plain(rows)


def test_whole_table(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    assert rows_of(alignment(corpus, A, B)) == plain(rows)


def test_very_long_texts_and_white_space():
    own = Aligner(A, B)
    for text in ("\n" * 1_200_000 + "x", "word " * 30_000, "no_blank" * 20_000):
        ((a, b),) = own.tokens([text])
        keys = list(own.windows(a, b))
        assert sum((k[0] for k in keys[:50]), ()) == tuple(a[: sum(len(k[0]) for k in keys[:50])])
        assert sum(len(k[1]) for k in keys) == len(b)
        assert sum(len(g[0]) for k in keys for g in own.groups(*k)) == len(a)
    short = "line\n\n  of text " * 20
    whole = list(own.tokens([short]))
    module_limit, module.LONG_TEXT = module.LONG_TEXT, 10
    try:
        assert list(own.tokens([short])) == whole
    finally:
        module.LONG_TEXT = module_limit


def test_windows_do_not_change_groups_and_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(module, "CACHE_ENTRIES", 5)
    own = Aligner(A, B)
    for a, b in own.tokens([t for t in ODD if "▁" not in t]):
        whole = own.groups(tuple(a), tuple(b))
        assert [g for key in own.windows(a, b) for g in own.groups(*key)] == whole
        assert ";".join(own.window(k)[0] for k in own.windows(a, b)) == own.window((tuple(a), tuple(b)))[0]
        packed = np.array(a, own.kind), np.array(b, own.kind)
        assert own.aligned(*packed) == own.aligned(*packed) == [own.window(k) for k in own.windows(a, b)]
        assert len(own.cache) <= 5


def test_groups_and_empty_table(docs):
    text = "Alignment of cafés"
    (row,) = token_groups(docs([(1, text)]), A, B).collect()
    raw = (" " + text).encode()
    assert [g.start for g in row.groups] == [0, *[g.end for g in row.groups[:-1]]] and row.groups[-1].end == len(raw)
    assert token_groups(docs([(1, None)]), A, B).first().groups == []
    assert alignment(docs([]), A, B).count() == 0
    assert rows_of(alignment(docs([(1, None), (2, "")]), A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
