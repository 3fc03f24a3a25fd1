"""Line-first quality rules: each line is judged, failing lines go, and a document that loses too much text is rejected.

A line fails if it is noise (symbols), shouting (upper case or exclamation), navigation (menu separators, or a few words
without an end), boilerplate (a known phrase, in a line of at most ``PHRASE_WORDS`` words) or a repetition (an earlier line of the text, or few different words). A
line of prose that lacks final punctuation is judged leniently: it fails only if it is short. Blank lines are neutral. A
document is rejected if its base rules fail (too few words; mostly repeated 3-word windows) or if failing lines hold
more than ``max_lost`` of its word characters.

All counts are taken with arrays over whole texts; nothing is cut at a length. Defined results: null texts are empty;
an empty text has zero counts, fails the base rules and is not kept; a text that loses exactly ``max_lost`` is kept; of
equal lines the first stays; repeated rows are each returned; an empty table gives an empty result; columns beyond the
named ones are ignored, and kept by ``clean_documents``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import AS_IS, NOT_SPACE, blocks, in_one_text, slice_hashes, windows, word_bounds

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
MAX_LOST = 0.5
#: A phrase makes boilerplate of a line of at most so many words; in a longer one, or a text of one line, it is a mention.
PHRASE_WORDS = 40
#: Phrases of licences, consent banners and page furniture.
BOILERPLATE = (
    b"all rights reserved", b"licensed under", b"released under the", b"general public license", b"terms of use", b"terms of service",
    b"privacy policy", b"cookie policy", b"use cookies", b"javascript", b"lorem ipsum", b"subscribe to", b"sign up for", b"click here", b"read more",
    b"alle rechte vorbehalten", b"datenschutzerkl", b"nutzungsbedingungen", b"verwenden cookies", b"mehr erfahren",
    b"tous droits r", b"mentions l\xc3\xa9gales", b"politique de confidentialit", b"utilise des cookies", b"en savoir plus",
    b"todos los derechos reservados", b"aviso legal", b"pol\xc3\xadtica de privacidad", b"utiliza cookies", b"leer m\xc3\xa1s",
)
#: Characters that end a sentence or a quotation, beyond ASCII.
ENDS = "…”’»›。．！？」』؟۔।॥"
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_POINT = np.zeros(256, bool)  # bytes that start a character
_POINT[[*range(0x80), *range(0xC0, 0x100)]] = True
_BREAK = np.ones(256, bool)
_BREAK[10] = False
_BANG, _PIPE = np.zeros(256, bool), np.zeros(256, bool)
_BANG[33] = _PIPE[124] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;\"')]")] = True
_LONG_ENDS = {n: np.array(sorted(int.from_bytes(c.encode(), "big") for c in ENDS if len(c.encode()) == n), np.int64) for n in (2, 3)}


def ended_at(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character before each place ends a sentence; whole characters are compared."""
    out = _END[buf[ends - 1]]
    for n, table in _LONG_ENDS.items():
        here = np.flatnonzero(ends >= n)
        code = np.zeros(len(here), np.int64)
        for j in range(n, 0, -1):
            code = code << 8 | buf[ends[here] - j]
        out[here] |= np.isin(code, table)
    return out


class Judged:
    """Counts of each text of a block, and its lines with a verdict."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, n = buf, len(offsets) - 1
        count = lambda table: np.concatenate(([0], np.cumsum(table[buf])))
        starts, ends, first = word_bounds(buf, offsets, NOT_SPACE)
        words = slice_hashes(buf, starts, ends, AS_IS)
        points, symbols = count(_POINT & NOT_SPACE), count(_SYMBOLS)
        self.n_words, self.word_chars, self.n_symbols = np.diff(first), np.diff(points[offsets]), np.diff(symbols[offsets])
        repeated = np.zeros(len(words) + 1, np.int64)
        three, ok = windows(words, 3), in_one_text(first, 3)
        for i in range(n):
            a, b = first[i], first[i + 1] - 2
            if b - a < 2:
                continue
            _, inverse, times = np.unique(three[a:b], return_inverse=True, return_counts=True)
            at = a + np.flatnonzero(times[inverse] > 1)
            repeated[at] += 1
            repeated[at + 3] -= 1
        del ok
        covered = np.concatenate(([0], np.cumsum(np.cumsum(repeated[:-1]) > 0)))
        self.n_repeat_words = covered[first[1:]] - covered[first[:-1]]
        # lines that have a word
        ls, le, _ = word_bounds(buf, offsets, _BREAK)
        chars = points[le] - points[ls]
        has = chars > 0
        self.ls, self.le, chars = ls[has], le[has], chars[has]
        self.first_line = np.searchsorted(self.ls, offsets, "left")
        hashes = slice_hashes(buf, self.ls, self.le, AS_IS)
        again = np.zeros(len(self.ls), bool)
        for i in range(n):
            a, b = self.first_line[i], self.first_line[i + 1]
            if b - a > 1:
                again[a:b] = True
                again[a + np.unique(hashes[a:b], return_index=True)[1]] = False
        total = np.concatenate(([0], np.cumsum(again)))
        self.n_dup_lines = total[self.first_line[1:]] - total[self.first_line[:-1]]
        of = lambda table: (c := count(table))[self.le] - c[self.ls]
        letters, lw = of(_LETTER), np.searchsorted(starts, self.le, "left") - (w0 := np.searchsorted(starts, self.ls, "left"))
        noise = 10 * (symbols[self.le] - symbols[self.ls]) > chars
        shout = (letters >= 12) & (10 * of(_UPPER) > 6 * letters) | (of(_BANG) * 4 > lw) & (lw >= 4)
        bars = _PIPE[buf]
        bars[1:] |= (buf[1:] == 0xBB) & (buf[:-1] == 0xC2)  # '»'; its last byte alone is also in other letters
        bars = np.concatenate(([0], np.cumsum(bars)))
        menu = 4 * (bars[self.le] - bars[self.ls]) > lw
        last = np.searchsorted(ends, self.le, "right") - 1  # the last word of the line
        ended = ended_at(buf, ends[last]) if len(ends) else np.zeros(0, bool)
        short = ~ended & (lw < 4)
        same = np.concatenate(([0], np.cumsum(np.concatenate((words[1:] == words[:-1], [False]))))) if len(words) else np.zeros(1, int)
        stuck = (lw >= 8) & (2 * (same[np.maximum(w0 + lw - 1, 0)] - same[w0]) > lw)
        self.failed = noise | shout | menu | short | stuck | again
        low = buf.tobytes().lower()
        for phrase in BOILERPLATE:
            at = low.find(phrase)
            while at >= 0:
                k = np.searchsorted(self.ls, at, "right") - 1
                if k >= 0 and at + len(phrase) <= self.le[k] and lw[k] <= PHRASE_WORDS:
                    self.failed[k] = True
                at = low.find(phrase, at + 1)
        lost = np.concatenate(([0], np.cumsum(np.where(self.failed, chars, 0))))
        self.lost = lost[self.first_line[1:]] - lost[self.first_line[:-1]]
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEATED_PERCENT * self.n_words)

    def kept(self, max_lost: float) -> np.ndarray:
        return ~self.base_failed & (self.lost <= max_lost * self.word_chars)

    def cleaned(self, i: int) -> str:
        """The text of document ``i`` without its failing lines."""
        at = [k for k in range(self.first_line[i], self.first_line[i + 1]) if not self.failed[k]]
        return b"\n".join(self.buf[self.ls[k] : self.le[k]].tobytes() for k in at).decode("utf-8", "replace")


def _report(max_lost: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")}
            for _, _, buf, offsets in blocks(batch.column(1)):
                j = Judged(buf, offsets)
                for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"):
                    out[c].append(getattr(j, c))
                out["kept"].append(j.kept(max_lost))
                out["lost_chars"].append(j.lost)
            kinds = {"base_failed": bool, "kept": bool}
            columns = [pa.array(np.concatenate(v).astype(kinds.get(c, np.int64)) if v else np.zeros(0, kinds.get(c, np.int64))) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *out])

    return run


def quality_report(documents: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """Counts and verdict of each row of ``documents`` (doc_id, text); lost_chars: word characters of failing lines."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        _report(max_lost), f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long"
    )


def _clean(max_lost: float, at: int, count_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[int] = []
            texts: list[str] = []
            for lo, hi, buf, offsets in blocks(batch.column(at)):
                j = Judged(buf, offsets)
                good = np.flatnonzero(j.kept(max_lost))
                keep += (good + lo).tolist()
                texts += [j.cleaned(i) for i in good]
            rest = batch.take(pa.array(keep, pa.int64()))
            columns = [pa.array(texts, rest.schema.field(i).type) if i == at else pa.array([len(t) for t in texts], rest.schema.field(i).type) if i == count_at else c for i, c in enumerate(rest.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=rest.schema.names)

    return run


def clean_documents(documents: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """``documents`` that pass, without their failing lines; ``n_chars``, where it is there, is counted anew."""
    names = documents.columns
    return documents.mapInArrow(_clean(max_lost, names.index("text"), names.index("n_chars") if "n_chars" in names else None), documents.schema)
