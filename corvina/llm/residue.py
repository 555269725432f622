"""Problem 9: template residue, filler and server notices, by character n-gram models and likelihood-ratio windows.

Models of hashed character 5-grams: filler words, stand-in phrases, notices and unfilled slots are fitted on seeds, natural prose on
the distinct sentences and lines of the collection (tables of fixed size, counted in parallel). A text's own prose - code, quotations
and markup masked - is scored by the log ratio of a model to natural prose; windows in which the ratio is high are residue.

Slots ({{ x }}, __X__, [x here]) have two models, one of the wording and one of the shape: runs of small letters, capitals and digits are
shortened to two, so that what is inside a slot does not matter, and what marks it does. N-grams of letters alone say nothing of a
slot. The best windows of a line, one of each model, make up its evidence.

A text is excluded by coverage: notices making up enough of its prose, any sentence mostly filler, any line with a slot."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm import residue_seeds as seeds
from corvina.llm.textkit import slices

GRAM, BITS = 5, 18
SIZE = 1 << BITS
WINDOW = 20  # characters of a likelihood-ratio window
SENTENCE_COVER = 0.7  # part of a sentence that windows must cover to make it residue
NOTICE_COVER = 0.12  # part of a text's prose that notices must make up
EVIDENCE = 11.0  # summed log ratio that a sentence must reach: prior odds of 60,000 to one against residue
DENSITY = 0.5  # log ratio per character that a notice must reach, which a sentence that mentions one does not
SLOT_WINDOW = 6  # n-grams of a window of the slot models
SLOT_EVIDENCE = 6.7  # summed log ratio that a line must reach: midway between sound lines (0) and slots (13.5) of sf0.1

_FENCE = re.compile(r"(?:^|\n)[ \t]*(```|~~~).*?(?:\n[ \t]*\1|\Z)", re.S)
# a notebook cell ends at its output, or at a blank line before a line that does not begin like code
_CELL = re.compile(r"^In ?\[\d*\]:.*?(?=^Out ?\[\d*\]:|\n\s*\n(?![ \t@#/(]|def |class |async |from |import |function |const |let |var |if |for |while |try|return |with |[\w.]+ ?[=(\[])|\Z)", re.S | re.M)
_INLINE = re.compile(r"``?[^`\n]*``?|<(code|pre|kbd|tt)\b[^>]*>.*?</\1>", re.S | re.I)
_CODE_LINE = re.compile(r"(?m)^(?:(?: {4}|\t).*|(?:def|class|async|function|const|let|var|from|import|return|export|if|for|while|try|else|elif|switch|case|raise|throw|with|del|assert|print|@|//|#include|Out ?\[|In ?\[).*[:;{(=,)\]}].*|[ \t]*>.*)$")
_QUOTED = {'"': re.compile(r"\"[^\"\n]{1,200}\""), "“": re.compile(r"“[^”\n]{1,200}”"), "„": re.compile(r"„[^“”\n]{1,200}[“”]"), " '": re.compile(r"(?<= )'[^'\n]{2,120}'(?!\w)")}
_INLINE_TAG = "code|pre|kbd|tt|b|i|u|em|strong|br|hr|p|div|span|a|ul|ol|li|h[1-6]|table|tr|td|th|img|sub|sup|t|k|v"
_TAG = re.compile(rf"</?(?:{_INLINE_TAG}|html|body|head|blockquote|script|style|link|meta|input|button)(?:\s+[\w-]+=[^>]*)?\s*/?>", re.I)
_MARK = re.compile(r"[{\[<%$@«]|#\{|__|XXX")
_MARK_WORDS = ("TBD", "TBA", "TODO", "tbd", "tba", "todo")
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes.maketrans(b"0123456789\t\n\r\x0b\x0c", b"0000000000     ")
_BREAKS = re.compile(r"[\r\n]+")
_ENDS = re.compile(r"(?<=[.!?:…])\s+|[\r\n]+")


def prose(text: str) -> str:
    """The text's own prose: code, quotations and markup gone."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    t = _FENCE.sub("\n", t) if "```" in t or "~~~" in t else t
    t = _CELL.sub("\n", t) if "In [" in t or "In[" in t else t
    t = _TAG.sub(" ", _INLINE.sub(" q ", t)) if "`" in t or "<" in t else t
    if "&" in t:
        t = html.unescape(t)
        t = _TAG.sub(" ", _INLINE.sub(" q ", t)) if "`" in t or "<" in t else t
    t = _CODE_LINE.sub("", t)
    for mark, quoted in _QUOTED.items():
        if mark in t:
            t = quoted.sub(" q ", t)
    return t


def sentences(text: str) -> list[bytes]:
    """Sentences of prose in lower case, as bytes, every digit as 0; runs without a letter are left out."""
    out = []
    for s in _ENDS.split(text.lower()):
        s = s.strip(" \t#*->|=")
        if s and _LETTER.search(s):
            out.append(s.encode("utf-8", "replace").translate(_PLAIN))
    return out


def grams(flat: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each position."""
    x = np.frombuffer(flat, np.uint8).astype(np.uint32)
    n = len(x) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.zeros(n, np.uint32)
    for k in range(GRAM):
        h = (h ^ x[k : k + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def joined(parts: list[bytes]) -> bytes:
    return b"".join([b" %s " % s for s in parts])


def has_mark(text: str) -> bool:
    """Whether a text holds any of the marks without which a line is not scored for a slot."""
    return bool(_MARK.search(text)) or any(w in text for w in _MARK_WORDS)


def prose_lines(text: str) -> list[str]:
    return [y for x in _BREAKS.split(text) if (y := x.strip(" \t"))]


def marked_lines(text: str) -> list[str]:
    """Lines of prose that could hold a slot; a line in capitals comes in small letters too, runs of X apart."""
    out = []
    for x in prose_lines(text):
        if has_mark(x):
            out.append(x)
            if x.isupper():
                out.append(re.sub("x{3,}", lambda m: m[0].upper(), x.lower()))
    return out


# Classes of bytes, and how many of a run the shape keeps: letters beyond ASCII are small letters, guillemets become marks of their own.
_CLASS = np.array([ord("A") if 65 <= i <= 90 else ord("0") if 48 <= i <= 57 else ord(" ") if i in (9, 11, 12, 13, 32) else ord("a") if 97 <= i <= 122 or i >= 128 else i for i in range(256)], np.uint8)
_KEEP = np.array([1 if i == 32 else 2 if i in b"aA0" else 3 for i in range(256)], np.int64)
# What marks a slot; of the ordinary punctuation only colon and brackets, and only where the wording counts. Runs of X and of underlines,
# in shapes, are symbols of their own.
_X, _LINE = ord("X"), 4
_MARKS = [np.array([i < 128 and chr(i) in x for i in range(256)]) for x in ("{}[]<>%$#@\x02\x03:()", "{}[]<>%$#@\x02\x03\x04X")]


def stream(lines: list[str], shaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, line, marked) of lines one after the other, as they are or as shapes: the hash of each n-gram, its line, -1 if it runs
    over the end of one, and whether it holds a mark."""
    flat = b"".join([b"\n %s \n" % (x if shaped else x.lower()).replace("«", "\x02").replace("»", "\x03").encode("utf-8", "replace") for x in lines])
    raw = np.frombuffer(flat if shaped else flat.translate(_DIGITS), np.uint8)
    own = (np.cumsum(raw == 10) - 1) // 2
    if shaped:
        c = _CLASS[raw]
        for sign, least, symbol in ((_X, 3, _X), (ord("_"), 2, _LINE)):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (raw == sign).astype(np.int8), [0]))))
            for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if hi - lo >= least:
                    c[lo:hi] = symbol
        new = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, np.int64)
        run = np.arange(len(c)) - np.repeat(new, np.diff(np.concatenate((new, [len(c)]))))
        keep = run < _KEEP[c]
        raw, own = c[keep], own[keep]
    g = grams(raw.tobytes()).astype(np.int64)
    m = _MARKS[shaped][raw]
    marked = np.logical_or.reduce([m[k : k + len(g)] for k in range(GRAM)])
    return g, np.where(own[: len(g)] == own[GRAM - 1 : GRAM - 1 + len(g)], own[: len(g)], -1), marked


_DIGITS = bytes.maketrans(b"0123456789\t\r", b"0000000000  ")


def line_counts(lines: list[str], shaped: bool) -> tuple[np.ndarray, int]:
    """Counts of the n-grams of lines that hold a mark, and the number of all n-grams."""
    g, own, marked = stream(lines, shaped)
    return np.bincount(g[(own >= 0) & marked], minlength=SIZE).astype(np.float64), int((own >= 0).sum())


def best_windows(lines: list[str], shaped: bool, ratio: np.ndarray) -> np.ndarray:
    """The highest sum of log ratios of a window of each line, at least 0; n-grams without a mark say nothing."""
    out = np.zeros(len(lines))
    g, own, marked = stream(lines, shaped)
    if len(g) < SLOT_WINDOW:
        return out
    c = np.concatenate(([0.0], np.cumsum(np.where((own >= 0) & marked, ratio[g], 0.0))))
    inside = (own[: len(g) - SLOT_WINDOW + 1] == own[SLOT_WINDOW - 1 :]) & (own[: len(g) - SLOT_WINDOW + 1] >= 0)
    np.maximum.at(out, own[: len(inside)][inside], (c[SLOT_WINDOW:] - c[:-SLOT_WINDOW])[inside])
    return out


def seed_counts(texts: list[str]) -> np.ndarray:
    return np.bincount(grams(joined([s for t in texts for s in sentences(t)])), minlength=SIZE).astype(np.float64)


def filler_seeds() -> list[str]:
    """Filler in running text: words of one stock in every order of two."""
    return [f"{a} {b}" for stock in (seeds.LATIN, seeds.DUMMY * 3, seeds.KEYS * 3) for a, b in product(stock, stock)]


def natural_counts(docs: DataFrame) -> np.ndarray:
    """Two tables of SIZE counts, whatever the input: n-grams of all sentences, fenced code left out, and of the shapes around marks
    of those sentences of the texts' own prose that hold any; summed in parallel. Every distinct sentence counts once, digits aside:
    a notice does not become natural prose by being repeated, be it on a third of all rows. What residue is left only lowers
    its own log ratio: n-grams are counted jointly, not by context."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in slices(texts):
                some = texts[part]
                both = [{x.strip() for t in some for x in _ENDS.split((_FENCE.sub("\n", t) if "```" in t or "~~~" in t else t).lower())}, {x.strip() for t in some if has_mark(t) and has_mark(p := prose(t)) for x in _ENDS.split(p) if has_mark(x)}]
                flat = [{x.encode("utf-8", "replace").translate(_PLAIN) for x in got if x} for got in both]
                yield pa.RecordBatch.from_arrays([pa.array([k for k in (0, 1) for _ in flat[k]], pa.int8()), pa.array([*flat[0], *flat[1]], pa.binary())], names=["k", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE), np.int64)
        for b in batches:
            kind = b.column(0).to_numpy()
            for k in (0, 1):
                parts = b.column(1).take(pa.array(np.flatnonzero(kind == k))).to_pylist()
                for part in slices(parts):
                    if k:
                        total[1] += line_counts([x.decode("utf-8", "replace") for x in parts[part]], True)[0].astype(np.int64)
                    else:
                        total[0] += np.bincount(grams(joined(parts[part])), minlength=SIZE)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["g", "n"])

    once = docs.mapInArrow(split, "k tinyint, s binary").distinct()
    rows = once.mapInArrow(run, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(2 * SIZE)
    out[rows["g"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(2, SIZE)


def log_ratio(model: np.ndarray, natural: np.ndarray) -> np.ndarray:
    """Per n-gram log P(model) / P(natural), within -3 and 4; n-grams that the seeds lack count against the model."""
    r = np.log((model + 0.01) / (model.sum() + 0.01 * SIZE)) - np.log((natural + 0.5) / (natural.sum() + 0.5 * SIZE))
    return np.where(model > 0, np.clip(r, -3, 4), -1.5).astype(np.float32)


def mark_ratio(seeded: list[str], sound: list[str], natural: np.ndarray, total: float, shaped: bool) -> np.ndarray:
    """The same for n-grams with marks, which are few where prose has many, so within -3 and 6. A line is judged as if it had not been
    counted itself, and sound uses of marks count beside the collection."""
    (model, m), (known, k) = line_counts(seeded, shaped), line_counts(sound, shaped)
    r = np.log((model + 0.01) / m) - np.log((np.maximum(natural - 1, 0) + 5 * known + 0.01) / (total + 5 * k))
    return np.where(model > 0, np.clip(r, -3, 6), -1.5).astype(np.float32)


class Judge:
    """Localises residue in texts by windows of the log ratio."""

    def __init__(self, natural: np.ndarray):
        prose_ = natural[0] + 5 * seed_counts(list(seeds.NATURAL))  # outweighed by any larger collection
        self.ratio = [log_ratio(seed_counts(list(x)), prose_) for x in (filler_seeds(), seeds.FILLER, seeds.NOTICES, seeds.CHROME)]
        sound = [x for t in (*seeds.NATURAL, *seeds.sound()) for x in prose_lines(t)]
        shapes, wordings = seeds.slots()
        total = natural[0].sum()  # a shape is about half as long as its text
        self.slots = [mark_ratio(wordings, sound, natural[0], total, False), mark_ratio(shapes, sound, natural[1], total / 2, True)]

    def covered(self, flat: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per model, whether each byte lies in a window of positive mean, and the log ratio summed up to each byte."""
        g = grams(flat)
        out = []
        for r in self.ratio:
            on = np.zeros(len(flat) + WINDOW, np.int8)
            c = np.concatenate(([0.0], np.cumsum(r[g], dtype=np.float64)))
            w = WINDOW - GRAM + 1
            if len(c) > w:
                hit = c[w:] - c[:-w] > 0
                on[: len(hit)] = hit
                on[WINDOW : WINDOW + len(hit)] -= hit
            c = np.concatenate((c, np.full(len(flat) + 1 - len(c), c[-1])))
            out.append((np.cumsum(on[: len(flat)], dtype=np.int32) > 0, c))
        return out

    def marked(self, lines: list[str]) -> np.ndarray:
        """Whether a line holds a slot: the best windows of both models together reach the evidence."""
        return best_windows(lines, False, self.slots[0]) + best_windows(lines, True, self.slots[1]) >= SLOT_EVIDENCE

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(lines with a slot, filler characters, notice characters, prose characters) of each text; a sentence counts whole."""
        parts, owner, lines, line_owner = [], [], [], []
        for i, t in enumerate(texts):
            if t:
                p = prose(t)
                s = sentences(p)
                parts += s
                owner += [i] * len(s)
                if has_mark(p):
                    m = marked_lines(p)
                    lines += m
                    line_owner += [i] * len(m)
        got = np.zeros((len(texts), 4), np.int64)
        if lines:
            got[:, 0] = np.bincount(np.array(line_owner)[self.marked(lines)], minlength=len(texts))
        raw = [b" %s " % s for s in parts]
        size = np.array([len(x) for x in raw], np.int64)
        flat = b"".join(raw)
        if not len(size):
            return [tuple(x) for x in got.tolist()]
        starts = np.concatenate(([0], np.cumsum(size)))[:-1]
        own = np.array(owner)
        last = np.maximum(starts + size - GRAM + 1, starts)  # the last n-gram within the sentence
        (fill, stand, note, chrome), (f_sum, s_sum, n_sum, c_sum) = zip(*((np.add.reduceat(c.astype(np.int64), starts) / size, r[last] - r[starts]) for c, r in self.covered(flat)))
        is_chrome = (chrome >= SENTENCE_COVER) & (c_sum >= EVIDENCE)
        # a sentence is covered by windows, and its own evidence, apart from its neighbours', suffices
        is_fill = (fill >= SENTENCE_COVER) & (f_sum >= EVIDENCE) & (f_sum >= n_sum) | (stand >= SENTENCE_COVER) & (s_sum >= EVIDENCE) & (s_sum >= n_sum)
        is_note = (note >= SENTENCE_COVER) & (n_sum >= np.maximum(EVIDENCE, DENSITY * size)) & (n_sum > 2 * c_sum * is_chrome) & ~is_fill
        ended = np.array([s.endswith((b".", b"!", b"?", b":")) or len(s) > 60 for s in parts])
        for k, mask in enumerate((is_fill, is_note, is_note | is_fill | ended & ~is_chrome), 1):
            got[:, k] = np.bincount(own[mask], weights=size[mask], minlength=len(texts)).astype(np.int64)
        return [tuple(x) for x in got.tolist()]


def verdict(slots: int, filler: int, notice: int, total: int) -> str | None:
    """What makes a text unusable, if anything."""
    if notice and notice >= NOTICE_COVER * total:
        return "notice"
    if filler:
        return "filler"
    return "slot" if slots else None


def judged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, verdict, slots, filler, notice, prose) of each text: verdict is slot, filler, notice or null for a sound text.

    Null and empty texts are sound (there is nothing unusable in them). Whole texts are read, twice: once to count the natural
    models, once to judge; sentences are shuffled to be counted once each, and the count tables."""
    docs = df.filter(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"))
    judge = Judge(natural_counts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [x for part in slices(texts) for x in judge(texts[part])]
            cols = list(zip(*got)) if got else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([verdict(*x) for x in got], pa.string()), *(pa.array(list(c), pa.int64()) for c in cols)], names=["doc_id", "verdict", "slots", "filler", "notice", "prose"])

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, verdict string, slots bigint, filler bigint, notice bigint, prose bigint")
