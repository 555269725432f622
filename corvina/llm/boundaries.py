"""Problem 1: cutting oversized texts at natural boundaries, with an exact overlap.

Every position of a text has a boundary strength. A sparse table of range maxima over the strengths answers, for each
piece, where in the permissible window of cut positions the strongest boundary lies (the rightmost of equals); the next
piece begins ``overlap`` characters before that cut. Positions are code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.textkit import slices

_DEFINES = ("def ", "class ", "async ", "function ", "func ", "fn ", "public ", "private ", "@", "export ", "interface ", "struct ", "impl ")
SCHEMA = "piece_no int, char_from int, char_to int, piece string"


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..len(text): start of a top-level definition 7, blank line 6, line that begins
    at the margin 5, any line 4, end of a sentence 3, after a clause mark or bracket 2, white space 1, inside a word 0."""
    n = len(text)
    s = np.zeros(n + 1, np.int8)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.isin(cp, (32, 9, 10, 13, 11, 12, 0xA0, 0x3000))
    after = np.zeros(n + 1, bool)
    after[1:] = space
    s[after] = 1
    for marks, k in ((b",;:)]}", 2), (b".!?\xe3\x80\x82", 3)):
        hit = np.isin(cp, np.array([ord(c) for c in marks.decode("utf-8")], np.uint32))
        at = np.flatnonzero(hit[:-1] & space[1:]) + 2 if n > 1 else np.zeros(0, int)
        s[at] = np.maximum(s[at], k)
    nl = np.flatnonzero(cp == 10) + 1
    s[nl] = np.maximum(s[nl], 4)
    if len(nl):
        inner = nl[nl < n]
        s[inner[~space[inner]]] = 5
        starts = np.concatenate(([0], nl))
        ends = np.concatenate((nl, [n]))
        filled = np.concatenate(([0], np.cumsum(~space)))
        blank = (filled[ends] - filled[starts] == 0) & (ends > starts)
        s[ends[blank]] = np.maximum(s[ends[blank]], 6)
        for p in inner[~space[inner]].tolist():
            if text.startswith(_DEFINES, p):
                s[p] = 7
    return s


def cuts(text: str, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """(from, to) of each piece: at most max_size long, each begins overlap before the end of the one before it.

    The sparse table covers a stretch of a few pieces at a time, so that its size follows max_size and not the text."""
    n = len(text)
    if n <= max_size:
        return [(0, n)]
    strength = strengths(text)
    span = max(8 * max_size, 1 << 16)
    base, table = -1, []

    def strongest(lo: int, hi: int) -> int:
        nonlocal base, table
        if base < 0 or lo < base or hi >= base + len(table[0]):
            base = lo
            part = strength[lo : lo + span].astype(np.int64)
            table = [part * (span + 1) + np.arange(len(part))]  # the position breaks ties rightward
            while (1 << len(table)) <= max_size + 1 and len(table[-1]) > 1 << (len(table) - 1):
                a, h = table[-1], 1 << (len(table) - 1)
                table.append(np.maximum(a[:-h], a[h:]))
        lo, hi = lo - base, hi - base
        k = (hi - lo + 1).bit_length() - 1
        return base + int(max(table[k][lo], table[k][hi - (1 << k) + 1])) % (span + 1)

    out, start = [], 0
    least = max(overlap + 1, max_size // 2)
    while n - start > max_size:
        to = strongest(start + least, start + max_size)
        out.append((start, to))
        start = to - overlap
    return [*out, (start, n)]


def split_oversized(df: DataFrame, text_col: str, max_size: int, overlap: int, keep: list[str], keep_small: bool = False) -> DataFrame:
    """Pieces of the texts above max_size code points: the columns ``keep``, then piece_no (from 0), char_from, char_to, piece.

    Null texts have no pieces; texts within the limit come out whole as one piece if keep_small, else not at all. Rows are
    not moved: a filter by length, then one pass over the oversized texts only. overlap must be below max_size / 2."""
    if not (0 <= overlap < max_size / 2 or (overlap == 0 and max_size == 1)):
        raise ValueError("overlap must be non-negative and less than half of max_size")
    if {"piece_no", "char_from", "char_to", "piece"} & set(keep):
        raise ValueError("kept columns must not have the names of the result's own")
    big = df.select(*keep, F.col(text_col).alias("__text"))
    big = big.filter(F.col("__text").isNotNull() if keep_small else F.char_length("__text") > max_size)
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in big.schema.fields[:-1]) + ", " + SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(p.start, p.stop - p.start) for b in batches for p in slices(b.column(b.num_columns - 1).to_pylist())):
            row, no, lo, hi, piece = [], [], [], [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for k, (x, y) in enumerate(cuts(t, max_size, overlap)):
                    row.append(i), no.append(k), lo.append(x), hi.append(y), piece.append(t[x:y])
            kept = [b.column(i).take(pa.array(row, pa.int64())) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(no, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(piece, pa.string())], names=[*keep, "piece_no", "char_from", "char_to", "piece"])

    return big.mapInArrow(run, out_schema)
