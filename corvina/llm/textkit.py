"""Text forms that several training-data operators share; plain Python and numpy, run on Arrow batches.

``canon_fields`` follows the definition of *same*: lower-cased letters and digits only (Unicode L and N); the fields of a
JSON object, or of two or more lines ``name = value``, in any order. ``Shingler`` follows the definition of *sim*:
sets of consecutive words, a word being a longest run of letters and digits of the lower-cased text."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import xxhash

_DROP = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")
_LINE = re.compile(r"\s*([\w.\-]+)\s*[=:]\s*(\S.*)")


def slices(texts: list[str | None], limit: int = 1_500_000) -> Iterator[slice]:
    """Consecutive runs of texts of at most ``limit`` characters together (a longer text is a run of its own): what is held of a
    batch in memory at once does not hang on how many rows Spark puts in it."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size + n > limit and i > at:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))


def squeeze(text: str) -> str:
    """Lower-cased letters and digits of a text."""
    return _DROP.sub("", text.lower())


def words(text: str) -> list[str]:
    """Lower-cased longest runs of letters and digits."""
    return _WORD.findall(text.lower())


class _Obj(list):
    """The (name, value) pairs of a JSON object, repeated names included."""


def _flat(value: object) -> str:
    """A JSON value as one text: fields of objects in order of their texts, at every depth. Without recursion, so that no depth that the
    parser accepts is too much."""
    todo: list[tuple[object, list[str] | int | None]] = [(value, None)]
    done: list[str] = []
    while todo:
        x, inner = todo.pop()
        if isinstance(inner, list):  # an object whose values are done
            got = done[len(done) - len(inner) :]
            del done[len(done) - len(inner) :]
            done.append("".join(sorted(k + v for k, v in zip(inner, got))))
        elif isinstance(inner, int):  # a list whose elements are done
            got = done[len(done) - inner :]
            del done[len(done) - inner :]
            done.append("".join(got))
        elif isinstance(x, _Obj):
            todo.append((None, [squeeze(k) for k, _ in x]))
            todo += [(v, None) for _, v in reversed(x)]
        elif isinstance(x, list):
            todo.append((None, len(x)))
            todo += [(v, None) for v in reversed(x)]
        else:
            done.append(squeeze({None: "null", True: "true", False: "false"}[x] if x is None or isinstance(x, bool) else str(x)))
    return done[0]


def canon_fields(text: str | None) -> list[str]:
    """The canonical field values of a record; one for a text without fields, none for a blank one."""
    if not text:
        return []
    head = text.lstrip()[:1]
    if head == "{":
        try:
            got = json.loads(text, object_pairs_hook=_Obj, parse_int=str, parse_float=str, parse_constant=str, strict=False)
        except (ValueError, RecursionError):
            got = None
        if isinstance(got, _Obj):
            return [x for x in (squeeze(k) + _flat(v) for k, v in got) if x]
    elif _LINE.match(text):
        lines = [x for x in text.splitlines() if x.strip()]
        if len(lines) > 1:
            hits = [_LINE.fullmatch(x) for x in lines]
            if all(hits):
                return [x for x in (squeeze(m[1]) + squeeze(m[2]) for m in hits if m) if x]
    whole = squeeze(text)
    return [whole] if whole else []


def value_id(value: str) -> tuple[int, int]:
    """The integer identifier of a canonical value: 128 bits of its BLAKE2b digest as two signed 64-bit integers. It follows
    from the value alone, so that all batches, tables and runs agree without a central dictionary."""
    d = hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_IDS: dict[str, tuple[int, int]] = {}


def field_id(value: str) -> tuple[int, int]:
    """value_id by a dictionary of the short values that a worker has met, bounded in size."""
    if len(value) > 200:
        return value_id(value)
    got = _IDS.get(value)
    if got is None:
        if len(_IDS) > 200_000:
            _IDS.clear()
        got = _IDS[value] = value_id(value)
    return got


def record_key(text: str | None) -> tuple[int, int] | None:
    """128-bit key of the record's sorted tuple of field-value identifiers; None for a blank text."""
    ids = sorted(map(field_id, canon_fields(text)))
    if len(ids) < 2:
        return ids[0] if ids else None
    d = hashlib.blake2b(repr(ids).encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are public)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """64-bit hashes of the words of texts, with a bounded cache."""

    def __init__(self, limit: int = 500_000):
        self.seen: dict[str, int] = {}
        self.limit = limit

    def __call__(self, ws: list[str]) -> np.ndarray:
        seen = self.seen
        try:
            return np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws))
        except KeyError:
            if len(seen) > self.limit:
                seen.clear()
            for w in set(ws):
                if w not in seen:
                    seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws))


def shingle_rows(texts: list[str | None], size: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, one after the other, and how many each text has."""
    flat: list[str] = []
    lens = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            ws = _WORD.findall(t.lower())
            flat += ws
            lens[i] = len(ws)
    h = hasher(flat)
    n = np.maximum(lens - size + 1, 0)
    if not n.sum():
        return np.zeros(0, np.uint64), n
    s = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        s = mix(s * _M1 + h[k : len(h) - size + 1 + k] * _M2 + _M3)
    starts = np.concatenate(([0], np.cumsum(lens)))[:-1]
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
    s, row = s[at], np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[new], np.bincount(row[new], minlength=len(texts)).astype(np.int64)
