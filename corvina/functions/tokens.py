"""Terms of texts within Arrow batches (T1-T3): the same terms as the expressions of ``functions.text``, for passes that read texts in
Python anyway. A name is taken apart once per worker, not once per occurrence."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD, _MINING = re.compile(r"[A-Za-z0-9_]+"), re.compile(r"[a-z_][a-z0-9_]*|[0-9]+")
_STEPS = [re.compile(p) for p in ("([0-9])([a-zA-Z])", "([a-zA-Z])([0-9])", "([A-Z]{2,})([A-Z][a-z])", "([a-z0-9])([A-Z])")]
_LIMIT = 500_000  # names held per worker


def parts(name: str) -> list[str]:
    """T1. As ``text.split_identifier``."""
    bare = name.strip("_")
    if not bare:
        return [name] if name else []
    s = bare
    for p in _STEPS:
        s = p.sub(r"\1_\2", s)
    got = re.split("_+", s.lower())
    return list(dict.fromkeys([*got, bare.lower()])) if len(got) > 1 else got


class CodeTokens:
    """T2. As ``text.tokenize_code``; null gives none."""

    def __init__(self) -> None:
        self.seen: dict[str, list[str]] = {}

    def __call__(self, text: str | None) -> list[str]:
        seen, out = self.seen, []
        for w in _WORD.findall(text or ""):
            got = seen.get(w)
            if got is None:
                if len(seen) > _LIMIT:
                    seen.clear()
                got = seen[w] = parts(w) if "_" in w or w.lower() != w else [w]
            out += got
        return out


class MiningTokens:
    """T3. As ``text.mining_tokens``; null gives none."""

    def __call__(self, text: str | None) -> list[str]:
        return _MINING.findall((text or "").lower())


def token_lists(texts: DataFrame, key: str, text: str, tokens: Callable[[str | None], list[str]]) -> DataFrame:
    """T2, T3. (key, tokens) of texts, in one Arrow pass; for whole columns this is faster than the expressions, which take every
    occurrence of a name apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokens(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=[key, "tokens"])

    rows = texts.select(key, F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, tokens array<string>")


def term_id(term: str) -> int:
    """A term as a signed 64-bit integer; it follows from the term alone."""
    h = xxhash.xxh3_64_intdigest(term)
    return h - (1 << 64) if h >> 63 else h


class TermIds:
    """term_id with a bounded cache."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, terms: list[str]) -> list[int]:
        seen = self.seen
        try:
            return [seen[t] for t in terms]
        except KeyError:
            if len(seen) > _LIMIT:
                seen.clear()
            for t in set(terms):
                if t not in seen:
                    seen[t] = term_id(t)
            return [seen[t] for t in terms]
