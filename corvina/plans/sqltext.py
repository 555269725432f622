"""Pieces of DuckDB SQL for the oracles, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from corvina.functions.text import KEYWORDS

CORPUS = "corpus AS (SELECT corpus_id AS doc_id, arg_min(coalesce(code, ''), pair_id) AS text FROM download WHERE trim(corpus_id) <> '' GROUP BY 1)"
QUERIES = "q AS (SELECT pair_id AS query_id, query, corpus_id FROM download WHERE pair_id % 50 = 0 AND trim(query) <> '')"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def split(x: str) -> str:
    s = f"regexp_replace({x}, '^_+|_+$', '', 'g')"
    bare = s
    for p in ("([0-9])([a-zA-Z])", "([a-zA-Z])([0-9])", "([A-Z]{2,})([A-Z][a-z])", "([a-z0-9])([A-Z])"):
        s = f"regexp_replace({s}, '{p}', '\\1_\\2', 'g')"
    parts = f"list_filter(string_split_regex(lower({s}), '_+'), lambda y: y <> '')"
    full = f"CASE WHEN len(p) > 1 THEN list_concat(p, [lower({bare})]) ELSE p END"
    once = let(full, "l", "list_filter(l, lambda y, i: list_position(l, y) = i)")
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN {bare} = '' THEN [lower({x})] ELSE {let(parts, 'p', once)} END"


def tokens(c: str) -> str:
    raw = f"list_filter(string_split_regex(regexp_replace(coalesce({c}, ''), '[^a-zA-Z0-9_]', ' ', 'g'), ' +'), lambda x: x <> '')"
    return f"flatten(list_transform({raw}, lambda x: CASE WHEN regexp_matches(x, '[A-Z_]') THEN {split('x')} ELSE [lower(x)] END))"


def mining(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z_][a-z0-9_]*|[0-9]+')"


KEYS = ", ".join(f"'{k}'" for k in KEYWORDS)


def bm25(tok=tokens, weight: str = "1.0", counted: bool = False, least: int = 0, corpus: str = CORPUS) -> str:
    """CTEs corpus, q, ..., scores (query_id, doc_id, score)."""
    qt = f"SELECT query_id, term, {'count(*)' if counted else '1'} AS w FROM (SELECT query_id, unnest({tok('query')}) AS term FROM q) GROUP BY 1, 2"
    return f"""{corpus}, {QUERIES}, toks AS (SELECT doc_id, {tok('text')} AS t FROM corpus), lens AS (SELECT doc_id, greatest(len(t), {least}) AS l FROM toks),
    post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY 1, 2), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    st AS (SELECT count(*) AS n, greatest(avg(l), 1) AS a FROM lens), qt AS ({qt}),
    wpost AS (SELECT doc_id, term, tf * ({weight}) AS tf FROM post),
    scores AS (SELECT query_id, doc_id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS score
      FROM qt JOIN dfs USING (term) JOIN wpost USING (term) JOIN lens USING (doc_id) CROSS JOIN st GROUP BY 1, 2)"""


def rank(src: str, k: int | None, d: str = "doc_id", extra: str = "") -> str:
    cut = f" WHERE rank <= {k}" if k else ""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {extra}{d}) AS rank FROM {src}){cut}"


#: cosine of unit-normalised vectors a.v and b.v (lists of doubles)
VECS = "vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS v FROM vecs)"
DENSE = f"{VECS}, dense AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_dot_product(a.v, b.v), 9) AS score FROM unit a, unit b WHERE a.vec_id % 50 = 0)"
RANKS = "r0 AS (SELECT query_id, source, doc_id, min(rank) AS rank, arg_min(score, rank) AS score FROM rankings WHERE query_id IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL AND rank IS NOT NULL GROUP BY 1, 2, 3)"
FIRST_REL = f"""{RANKS}, rel AS (SELECT DISTINCT query_id, corpus_id AS doc_id FROM download WHERE trim(query_id) <> '' AND trim(corpus_id) <> ''),
  asked AS (SELECT DISTINCT r.source, r.query_id FROM r0 r SEMI JOIN rel USING (query_id)),
  best AS (SELECT r.source, r.query_id, min(r.rank) AS rank FROM r0 r JOIN rel USING (query_id, doc_id) GROUP BY 1, 2),
  fr AS (SELECT asked.source, asked.query_id, best.rank FROM asked LEFT JOIN best USING (source, query_id))"""
METRICS = "count(*) AS n_queries, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1) ELSE 0 END), 6) AS ndcg, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_k"
