"""DuckDB SQL for those training-data queries that SQL can express over whole tables."""

from __future__ import annotations

_TOKENS = "len(regexp_extract_all(lower(coalesce(text, '')), '[a-z_][a-z0-9_]*|[0-9]+'))"
_DOCS = f"docs AS (SELECT doc_id, source, {_TOKENS} AS tokens FROM documents)"
_RATES = f"""{_DOCS}, own AS (SELECT source, sum(tokens) AS own FROM docs GROUP BY 1), total AS (SELECT sum(tokens) AS total FROM docs),
  rates AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(own, 0)::BIGINT AS own, total, CASE WHEN coalesce(own, 0) > 0 THEN least(target_share * total / own, max_repeats::DOUBLE) ELSE 0.0 END AS rate FROM mix_targets t LEFT JOIN own USING (source) CROSS JOIN total)"""
_MIX = f"""{_RATES}, n AS (SELECT doc_id, d.source, tokens, (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS n FROM docs d JOIN rates USING (source)),
  mixed AS (SELECT doc_id, source, tokens, unnest(range(1, n + 1)) AS copy_no FROM n WHERE n > 0)"""
_TOP = "p AS (SELECT query_id, hard_negative_corpus_id, max(bm25_score) AS bm25_score FROM hard_negative_mining WHERE trim(query_id) <> '' AND hard_negative_corpus_id IS NOT NULL AND bm25_score IS NOT NULL AND NOT isnan(bm25_score) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, hard_negative_corpus_id) AS place FROM p)"

_LINKED = """ks AS (SELECT pair_id, unnest([CASE WHEN trim(query_id) <> '' THEN 'q' || query_id END, CASE WHEN trim(corpus_id) <> '' THEN 'c' || corpus_id END]) AS k FROM download),
  sym AS MATERIALIZED (SELECT DISTINCT a.pair_id AS x, b.pair_id AS y FROM ks a JOIN (SELECT k, min(pair_id) AS pair_id FROM ks GROUP BY 1) b USING (k)),
  edge AS MATERIALIZED (SELECT x, y FROM sym UNION SELECT y, x FROM sym), walk AS (SELECT pair_id AS id, pair_id AS m FROM download UNION SELECT edge.y, walk.m FROM walk JOIN edge ON edge.x = walk.id),
  grp AS MATERIALIZED (SELECT id AS pair_id, min(m) AS group_id FROM walk GROUP BY 1)"""
_PUT = f"""{_LINKED}, sz AS (SELECT group_id, count(*) AS n FROM grp GROUP BY 1), tg AS (SELECT split, target_share AS w, target_share / sum(target_share) OVER () AS room FROM split_targets WHERE target_share > 0),
  sc AS (SELECT group_id, split, CASE WHEN room >= least(n / (SELECT count(*) FROM download), (SELECT max(room) FROM tg)) THEN w / -ln((('0x' || substr(md5('corvina|' || split || '|' || group_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0) ELSE -1.0 END AS k FROM sz, tg),
  pick AS (SELECT group_id, arg_max(split, k) AS split FROM sc GROUP BY 1), put AS (SELECT pair_id, group_id, split FROM grp JOIN pick USING (group_id))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT pair_id, 'download.code' AS field_name FROM download WHERE length(code) > (SELECT max_size FROM size_limits WHERE field_name = 'download.code') UNION ALL SELECT pair_id, 'download.query' FROM download WHERE length(query) > (SELECT max_size FROM size_limits WHERE field_name = 'download.query')",
        "p1_checks": " UNION ALL ".join(f"SELECT 'download.{c}' AS field_name, count(*) AS texts, 0::BIGINT AS over, 0::BIGINT AS misplaced, 0::BIGINT AS not_whole FROM download WHERE length({c}) > (SELECT max_size FROM size_limits WHERE field_name = 'download.{c}')" for c in ("code", "query")),
        "p2_found": f"WITH {_TOP} SELECT query_id, hard_negative_corpus_id FROM r WHERE place <= 3",
        "p2_top3": f"WITH {_TOP} SELECT query_id, hard_negative_corpus_id, bm25_score FROM r WHERE place <= 3",
        "p5_found": f"WITH RECURSIVE {_LINKED} SELECT group_id, pair_id FROM grp WHERE group_id < pair_id",
        "p5_splits": f"WITH RECURSIVE {_PUT} SELECT pair_id, group_id, split FROM put",
        "p5_shares": f"WITH RECURSIVE {_PUT}, per AS (SELECT split, group_id, count(*) AS n FROM put GROUP BY 1, 2), t AS (SELECT split, sum(n)::BIGINT AS n_rows, count(*) AS n_groups, max(n) AS largest_group FROM per GROUP BY 1) SELECT split, target_share, coalesce(n_rows, 0) AS n_rows, round(coalesce(n_rows, 0) / (SELECT count(*) FROM put), 9) AS reached_share, coalesce(n_groups, 0) AS n_groups, coalesce(largest_group, 0) AS largest_group FROM split_targets LEFT JOIN t USING (split)",
        "p7_checks": f"WITH {_DOCS} SELECT count(*) AS texts, sum(ceil(tokens / (SELECT max_size FROM size_limits WHERE field_name = 'documents.text')))::BIGINT AS pieces, sum(tokens)::BIGINT AS tokens, 0::BIGINT AS not_whole, 0::BIGINT AS over FROM docs WHERE tokens > 0",
        "p7_found": f"WITH {_DOCS} SELECT doc_id FROM docs WHERE tokens > (SELECT max_size FROM size_limits WHERE field_name = 'documents.text')",
        "p8_found": f"WITH {_RATES} SELECT source FROM rates WHERE max_repeats * own < target_share * total",
        "p8_mix": f"WITH {_MIX} SELECT doc_id, source, tokens, copy_no FROM mixed",
        "p8_shares": f"WITH {_MIX}, got AS (SELECT source, sum(tokens)::BIGINT AS mixed_tokens FROM mixed GROUP BY 1) SELECT source, target_share, own AS source_tokens, coalesce(mixed_tokens, 0) AS mixed_tokens, round(coalesce(mixed_tokens, 0) / (SELECT sum(mixed_tokens) FROM got), 9) AS reached_share FROM rates LEFT JOIN got USING (source)",
    }
