"""Pieces of SQL shared by the statements the queries are checked against."""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

DOCS = """docs AS (SELECT doc_id, lang AS kb_id, source AS connector_id,
  split_part(text, chr(10), 1) AS title, text FROM documents)"""


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}+'), lambda x: x <> '')"


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def windows(size: int, overlap: int, source: str = "docs", out: str = "windows") -> str:
    """(doc_id, kb_id, pos, text) of fixed word windows."""
    step = size - overlap
    return f"""{out}_w AS (SELECT doc_id, kb_id, {words('text')} AS ws FROM {source}),
{out} AS (SELECT doc_id, kb_id, i AS pos, array_to_string(ws[i*{step}+1 : i*{step}+{size}], ' ') AS text
  FROM (SELECT *, unnest(range(CASE WHEN len(ws)=0 THEN 0 WHEN len(ws)<={size} THEN 1
    ELSE CAST(ceil((len(ws)-{size})/{step}.0) AS BIGINT)+1 END)) AS i FROM {out}_w))"""


def chunks(size: int, overlap: int, min_chars: int = 30) -> str:
    """docs + chunks (doc_id, kb_id, chunk_index, total_chunks, chunk_id, text)."""
    return f"""{DOCS}, {windows(size, overlap)},
chunks AS (SELECT doc_id, kb_id, chunk_index, total_chunks, doc_id || ':' || chunk_index AS chunk_id, text FROM (
  SELECT doc_id, kb_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index,
  count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM windows WHERE length({strip('text')}) >= {min_chars}))"""


def hashed(source: str, ids: str, out: str, text: str = "text") -> str:
    """{out} (ids, b, v) non-zero coordinates of unit vectors by signed feature hashing."""
    return f"""{out}_t AS (SELECT {ids}, md5(t) AS h FROM (SELECT {ids}, unnest({tokens(text)}) AS t FROM {source})),
{out}_r AS (SELECT {ids}, CAST('0x' || left(h, 2) AS INTEGER) % 64 AS b,
  sum(CASE WHEN substr(h, 3, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM {out}_t GROUP BY ALL),
{out} AS (SELECT {ids}, b, v / sqrt(sum(v*v) OVER (PARTITION BY {ids})) AS v FROM {out}_r WHERE v <> 0)"""
