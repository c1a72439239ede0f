"""Fragments shared by the SQL twins (checker dialect)."""

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


def normalize(text: str) -> str:
    return f"lower({collapse(text)})"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def words(text: str) -> str:
    return f"list_filter(string_split({normalize(text)}, ' '), lambda w: w <> '')"


def terms(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"


def chunk_id(document_id: str, text: str) -> str:
    return f"CAST({document_id} AS VARCHAR) || ':' || substr(sha1({normalize(text)}), 1, 16)"


SHINGLES = f"""
doc_words AS (SELECT doc_id, {words('text')} AS w FROM documents),
doc_shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM doc_words)
"""

MINHASH = SHINGLES + """,
perms AS (
  SELECT i, ('0x' || substr(md5('a' || i), 1, 8))::BIGINT % 2147483646 + 1 AS a, ('0x' || substr(md5('b' || i), 1, 8))::BIGINT % 2147483647 AS b
  FROM range(128) r(i)),
hashes AS (SELECT doc_id, ('0x' || substr(md5(x), 1, 8))::BIGINT % 2147483647 AS h FROM (SELECT doc_id, unnest(s) AS x FROM doc_shingles)),
sig_rows AS (SELECT doc_id, i, min((a * h + b) % 2147483647) AS v FROM hashes CROSS JOIN perms GROUP BY ALL),
sigs AS (SELECT doc_id, list(v ORDER BY i) AS sig FROM sig_rows GROUP BY doc_id),
bands AS (
  SELECT doc_id, CAST(i // 4 AS INTEGER) AS band, substr(sha1(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)), 1, 16) AS bucket
  FROM sig_rows GROUP BY doc_id, i // 4)
"""


def embedding(source: str, key: str, text: str, dim_hex: int = 2, dim: int = 256, prefix: str = "") -> str:
    """CTEs ``{prefix}vec(key, slot, x)``: unit-length sparse vectors of a text column."""
    p = prefix
    return rf"""
{p}tok AS (SELECT {key} AS k, {text} AS t, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+') AS w FROM {source}),
{p}gram AS (
  SELECT k, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS g FROM {p}tok WHERE len(w) > 0),
{p}raw AS (
  SELECT k, CAST(('0x' || substr(md5(g), {33 - dim_hex}, {dim_hex})) AS INTEGER) % {dim} AS slot,
    sum(CASE WHEN CAST(('0x' || substr(md5(g), 16, 1)) AS INTEGER) % 2 = 1 THEN 1.0 ELSE -1.0 END) AS x FROM {p}gram GROUP BY ALL
  UNION ALL
  SELECT k, CAST(('0x' || substr(md5(t), {33 - dim_hex}, {dim_hex})) AS INTEGER) % {dim}, 1.0 FROM {p}tok WHERE len(w) = 0),
{p}norm AS (SELECT k, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM {p}raw GROUP BY k),
{p}vec AS (SELECT r.k, r.slot, CAST(r.x AS DOUBLE) / (CASE WHEN n = 0 THEN 1 ELSE n END) AS x FROM {p}raw r JOIN {p}norm USING (k) WHERE r.x <> 0)
"""
