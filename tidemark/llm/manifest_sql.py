"""The Merkle manifest as SQL: the levels written out one by one, for up to 65,536 rows a source and as many sources."""

from __future__ import annotations

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def manifest_sql(levels: int = 4) -> str:
    # CRC-32 byte by byte, eight steps a byte.
    step = "list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: i::UBIGINT)), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)), lambda c, b: {step}), 4294967295::UBIGINT)"
    out = [f"""d AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf(f"translate(text, '{_CAPITALS}', '{_SMALL}')")} AS lowered, ({crc}) % 5 = 0 AS tampered,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS m FROM documents),
l0 AS (SELECT *, leaf AS h, CASE WHEN tampered THEN lowered ELSE leaf END AS f, '' AS proof FROM d)"""]

    def level(k: int, of: str, source: str, place: str, first: str) -> str:
        size = 16**k
        part = f"PARTITION BY {'source, ' if source else ''}{place} // {16 * size}"
        own, left, right = f"({place} // {size}) % 16", "substr(w, 1, 64 * s)", "substr(w, 64 * s + 65)"
        return f"""SELECT * EXCLUDE (w, s) REPLACE (CASE WHEN m > 1 THEN sha256(w) ELSE h END AS h, CASE WHEN m > 1 THEN sha256({left} || f || {right}) ELSE f END AS f,
  CASE WHEN m > 1 THEN proof || {left} || {right} ELSE proof END AS proof, (m + 15) // 16 AS m)
FROM (SELECT *, string_agg(CASE WHEN {place} % {size} = 0{first} THEN h END, '' ORDER BY {place}) OVER ({part}) AS w, ({own})::INT AS s FROM {of})"""

    for k in range(levels):
        out.append(f"l{k + 1} AS ({level(k, f'l{k}', 'source', 'p', '')})")
    out.append(f"""s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS q, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
t0 AS (SELECT l.* REPLACE (n AS m), h AS subroot, q FROM l{levels} l JOIN s ON l.source IS NOT DISTINCT FROM s.source)""")
    for k in range(levels):
        out.append(f"t{k + 1} AS ({level(k, f't{k}', '', 'q', ' AND p = 0')})")
    return f"""WITH {', '.join(out)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM t{levels}"""
