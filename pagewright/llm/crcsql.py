"""CRC-32 in DuckDB's SQL, for the SQL that checks operators which choose rows by crc32."""

from __future__ import annotations


def crc_sql(name: str, texts: str) -> str:
    """Common table expressions, the last of them name(t, c): the CRC-32 of each ASCII text t that the SELECT texts gives."""
    shift = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
{name}_steps AS (SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: {shift}) ORDER BY i) AS s FROM range(256) AS r(i)),
{name}_texts AS MATERIALIZED ({texts}),
{name} AS MATERIALIZED (SELECT t, xor(list_reduce(list_concat([4294967295], list_transform(string_split(t, ''), lambda a: CAST(ascii(a) AS BIGINT))), lambda c, b: xor(c >> 8, s[(xor(c, b) & 255) + 1])), 4294967295) AS c FROM {name}_texts, {name}_steps)"""
