"""crc32 in DuckDB's SQL, which has none of its own."""

from __future__ import annotations

#: A common table: the 256 remainders of a byte, from the polynomial.
TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS remainders FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    """The unsigned crc32 of the UTF-8 bytes of an SQL text; crc_table has to be in scope."""
    byte = lambda i: f"(16 * (instr('0123456789ABCDEF', hex({text})[2 * {i} + 1]) - 1) + instr('0123456789ABCDEF', hex({text})[2 * {i} + 2]) - 1)"
    listed = f"list_transform(range(length(hex({text})) // 2), lambda i: {byte('i')})"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {listed}), lambda c, b: xor(c >> 8, remainders[xor(c & 255, b) + 1])))"
