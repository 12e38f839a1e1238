"""crc32 in DuckDB SQL, which has no such function: from the table of its polynomial, byte by byte."""


def crc32_tables(keys: str) -> str:
    """Recursive CTEs (after WITH RECURSIVE) that end in crc32(key, c) for the ASCII texts that the query `keys` gives."""
    return f"""
bits(i, k, c) AS (
    SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
tab AS (SELECT i, c FROM bits WHERE k = 8),
keys(key) AS ({keys}),
crc(key, n, c) AS (
    SELECT key, 0, 4294967295::BIGINT FROM keys
    UNION ALL
    SELECT key, n + 1, xor(crc.c // 256, tab.c) FROM crc JOIN tab ON tab.i = xor(crc.c % 256, ascii(substr(key, n + 1, 1))::BIGINT)
    WHERE n < length(key)),
crc32(key, c) AS (SELECT key, xor(c, 4294967295) FROM crc WHERE n = length(key))"""
