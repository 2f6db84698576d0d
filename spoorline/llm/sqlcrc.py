"""crc32 in checking SQL: DuckDB has no such function, so its table is derived from the polynomial."""

#: Steps of a ``with recursive`` clause; the last, ``crc``, is one row whose list ``t`` is the table.
CRC_STEPS = """crc_step(n, k, c) as (
  select n, 0, n::bigint from range(256) t(n)
  union all
  select n, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc_step where k < 8),
crc as (select list(c order by n) as t from crc_step where k = 8)"""


def crc_of(text: str) -> str:
    """The unsigned crc32 of an ASCII text, beside ``crc``; null for null."""
    return f"""(case when {text} is not null then xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(1, strlen({text}) + 1), lambda i: ascii(substr({text}, i, 1))::bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) end)"""
