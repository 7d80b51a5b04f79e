"""Canonical spellings: one value per host, flow group, split, class and source.

Every function maps null, empty and blank input to null. The SQL twins (`*_sql`) give DuckDB the same result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\p{Z}\p{C}]*"
_OCTET = r"0*([0-9]{1,3})"
_ADDRESS = rf"^{_BLANK}(?:::[fF]{{4}}:)?{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?:/32)?{_BLANK}$"


def _address(c: Column | str, hosts_only: bool) -> Column:
    """The octets are folded once, from 1 on, so that four valid octets end in [2**32, 2**33)."""
    octets = F.split(F.regexp_replace(F.col(c) if isinstance(c, str) else c, _ADDRESS, "$1.$2.$3.$4"), r"\.")

    def fold(total: Column, text: Column) -> Column:
        octet = text.try_cast("bigint")
        return F.when(octet.between(0, 255) & (total < 1 << 40), total * 256 + octet)

    def check(total: Column) -> Column:
        n = total - (1 << 32)
        valid = total.between(1 << 32, (1 << 33) - 1)
        return F.when(valid & names_host(n) if hosts_only else valid, n)

    return F.aggregate(octets, F.lit(1).cast("bigint"), fold, check)


def host_number(c: Column | str) -> Column:
    """An IPv4 address in any spelling (blanks, leading zeros, ::ffff: prefix, /32) as a bigint; else null.

    Octets are decimal. An octet over 255 or any other text gives null.
    """
    return _address(c, hosts_only=False)


def names_host(n: Column) -> Column:
    """Whether an address number names one host: not all zeros, broadcast, loopback or multicast. Null gives null."""
    return ~((n == 0) | (n == 4294967295) | (n.between(127 << 24, (128 << 24) - 1)) | n.between(224 << 24, (240 << 24) - 1))


def linking_host(c: Column | str) -> Column:
    """`host_number` of an address that names one host; else null."""
    return _address(c, hosts_only=True)


def dotted(n: Column) -> Column:
    """An address number in plain dotted form."""
    octets = [F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(n.isNotNull(), F.concat_ws(".", *octets))


def group_key(c: Column | str) -> Column:
    """A flow group id as 32 lower-case hex digits, whatever its case, braces, hyphens, blanks or 0x; else null."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_replace(F.regexp_replace(F.lower(c), r"^[^0-9a-f]*0x", ""), r"[^0-9a-f]", "")
    return F.when(F.length(digits) == 32, digits)


def word_key(c: Column | str) -> Column:
    """Letters and digits only, in lower case: what a class, source or dataset name is compared by; blank is null."""
    c = F.col(c) if isinstance(c, str) else c
    key = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.when(key != "", key)


def split_name(c: Column | str) -> Column:
    """train, val or test, whatever the case, blanks or longer form (training, validation, testing); else null."""
    key = word_key(c)
    return F.when(key.startswith("train"), "train").when(key.startswith("val"), "val").when(key.startswith("test"), "test")


def host_number_sql(c: str) -> str:
    """`host_number` for DuckDB."""
    clean = f"regexp_extract({c}, '^[\\s\\pZ\\pC]*(?:::[fF]{{4}}:)?0*([0-9]{{1,3}}\\.0*[0-9]{{1,3}}\\.0*[0-9]{{1,3}}\\.0*[0-9]{{1,3}})(?:/32)?[\\s\\pZ\\pC]*$', 1)"
    octets = [f"try_cast(split_part({clean}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    valid = " AND ".join(f"{o} BETWEEN 0 AND 255" for o in octets)
    return f"(CASE WHEN {valid} THEN (({octets[0]} * 256 + {octets[1]}) * 256 + {octets[2]}) * 256 + {octets[3]} END)"


def linking_host_sql(c: str) -> str:
    """`linking_host` for DuckDB."""
    n = host_number_sql(c)
    return f"(CASE WHEN {n} NOT IN (0, 4294967295) AND {n} NOT BETWEEN {127 << 24} AND {(128 << 24) - 1} AND {n} NOT BETWEEN {224 << 24} AND {(240 << 24) - 1} THEN {n} END)"


def dotted_sql(n: str) -> str:
    """`dotted` for DuckDB."""
    return f"(({n}) // 16777216)::VARCHAR || '.' || (({n}) // 65536 % 256)::VARCHAR || '.' || (({n}) // 256 % 256)::VARCHAR || '.' || (({n}) % 256)::VARCHAR"


def group_key_sql(c: str) -> str:
    """`group_key` for DuckDB."""
    digits = f"regexp_replace(regexp_replace(lower({c}), '^[^0-9a-f]*0x', ''), '[^0-9a-f]', '', 'g')"
    return f"(CASE WHEN length({digits}) = 32 THEN {digits} END)"


def word_key_sql(c: str) -> str:
    """`word_key` for DuckDB."""
    return f"nullif(lower(regexp_replace({c}, '[^\\pL\\pN]', '', 'g')), '')"


def split_name_sql(c: str) -> str:
    """`split_name` for DuckDB."""
    k = word_key_sql(c)
    return f"(CASE WHEN {k} LIKE 'train%' THEN 'train' WHEN {k} LIKE 'val%' THEN 'val' WHEN {k} LIKE 'test%' THEN 'test' END)"
