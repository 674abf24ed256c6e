"""SQL twins (DuckDB dialect) of the Spark expression helpers, for oracle checks."""

from __future__ import annotations

from retort.functions.smiles import TOKEN_PATTERN

STRIP = r"regexp_replace({x}, '(\[[^\[\]:]*):[0-9]+\]', '\1]', 'g')"


def strip_maps(x: str) -> str:
    return STRIP.format(x=x)


def valid_fragment(f: str) -> str:
    parens = (f"list_reduce(string_split({f}, ''), lambda acc, ch: CASE WHEN acc < 0 THEN acc "
              f"WHEN ch = '(' THEN acc + 1 WHEN ch = ')' THEN acc - 1 ELSE acc END, 0) = 0")
    s = f"regexp_replace({f}, '\\[[^\\[\\]]*\\]', '', 'g')"
    found = f"regexp_extract_all({s}, '%[0-9][0-9]|[0-9]')"
    rings = f"list_bool_and(list_transform(list_distinct({found}), lambda z: len(list_filter({found}, lambda y: y = z)) % 2 = 0))"
    rings = f"coalesce({rings}, true)"
    return (f"(length({f}) > 0 AND regexp_replace({f}, '{TOKEN_PATTERN}', '', 'g') = '' "
            f"AND regexp_matches({f}, '[A-Za-z*]') AND {parens} AND {rings})")


def is_valid(x: str) -> str:
    return f"list_bool_and(list_transform(string_split({x}, '.'), lambda f: {valid_fragment('f')}))"


def canonical(x: str) -> str:
    return (f"CASE WHEN {is_valid(x)} THEN array_to_string(list_sort(list_transform(string_split({x}, '.'), "
            f"lambda f: {strip_maps('f')})), '.') END")


def canonical_or_blank(x: str) -> str:
    return f"CASE WHEN {x} = ' ' THEN {x} ELSE {canonical(x)} END"


def space_clean(x: str) -> str:
    return f"replace(replace(replace({x}, '. ', ''), ' .', ''), '  ', ' ')"


def md5_u32(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"


def hkey(seed: int, *cols: str) -> str:
    parts = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5('{seed}' || '|' || {parts})"
