"""Pieces of SQL that several queries' texts share."""

from __future__ import annotations

from tessella.functions import products as P


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick(key: str, texts: list[str]) -> str:
    """One of the texts by a whole number, in either dialect."""
    return f"CASE ({key}) % {len(texts)} " + " ".join(f"WHEN {i} THEN {quoted(t)}" for i, t in enumerate(texts)) + " END"


def flat(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), {quoted('(?i)' + pattern)})"


def plain(x: str) -> str:
    return f"replace(strip_accents(lower({flat(x)})), 'đ', 'd')"


def either(x: str, pattern: str) -> str:
    return f"({hit(x, pattern)} or {hit(plain(x), pattern)})"


def first_of(x: str, rules: list[tuple[str, str]], test=hit) -> str:
    return "CASE " + " ".join(f"WHEN {test(x, p)} THEN {quoted(n)}" for n, p in rules) + " END"


def prices(x: str) -> str:
    return (
        f"list_filter(list_transform(list_concat(regexp_extract_all(coalesce({x}, ''), '[0-9]{{1,3}}(?:[.,][0-9]{{3}}){{1,4}}'), regexp_extract_all(coalesce({x}, ''), '\\b[0-9]{{5,10}}\\b')), "
        "lambda v: CAST(regexp_replace(v, '[.,]', '', 'g') AS BIGINT)), lambda n: n between 1000 and 1000000000)"
    )


_CODE = r"\b(?:[A-Z]{2,}[A-Z0-9]*[-_/][A-Z0-9][A-Z0-9._\-/]{1,}|[A-Z]{2,}[0-9]{2,}[A-Z0-9._\-/]*|[A-Z0-9]{2,}-[A-Z0-9]{2,}(?:[-_/][A-Z0-9]{1,})*)\b"


def codes(x: str) -> str:
    found = rf"list_transform(regexp_extract_all(regexp_replace(upper(coalesce({x}, '')), '[\t\r\n|]+', ' ', 'g'), '{_CODE}'), lambda c: regexp_replace(c, '^[^A-Z0-9]+|[^A-Z0-9._\-/]+$', '', 'g'))"
    return f"list_filter({found}, lambda c: not regexp_matches(c, '{P.NO_CODES}') and length(c) between 4 and 40 and regexp_matches(c, '[A-Z]') and regexp_matches(c, '[0-9]'))"


def joined(*columns: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(columns) + "], lambda t: coalesce(t, '') <> ''), ' ')"
