"""SQL fragments for the checking engine, mirroring the text functions."""

from __future__ import annotations

from evidentia import tables
from evidentia.functions import text as X


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return ", ".join(quote(v) for v in values)


def tokens(column: str) -> str:
    stop = "[" + in_list(tables.STOP_WORDS) + "]"
    return (
        f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({column},"
        f" {quote(X.TOKEN)}), lambda w: lower(w)), lambda w: NOT list_contains({stop}, w))))"
    )


def numbers(column: str) -> str:
    return (
        f"list_sort(list_distinct(list_transform(regexp_extract_all({column}, {quote(X.NUMBER)}),"
        " lambda v: rtrim(replace(v, ',', ''), '.'))))"
    )


def squeeze(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def subject(column: str) -> str:
    return (
        f"nullif(regexp_replace(regexp_extract(trim({column}), {quote(X.SUBJECT)}, 1),"
        " '^[ .,:;]+|[ .,:;]+$', '', 'g'), '')"
    )


def hash16(*parts: str) -> str:
    return f"substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 16)"
