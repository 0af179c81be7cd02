"""The catalogue of named queries: a Spark function and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query under its name."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    """Six decimals, the precision at which results are compared."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


# Pieces of the SQL versions.
WHITE_SQL = r"'[ \t\n\r\f]+'"


def w_sql(t: str) -> str:
    return f"[x for x in string_split_regex(coalesce({t}, ''), {WHITE_SQL}) if x <> '']"


def tok_sql(t: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({t}, '')), '[\p{{L}}\p{{N}}_]+')"


def strip_sql(t: str) -> str:
    return rf"regexp_replace({t}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"


def norm_sql(t: str) -> str:
    return f"trim(regexp_replace(coalesce({t}, ''), {WHITE_SQL}, ' ', 'g'), ' ')"


def lines_sql(t: str) -> str:
    inner = strip_sql("x")
    return rf"[{inner} for x in string_split(coalesce({t}, ''), chr(10)) if {inner} <> '']"


def gram_sql(w: str, n: int) -> str:
    return f"[array_to_string({w}[i:i+{n - 1}], ' ') for i in range(1, len({w}) - {n - 2})]"


def list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def hits_sql(t: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"(case when regexp_matches({t}, '{p.replace(chr(39), chr(39) * 2)}') then 1 else 0 end)" for p in patterns) + ")"


DOCS_SQL = f"""
with d as (select doc_id, lang, source, topic, coalesce(text, '') as t, lower(coalesce(text, '')) as lt,
  {w_sql("text")} as w, {tok_sql("text")} as tok, {lines_sql("text")} as ls from documents)
"""
PAIRS_SQL = f"""
with d as (select pair_id, coalesce(output_prompt, '') as q, coalesce(best_essay, '') as t, lower(coalesce(best_essay, '')) as lt,
  {w_sql("best_essay")} as w, {tok_sql("best_essay")} as tok, {tok_sql("output_prompt")} as qtok, {lines_sql("best_essay")} as ls
  from (select pair_id, any_value(output_prompt) as output_prompt, any_value(best_essay) as best_essay from prompt_pairs group by pair_id))
"""
