"""Registry and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.text import WS
from plumbline.plans.layout import spread
from plumbline.sources.tables import load_table

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, run, sql)
        return run

    return register


# Tables whose rows carry long texts, with their keys.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = load_table(spark, folder, name)
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


# ---- SQL fragments -------------------------------------------------------------


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_lines(x: str) -> str:
    return f"string_split_regex({x}, '\\r?\\n')"


def sql_loc(x: str) -> str:
    return f"CAST(len(list_filter({sql_lines(x)}, lambda l: length({sql_trim('l')}) > 0)) AS BIGINT)"


def sql_count(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"


def sql_fp_norm(x: str) -> str:
    s = f"regexp_replace({sql_trim(x)}, '(^|[^:])//[^\\n]*$', '\\1')"
    s = f"regexp_replace({s}, '{WS}+', ' ', 'g')"
    s = f"regexp_replace({s}, ' *([()\\[\\]{{}},;:=]) *', '\\1', 'g')"
    s = f"regexp_replace({s}, '([,;:])', '\\1 ', 'g')"
    return f"trim(regexp_replace({s}, ' +', ' ', 'g'))"


def sql_fingerprint(lens: str, quoted: str, symbol: str) -> str:
    kept = f"list_filter(list_transform({quoted}, lambda q: {sql_fp_norm('q')}), lambda q: length(q) > 0)"
    parts = f"list_concat(list_concat([{lens}], {kept}), [coalesce({symbol}, '<no-symbol>')])"
    return f"substr(sha256(array_to_string({parts}, chr(0))), 1, 16)"


def pct_sql(covered: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN CAST(floor({covered} * 100.0 / {total} + 0.5) AS BIGINT) ELSE 100 END"
