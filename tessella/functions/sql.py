"""The main text functions for SQL users, as temporary functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessella.functions.text import EDGE, NO, SPACE, YES


def _quoted(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def register(spark: SparkSession) -> list[str]:
    """Creates normalize_answer(x), token_f1(a, b) and has_option_markers(x); returns their names."""
    listed = lambda items: ", ".join(f"'{x}'" for x in items)
    squash = f"regexp_replace(regexp_replace(lower(coalesce(x, '')), {_quoted(SPACE + '+')}, ' '), '^ +| +$', '')"
    inner = f"trim(BOTH {_quoted(EDGE)} FROM {squash})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_answer(x STRING) RETURNS STRING RETURN CASE WHEN {inner} IN ({listed(YES)}) THEN 'yes' WHEN {inner} IN ({listed(NO)}) THEN 'no' ELSE {inner} END")
    words = lambda v: f"filter(split(normalize_answer({v}), ' '), w -> w <> '')"
    count = lambda arr: f"size(filter({arr}, y -> y = v))"
    common = f"aggregate(array_distinct({words('a')}), 0, (n, v) -> n + least({count(words('a'))}, {count(words('b'))}))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION token_f1(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN size({words('a')}) = 0 OR size({words('b')}) = 0 THEN 0D ELSE 2D * {common} / (size({words('a')}) + size({words('b')})) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION has_option_markers(x STRING) RETURNS BOOLEAN RETURN coalesce(x, '') RLIKE r'(?iU)\\b(?:or|either|vs|versus)\\b|/'")
    return ["normalize_answer", "token_f1", "has_option_markers"]
