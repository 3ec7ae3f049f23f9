"""Guards on generated text: numbers it may name, units it may not, fences, JSON drafts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: How numbers look in text, with sign and percent, and words that claim a measurement
#: which is never made; of mph see mph_binding.
NUMBER = r"[-+]?\p{Nd}+(?:\.\p{Nd}+)?%?"
BANNED_UNITS = ("km/h", "m/s", "kph", "rpm", "rally", "spin rate", "revolutions", "meters", "metres", "feet", "inches")


def numeric_tokens(text: Column) -> Column:
    """Numbers in a text, with sign and percent; of text that may not be ASCII, give nfkc(text)."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def banned(text: Column, words: tuple[str, ...] = BANNED_UNITS) -> Column:
    """The banned words that a text holds, sorted."""
    return F.array_sort(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w)))


def allowlist(numbers: Column) -> Column:
    """Renderings of numbers with 0, 1 and 2 digits, and 1 to 5, that a text may use."""
    shown = F.flatten(F.transform(numbers, lambda v: F.array(*(F.replace(F.format_number(v, d), F.lit(","), F.lit("")) for d in (0, 1, 2)))))
    return F.array_distinct(F.concat(shown, F.array(*(F.lit(str(k)) for k in range(1, 6)))))


def violations(text: Column, allowed: Column, words: tuple[str, ...] = BANNED_UNITS) -> Column:
    """Numbers that are not allowed, and banned words; each once."""
    return F.array_distinct(F.concat(F.array_except(numeric_tokens(text), allowed), banned(text, words)))


def enforce(df: DataFrame, fields: list[str], allowed: Column, most_dropped: int = 2) -> DataFrame:
    """Fields with violations become null; ``fallback`` where too many or the first one did."""
    for f in fields:
        df = df.withColumn(f, F.when(F.size(violations(F.col(f), allowed)) == 0, F.col(f)))
    dropped = sum((F.col(f).isNull().cast("int") for f in fields), F.lit(0))
    return df.withColumn("fallback", F.col(fields[0]).isNull() | (dropped > most_dropped))


def mph_binding(text: Column, mph: Column, most: int = 2) -> Column:
    """Whether all mentions of mph name the measured speed, at most ``most`` times."""
    # the word alone counts, and the whole number right before it, with a space at most between
    mentions = F.regexp_count(text, F.lit(r"(?i)\bmph\b"))
    bound = F.size(F.filter(F.regexp_extract_all(text, F.lit(r"(?i)\b(\d+)\s?mph\b"), F.lit(1)), lambda v: v == mph.cast("int").cast("string")))
    return F.when(mentions == 0, True).otherwise(F.coalesce((mentions <= most) & (mentions == bound), F.lit(False)))


def strip_fences(text: Column) -> Column:
    inner = F.regexp_extract(text, r"(?s)^\s*```[a-zA-Z]*\s*\n(.*?)\n?\s*```\s*$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def parse_draft(text: Column) -> Column:
    """A feedback draft out of JSON; null where it is none."""
    parsed = F.from_json(strip_fences(text), "summary string, strengths array<string>, improvements array<struct<priority: int, title: string, why: string, cue: string, drill: string>>")
    return F.when(parsed["summary"].isNotNull(), parsed)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark lacks."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def hedge(confidence: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for x in ("low", "It looks like", "medium", "It seems", "high", "")))[confidence], F.lit(""))


def percent(part: Column, total: Column) -> Column:
    return F.coalesce(F.bround(100.0 * part / F.nullif(total, F.lit(0)), 0).cast("long"), F.lit(0))


def stage_timings(df: DataFrame, key: str, stage: str, ms: str, stages: list[str]) -> DataFrame:
    """A column of summed milliseconds for each stage."""
    return df.groupBy(key).pivot(stage, stages).agg(F.sum(ms))


def median_low(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median_low): the lower of the two middle values."""
    s = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("s"))
    return s.select(key, F.element_at("s", F.floor((F.size("s") + 1) / 2).cast("int")).alias("median_low"))
