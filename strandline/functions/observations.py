"""Scalar and window transforms that turn loaded records into observations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.sources.scratch import written

#: What every text that reads as a double matches: decimal and hexadecimal forms with their suffixes, and the names of what isn't finite.
_MAY_BE_DOUBLE = r"^[\x00-\x20]*[+-]?(?:\.?[0-9][0-9a-fA-FxXpP.+-]*|(?i:nan|inf|infinity))[\x00-\x20]*$"


def clean(text: Column) -> Column:
    """Without the replacement character that broken encodings leave."""
    return F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))


def normal_path(path: Column, micro: bool = False) -> Column:
    """Segments trimmed, with one backslash after the last; with ``micro``, the micro sign is a separator too."""
    raw = F.replace(path, F.lit("µ"), F.lit("\\")) if micro else path
    body = F.regexp_replace(raw, r"\\+$", "")
    trimmed = F.concat(F.array_join(F.transform(F.split(body, r"\\"), lambda x: F.trim(x)), "\\"), F.lit("\\"))
    # most paths are so already, which is told without taking them apart
    end, gap = F.lit("\\"), (F.lit("\\ "), F.lit(" \\"))
    done = F.endswith(raw, end) & ~F.endswith(raw, F.lit("\\\\")) & ~F.startswith(raw, F.lit(" ")) & ~F.contains(raw, gap[0]) & ~F.contains(raw, gap[1])
    return F.when(done, raw).otherwise(trimmed)


def rolled_up(path: Column, text: Column) -> Column:
    """A path whose last segment is the value itself loses that segment."""
    tail = F.concat(F.lit("\\"), F.trim(text), F.lit("\\"))
    return F.when(F.trim(text).isNotNull() & (F.trim(text) != "") & F.endswith(path, tail), F.substring(path, F.lit(1), F.length(path) - F.length(tail) + 1)).otherwise(path)


def rooted(path: Column, dataset: Column) -> Column:
    return F.when(dataset.isNotNull() & (dataset != ""), F.concat(F.lit("\\"), dataset, path)).otherwise(path)


def double(text: Column) -> Column:
    """A text's number, or null. A text that can't be one isn't cast: a failing cast raises and catches an error, which takes longer than all else that is done to a record."""
    return F.when(text.rlike(_MAY_BE_DOUBLE), text.try_cast("double"))


def number(numeric: Column, text: Column, coerce: bool) -> Column:
    """The record's number; with ``coerce`` a text that reads as a number is one where the numeric field is blank."""
    own = double(F.trim(numeric))
    return F.coalesce(own, F.when(F.coalesce(F.trim(numeric), F.lit("")) == "", double(F.trim(text)))) if coerce else own


def millis(stamp: Column, strict: bool) -> Column:
    """Epoch milliseconds; a blank is null, and a bad value is null too or, if ``strict``, an error."""
    raw = F.when(F.trim(stamp) != "", F.trim(stamp))
    return raw.cast("bigint") if strict else raw.try_cast("bigint")


def typed_by_first(records: DataFrame) -> DataFrame:
    """A concept's first record (by seq) fixes whether it is numeric; records of the other type, and blank ones, are dropped."""
    filled = records.where(F.col("nval").isNotNull() | (F.coalesce(F.trim("tval"), F.lit("")) != ""))
    # the smallest seq of each concept is an aggregate, so no partition has to hold a whole concept; it is stored, so that its true size decides how it is joined
    first = written(records.sparkSession, filled.groupBy("concept_path").agg(F.min_by(F.col("nval").isNotNull(), F.col("seq")).alias("numeric")), "first")
    same = filled.join(first, "concept_path").where(F.col("nval").isNotNull() == F.col("numeric"))
    return same.select("patient_num", "concept_path", "nval", F.when(~F.col("numeric"), F.trim("tval")).alias("tval"), "ts_ms", "seq")


def iso_instant(ms: Column) -> Column:
    """UTC time with milliseconds where there are any; null as an empty text."""
    stamp = F.timestamp_millis(ms)
    return F.coalesce(F.when(F.pmod(ms, F.lit(1000)) == 0, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), F.lit(""))


def field_name(text: str) -> str:
    """A name that record formats allow: signs become underscores, and a leading digit gets one before it."""
    out = re.sub(r"[^A-Za-z0-9_]", "_", text)
    return "_" + out if out[:1].isdigit() else out


def field_names(text: Column) -> Column:
    """:func:`field_name` of a column."""
    out = F.regexp_replace(text, "[^A-Za-z0-9_]", "_")
    return F.when(out.rlike("^[0-9]"), F.concat(F.lit("_"), out)).otherwise(out)


def in_column_order(columns: list[str], configured: str | None) -> list[str]:
    """INFO columns as configured (others left out); all of them, as they are, without a configuration."""
    order = [c for c in (configured or "").split(",") if c]
    return [c for c in order if c in set(columns)] if order else list(columns)
