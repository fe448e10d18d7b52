"""Problem 1: separate the lines of delivered CSV files that do not hold a valid record.

The schema is turned into two kinds of anchored patterns. One pattern describes a whole good row, the number of concepts that
must be numeric included; nearly all lines match it and are done. The others match ever longer prefixes (field 1, fields 1-2, ...); the first prefix that fails names the broken
field. Everything is `rlike` on the JVM: one scan, no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\s\u00a0\ufeff]*+"
#: What a field may hold between its blanks, in an unquoted and in a quoted field (quotes doubled, commas allowed).
BARE = r"[^\",]*+"
QUOTED = r"\"[^\"]*+(?:\"\"[^\"]*+)*+\""
LEAP = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
DATE = (
    r"(?:[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
    rf"|{LEAP}-02-29)"
)
CLOCK = r"(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?"
INSTANT = rf"{DATE}[ T]{CLOCK}(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?"
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


@dataclass(frozen=True)
class Field:
    """One field of the line: its name, the pattern of its content (None: anything) and the reason given when it fails."""

    name: str
    content: str | None
    reason: str | None


#: The record of this engine. Value has another pattern for concepts that must be numeric.
PATIENT_RECORD = (
    Field("PatientId", r"[0-9]+", "bad_patient_id"),
    Field("ConceptName", "some", "empty_concept"),
    Field("StartDateTime", INSTANT, "bad_start"),
    Field("EndDateTime", INSTANT, "bad_end"),
    Field("Value", "value", "bad_value"),
    Field("Unit", None, None),
)
NUMERIC_SUFFIX = r"(?:_MEASURE|_DOSAGE)"
#: A number that is finite for certain; others (exponents, over 300 digits) are looked at on their own.
PLAIN_NUMBER = r"[+-]?(?:[0-9]{1,300}+\.?[0-9]*+|\.[0-9]++)"


def any_field() -> str:
    return rf"(?:{BLANK}{QUOTED}{BLANK}|{BARE})"


def exact(content: str) -> str:
    """A field whose trimmed content matches `content`, quoted or not."""
    return rf"{BLANK}(?:{content}|\"{BLANK}{content}{BLANK}\"){BLANK}"


def some_field() -> str:
    """A field with any content but blanks."""
    return rf"(?:{BLANK}[^\s\u00a0\ufeff\",]{BARE}|{BLANK}\"{BLANK}(?:[^\s\u00a0\ufeff\"]|\"\")[^\"]*+(?:\"\"[^\"]*+)*+\"{BLANK})"


@dataclass(frozen=True)
class LinePatterns:
    """The generated patterns. `sure`: good rows, numbers included; `whole`: good but for the number; `prefixes`: (reason, pattern of all fields up to this one)."""

    header: str
    quoting: str
    count: str
    sure: str
    whole: str
    prefixes: tuple[tuple[str, str], ...]
    concept_at: int
    value_at: int


def patterns(fields: tuple[Field, ...] = PATIENT_RECORD) -> LinePatterns:
    """Patterns for a schema: whole row, quoting, column count and incremental prefixes."""
    made, prefixes = [], []
    for f in fields:
        made.append(any_field() if f.content is None else some_field() if f.content in ("some", "value") else exact(f.content))
        if f.reason:
            prefixes.append((f.reason, "^" + ",".join(made) + "(?:,|$)"))
    rest = any_field()
    concept_at = next((i for i, f in enumerate(fields) if f.name == "ConceptName"), -1)
    value_at = next((i for i, f in enumerate(fields) if f.content == "value"), -1)
    # a quoted concept is left to the slower way: its end can't be found without going back
    bare, numeric = rf"{BLANK}[^\s\u00a0\ufeff\",]{BARE}", rf"{BLANK}[^\",]*{NUMERIC_SUFFIX}{BLANK},"
    head, tail = ",".join(made[:concept_at]) + ",", ",".join([bare, *made[concept_at + 1 : value_at]])
    sure = rf"(?:(?={numeric}){tail},{exact(PLAIN_NUMBER)}|(?!{numeric}){tail},{made[value_at]})"
    return LinePatterns(
        header=rf"^{BLANK}\"?{BLANK}(?i:{fields[0].name}){BLANK}\"?{BLANK}(?:,|$)",
        quoting=rf"^{rest}(?:,{rest})*+$",
        count=rf"^{rest}(?:,{rest}){{{len(fields) - 1}}}$",
        sure="^" + head + ",".join([sure, *made[value_at + 1 :]]) + "$",
        whole="^" + ",".join(made) + "$",
        prefixes=tuple(prefixes),
        concept_at=concept_at,
        value_at=value_at,
    )


def _one_line(pattern: str) -> str:
    """`$` as the very end of the text; `.`-free patterns need no other flag."""
    return pattern.replace("$", r"\z")


def field_at(line: Column, at: int) -> Column:
    """Content of field `at` of a line with sound quoting: trimmed, quotes removed, doubled quotes made single."""
    raw = F.regexp_extract(line, _one_line("^" + rf"{any_field()}," * at + rf"({any_field()})(?:,|$)"), 1)
    raw = F.regexp_replace(raw, _one_line(rf"^{BLANK}|[\s\u00a0\ufeff]+$"), "")
    inner = F.regexp_extract(raw, _one_line(r"(?s)^\"(.*)\"$"), 1)
    text = F.when(raw.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(raw)
    return F.regexp_replace(text, _one_line(rf"^{BLANK}|[\s\u00a0\ufeff]+$"), "")


def reason_of(line: Column, fields: tuple[Field, ...] = PATIENT_RECORD) -> Column:
    """The first reason why `line` is no good record; null for good records."""
    p = patterns(fields)
    concept, value = field_at(line, p.concept_at), field_at(line, p.value_at)
    number = value.rlike(_one_line(f"^{NUMBER}$")) & (F.abs(value.try_cast("double")) < F.lit(float("inf")))
    numeric_ok = ~concept.rlike(_one_line(rf"{NUMERIC_SUFFIX}$")) | F.coalesce(number, F.lit(False))
    broken = F.when(~line.rlike(_one_line(p.quoting)), "quoting").when(~line.rlike(_one_line(p.count)), "column_count")
    for reason, pattern in p.prefixes:
        broken = broken.when(~line.rlike(_one_line(pattern)), reason)
    return F.when(line.rlike(_one_line(p.sure)), F.lit(None)).when(line.rlike(_one_line(p.whole)), F.when(~numeric_ok, "bad_value")).otherwise(broken.otherwise("bad_value"))


def is_record(line: Column) -> Column:
    """False for null lines, blank lines and headers."""
    return F.coalesce(line.rlike(r"[^\s\u00a0\ufeff]") & ~line.rlike(_one_line(patterns().header)), F.lit(False))


def instant(text: Column) -> Column:
    """A good time text as timestamp_ntz in UTC; a time without offset is taken as UTC."""
    clock = F.replace(F.regexp_replace(text, r"(Z|[+-]\d\d:\d\d)\z", ""), F.lit("T"), F.lit(" "))
    sign = F.when(F.regexp_extract(text, r"([+-])\d\d:\d\d\z", 1) == "-", 1).otherwise(-1)
    hours = F.regexp_extract(text, r"[+-](\d\d):\d\d\z", 1).try_cast("int")
    minutes = F.regexp_extract(text, r"[+-]\d\d:(\d\d)\z", 1).try_cast("int")
    shift = F.coalesce(sign * (hours * 60 + minutes), F.lit(0))
    return F.try_to_timestamp(clock).cast("timestamp_ntz") + F.make_dt_interval(mins=shift)


def split_lines(lines: DataFrame, text: str = "line_text") -> tuple[DataFrame, DataFrame]:
    """(good, bad) records of `lines`.

    good: the columns of `lines` and struct `record` with typed fields (a PatientId too large for a long is null in
    patient_id; patient_text has it as written); bad: the columns of `lines` and `reason`.
    Null lines, blank lines and headers are in neither. A line of any length is matched whole. Repeated lines are kept each.
    An empty table gives two empty tables. A column named `record` or `reason` in `lines` is replaced.
    """
    line = F.col(text)
    judged = lines.where(is_record(line)).withColumn("reason", reason_of(line))
    record = F.struct(
        field_at(line, 0).try_cast("long").alias("patient_id"),
        field_at(line, 0).alias("patient_text"),
        field_at(line, 1).alias("concept_name"),
        instant(field_at(line, 2)).alias("start_date_time"),
        instant(field_at(line, 3)).alias("end_date_time"),
        field_at(line, 4).alias("value"),
        F.nullif(field_at(line, 5), F.lit("")).alias("unit"),
    )
    return judged.where(F.col("reason").isNull()).drop("reason").withColumn("record", record), judged.where(F.col("reason").isNotNull())
