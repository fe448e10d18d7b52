"""Queries of the cleaning operators (problems 1 to 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervallum.operators import fill, lines, periods, spikes, units, wide
from intervallum.queries.rounding import six, six_sql
from intervallum.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.split_lines(table(spark, sf_dir, "input_lines"))[1].select("line_id", "reason")


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = lines.split_lines(table(spark, sf_dir, "input_lines"))[0]
    """Every good line as a record; times in microseconds since 1970, UTC."""
    good = good.withColumn("_start", F.unix_micros(F.col("record.start_date_time").cast("timestamp"))).withColumn("_end", F.unix_micros(F.col("record.end_date_time").cast("timestamp")))
    return good.select("line_id", F.col("record.patient_id").alias("patient_id"), F.col("record.concept_name").alias("concept_name"), F.col("_start").alias("start_us"), F.col("_end").alias("end_us"), F.col("record.value").alias("value"), F.col("record.unit").alias("unit"))


def _harmonised(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    return units.harmonise(table(spark, sf_dir, "input_patient_data"), table(spark, sf_dir, "concept_catalog"), table(spark, sf_dir, "unit_catalog"), keep)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible(_harmonised(spark, sf_dir, ["row_id", "patient_id", "start_date_time"]))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.foreign_units(table(spark, sf_dir, "input_patient_data"), table(spark, sf_dir, "concept_catalog"), table(spark, sf_dir, "unit_catalog"))


def p3_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable value in its common unit; review: the unit was inferred without enough certainty."""
    y = _harmonised(spark, sf_dir, ["row_id"])
    return y.select("row_id", "concept_name", F.round("y", 6).alias("common_value"), "common_unit", "named", "review")


def p3_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that name their unit, in the common one."""
    y = _harmonised(spark, sf_dir, ["row_id"]).where("named")
    return y.select("row_id", "concept_name", "unit_code", six("y").alias("common_value"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.filled_cells(p4_filled(spark, sf_dir))


def p4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.repaired_scores(table(spark, sf_dir, "patient_qa_scores"), table(spark, sf_dir, "concept_catalog"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.cells_of(*_wide(spark, sf_dir))


def p5_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table as rows: patients and how many of their columns are filled."""
    df = _wide(spark, sf_dir)[0]
    filled = sum((F.col(f"`{c}`").isNotNull().cast("long") for c in df.columns if c != "patient_id"), F.lit(0).cast("long"))
    return df.select("patient_id", filled.alias("n_cells"))


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[wide.Attribute]]:
    return wide.wide_patients(table(spark, sf_dir, "output_patient_data"), table(spark, sf_dir, "patient_qa_scores"), table(spark, sf_dir, "concept_catalog"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "output_patient_data").where("abstraction_type = 'state'")
    found = periods.periods_and_gaps(states, "patient_id", "start_date_time", "end_date_time")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select("patient_id", "kind", text("start_date_time").alias("from_text"), text("end_date_time").alias("to_text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p2_found, p3_found, p3_common, p3_named, p4_found, p4_filled, p5_found, p5_wide, p6_found)}

_BLANK = r"[\s\x{A0}\x{FEFF}]"
_LEAP = "(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
_DATE = f"(?:[0-9]{{4}}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))|{_LEAP}-02-29)"
_TIME = rf"{_DATE}[ T](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?"
_FIELD = rf'(?:{_BLANK}*"(?:[^"]|"")*"{_BLANK}*|[^",]*)'

_JUDGED = rf"""with lines as (select line_id, line_text from input_lines where line_text is not null and regexp_matches(line_text, '[^\s\x{{A0}}\x{{FEFF}}]')),
sound as (select *, regexp_full_match(line_text, '{_FIELD}(?:,{_FIELD})*') as quoted from lines),
cells as (select *, list_transform(regexp_extract_all(',' || line_text, '(,)({_FIELD})', 2), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')) as raw from sound),
texts as (select line_id, quoted, list_transform(raw, lambda x: regexp_replace(case when x[1] = '"' and length(x) > 1 then replace(x[2:-2], '""', '"') else x end, '^{_BLANK}+|{_BLANK}+$', '', 'g')) as f from cells),
heads as (select *, regexp_matches(line_text, '^{_BLANK}*"?{_BLANK}*(?i:PatientId){_BLANK}*"?{_BLANK}*(?:,|$)') as head from lines),
judged as (
select t.line_id, case when not quoted then 'quoting' when len(f) <> 6 then 'column_count'
 when not regexp_full_match(f[1], '[0-9]+') then 'bad_patient_id' when f[2] = '' then 'empty_concept'
 when not regexp_full_match(f[3], '{_TIME}') then 'bad_start' when not regexp_full_match(f[4], '{_TIME}') then 'bad_end'
 when f[5] = '' then 'bad_value'
 when regexp_matches(f[2], '(?:_MEASURE|_DOSAGE)$') and not (regexp_full_match(f[5], '[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?') and coalesce(isfinite(try_cast(f[5] as double)), false)) then 'bad_value' end as reason
from texts t join heads h on t.line_id = h.line_id where not head)"""


def _micros(f: str) -> str:
    """SQL of a good time text as microseconds, UTC."""
    zone = rf"regexp_extract({f}, '([+-])([0-9]{{2}}):([0-9]{{2}})$', %d)"
    shift = f"case when {zone % 1} = '' then 0 else (case {zone % 1} when '-' then 1 else -1 end) * (cast({zone % 2} as int) * 60 + cast({zone % 3} as int)) end"
    return f"epoch_us(cast(replace(regexp_replace({f}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', ''), 'T', ' ') as timestamp)) + cast(60000000 as bigint) * ({shift})"


#: The spellings of units for SQL: (concept, unit key) -> unit, factor, shift.
_SPELLED = f"""spelled as (select concept_name, lower(replace(unit_code, ' ', '')) as k, unit_code, factor, coalesce(shift, 0) as shift from unit_catalog
 union all select concept_name, o, unit_code, factor, coalesce(shift, 0) from unit_catalog join (values {", ".join(f"('{k}', '{o}')" for k, others in units.EQUAL_UNITS.items() for o in others)}) as e(k, o) on lower(replace(unit_code, ' ', '')) = e.k
 where not exists (select 1 from unit_catalog x where x.concept_name = unit_catalog.concept_name and lower(replace(x.unit_code, ' ', '')) = o))"""
_UNIT_KEY = lambda t: rf"regexp_replace(regexp_replace(regexp_replace(lower({t}), '[µμ]', 'u', 'g'), '(^|\s)per\s', '/', 'g'), '\s+', '', 'g')"
_NUMBER = r"^\s*([+-]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?)\s*(.*?)\s*$"

SQL = {
    "p1_found": _JUDGED + " select line_id, reason from judged where reason is not null",
    "p1_loaded": _JUDGED + f""" select t.line_id, try_cast(f[1] as bigint) as patient_id, f[2] as concept_name, {_micros("f[3]")} as start_us, {_micros("f[4]")} as end_us, f[5] as value, nullif(f[6], '') as unit
from texts t join judged j on t.line_id = j.line_id where reason is null""",
    "p3_named": rf"""with {_SPELLED},
m as (select row_id, i.concept_name, try_cast(replace(regexp_extract(value, '{_NUMBER}', 1), ',', '.') as double) as x, {_UNIT_KEY(f"regexp_extract(value, '{_NUMBER}', 2)")} as rest, {_UNIT_KEY("unit")} as u
 from input_patient_data i join concept_catalog c on i.concept_name = c.concept_name where family = 'measure'),
n as (select *, case when rest <> '' then rest else u end as k from m where x is not null and not isinf(x))
select row_id, n.concept_name, s.unit_code, round(x * factor + shift, 6) as common_value from n join spelled s on s.concept_name = n.concept_name and s.k = n.k""",
    "p5_wide": r"""
with cells as (select patient_id, o.concept_name as attribute, start_date_time, row_id, regexp_replace(value, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') as v, value_type as kind
 from output_patient_data o join concept_catalog c on o.concept_name = c.concept_name where abstraction_type in ('event', 'context') and patient_id is not null),
readable as (select patient_id, attribute, start_date_time, row_id from cells where case kind when 'boolean' then lower(v) in ('true', '1', 'yes', 'y', 't', 'false', '0', 'no', 'n', 'f')
 when 'timestamp' then regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?Z?') and try_cast(replace(replace(v, 'T', ' '), 'Z', '') as timestamp) is not null
 when 'string' then lower(v) not in ('', 'n/a', '?', 'pending', 'not done', 'nan')
 else regexp_full_match(v, '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?') and (kind = 'double' or try_cast(replace(v, ',', '.') as double) = floor(try_cast(replace(v, ',', '.') as double))) end
 union all
 select patient_id, concat_ws('|', pattern_name, compliance_type), start_date_time, row_id from patient_qa_scores
 where compliance_score between 0 and 1 and not isnan(compliance_score) and patient_id is not null and pattern_name in (select concept_name from concept_catalog where family = 'pattern'))
select patient_id, count(distinct attribute) as n_cells from readable group by patient_id""",
    "p4_found": """
select row_id, 'pattern_name' as field_name from patient_qa_scores where pattern_name is null or pattern_name not in (select concept_name from concept_catalog where family = 'pattern')
union all
select row_id, 'compliance_score' from patient_qa_scores where compliance_score is null or isnan(compliance_score) or compliance_score < 0 or compliance_score > 1""",
    "p5_found": r"""
with facts as (
 select patient_id, o.concept_name as attribute, start_date_time, row_id, value_type as kind, regexp_replace(value, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') as v
 from output_patient_data o join concept_catalog c on o.concept_name = c.concept_name where abstraction_type in ('event', 'context') and patient_id is not null),
numbers as (select *, case when regexp_full_match(v, '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?') then try_cast(replace(v, ',', '.') as double) end as x,
 case when regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?Z?') then try_cast(replace(replace(v, 'T', ' '), 'Z', '') as timestamp) end as stamp from facts),
texts as (select patient_id, attribute, start_date_time, row_id, case kind
 when 'boolean' then case when lower(v) in ('true', '1', 'yes', 'y', 't') then 'true' when lower(v) in ('false', '0', 'no', 'n', 'f') then 'false' end
 when 'integer' then case when x = floor(x) then cast(cast(x as bigint) as varchar) end
 when 'double' then printf('%.1f', round(x, 1) + 0.0)
 when 'timestamp' then strftime(stamp, '%Y-%m-%d %H:%M:%S')
 else case when lower(v) not in ('', 'n/a', '?', 'pending', 'not done', 'nan') then v end end as cell from numbers
 union all
 select patient_id, concat_ws('|', pattern_name, compliance_type), start_date_time, row_id, printf('%.3f', round(compliance_score, 3) + 0.0) from patient_qa_scores
 where compliance_score between 0 and 1 and not isnan(compliance_score) and patient_id is not null and pattern_name in (select concept_name from concept_catalog where family = 'pattern')),
ranked as (select *, row_number() over (partition by patient_id, attribute order by start_date_time desc nulls last, row_id) as k from texts where cell is not null)
select patient_id, attribute, cell from ranked where k = 1""",
    "p6_found": """
with i as (select patient_id, least(start_date_time, end_date_time) as s, greatest(start_date_time, end_date_time) as e from output_patient_data
 where abstraction_type = 'state' and patient_id is not null and start_date_time is not null and end_date_time is not null),
m as (select *, max(e) over (partition by patient_id order by s, e rows between unbounded preceding and 1 preceding) as reach from i),
g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by patient_id order by s, e rows unbounded preceding) as k from m),
p as (select patient_id, k, min(s) as s, max(e) as e from g group by patient_id, k),
n as (select *, lead(s) over (partition by patient_id order by s) as after from p)
select patient_id, 'period' as kind, strftime(s, '%Y-%m-%d %H:%M:%S') as from_text, strftime(e, '%Y-%m-%d %H:%M:%S') as to_text from p
union all
select patient_id, 'gap', strftime(e, '%Y-%m-%d %H:%M:%S'), strftime(after, '%Y-%m-%d %H:%M:%S') from n where after is not null""",
}
SQL["p3_named"] = six_sql(SQL["p3_named"])
