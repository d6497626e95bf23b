"""Queries of the general data problems over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fotarium.operators.drift import field_changes, report_frames, report_runs, unified_reports
from fotarium.operators.sessions import shooting_sessions
from fotarium.operators.timestamps import utc_instants
from fotarium.session import materialize, table


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return field_changes(table(spark, base, "report_files"))


def p3_table(spark: SparkSession, base: str) -> DataFrame:
    return unified_reports(table(spark, base, "report_files"))


def p3_runs(spark: SparkSession, base: str) -> DataFrame:
    return report_runs(materialize(p3_table(spark, base), "unified"))


def p3_frames(spark: SparkSession, base: str) -> DataFrame:
    return report_frames(materialize(p3_table(spark, base), "unified"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return utc_instants(table(spark, base, "frames"), table(spark, base, "manifest"), table(spark, base, "shoots"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return shooting_sessions(table(spark, base, "frames")).select("model", "start_us", "end_us", "n_frames")


def p5_sessions(spark: SparkSession, base: str) -> DataFrame:
    return shooting_sessions(table(spark, base, "frames"))


QUERIES = {f.__name__: f for f in (p3_found, p3_table, p3_runs, p3_frames, p4_found, p5_found, p5_sessions)}

_MODEL = r"nullif(lower(trim(regexp_replace(exif.model, '\s+', ' ', 'g'))), '')"
_DIGITS = r"case when regexp_matches(own, '^[0-9]+$') then own when regexp_matches(trim(exif.subsec), '^[0-9]+$') then trim(exif.subsec) else '' end"
_SESSIONS = rf"""
with once as (select frame_id, any_value(exif) exif from frames where frame_id is not null group by frame_id),
parsed as (
  select frame_id, {_MODEL} model, exif,
    regexp_extract(trim(exif.date_time_original), '^(\d{{4}})[-:/](\d\d)[-:/](\d\d)[T ](\d\d:\d\d:\d\d)(?:\.(\d+))?(?:Z|[+-]\d\d:?\d\d)?$', ['y', 'm', 'd', 't', 'own']) p
  from once),
digits as (select frame_id, model, p, exif, p.own own from parsed),
walls as (
  select frame_id, model,
    epoch_us(try_cast(p.y || '-' || p.m || '-' || p.d || ' ' || p.t as timestamp))
      + cast(rpad(substr({_DIGITS}, 1, 6), 6, '0') as bigint) wall
  from digits where p.y <> '' and p.y not in ('0000', '0001')),
gaps as (
  select model, wall, case when wall - lag(wall) over (partition by model order by wall, frame_id) <= 1200000000 then 0 else 1 end opens, frame_id
  from walls where model is not null and wall is not null),
runs as (select model, wall, sum(opens) over (partition by model order by wall, frame_id rows unbounded preceding) run from gaps)
select model, min(wall) start_us, max(wall) end_us, %s count(*) n_frames from runs group by model, run
"""

SQL = {
    "p5_found": _SESSIONS % "",
    "p5_sessions": _SESSIONS % "max(wall) - min(wall) duration_us,",
}
