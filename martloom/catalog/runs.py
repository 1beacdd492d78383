"""Run identifiers, metric files, run log and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from martloom.catalog.common import query, r6, sql_r6, table
from martloom.functions.reports import elapsed_text, job_id, project_number, start_time
from martloom.session import scratch_path
from martloom.sources.runs import append_runs, metrics_rows, read_metrics, read_runs, run_report, runs_after


def _runs(spark, sf):
    """One run per event: half of the ids hold a scheduled, half a submitted time."""
    submitted = F.concat(F.lit("train-"), F.date_format("ts", "yyyyMMdd-HHmmss"))
    scheduled = F.concat(F.lit("train-"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("123"))
    kind = F.when(F.col("event_id") % 2 == 0, submitted).otherwise(scheduled)
    kind = F.when(F.col("event_id") % 11 == 0, F.lit("manual")).otherwise(kind)
    events = table(spark, sf, "events")
    text = F.format_string("{'auc': 0.%03d, 'recall': %d}", F.col("event_id") % 1000, F.col("event_id") % 7)
    return events.select(
        F.concat(
            F.lit("projects/"), F.col("user_id").cast("string"), F.lit("/jobs/"), kind, F.lit("-e"), F.col("event_id").cast("string")
        ).alias("resource"),
        F.col("event_type").alias("status"),
        F.when(F.col("event_id") % 13 == 0, "not json").otherwise(text).alias("metrics"),
    )


SQL_RUNS = """
select 'projects/' || user_id || '/jobs/' ||
    case when event_id % 11 = 0 then 'manual' when event_id % 2 = 0 then 'train-' || strftime(ts, '%Y%m%d-%H%M%S')
         else 'train-' || strftime(ts, '%Y%m%d%H%M%S') || '123' end || '-e' || event_id as resource,
  event_type as status,
  case when event_id % 13 = 0 then 'not json'
       else printf('{''auc'': 0.%03d, ''recall'': %d}', event_id % 1000, event_id % 7) end as metrics
from events
"""
SQL_NUMBER = r"regexp_extract(split_part(resource, '/', -1), '\d+(-)*\d+')"
SQL_START = f"""
case when regexp_matches({SQL_NUMBER}, '^\\d{{17}}') then try_strptime({SQL_NUMBER}[:-4], '%Y%m%d%H%M%S')
     when regexp_matches({SQL_NUMBER}, '^\\d{{8}}-\\d{{6}}') then try_strptime({SQL_NUMBER}, '%Y%m%d-%H%M%S') end
"""
NOW = "2024-02-01 12:34:56"


@query(f"""
select split_part(resource, '/', -1) as job_id, split_part(resource, '/', 2) as project,
       epoch({SQL_START})::bigint as start_second,
       case when {SQL_START} is not null then
         printf('%dHrs %dMin', (datediff('second', {SQL_START}, timestamp '{NOW}') // 3600)::bigint,
                (datediff('second', {SQL_START}, timestamp '{NOW}') // 60 % 60)::bigint) end as elapsed
from ({SQL_RUNS})
""")
def run_times(spark, sf):
    runs = _runs(spark, sf)
    began = start_time(job_id(F.col("resource")))
    now = F.to_timestamp(F.lit(NOW))
    return runs.select(
        job_id(F.col("resource")).alias("job_id"),
        project_number(F.col("resource")).alias("project"),
        F.unix_timestamp(began).alias("start_second"),
        elapsed_text(now, began).alias("elapsed"),
    )


_SQL_METRICS = " union all ".join(
    f"""select split_part(resource, '/', -1) as job_id, '{m}' as metric,
        json_extract(replace(metrics, '''', '"'), '$.{m}')::double as value
        from ({SQL_RUNS}) where metrics <> 'not json'"""
    for m in ("auc", "recall")
)


@query(_SQL_METRICS)
def metrics_parsed(spark, sf):
    runs = _runs(spark, sf).withColumn("job_id", job_id(F.col("resource")))
    return metrics_rows(runs, "job_id", "metrics")


@query(f"""
select job_id, status, strftime(s - interval 3 hour, '%d-%m-%Y %H:%M:%S') as start_time,
       strftime(timestamp '{NOW}' - interval 3 hour, '%d-%m-%Y %H:%M:%S') as current_time,
       case when s is not null then printf('%dHrs %dMin', (datediff('second', s, timestamp '{NOW}') // 3600)::bigint,
            (datediff('second', s, timestamp '{NOW}') // 60 % 60)::bigint) end as elapsed_time,
       {sql_r6("auc")} as auc
from (select split_part(resource, '/', -1) as job_id, status, {SQL_START} as s,
        case when metrics <> 'not json' then json_extract(replace(metrics, '''', '"'), '$.auc')::double end as auc
      from ({SQL_RUNS}))
""")
def run_reports(spark, sf):
    runs = _runs(spark, sf)
    rows = metrics_rows(runs.withColumn("job_id", job_id(F.col("resource"))), "job_id", "metrics")
    return run_report(runs, rows, ["auc"], F.to_timestamp(F.lit(NOW)))


@query(f"""
select 'run-' || strftime(ts, '%Y%m%d') || '-' || event_type as job_id, unnest(['mean_value', 'rows']) as metric,
       unnest([round(avg(value), 3), count(*)]) as value
from events group by ts::date, strftime(ts, '%Y%m%d'), event_type
""")
def metrics_files(spark, sf):
    root = scratch_path(spark, "metric-files")
    events = table(spark, sf, "events")
    job = F.concat_ws("-", F.lit("run"), F.date_format("ts", "yyyyMMdd"), "event_type")
    rows = events.groupBy(job.alias("job_id")).agg(
        F.concat(
            F.lit("{'mean_value': "), F.round(F.avg("value"), 3), F.lit(", 'rows': "), F.count("*"), F.lit("}")
        ).alias("value")
    )
    rows.repartition("job_id").write.partitionBy("job_id").text(root)
    return read_metrics(spark, f"{root}/*/*", pattern=r"job_id=([^/]+)/")


# -- run log ------------------------------------------------------------------


def _log(spark, sf):
    path = scratch_path(spark, "run-log")
    events = table(spark, sf, "events")
    clicks = F.coalesce(F.col("event_type") == "click", F.lit(False))
    for part in (clicks, ~clicks):
        append_runs(
            events.where(part).select(
                F.col("ts").cast("timestamp").alias("start_time"),
                F.col("event_type").alias("model"),
                F.col("value").alias("metrics.auc"),
                (F.col("user_id") / 4).alias("metrics.gini"),
                F.col("props").alias("params.k"),
            ),
            path,
        )
    return read_runs(spark, path)


@query("""
select value as auc, user_id / 4 as gini from events
where ts > timestamp '2024-01-15 00:00:00'
""")
def run_log_after(spark, sf):
    return runs_after(_log(spark, sf), F.to_timestamp(F.lit("2024-01-15 00:00:00")))


@query(f"""
select event_type as model, {sql_r6("avg(value)")} as auc, count(*) as n from events
where ts > timestamp '2024-01-15 00:00:00' group by event_type
""")
def run_log_by_model(spark, sf):
    runs = runs_after(_log(spark, sf), F.to_timestamp(F.lit("2024-01-15 00:00:00")), ("model",))
    return runs.groupBy("model").agg(r6(F.avg("auc")).alias("auc"), F.count("*").alias("n"))
