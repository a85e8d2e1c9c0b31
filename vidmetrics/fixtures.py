"""Fixture views over the driver tables. The same text runs in Spark SQL and in DuckDB.

Operators never read these names: the entry point hands the resulting DataFrames to them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vidmetrics.session import use_utc

AS_OF = "2024-01-31 00:00:00"

TABLES = ("events", "part")

VIEWS: dict[str, str] = {
    "video": """
select vid as id, concat('v-', cast(vid as string)) as slug, p_name as title,
  timestamp '2024-01-01 00:00:00' + interval '1' hour * cast((vid*7)%240 as int) as published_at,
  case when vid%9=0 then null else 30+(vid*53)%600 end as duration_seconds,
  case when vid%13=0 then 1 else 0 end as is_locked
from (select distinct cast(floor(user_id/4) as bigint) as vid from events) u
left join part on p_partkey = vid
""",
    "source_video": """
select user_id as id,
  case when user_id%37=0 then null else vid end as video_id,
  case user_id%4 when 0 then 'YOUTUBE' when 1 then 'FACEBOOK' when 2 then 'INSTAGRAM' else 'TIKTOK' end as platform,
  case user_id%5 when 0 then 'SHORT' when 1 then 'REEL' when 2 then null else 'VIDEO' end as platform_format,
  concat('pv', cast(user_id as string)) as platform_video_id,
  concat(case when user_id%4=1 then 'Teaser: ' else '' end, p_name) as title,
  timestamp '2024-01-01 00:00:00' + interval '1' hour * cast((vid*7)%240 as int)
    + interval '1' minute * cast((user_id%4)*11 as int) as published_at,
  case when user_id%11=0 then null else 30+(user_id*37)%600 end as duration_seconds,
  case when user_id%29=5 then 0 else 1 end as is_active
from (select distinct user_id, cast(floor(user_id/4) as bigint) as vid from events) u
left join part on p_partkey = vid
""",
    "metric_snapshot": """
select event_id as id, user_id as source_video_id, date_trunc('millisecond', ts) as snapshot_at,
  date_trunc('millisecond', ts) + interval '2' second as created_at,
  case when event_type='error' then null else cum end as views_native,
  case when event_type='view' then event_id%60 else null end as avg_watch_seconds,
  cum*3 as total_watch_seconds, cast(null as int) as video_length_seconds,
  cum*2+5 as reach, cum+1 as unique_viewers, likes, comments,
  case when user_id%4=0 then null else shares end as shares,
  likes+love as reactions_total, likes as reactions_like, love as reactions_love
from (select *,
  cast(sum(cast(round(value*100) as bigint)) over w as bigint) as cum,
  cast(sum(case when event_type='click' then 1 else 0 end) over w as bigint) as likes,
  cast(sum(case when event_type='signup' then 1 else 0 end) over w as bigint) as comments,
  cast(sum(case when event_type='purchase' then 1 else 0 end) over w as bigint) as shares,
  cast(sum(case when event_type='view' then 1 else 0 end) over w as bigint) as love
  from events
  window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)) e
""",
    "snapshot_feed": """
select id*2 as arrival_seq, source_video_id,
  case when id%23=0 then snapshot_at - interval '2' day else snapshot_at end as snapshot_at,
  case when id%17=0 then greatest(views_native-500, 0) else cast(floor(views_native/1000)*1000 as bigint) end as views_native,
  total_watch_seconds, reach, cast(floor(likes/5) as bigint) as likes,
  cast(floor(comments/5) as bigint) as comments, cast(floor(shares/5) as bigint) as shares
from metric_snapshot
union all
select id*2+1 as arrival_seq, source_video_id, snapshot_at, views_native+3 as views_native,
  total_watch_seconds, reach, cast(floor(likes/5) as bigint) as likes,
  cast(floor(comments/5) as bigint) as comments, cast(floor(shares/5) as bigint) as shares
from metric_snapshot where id%31=0
""",
    "catalog_source": """
select p_partkey as id,
  case when p_partkey%3=0 then null else cast(floor(p_partkey/4) as bigint) end as video_id,
  case p_partkey%4 when 0 then 'YOUTUBE' when 1 then 'FACEBOOK' when 2 then 'INSTAGRAM' else 'TIKTOK' end as platform,
  concat(case when p_partkey%10=7 then 'Extrait - ' else '' end, p_name) as title,
  concat(p_type, ' ', p_brand) as description,
  timestamp '2024-01-01 00:00:00' + interval '1' hour * cast((p_partkey*13)%4320 as int) as published_at,
  case when p_size%10=0 then null else p_size*20 end as duration_seconds,
  1 as is_active
from part
""",
    "reconcile_override": """
select p_partkey as id, cast(floor(p_partkey/2) as bigint) as source_video_id,
  case when p_partkey%3=0 then 'UNLINK' when p_partkey%3=1 then 'LINK' else 'IGNORE' end as action,
  case when p_partkey%2=0 then p_partkey else null end as target_video_id
from part
""",
    "override_request": """
select p_partkey as seq,
  case p_partkey%4 when 0 then 'YOUTUBE' when 1 then 'FACEBOOK' when 2 then 'INSTAGRAM' else 'TIKTOK' end as source_platform,
  case when p_partkey%50=49 then '' else concat('pv', cast(p_partkey as string)) end as source_platform_id,
  case p_size%4 when 0 then 'link' when 1 then 'UNLINK' when 2 then 'LINK' else 'IGNORE' end as action,
  case when p_partkey%5=0 then null else p_partkey%40 end as target_video_id
from part
""",
    "requested_id": """
select p_partkey as pos,
  case p_partkey%4 when 0 then 'YOUTUBE' when 1 then 'FACEBOOK' when 2 then 'INSTAGRAM' else 'TIKTOK' end as platform,
  concat('pv', cast((p_partkey*4+p_partkey%4)%700 as string)) as platform_video_id
from part
""",
    "source_update": """
select p_partkey as arrival_seq,
  case p_partkey%4 when 0 then 'YOUTUBE' when 1 then 'FACEBOOK' when 2 then 'INSTAGRAM' else 'TIKTOK' end as platform,
  concat('pv', cast((p_partkey%4)+4*(p_partkey%60) as string)) as platform_video_id,
  case when p_size%3=0 then 'SHORT' else 'VIDEO' end as platform_format,
  case when p_size%7=0 then null else p_name end as title,
  timestamp '2024-01-01 00:00:00' + interval '1' hour * cast((p_partkey*13)%4320 as int) as published_at,
  case when p_size%10=0 then null else p_size*20 end as duration_seconds
from part
""",
    "health_event": """
select event_id as seq, date_trunc('millisecond', ts) as happened_at,
  case user_id%4 when 0 then 'YOUTUBE' when 1 then 'FACEBOOK' when 2 then 'INSTAGRAM'
    else case when event_type<>'error' and ts >= timestamp '2024-01-27 00:00:00' then 'WORDPRESS' else 'TIKTOK' end end as platform,
  case when event_type='error' then 'ERROR' else 'SUCCESS' end as outcome,
  case when event_id%5=0 then null else date_trunc('millisecond', ts) end as snapshot_at,
  event_id%9000 as duration_ms, event_id%400 as items,
  case when user_id%4=0 then timestamp '2024-06-01 00:00:00'
       when user_id%4=1 then timestamp '2024-02-07 00:00:00'
       when user_id%4=2 and event_id%3<>0 then timestamp '2024-01-15 00:00:00' end as token_expires_at,
  case when event_type='error' then concat(case when event_id%7=0 then 'HTTP 401 OAuth call ' else 'HTTP 500 call ' end, cast(event_id as string)) end as message
from events
""",
    "resolution": """
select id as source_id, video_id as delete_id, min(video_id) over (partition by title) as keep_id
from catalog_source where video_id is not null
""",
    "batch_event": """
select event_id as seq, concat('run-', cast(cast(floor(event_id/20) as bigint) as string)) as run_id,
  case when event_id%20=19 then 'success' when event_id%20=7 then 'ERROR' else 'RUNNING' end as status,
  date_trunc('millisecond', ts) as started_at,
  case when event_id%20=19 then date_trunc('millisecond', ts) end as finished_at,
  event_id%9000-10 as duration_ms, event_id%400 as items,
  case when event_id%20=7 then concat('failed at ', cast(event_id as string)) end as message
from events
""",
}

_NEEDS = {
    "snapshot_feed": ("metric_snapshot",), "resolution": ("catalog_source",),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for needed in (*_closure(_NEEDS.get(name, ())), name):
            if needed not in ordered:
                ordered.append(needed)
    return ordered


def with_views(body: str, *names: str) -> str:
    """``body`` prefixed by the named views as common table expressions."""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in _closure(names)]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Fixtures:
    """Lazily built fixture DataFrames over one test-data folder: ``Fixtures(spark, dir).video``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = use_utc(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, body: str, *names: str) -> DataFrame:
        """Runs ``body`` over the named views; driver tables are bound by value, not by name."""
        text = with_views(body, *names)
        text = re.sub(r"\b(from|join) (events|part)\b", r"\1 {\2}", text)
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        view = self.sql(f"SELECT * FROM {name}", name)
        setattr(self, name, view)
        return view
