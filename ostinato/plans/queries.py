"""Every operator bound to the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ostinato.functions import columns as fc
from ostinato.operators import (
    align, events, metrics, models, quality, registry, spectral, splits, structure, windows)
from ostinato.operators.ordering import positions
from ostinato.operators.skew import attach, row_count
from ostinato.plans.views import (
    ENVELOPE, FRAMES, GRADED, HISTORY, METRICS_SQL, MODELS, ONSETS, RUNS, SPLIT, durations, envelope, frames, graded,
    history, onsets, r, rounded, runs, split_items, table, windows_sql)

from ostinato.session import settled, step_folder
from ostinato.sources import io
from ostinato.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

WIN, HOP = 10, 5          # frame windows
HOURS, STEP = 48, 12      # envelope windows
COLUMNS = 256             # pooled length for the structure queries


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


# --- sources and sets -------------------------------------------------------------------------------

@query("content_hash", "select doc_id, sha256(text) as sha256, sha256(text) as lf_sha256 from documents")
def content_hash(spark, sf):
    text = F.col("text")
    lf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("sha256"), F.sha2(lf, 256).alias("lf_sha256"))


@query("resume_pending", """select o_orderkey as id from orders where o_orderpriority = '1-URGENT' or o_orderkey not in
 (select l_orderkey from lineitem where l_returnflag <> 'N')""")
def resume_pending(spark, sf):
    orders = table(spark, sf, "orders")
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flags"))
    force = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return quality.pending(orders.select(F.col("o_orderkey").alias("id")), done, force)


@query("stream_resume", """select l_orderkey as id, count(*) as length from lineitem join orders on o_orderkey = l_orderkey
 where l_returnflag <> 'N' or o_orderpriority = '1-URGENT' group by 1""")
def stream_resume(spark, sf):
    """Lines taken in by a file stream, those of urgent orders made again by another rule; the index of what was written."""
    source, target = f"{sf}/lineitem.parquet", step_folder(spark)
    schema = spark.read.parquet(source).schema
    lines = lambda df: df.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "l_returnflag")
    incremental.take_new(spark, source, schema, lambda df: lines(df).filter("l_returnflag != 'N'"), target)
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    incremental.make_again(spark, source, schema, lines, target, urgent, 1)
    return incremental.index_of(incremental.taken(spark, target, lines(spark.read.parquet(source)).schema))


@query("inventory", """select status, count(*) as n from (select case when f.id is null then 'missing' when m.id is null then 'orphan'
 else 'matched' end as status from (select distinct doc_id as id from labels) m
 full outer join (select distinct page_id as id from pages) f on m.id = f.id) group by status""")
def inventory(spark, sf):
    rows = quality.inventory(*_labels_and_pages(spark, sf))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("key_mismatch", """select doc_id as id, 'wanted_only' as side from labels where doc_id not in (select page_id from pages)
 union all select page_id, 'found_only' from pages where page_id not in (select doc_id from labels)""")
def key_mismatch(spark, sf):
    return quality.key_mismatch(*_labels_and_pages(spark, sf))


def _labels_and_pages(spark, sf):
    return (table(spark, sf, "labels").select(F.col("doc_id").alias("id")), table(spark, sf, "pages").select(F.col("page_id").alias("id")))


# --- projections ------------------------------------------------------------------------------------

@query("grade_filter", """select case when p_size between 0 and 10 then p_size end as grade, p_size not between 0 and 10 as invalid, count(*) as n
 from part group by 1, 2""")
def grade_filter(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("ps"))
    return quality.grade_or_invalid(part).groupBy("grade", "invalid").agg(F.count(F.lit(1)).alias("n"))


@query("rel_err", f"""select o_orderkey, case when o_totalprice > 0 then {r('abs(s - o_totalprice) / o_totalprice', 4)} end as rel_err
 from orders join (select l_orderkey, sum(l_extendedprice) as s from lineitem group by 1) on l_orderkey = o_orderkey""")
def rel_err(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    both = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(sums, "o_orderkey")
    return rounded(both.select("o_orderkey", fc.relative_error(F.col("s"), F.col("o_totalprice")).alias("rel_err")), 4)


@query("url_key", """with u as (select page_id, split_part(split_part(url, '://', 2), '#', 1) as rest from pages),
 p as (select page_id, lower(split_part(split_part(rest, '/', 1), '?', 1)) as host,
  split_part(split_part(substr(rest, length(split_part(rest, '/', 1)) + 2), '?', 1), '/', 1) as first,
  nullif(regexp_extract(rest, '[?&]page=([^&]*)', 1), '') as page from u)
 select page_id, host, first, page, cast(null as varchar) as recording from p""")
def url_key(spark, sf):
    url = F.trim("url")
    path = F.split(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/+|/+$", ""), "/")
    return table(spark, sf, "pages").select(
        "page_id", F.lower(F.try_parse_url(url, F.lit("HOST"))).alias("host"), F.get(path, F.lit(0)).alias("first"),
        F.try_parse_url(url, F.lit("QUERY"), F.lit("page")).alias("page"), fc.recording_id(F.col("url")).alias("recording"))


LINKS = ["'https://www.youtube.com/watch?v=' || v", "'https://youtu.be/' || v || '?x=a|b'", "'https://youtube.com/embed/' || v || '/'",
         "'http://m.youtube.com/watch?v=&v=' || v || '#t=1'", "'https://www.youtube.com/watch?a=x y&v=' || v", "'https://youtube-nocookie.com/shorts/' || v",
         "'https://youtu.be/' || v || 'x'", "url"]


@query("recording_links", "select page_id, case when page_id % 8 < 6 then substr(md5(url), 1, 11) end as recording from pages")
def recording_links(spark, sf):
    """Links of every form, and two kinds without an id, made from the pages' urls."""
    forms = " ".join(f"when {k} then {form}" for k, form in enumerate(LINKS))
    links = table(spark, sf, "pages").withColumn("v", F.expr("substr(md5(url), 1, 11)")).withColumn("link", F.expr(f"case page_id % 8 {forms} end"))
    return links.select("page_id", fc.recording_id(F.col("link")).alias("recording"))


@query("name_key", "select p_partkey, lower(trim(regexp_replace(p_name, ' +', ' ', 'g'))) as name_key from part")
def name_key(spark, sf):
    from ostinato.functions.text import composer_key
    return composer_key(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "name_key").select("p_partkey", "name_key")


@query("reduced_length", "select doc_id, ((n_chars + 1) // 2 + 1) // 2 as reduced from documents")
def reduced_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fc.reduced_length(F.col("n_chars")).alias("reduced"))


@query("channel_slice", f"with {FRAMES} select id, frame, channel, {r('x')} as x from cells where channel between 48 and 63")
def channel_slice(spark, sf):
    long = spectral.channel_rows(frames(spark, sf, stored=False), "id", "frame")
    return rounded(align.channel_range(long, 48, 63)).select("id", "frame", F.col("channel").cast("long").alias("channel"), "x")


@query("peak_normalize", f"""select event_id, {r('case when p > 0 then value * (0.99e0 / p) else value end', 9)} as x
 from (select event_id, value, max(abs(value)) over (partition by user_id) as p from events)""")
def peak_normalize(spark, sf):
    samples = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", F.col("value").alias("x"))
    return rounded(align.peak_normalize(samples).select("event_id", "x"), 9)


@query("nonmonotonic", """select id, event_id from (select user_id as id, event_id, value,
 lag(value) over (partition by user_id order by event_id) as before from events) where value <= before""")
def nonmonotonic(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", "value")
    return align.nonmonotonic(rows, "event_id", "value").select("id", "event_id")


# --- quality ----------------------------------------------------------------------------------------

def _signal(spark, sf):
    samples = table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.lit(1).alias("sr"), (F.col("value") / 490).alias("x"))
    return quality.waveform_stats(samples)


STATS = """stats as (select user_id as id, count(*) as n_samples, cast(count(*) as double) as duration_sec, max(abs(value / 490)) as peak,
  sqrt(avg((value / 490) * (value / 490))) as rms,
  case when max(abs(value / 490)) > 0 then avg(case when abs(value / 490) > 0.99 then 1.0 else 0.0 end) else 0.0 end as clip_fraction
  from events group by user_id)"""


@query("waveform_stats", f"""with {STATS} select id, n_samples, duration_sec, {r('peak')} as peak, {r('rms')} as rms,
 {r('clip_fraction')} as clip_fraction, false as has_nan_inf from stats""")
def waveform_stats(spark, sf):
    return rounded(_signal(spark, sf))


FLAGS = STATS + """, meta as (select id, n_samples, duration_sec, peak, rms, clip_fraction,
   case when id % 25 = 0 then null else 55.0 + id % 20 end as meta_duration from stats),
 flagged as (select *, list_filter([
   case when duration_sec < 55 then 'too_short' end, case when peak = 0 then 'silence' end,
   case when meta_duration is null or meta_duration <= 0 then 'missing_meta_duration'
        when abs(duration_sec - meta_duration) / meta_duration > 0.1 then 'duration_mismatch' end,
   case when peak > 0 and rms < 0.15 then 'low_rms' end, case when clip_fraction > 1e-3 then 'clipping' end,
   case when duration_sec > 75 then 'long_duration' end], lambda f: f is not null) as flags from meta)"""


def _flagged(stats):
    meta = F.when(F.col("id") % 25 != 0, F.lit(55.0) + F.col("id") % 20)
    return quality.qc_rows(stats.withColumn("meta_duration", meta), min_seconds=55.0, low_rms=0.15, long_seconds=75.0)


def _qc(spark, sf):
    return _flagged(_signal(spark, sf))


@query("qc_flags", f"""with {FLAGS} select id, array_to_string(flags, ',') as flags, not list_contains(flags, 'too_short')
 and not list_contains(flags, 'silence') as ok, {r('abs(duration_sec - meta_duration) / meta_duration')} as duration_rel_err from flagged""")
def qc_flags(spark, sf):
    return rounded(_qc(spark, sf).select("id", F.array_join("flags", ",").alias("flags"), "ok", "duration_rel_err"))


@query("qc_report", f"""with {FLAGS}, okd as (select *, not list_contains(flags, 'too_short') and not list_contains(flags, 'silence') as ok from flagged)
 select 'total' as section, 'n_queued' as name, count(*) as n from okd union all
 select 'total', 'n_ok', count(*) filter (where ok) from okd union all select 'total', 'n_failed', count(*) filter (where not ok) from okd
 union all select 'flag', f, count(*) from (select unnest(flags) as f from okd) group by f""")
def qc_report(spark, sf):
    return quality.qc_report(_qc(spark, sf))


@query("decode_errors", f"""with {FLAGS}, broken as (select distinct user_id as id from events where event_id % 500 = 0)
 select f.id, case when b.id is not null then 'decode_error' else array_to_string(flags, ',') end as flags,
  b.id is null and not list_contains(flags, 'too_short') and not list_contains(flags, 'silence') as ok,
  case when b.id is null then n_samples end as n_samples, {r('case when b.id is null then peak end')} as peak
 from flagged f left join broken b on b.id = f.id""")
def decode_errors(spark, sf):
    """Events as JSON lines, some of them with a value that is no number; such a series is flagged, the others are not touched."""
    events_ = table(spark, sf, "events")
    value = F.when(F.col("event_id") % 500 == 0, F.lit('"?"')).otherwise(F.col("value").cast("string"))
    line = F.concat(F.lit('{"id":'), F.col("user_id"), F.lit(',"i":'), F.col("event_id"), F.lit(',"x":'), value, F.lit("}"))
    folder = step_folder(spark)
    events_.select(line.alias("value")).write.text(folder)
    kinds = dict(events_.dtypes)
    read = io.read_records(spark, folder, T.StructType.fromDDL(f"id {kinds['user_id']}, i {kinds['event_id']}, x double"))
    samples = read.select("id", "i", (F.col("x") / 490).alias("x"), F.lit(1).alias("sr"), "error")
    failed = samples.filter("error is not null").select("id").distinct().withColumn("error", F.lit("broken record"))
    stats = quality.waveform_stats(samples.filter("error is null").select("id", "i", "x", "sr"))
    both = stats.join(failed, "id", "full_outer")
    return rounded(_flagged(both).select("id", F.array_join("flags", ",").alias("flags"), "ok", "n_samples", "peak"))


# --- frames and windows -----------------------------------------------------------------------------

@query("frame_windows", f"""with {FRAMES}, {windows_sql(WIN, HOP)}
 select w.id, w.start, f.frame from wins w join frames f on f.id = w.id and f.frame >= w.start and f.frame < w.start + {WIN}""")
def frame_windows(spark, sf):
    return windows.frame_windows(frames(spark, sf).select("id", "frame"), WIN, HOP).select("id", "start", "frame")


@query("bucketed_windows", f"""with {FRAMES}, {windows_sql(WIN, HOP)}, idx as (select id, count(*) as length from wins group by id)
 select w.id, i.length, count(*) as n_windows, sum(w.start)::bigint as starts from wins w join idx i on i.id = w.id group by 1, 2""")
def bucketed_windows(spark, sf):
    """Windows written in buckets of id, read back in another session and joined with their index."""
    starts = windows.frame_windows(frames(spark, sf).select("id", "frame"), WIN, HOP).select("id", "start").distinct()
    numbered = positions(starts, ["id"], ["start"], "win").select("id", "win", "start")
    index = numbered.groupBy("id").agg(F.count(F.lit(1)).alias("length"))
    folder = step_folder(spark)
    name = "windows_" + folder.rsplit("/", 1)[-1]
    io.write_window_table(numbered, name, folder, index, buckets=8)
    rows, lengths = io.open_window_table(spark.newSession(), name, folder, numbered.schema, index.schema, buckets=8)
    joined = rows.join(lengths, "id").groupBy("id", "length").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("start").alias("starts"))
    for entry in (name, f"{name}_index"):
        spark.sql(f"drop table `{entry}`")
    return joined


@query("frame_summary", f"""with {FRAMES} select id, channel, {r('avg(x)')} as mean, {r('stddev_pop(x)')} as std from cells group by id, channel""")
def frame_summary(spark, sf):
    return rounded(spectral.summarize_frames(frames(spark, sf, stored=False))).withColumn("channel", F.col("channel").cast("long"))


CHANGE = """change as (select id, frame, avg(greatest(x - before, 0)) as change from (select id, frame, channel, x,
   lag(x) over (partition by id, channel order by frame) as before from cells) where before is not null group by id, frame)"""


@query("spectral_flux", f"with {FRAMES}, {CHANGE} select l.id, {r('coalesce(avg(change), 0)')} as flux from lens l left join change c on c.id = l.id group by l.id")
def spectral_flux(spark, sf):
    return rounded(spectral.spectral_flux(frames(spark, sf, stored=False)))


SCORES = f"""{FRAMES}, {CHANGE}, {windows_sql(WIN, HOP)},
 scores as (select w.id, w.start, w.n, coalesce(avg(c.change), 0) as flux from wins w left join change c
   on c.id = w.id and c.frame > w.start and c.frame < w.start + {WIN} group by w.id, w.start, w.n),
 ranked as (select *, row_number() over (partition by id order by flux desc, start desc) as k, count(*) over (partition by id) as nw from scores),
 hard as (select id, start from ranked where k <= greatest(1, ceil(nw * 0.2e0)))"""


@query("hard_windows", f"""with {SCORES},
 wstats as (select h.id, h.start, c.channel, avg(x) as mean, stddev_pop(x) as std from hard h join cells c
   on c.id = h.id and c.frame >= h.start and c.frame < h.start + {WIN} group by h.id, h.start, c.channel),
 long as (select id, 'global' as block, channel, avg(x) as mean, stddev_pop(x) as std from cells group by id, channel
   union all select id, 'hard_mean', channel, avg(mean), avg(std) from wstats group by id, channel
   union all select id, 'hard_max', channel, max(mean), max(std) from wstats group by id, channel)
 select id, block, 'mean' as stat, channel, {r('mean')} as value from long
 union all select id, block, 'std', channel, {r('std')} from long""")
def hard_windows(spark, sf):
    return rounded(spectral.hard_windows(frames(spark, sf), WIN, HOP, 0.2)).withColumn("channel", F.col("channel").cast("long"))


@query("hard_window_diagnostics", f"""with {SCORES} select id, any_value(n) as n_frames, count(*) as n_windows,
 cast(greatest(1, ceil(count(*) * 0.2e0)) as bigint) as n_hard_windows, {r('max(flux)')} as max_flux, {r('avg(flux)')} as mean_flux from scores group by id""")
def hard_window_diagnostics(spark, sf):
    return rounded(spectral.hard_window_diagnostics(frames(spark, sf), WIN, HOP, 0.2))


def pooled_sql(columns: int, source: str = "cells") -> str:
    return f"""buckets as (select id, n, k, k * n // {columns} as lo, (k + 1) * n // {columns} as hi
   from lens, (select unnest(range({columns})) as k) where n > {columns}
   union all select id, n, k, k, k + 1 from (select id, n, unnest(range(n)) as k from lens where n <= {columns})),
 pooled as (select c.id, b.k as bucket, c.channel, avg(x) as x from buckets b join {source} c
   on c.id = b.id and c.frame >= b.lo and c.frame < b.hi group by c.id, b.k, c.channel)"""


@query("time_pool", f"with {FRAMES}, {pooled_sql(16)} select id, bucket, channel, {r('x')} as value from pooled")
def time_pool(spark, sf):
    out = windows.time_pool(frames(spark, sf), 16)
    return rounded(out.select("id", "bucket", F.col("channel").cast("long").alias("channel"), "value"))


# --- structure --------------------------------------------------------------------------------------

SSM = f"""{FRAMES},
 unit as (select id, frame, channel, x / greatest(sqrt(sum(x * x) over (partition by id, frame)), 1e-8) as x from cells),
 {pooled_sql(COLUMNS, 'unit')},
 pn as (select id, count(distinct bucket) as n from pooled group by id),
 ssm as (select a.id, a.bucket as i, b.bucket as j, sum(a.x * b.x) as sim from pooled a join pooled b
   on a.id = b.id and a.channel = b.channel and a.bucket <= b.bucket group by a.id, a.bucket, b.bucket),
 lags as (select n.id, l.lag, coalesce(avg(sim), 0) as value from pn n cross join (select unnest(range(1, 65)) as lag) l
   left join ssm s on s.id = n.id and s.j - s.i = l.lag group by n.id, l.lag),
 raw as (select n.id, q.i, case when q.i = 0 then 0 else -avg(s.sim) end as v from pn n, lateral (select unnest(range(n.n)) as i) q
   left join ssm s on s.id = n.id and s.i >= q.i - 8 and s.i < q.i and s.j >= q.i and s.j < q.i + 8 group by n.id, q.i),
 nov as (select id, i, v - min(v) over (partition by id) as novelty from raw)"""
SPANS = "spans as (select id, count(*) / 5.0e0 as duration from frames group by id)"


def _spans(fr):
    return fr.groupBy("id").agg((F.count(F.lit(1)) / 5.0).alias("duration"))


@query("ssm_pairs", f"with {SSM} select id, i, j, {r('sim')} as sim from ssm")
def ssm_pairs(spark, sf):
    out = structure.similarity_pairs(frames(spark, sf), COLUMNS)
    return rounded(out.select("id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "sim"))


@query("ssm_stats", f"""with {SSM} select id, {r('avg(sim)')} as ssm_mean, {r('stddev_pop(sim)')} as ssm_std,
 {r('avg(case when sim >= 0.05e0 then 1.0 else 0.0 end)')} as recurrence_rate from ssm where i < j group by id""")
def ssm_stats(spark, sf):
    return rounded(structure.ssm_stats(frames(spark, sf), COLUMNS, level=0.05))


@query("ssm_lags", f"with {SSM} select id, lag, {r('value')} as value from lags")
def ssm_lags(spark, sf):
    return rounded(structure.ssm_lags(frames(spark, sf), COLUMNS)).withColumn("lag", F.col("lag").cast("long"))


@query("ssm_lag_summary", f"""with {SSM} select id, {r('avg(value)')} as lag_profile_mean, {r('stddev_pop(value)')} as lag_profile_std,
 {r('max(value)')} as lag_profile_max from lags group by id""")
def ssm_lag_summary(spark, sf):
    return rounded(structure.ssm_lag_summary(frames(spark, sf), COLUMNS))


@query("novelty", f"with {SSM} select id, i, {r('novelty')} as novelty from nov")
def novelty(spark, sf):
    return rounded(structure.novelty(frames(spark, sf), COLUMNS)).withColumn("i", F.col("i").cast("long"))


@query("novelty_peaks", f"""with {SSM}, {SPANS}, st as (select id, avg(novelty) as m, stddev_pop(novelty) as s, count(*) as n from nov group by id),
 nb as (select id, i, novelty, lag(novelty) over (partition by id order by i) as a, lead(novelty) over (partition by id order by i) as b from nov),
 pk as (select nb.id, count(*) filter (where novelty > a and novelty > b and novelty > m + s and n >= 3 and s > 0) as peaks
   from nb join st on st.id = nb.id group by nb.id)
 select st.id, {r('m')} as novelty_mean, {r('s')} as novelty_std, peaks, {r('peaks / duration')} as novelty_peak_density
 from st join pk on pk.id = st.id join spans on spans.id = st.id""")
def novelty_peaks(spark, sf):
    fr = frames(spark, sf)
    return rounded(structure.novelty_peaks(fr, _spans(fr), COLUMNS))


@query("best_repeat", f"""with {SSM}, {SPANS}, best as (select s.id, i, j, sim, n.n, row_number() over (partition by s.id order by sim desc, i, j) as k
   from ssm s join pn n on n.id = s.id where j >= i + greatest(3, n.n // 10)),
 b as (select best.*, duration, duration / n as step, greatest(1, cast(round_even(2.0e0 / greatest(duration / n, 1e-6) / 2, 0) as bigint)) as half
   from best join spans on spans.id = best.id where k = 1)
 select id, {r('sim')} as sim, i, j, {r('greatest(0, i - half) * step')} as a_start, {r('least(n - 1, i + half) * step + step')} as a_end,
  {r('greatest(0, j - half) * step')} as b_start, {r('least(n - 1, j + half) * step + step')} as b_end from b""")
def best_repeat(spark, sf):
    fr = frames(spark, sf)
    return rounded(structure.best_repeat(fr, _spans(fr), COLUMNS, window_seconds=2.0))


# --- events -----------------------------------------------------------------------------------------

GAPS = ONSETS + ", gaps as (select id, t, t - lag(t) over (partition by id order by t, event_id) as ioi from onsets)"


@query("ioi_stats", f"""with {GAPS} select id, {r('coalesce(avg(ioi), 0) / 3600', 4)} as ioi_mean, {r('coalesce(stddev_pop(ioi), 0) / 3600', 4)} as ioi_std,
 {r('case when avg(ioi) > 0 then stddev_pop(ioi) / avg(ioi) else 0 end', 4)} as ioi_cv, {r('coalesce(quantile_cont(ioi, 0.25), 0) / 3600', 4)} as ioi_p25,
 {r('coalesce(quantile_cont(ioi, 0.5), 0) / 3600', 4)} as ioi_p50, {r('coalesce(quantile_cont(ioi, 0.75), 0) / 3600', 4)} as ioi_p75 from gaps group by id""")
def ioi_stats(spark, sf):
    out = events.ioi_stats(onsets(spark, sf, stored=False))
    # in hours, as rounded microseconds would often end in a tie
    return rounded(out.select("id", *[(F.col(c) if c == "ioi_cv" else F.col(c) / 3600).alias(c) for c in out.columns[1:]]), 4)


@query("strength_stats", f"""select user_id as id, {r('avg(value)', 9)} as mean, {r('stddev_pop(value)', 9)} as std, max(value) as max,
 {r('quantile_cont(value, 0.25)', 9)} as p25, {r('quantile_cont(value, 0.5)', 9)} as p50, {r('quantile_cont(value, 0.75)', 9)} as p75,
 {r('quantile_cont(value, 0.95)', 9)} as p95 from events group by user_id""")
def strength_stats(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("value").alias("strength"))
    return rounded(events.strength_stats(rows), 9)


def _density_sql() -> str:
    edge = lambda i: f"{i} * (duration / 8)" if i < 8 else "duration"
    counts = ", ".join(f"count(*) filter (where t >= {edge(i)} and t < {edge(i + 1)}) as c{i}" for i in range(8))
    bins = ", ".join(f"case when {edge(i + 1)} - {edge(i)} > 0 then c{i} / ({edge(i + 1)} - {edge(i)}) else 0 end as b{i}" for i in range(8))
    out = ", ".join(f"{r(f'b{i}', 9)} as bin_{i}" for i in range(8))
    names = ", ".join(f"b{i}" for i in range(8))
    return f"""with {ONSETS}, dur as (select id, max(t) as duration from onsets group by id),
 c as (select o.id, duration, count(*) as n, {counts} from onsets o join dur d on d.id = o.id group by o.id, duration),
 d as (select id, case when duration > 0 then n / duration else 0 end as density, {bins} from c)
 select id, {r('density', 9)} as density, {out}, {r(f'list_stddev_pop([{names}])', 9)} as bin_std, {r(f'greatest({names})', 9)} as bin_max from d"""


@query("event_density", _density_sql())
def event_density(spark, sf):
    on = onsets(spark, sf)
    return rounded(events.event_density(on.select("id", "t"), durations(on)), 9)


@query("lag_autocorr", f"""with {ENVELOPE} select a.id, b.frame - a.frame as lag, {r('sum(a.strength * b.strength)', 5)} as r
 from envelope a join envelope b on a.id = b.id and b.frame >= a.frame and b.frame < a.frame + 192 group by 1, 2""")
def lag_autocorr(spark, sf):
    out = events.lag_autocorr(envelope(onsets(spark, sf)), 192)
    return rounded(out.select("id", F.col("lag").cast("long").alias("lag"), "r"), 5)


@query("pulse_clarity", f"""with {ENVELOPE}, prof as (select a.id, b.frame - a.frame as lag, sum(a.strength * b.strength) as v
 from envelope a join envelope b on a.id = b.id and b.frame >= a.frame and b.frame < a.frame + 192 group by 1, 2),
 w as (select id, lag, v, case when lag > 0 and 60.0e0 / (lag * 0.05e0) <= 320 then 60.0e0 / (lag * 0.05e0) end as bpm from prof),
 k as (select *, row_number() over (partition by id order by case when bpm is not null then
   ln(1 + 1e6 * greatest(v, 0)) - 0.5 * pow(log2(bpm / 120), 2) end desc nulls last, lag) as k from w)
 select id, {r('max(case when k = 1 then bpm end)')} as tempo_bpm, {r('max(v) / (avg(v) + 1e-8)')} as tempo_confidence from k group by id""")
def pulse_clarity(spark, sf):
    profile = events.lag_autocorr(envelope(onsets(spark, sf)), 192)
    return rounded(events.tempo(profile, 0.05, "r"))


def _framed(keys: str) -> str:
    """Local autocorrelation of sized(keys, xs, size): Hann frames about each value, a ramp to 0 beyond the ends, each frame scaled to at most 1."""
    return f"""padded as (select {keys}, size, len(xs) as n, list_concat(list_transform(range(0, size // 2), lambda i: xs[1] * i / (size // 2)), xs,
   list_transform(range(0, size // 2), lambda i: xs[len(xs)] * (size // 2 - 1 - i) / (size // 2))) as p from sized),
 framed as (select {keys}, size, list_transform(range(0, size), lambda i: p[t + 1 + i] * (0.5 - 0.5 * cos(2 * pi() * i / size))) as f
   from (select *, unnest(range(0, n)) as t from padded)),
 lagged as (select {keys}, size, list_transform(range(0, size), lambda k: list_inner_product(f[1:size - k], f[k + 1:size])) as r from framed),
 topped as (select *, list_max(list_transform(r, lambda v: abs(v))) as top from lagged),
 localr as (select {keys}, unnest(range(0, size)) as lag, unnest(list_transform(r, lambda v: v / case when top < 2.2250738585072014e-308 then 1 else top end)) as v from topped)"""


def _tempos(seconds: str) -> str:
    """tempos(id, start, tempo_bpm, tempo_confidence) of wins over envelope."""
    return f"""segs as (select w.id, w.start, list(strength order by frame) as xs from wins w
   join envelope e on e.id = w.id and e.frame >= w.start and e.frame < w.start + {HOURS} group by w.id, w.start),
 sized as (select *, least(192, greatest(2, len(xs))) as size from segs), {_framed("id, start")},
 profile as (select id, start, lag, avg(v) as v, 60.0e0 / (lag * {seconds}) as bpm from localr group by id, start, lag),
 weighed as (select *, case when lag > 0 and bpm <= 320 then ln(1 + 1e6 * greatest(v, 0)) - 0.5 * log2(bpm / 120) ** 2 end as w from profile),
 tempos as (select id, start, coalesce(arg_max(bpm, {{'w': w, 'l': -lag}}) filter (where w is not null), 0) as tempo_bpm,
   max(v) / (avg(v) + 1e-8) as tempo_confidence from weighed group by id, start)"""


@query("tempo_profile", f"""with {ENVELOPE}, sized as (select id, list(strength order by frame) as xs, 192 as size from envelope group by id), {_framed("id")}
 select id, lag::integer as lag, {r('avg(v)')} as mean, {r('stddev_pop(v)')} as std from localr group by id, lag""")
def tempo_profile(spark, sf):
    """Local autocorrelation profile; by Fourier transforms here, by sums of products in SQL."""
    return rounded(events.lag_profile(envelope(onsets(spark, sf)), 192))


def _event_windows(spark, sf):
    on = onsets(spark, sf)
    return events.event_windows(on.select("id", "t"), envelope(on), HOURS, STEP, 3600.0)


WINDOWS = f"""{ENVELOPE}, {windows_sql(HOURS, STEP, 'elens')},
 bounds as (select id, start, start * 3600.0e0 as t0, least(start + {HOURS}, n) * 3600.0e0 as t1 from wins),
 str as (select w.id, w.start, avg(strength) as m, stddev_pop(strength) as s, max(strength) as x from wins w join envelope e
   on e.id = w.id and e.frame >= w.start and e.frame < w.start + {HOURS} group by w.id, w.start),
 gaps as (select id, t, lag(t) over (partition by id order by t, event_id) as before from onsets),
 occ as (select b.id, b.start, count(*) as c, avg(case when before >= t0 then t - before end) as im,
   stddev_pop(case when before >= t0 then t - before end) as isd from bounds b join gaps g
   on g.id = b.id and g.t >= b.t0 and g.t < b.t1 group by b.id, b.start),
 ew as (select b.id, b.start, t0 as t_start, t1 as t_end, coalesce(c, 0) / (t1 - t0) as onset_density, m as onset_strength_mean,
   s as onset_strength_std, x as onset_strength_max, coalesce(im, 0) as ioi_mean, coalesce(isd, 0) as ioi_std,
   case when im > 0 then coalesce(isd, 0) / im else 0 end as ioi_cv
   from bounds b join str on str.id = b.id and str.start = b.start left join occ on occ.id = b.id and occ.start = b.start)"""


@query("event_windows", f"""with {WINDOWS} select id, start, t_start, t_end, {r('onset_density', 9)} as onset_density,
 {r('onset_strength_mean', 7)} as onset_strength_mean, {r('onset_strength_std', 5)} as onset_strength_std,
 {r('onset_strength_max', 7)} as onset_strength_max, {r('ioi_mean / 3600', 4)} as ioi_mean, {r('ioi_std / 3600', 4)} as ioi_std, {r('ioi_cv', 5)} as ioi_cv from ew""")
def event_windows(spark, sf):
    out = _event_windows(spark, sf)
    digits = {"onset_density": 9, "onset_strength_std": 5, "ioi_mean": 4, "ioi_std": 4, "ioi_cv": 5}
    hours = lambda c: F.col(c) / 3600 if c in ("ioi_mean", "ioi_std") else F.col(c)
    return out.select("id", "start", "t_start", "t_end", *[
        (F.round(hours(c), digits.get(c, 7)) + F.lit(0.0)).alias(c) for c in out.columns[4:]])


@query("window_tempo", f"""with {ENVELOPE}, {windows_sql(HOURS, STEP, 'elens')}, {_tempos("0.05e0")}
 select id, start, {r('tempo_bpm')} as tempo_bpm, {r('tempo_confidence')} as tempo_confidence from tempos""")
def window_tempo(spark, sf):
    """Tempo and pulse clarity inside each window."""
    return rounded(events.window_tempo(envelope(onsets(spark, sf)), HOURS, STEP, 0.05, 192))


@query("rhythm_windows", f"""with {WINDOWS}, {_tempos("3600.0e0")}
 select ew.id, ew.start, {r('onset_density', 9)} as onset_density, {r('onset_strength_mean', 7)} as onset_strength_mean, {r('onset_strength_std', 5)} as onset_strength_std,
 {r('onset_strength_max', 7)} as onset_strength_max, {r('ioi_mean / 3600', 4)} as ioi_mean, {r('ioi_std / 3600', 4)} as ioi_std, {r('ioi_cv', 5)} as ioi_cv,
 {r('tempo_bpm * 3600')} as tempo_bph, {r('tempo_confidence')} as tempo_confidence from ew join tempos t on t.id = ew.id and t.start = ew.start""")
def rhythm_windows(spark, sf):
    """All nine channels of a rhythm window; the tempo in beats per hour, as frames are hours."""
    on = onsets(spark, sf)
    rows = events.event_windows(on.select("id", "t"), envelope(on), HOURS, STEP, 3600.0, with_tempo=True)
    out = rows.select("id", "start", events.window_values(rows).alias("v"))
    at = {n: F.get("v", F.lit(k)) for k, n in enumerate(events.RHYTHM_NAMES)}
    digits = {"onset_density": 9, "onset_strength_std": 5, "ioi_mean": 4, "ioi_std": 4, "ioi_cv": 5, "tempo_bph": 6, "tempo_confidence": 6}
    shown = {n: at[n] / 3600 if n in ("ioi_mean", "ioi_std") else at[n] for n in events.RHYTHM_NAMES[:7]} | {"tempo_bph": at["tempo_bpm"] * 3600, "tempo_confidence": at["tempo_confidence"]}
    return out.select("id", "start", *[(F.round(c, digits.get(n, 7)) + F.lit(0.0)).alias(n) for n, c in shown.items()])


@query("validity_mask", f"""with {WINDOWS} select id, start, ioi_mean > 0 as ioi_valid,
 onset_density > 0 and onset_strength_mean > 0 and ioi_mean > 0 as tempo_valid,
 onset_density > 0 and onset_strength_mean > 0 as confidence_valid from ew""")
def validity_mask(spark, sf):
    rows = _event_windows(spark, sf)
    values = F.array(*[F.col(c) if c in rows.columns else F.lit(0.0) for c in events.RHYTHM_NAMES])
    mask = rows.select("id", "start", fc.rhythm_validity(values).alias("ok"))
    return mask.select("id", "start", F.get("ok", F.lit(4)).alias("ioi_valid"), F.get("ok", F.lit(7)).alias("tempo_valid"),
                       F.get("ok", F.lit(8)).alias("confidence_valid"))


@query("local_peaks", f"""with {ENVELOPE}, w as (select id, frame, strength,
  max(strength) over (partition by id order by frame rows between 3 preceding and 1 preceding) as b,
  max(strength) over (partition by id order by frame rows between 1 following and 3 following) as a,
  avg(strength) over (partition by id order by frame rows between 5 preceding and 5 following) as m from envelope)
 select id, frame, {r('strength')} as strength from w where (b is null or strength > b) and (a is null or strength >= a) and strength >= m + 5""")
def local_peaks(spark, sf):
    return rounded(events.local_peaks(envelope(onsets(spark, sf)), 3, 3, 5, 5, 5.0))


PEAKS = f"""{ENVELOPE}, w as (select id, frame, strength,
  max(strength) over (partition by id order by frame rows between 1 preceding and 1 preceding) as b,
  max(strength) over (partition by id order by frame rows between 1 following and 1 following) as a,
  avg(strength) over (partition by id order by frame rows between 5 preceding and 5 following) as m from envelope),
 peaks as (select id, frame, strength, row_number() over (partition by id order by strength desc, frame) as k from w
  where (b is null or strength > b) and (a is null or strength >= a) and strength >= m)"""


@query("spaced_peaks", f"""with recursive {PEAKS}, g as (select distinct id, 0::bigint as k, []::bigint[] as kept from peaks
 union all select g.id, g.k + 1, case when len(list_filter(kept, lambda f: abs(f - frame) <= 6)) = 0 then list_append(kept, frame::bigint) else kept end
  from g join peaks p on p.id = g.id and p.k = g.k + 1),
 chosen as (select id, unnest(kept) as frame from (select id, max_by(kept, k) as kept from g group by id))
 select c.id, c.frame::bigint as frame, {r('strength')} as strength from chosen c join peaks p on p.id = c.id and p.frame = c.frame""")
def spaced_peaks(spark, sf):
    return rounded(events.spaced_peaks(events.local_peaks(envelope(onsets(spark, sf)), 1, 1, 5, 5, 0.0), 6))


# --- alignment and normalization --------------------------------------------------------------------

def _window_means(fr):
    """Window means of the first nine channels, as a stand-in for rhythm windows."""
    rows = spectral.channel_rows(windows.frame_windows(fr, WIN, HOP), "id", "n", "start").filter("channel < 9")
    cells = rows.groupBy("id", "n", "start", "channel").agg(F.avg("x").alias("value"))
    wide = windows.gather_vectors(cells, ["id", "n", "start"])
    # the regular starts count in hops, and the forced last window follows them
    number = F.ceil(F.col("start") / HOP)
    return wide.select("id", number.alias("win"), (F.col("start") / 5.0).alias("t_start"),
                       (F.least(F.col("start") + WIN, F.col("n")) / 5.0).alias("t_end"), "values")


_VALID = "case when c < 4 then true when c < 7 then y4 > 0 when c = 7 then y4 > 0 and y0 > 0 and y1 > 0 else y0 > 0 and y1 > 0 end"


@query("align_interp", f"""with {FRAMES}, {windows_sql(WIN, HOP)},
 wm as (select w.id, w.start, (w.start / 5.0e0 + least(w.start + {WIN}, w.n) / 5.0e0) / 2 as centre, c.channel as c, avg(x) as y
   from wins w join cells c on c.id = w.id and c.frame >= w.start and c.frame < w.start + {WIN} and c.channel < 9 group by all),
 wv as (select *, max(case when c = 0 then y end) over (partition by id, start) as y0, max(case when c = 1 then y end) over (partition by id, start) as y1,
   max(case when c = 4 then y end) over (partition by id, start) as y4 from wm),
 wk as (select id, start, centre, c, y, {_VALID} as ok from wv),
 ends as (select id, min(centre) as c0, max(centre) as cn from wk group by id),
 ft as (select f.id, f.frame, f.frame / 5.0e0 + 0.1e0 as t, least(greatest(f.frame / 5.0e0 + 0.1e0, c0), cn) as target
   from frames f join ends e on e.id = f.id where f.frame / 5.0e0 + 0.1e0 >= c0 - 1e-9 and f.frame / 5.0e0 + 0.1e0 <= cn + 1e-9),
 ch as (select ft.*, unnest(range(9)) as c from ft),
 rt as (select ch.*, k.centre as cr, k.y as yr, k.ok as okr from ch asof join wk k on k.id = ch.id and k.c = ch.c and k.centre >= ch.target),
 lt as (select rt.*, k.centre as cl, k.y as yl, k.ok as okl from rt asof left join wk k on k.id = rt.id and k.c = rt.c and k.centre < rt.cr),
 v as (select id, frame, c, case when cl is not null and abs(target - cl) <= 1e-9 then yl when cl is null or abs(target - cr) <= 1e-9 then yr
     else (yr - yl) / (cr - cl) * (target - cl) + yl end as y,
   case when cl is not null and abs(target - cl) <= 1e-9 then okl when cl is null or abs(target - cr) <= 1e-9 then okr else okl and okr end as ok from lt)
 select id, frame, c as channel, {r('case when ok then y else 0 end')} as value, ok as valid from v""")
def align_interp(spark, sf):
    fr = frames(spark, sf)
    aligned = align.align(fr, _window_means(fr), fps=5.0, offset=0.1)
    cells = aligned.select("id", "frame", F.posexplode(F.arrays_zip(
        F.slice("values", 65, 9).alias("value"), F.slice("valid", 65, 9).alias("valid"))).alias("channel", "c"))
    return rounded(cells.select("id", "frame", F.col("channel").cast("long").alias("channel"), "c.value", "c.valid"))


@query("align_problems", """with w as (select l_orderkey as id, l_linenumber - 1 as win, cast(l_quantity as double) as t_start,
  cast(l_quantity as double) + cast(l_discount as double) * 64 as t_end from lineitem),
 o as (select *, (t_start + t_end) / 2 as centre, (lag(t_start) over (partition by id order by win) + lag(t_end) over (partition by id order by win)) / 2 as before from w),
 p as (select id, count(*) as k, count(distinct win) as d, min(win) as lo, max(win) as hi, bool_or(t_end <= t_start) as bad, bool_or(centre <= before) as falls,
  min(centre) as c0, max(centre) as cn from o group by id),
 l as (select o_orderkey as id, 1 + cast(floor(o_totalprice / 8000) as bigint) as n from orders where o_orderkey % 7 > 0)
 select coalesce(l.id, p.id) as id, n, case when n is null then 'no_frames' when k is null then 'no_windows' when d < k or lo <> 0 or hi <> k - 1 then 'window_numbers'
  when bad then 'window_times' when falls then 'centres_not_increasing' when greatest(0, ceil(c0 - 1e-9)) > least(n - 1, floor(cn + 1e-9)) then 'no_coverage' end as problem
 from l full join p on l.id = p.id""")
def align_problems(spark, sf):
    """Which orders could be aligned if their lines were windows; a seventh of the orders has no frames."""
    start = F.col("l_quantity").cast("double")
    wins = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).alias("win"), start.alias("t_start"),
                                               (start + F.col("l_discount").cast("double") * 64).alias("t_end"))
    lengths = table(spark, sf, "orders").filter("o_orderkey % 7 > 0").select(
        F.col("o_orderkey").alias("id"), (1 + F.floor(F.col("o_totalprice") / 8000)).cast("long").alias("n"))
    return align.window_problems(wins, lengths, fps=1.0)


def _masked(fr):
    """Upper channels count as observed only where channel 0 is positive."""
    first = F.get("values", F.lit(0)) > 0
    return fr.withColumn("valid", F.transform("values", lambda x, i: (i < 48) | first))


def _train_series(fr):
    series = fr.select("id").distinct().withColumn("group", F.col("id").cast("string"))
    return splits.assign_split(series).filter("part = 'train'").select("id")


NORM = f"""{FRAMES}, ids as (select id, row_number() over (order by sha256('42:' || id)) - 1 as pos, count(*) over () as g from lens),
 train as (select id from ids where pos >= ceil(g / 5.0) + ceil((g - ceil(g / 5.0)) / 4.0)),
 masked as (select c.id, c.frame, channel, x, channel < 48 or f.v[1] > 0 as ok from cells c join frames f on f.id = c.id and f.frame = c.frame),
 norm as (select channel, avg(x) as mean, stddev_pop(x) as std, count(*) as n_valid from masked where ok and id in (select id from train) group by channel)"""


@query("channel_stats", f"""with {NORM} select channel, {r('mean')} as mean, {r('case when std < 1e-8 then 1 else std end')} as std, n_valid,
 {r('sqrt(greatest(std * std, 1e-8))')} as std_floor from norm""")
def channel_stats(spark, sf):
    fr = _masked(frames(spark, sf))
    train = _train_series(fr)
    unit = align.channel_stats(fr, train, strict=True)
    floor = align.channel_stats(fr, train, floor="variance").select("channel", F.col("std").alias("std_floor"))
    return rounded(unit.join(floor, "channel")).withColumn("channel", F.col("channel").cast("long"))


@query("standardize", f"""with {NORM} select m.id, m.frame, m.channel, (round(cast(case when ok then
 (cast(x as float) - cast(mean as float)) / cast(case when std < 1e-8 then 1 else std end as float) else 0 end as double), 4) + 0.0) as z
 from masked m join norm n on n.channel = m.channel""")
def standardize(spark, sf):
    fr = _masked(frames(spark, sf))
    out = align.standardize(fr, align.channel_stats(fr, _train_series(fr)))
    long = out.select("id", "frame", F.posexplode("values").alias("channel", "z"))
    return rounded(long.select("id", "frame", F.col("channel").cast("long").alias("channel"), F.col("z").cast("double").alias("z")), 4)


# --- metrics ----------------------------------------------------------------------------------------

SCORED = f"{GRADED}, scored as (select model, truth, score from graded), {METRICS_SQL}"


@query("evaluate", f"""with {SCORED} select model, n, {r('tau', 9)} as kendall_tau_c, {r('rho', 9)} as spearman, {r('mae', 9)} as mae, {r('mse', 9)} as mse,
 {r('acc', 9)} as acc_pm1, cast(null as varchar) as correlation_note from metrics""")
def evaluate(spark, sf):
    return rounded(metrics.evaluate(graded(spark, sf), ["model"]), 9)


@query("tau_c", f"with {SCORED} select model, {r('tau', 9)} as kendall_tau_c from metrics")
def tau_c(spark, sf):
    return rounded(metrics.rank_metrics(graded(spark, sf), ["model"]).select("model", "kendall_tau_c"), 9)


@query("spearman", f"with {SCORED} select model, {r('rho', 9)} as spearman from metrics")
def spearman(spark, sf):
    return rounded(metrics.rank_metrics(graded(spark, sf), ["model"]).select("model", "spearman"), 9)


@query("mean_baseline", f"""with {SPLIT}, m as (select avg(grade) as s from split where part = 'train')
 select part, count(*) as n, cast(null as double) as kendall_tau_c, cast(null as double) as spearman, {r('avg(abs(s - grade))', 9)} as mae,
 {r('avg((s - grade) * (s - grade))', 9)} as mse, {r('avg(case when abs(floor(s + 0.5) - grade) <= 1 then 1.0 else 0.0 end)', 9)} as acc_pm1,
 'Undefined for constant truth or predictions' as correlation_note from split, m where part <> 'train' group by part""")
def mean_baseline(spark, sf):
    return rounded(metrics.mean_baseline(split_items(spark, sf), truth="grade"), 9)


@query("grade_band_stats", f"""with {GRADED}, e as (select model, truth as grade, case when truth <= 3 then 'Low0-3' when truth <= 6 then 'Mid4-6'
 else 'High7-10' end as band, score - truth as err from graded)
 select model, case when grouping(grade) = 0 then 'grade' when grouping(band) = 0 then 'band' else 'overall' end as level, grade, band,
 count(*) as n, {r('avg(abs(err))', 9)} as mae, {r('avg(err)', 9)} as bias, {r('avg(case when abs(err) <= 1 then 1.0 else 0.0 end)', 9)} as acc_pm1
 from e group by grouping sets ((model, grade), (model, band), (model))""")
def grade_band_stats(spark, sf):
    return rounded(metrics.grade_stats(graded(spark, sf)), 9)


@query("model_report", f"""with {SCORED}, e as (select model, case when truth <= 3 then 'Low0-3' when truth <= 6 then 'Mid4-6'
 else 'High7-10' end as band, score - truth as err from graded)
 select e.model, band, count(*) as n, {r('avg(abs(err))', 9)} as mae, {r('avg(err)', 9)} as bias, {r('any_value(tau)', 9)} as kendall_tau_c
 from e join metrics m on m.model = e.model group by e.model, band""")
def model_report(spark, sf):
    """Which model ranks best, and where does it err."""
    rows = graded(spark, sf)
    bands = metrics.grade_stats(rows).filter("level = 'band'").select("model", "band", "n", "mae", "bias")
    return rounded(bands.join(metrics.rank_metrics(rows, ["model"]).select("model", "kendall_tau_c"), "model"), 9)


@query("pivot_predictions", f"""with {GRADED} select id, any_value(truth) as truth, """ + ", ".join(
    f"{r(f'''max(case when model = '{m}' then score end)''')} as {m}" for m in MODELS) + " from graded group by id")
def pivot_predictions(spark, sf):
    return rounded(metrics.pivot_predictions(graded(spark, sf), list(MODELS)))


def _cases_sql() -> str:
    wide = "wide as (select id, any_value(truth) as truth, " + ", ".join(
        f"abs(max(case when model = '{m}' then score end) - any_value(truth)) as {m}" for m in MODELS) + " from graded group by id)"
    cat = lambda place, name, rule, score, k: (
        f"select * from (select {place} as place, '{name}' as category, id, {score} as score, "
        f"row_number() over (order by {score} desc, id) as rank from wide where {rule}) where rank <= {k}")
    s, q, f = "hgb_cqt_structure - hgb_cqt", "hgb_cqt_rhythm - hgb_cqt", "hgb_cqt_rhythm_structure"
    parts = [cat(0, "baseline_large_err", "true", "hgb_cqt", 4), cat(1, "structure_improved", f"{s} < -0.5", f"-({s})", 3),
             cat(2, "structure_worsened", f"{s} > 0.5", s, 3), cat(3, "rhythm_improved", f"{q} < -0.5", f"-({q})", 3),
             cat(4, "rhythm_worsened", f"{q} > 0.5", q, 3), cat(5, "full_still_bad", f"{f} >= 2", f, 3)]
    return (f"with {GRADED}, {wide}, c as ({' union all '.join(parts)}) select place, category, cast(rank as integer) as rank, id, {r('score')} as score"
            " from (select *, row_number() over (partition by id order by place) as k from c) where k = 1")


def _wide(spark, sf):
    # scores are given in hundredths; rounding keeps equal errors equal on both sides
    rows = graded(spark, sf)
    return metrics.pivot_predictions(rows, list(MODELS))


@query("pick_cases", _cases_sql())
def pick_cases(spark, sf):
    return rounded(registry.pick_cases(_wide(spark, sf), "hgb_cqt", "hgb_cqt_rhythm", "hgb_cqt_structure", "hgb_cqt_rhythm_structure"))


@query("best_trial", f"with {SCORED} select model as param, {r('tau')} as kendall_tau_c, {r('mse')} as mse from metrics order by tau desc nulls last, mse, model limit 1")
def best_trial(spark, sf):
    trials = metrics.evaluate(graded(spark, sf), ["model"]).withColumnRenamed("model", "param")
    return rounded(registry.best_trial(trials).select("param", "kendall_tau_c", "mse"))


@query("verify_predictions", f"""with {SPLIT}, {GRADED}, members as (select id, case when p_type = 'LARGE' then (grade + 1) % 11 else grade end as grade
   from split where part = 'val' and p_type <> 'SMALL' or part = 'test'),
 preds as (select g.id, truth, score from graded g join split s on s.id = g.id where part = 'val' and model = 'hgb_cqt'),
 scored as (select model, truth, score from graded g join split s on s.id = g.id where part = 'val' and model in ('hgb_cqt', 'hgb_cqt_rhythm')),
 {METRICS_SQL}, a as (select * from metrics where model = 'hgb_cqt'), b as (select * from metrics where model = 'hgb_cqt_rhythm'),
 m as (select unnest(['n', 'kendall_tau_c', 'spearman', 'mae', 'mse', 'acc_pm1']) as name, unnest([a.n, a.tau, a.rho, a.mae, a.mse, a.acc]) as x,
   unnest([b.n, b.tau, b.rho, b.mae, b.mse, b.acc]) as y from a, b)
 select subject, problem from (select cast(coalesce(p.id, q.id) as varchar) as subject, case when p.id is null then 'missing_prediction'
   when q.id is null then 'unknown_id' when p.truth <> q.grade then 'label_differs' end as problem
   from preds p full outer join members q on p.id = q.id) where problem is not null
 union all select name, 'metric_differs' from m where not (abs(x - y) <= 1e-7 + 1e-6 * abs(y))""")
def verify_predictions(spark, sf):
    items = split_items(spark, sf)
    grade = F.when(F.col("p_type") == "LARGE", (F.col("grade") + 1) % 11).otherwise(F.col("grade"))
    members = items.filter("part = 'val' and p_type != 'SMALL' or part = 'test'").select("id", grade.alias("grade"))
    # a part's ids are many and their file is small, so Spark would send them through the driver
    val = items.filter("part = 'val'").select("id").hint("merge")
    rows = settled(graded(spark, sf, {m: MODELS[m] for m in ("hgb_cqt", "hgb_cqt_rhythm")}).join(val, "id"))
    predictions = rows.filter("model = 'hgb_cqt'").select("id", "truth", "score")
    reported = metrics.evaluate(rows.filter("model = 'hgb_cqt_rhythm'"))
    return metrics.verify_predictions(predictions, members, reported)


# --- splits and groups ------------------------------------------------------------------------------

@query("group_split", f"with {SPLIT} select grp as \"group\", part from gparts")
def group_split(spark, sf):
    return splits.group_split(table(spark, sf, "part").select(F.col("p_brand").alias("group")))


@query("coverage", f"""with {SPLIT} select p.part, cast(g.grade as integer) as grade, count(s.id) as n from (select unnest(['train', 'val', 'test']) as part) p
 cross join (select unnest(range(11)) as grade) g left join split s on s.part = p.part and s.grade = g.grade group by 1, 2""")
def coverage(spark, sf):
    return splits.coverage(split_items(spark, sf))


@query("grade_counts", "select p_size % 11 as grade, count(*) as n from part group by 1")
def grade_counts(spark, sf):
    return splits.grade_counts(table(spark, sf, "part").select((F.col("p_size") % 11).alias("grade")))


@query("split_overlap", f"""with {SPLIT}, k as (select distinct part, p_name from split)
 select a.part as part_a, b.part as part_b, count(*) as n from k a join k b on a.p_name = b.p_name
 where (a.part, b.part) in (('train', 'val'), ('train', 'test'), ('val', 'test')) group by 1, 2""")
def split_overlap(spark, sf):
    return splits.split_overlap(split_items(spark, sf), "p_name")


@query("common_subset", f"""with {SPLIT}, ok as (select l_partkey from lineitem group by 1 having avg(l_quantity) >= 25)
 select part, count(*) as source, count(*) filter (where id in (select l_partkey from ok)) as kept,
 count(*) filter (where id not in (select l_partkey from ok)) as missing from split group by part""")
def common_subset(spark, sf):
    valid = (table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.avg("l_quantity").alias("q")).filter("q >= 25"))
    return splits.common_subset(split_items(spark, sf), valid)[1]


@query("validate_split", f"""with {SPLIT}, doubled as (select id, grp, part from split union all select id, grp, 'test' from split where p_type = 'SMALL' and part = 'train')
 select case when count(distinct part) > 1 then 'id_in_two_parts' else 'duplicate_id' end as problem, cast(id as varchar) as subject, count(*) as n
 from doubled group by id having count(*) > 1
 union all select 'group_in_two_parts', grp, count(distinct part) from doubled group by grp having count(distinct part) > 1""")
def validate_split(spark, sf):
    items = split_items(spark, sf)
    copied = items.filter("p_type = 'SMALL' and part = 'train'").select("id", F.lit("test").alias("part"))
    return splits.validate_split(items.select("id", "part").unionByName(copied), items.select("id", "group"))


@query("groups", """with recursive links as (select distinct a.o_custkey as x, b.o_custkey as y from orders a join orders b
   on a.o_totalprice = b.o_totalprice and a.o_custkey <> b.o_custkey),
 reach as (select distinct o_custkey as x, o_custkey as y from orders union select r.x, l.y from reach r join links l on r.y = l.x),
 low as (select o_custkey as y, min(cast(o_orderkey as varchar)) as m from orders group by 1),
 comp as (select x, min(m) as g from reach join low on low.y = reach.y group by x)
 select cast(o_orderkey as varchar) as id, g as "group" from orders join comp on x = o_custkey""")
def groups(spark, sf):
    """Orders of one customer or of one total price belong together, transitively."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.explode(F.array(
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")),
        F.concat(F.lit("price:"), F.col("o_totalprice").cast("string")))).alias("token"))
    return splits.connected_groups(orders)


# --- registry ---------------------------------------------------------------------------------------

@query("integrity_check", """with items as (select doc_id as id, cast(n_chars > 1000 as integer) as label, sha256(text) as h from documents),
 manifest as (select l.doc_id as id, quality as label, case when toxic = 0 then 'included' else 'excluded' end as status,
   sha256(replace(text, 'http', 'hxxp')) as h from labels l join documents d on d.doc_id = l.doc_id)
 select id, problem from (select i.id, case when m.id is null then 'absent' when m.status <> 'included' then 'not_included'
   when i.label <> m.label then 'label_differs' when i.h <> m.h then 'content_changed' end as problem
   from items i left join manifest m on m.id = i.id) where problem is not null""")
def integrity_check(spark, sf):
    docs = table(spark, sf, "documents")
    items = docs.select(F.col("doc_id").alias("id"), (F.col("n_chars") > 1000).cast("int").alias("label"), F.sha2("text", 256).alias("h"))
    manifest = table(spark, sf, "labels").join(docs.select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"),
        F.when(F.col("toxic") == 0, "included").otherwise("excluded").alias("status"),
        F.sha2(F.replace("text", F.lit("http"), F.lit("hxxp")), 256).alias("h"))
    return registry.verify_manifest(items, manifest, ["h"])


@query("index_check", f"""with {FRAMES}, {windows_sql(WIN, HOP)}, actual as (select id, count(*) as length from wins group by id),
 idx as (select label as id, count(*) // {HOP} as length, max(vec_id) % 11 as y from embeddings group by label)
 select a.id, case when a.length <> i.length then 'length_differs' else 'label_differs' end as problem from actual a join idx i on i.id = a.id
 join (select label as id, min(vec_id) % 11 as y from embeddings group by label) l on l.id = a.id where a.length <> i.length or i.y <> l.y""")
def index_check(spark, sf):
    fr = frames(spark, sf)
    vectors = table(spark, sf, "embeddings").groupBy(F.col("label").alias("id"))
    labels = vectors.agg((F.min("vec_id") % 11).alias("y")).withColumn("audio_sha256", F.lit("-"))
    index = vectors.agg(F.floor(F.count(F.lit(1)) / HOP).alias("length"), (F.max("vec_id") % 11).alias("y")).select(
        "id", "length", "y", F.lit("-").alias("audio_sha256"), F.lit(2.0).alias("win_sec"), F.lit(1.0).alias("hop_sec"))
    return registry.verify_index(windows.window_table(fr, WIN, HOP), index, labels, 2.0, 1.0)


@query("run_status", f"with {RUNS} select c_custkey as experiment_id, run, case when run is null then 'not_started' else coalesce(status, 'unmanaged') end as status from customer left join runs on experiment_id = c_custkey")
def run_status(spark, sf):
    experiments = table(spark, sf, "customer").select(F.col("c_custkey").alias("experiment_id"))
    return registry.run_status(experiments, runs(spark, sf).select("experiment_id", "run", "status"))


@query("comparable", f"with {RUNS} select coalesce(split_sha256, 'unknown') as split_sha256, n_validation, count(*) as n_runs from runs group by 1, 2")
def comparable(spark, sf):
    return registry.comparable(runs(spark, sf))


@query("comparable_members", f"""with {RUNS} select coalesce(split_sha256, 'unknown') as split_sha256, coalesce(cast(n_validation as varchar), 'none') as n_validation,
 run, count(*) over (partition by coalesce(split_sha256, 'unknown'), n_validation) as n_runs from runs""")
def comparable_members(spark, sf):
    return registry.comparable_members(runs(spark, sf))


@query("registry_summary", f"""with {RUNS} select 'runs' as name, count(*) as n from runs union all select 'test_evaluated', count(*) filter (where test_evaluated) from runs
 union all select 'n_validation=' || coalesce(cast(n_validation as varchar), 'none'), count(*) from runs group by 1""")
def registry_summary(spark, sf):
    return registry.registry_summary(runs(spark, sf))


@query("leaderboard", f"with {RUNS} select run, {r('kendall_tau_c', 9)} as kendall_tau_c from runs order by runs.kendall_tau_c desc nulls last, run")
def leaderboard(spark, sf):
    return rounded(registry.leaderboard(runs(spark, sf).select("run", "kendall_tau_c")), 9)


@query("ids_digest", """with h as (select distinct sha256(cast(o_orderkey as varchar)) as h from orders),
 l8 as (select substr(h, 1, 8) as p, sha256(string_agg(h, chr(10) order by h)) as h from h group by 1),
 l6 as (select substr(p, 1, 6) as p, sha256(string_agg(h, chr(10) order by p, h)) as h from l8 group by 1),
 l4 as (select substr(p, 1, 4) as p, sha256(string_agg(h, chr(10) order by p, h)) as h from l6 group by 1),
 l2 as (select substr(p, 1, 2) as p, sha256(string_agg(h, chr(10) order by p, h)) as h from l4 group by 1)
 select sha256(string_agg(h, chr(10) order by p, h)) as digest from l2""")
def ids_digest(spark, sf):
    return registry.ids_digest(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("best_epoch", f"""with {HISTORY} select run, epoch, {r('tau_c')} as tau_c, {r('mse')} as mse from (select *, row_number() over
 (partition by run order by tau_c desc nulls last, mse, epoch) as k from history) where k = 1""")
def best_epoch(spark, sf):
    return rounded(registry.best_epoch(history(spark, sf)))


@query("early_stop", f"""with recursive {HISTORY}, s as (select run, epoch, tau_c as ref, 0 as stale, 1 as n, false as stop from history where epoch = 1
 union all select h.run, h.epoch, case when h.tau_c > s.ref and h.tau_c - s.ref >= 0.001e0 then h.tau_c else s.ref end,
  case when h.tau_c > s.ref and h.tau_c - s.ref >= 0.001e0 then 0 else s.stale + 1 end, s.n + 1,
  not (h.tau_c > s.ref and h.tau_c - s.ref >= 0.001e0) and s.stale + 1 >= 15
  from s join history h on h.run = s.run and h.epoch = s.epoch + 1 where not s.stop)
 select run, cast(max(n) as bigint) as epochs_run, bool_or(stop) as stopped, {r('max(ref)')} as reference_tau from s group by run""")
def early_stop(spark, sf):
    return rounded(registry.early_stop(history(spark, sf), 15, 0.001))


# --- models -----------------------------------------------------------------------------------------

@query("hstack_features", """select l.doc_id as id, quality as grade, n_chars, source, toxic, length(text) as n_text from labels l join documents d on d.doc_id = l.doc_id""")
def hstack_features(spark, sf):
    labels = table(spark, sf, "labels")
    truth = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("grade"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "source", F.length("text").cast("long").alias("n_text"))
    main = truth.join(docs, "id")
    extra = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("grade"), "toxic")
    return models.assemble_features(truth, [main, extra])


@query("missing_features", """select d.doc_id as id, case when l.doc_id is null then 'missing' else 'label_differs' end as problem
 from documents d left join labels l on l.doc_id = d.doc_id where l.doc_id is null or l.quality <> cast(n_chars > 1000 as integer)""")
def missing_features(spark, sf):
    truth = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") > 1000).cast("int").alias("grade"))
    return models.missing_features(truth, table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("grade")))


@query("ridge_1d", f"""with s as (select count(*) as n, avg(p_retailprice) as mx, avg(p_size % 11) as my, stddev_pop(p_retailprice) as sx,
 covar_pop(p_retailprice, p_size % 11) as c from part), g as (select *, unnest([0.1e0, 1, 10, 100, 1000]) as alpha from s)
 select alpha, {r('n * (c / sx) / (n + alpha) / sx', 9)} as slope, {r('my - n * (c / sx) / (n + alpha) / sx * mx', 9)} as intercept from g""")
def ridge_1d(spark, sf):
    part = table(spark, sf, "part").select("p_retailprice", (F.col("p_size") % 11).alias("grade"))
    return rounded(models.ridge_closed_form(part, "p_retailprice", "grade", [0.1, 1, 10, 100, 1000]), 9)


FEATURES = ["p_retailprice", "p_size", "quantity", "discount"]


def _model_table(spark, sf):
    sold = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    items = split_items(spark, sf).select("id", "grade", "part")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return items.join(part, "id").join(sold, "id", "left").na.fill(0.0)


MODEL_TABLE = f"""{SPLIT}, sold as (select l_partkey as id, avg(l_quantity) as quantity, avg(l_discount) as discount from lineitem group by 1),
 items as (select s.id, grade, part, array_value(p_retailprice::double, p_size::double, coalesce(quantity, 0)::double, coalesce(discount, 0)::double) as x
  from split s join part p on p.p_partkey = s.id left join sold on sold.id = s.id)"""


def _solved(n: int) -> str:
    """Gaussian elimination of the symmetric system a0(alpha, i, row), one step per unknown; the right side is row[n + 1]."""
    steps = [f"""a{k} as (select a.alpha, a.i, case when a.i = {k} then list_transform(p.row, lambda v: v / p.row[{k}])
  else list_transform(range(1, {n + 2}), lambda j: a.row[j] - a.row[{k}] * p.row[j] / p.row[{k}]) end as row
  from a{k - 1} a join a{k - 1} p on p.alpha = a.alpha and p.i = {k})""" for k in range(1, n + 1)]
    return ", ".join(steps)


RIDGE_SQL = f"""with {MODEL_TABLE}, tr as (select * from items where part = 'train'),
 cols as (select id, grade::double as y, unnest(range(1, 5)) as i, unnest(x::double[]) as v from tr),
 st as (select i, avg(v) as m, case when stddev_pop(v) > 0 then stddev_pop(v) else 1 end as sd from cols group by i),
 my as (select avg(grade) as my from tr),
 z as (select id, i, (v - m) / sd as z, y - my as y from cols join st using (i), my),
 gram as (select a.i, b.i as j, sum(a.z * b.z) as g from z a join z b using (id) group by 1, 2),
 rhs as (select i, sum(z * y) as g from z group by i),
 a0 as (select alpha, i, list_append(list(g + case when i = j then alpha else 0 end order by j), any_value(t)) as row
  from (select gram.*, rhs.g as t from gram join rhs using (i)), (select unnest([0.1e0, 1, 10, 100, 1000]) as alpha) group by alpha, i),
 {_solved(4)}, w as (select alpha, i, row[5] / sd as w, row[5] / sd * m as wm from a4 join st using (i)),
 c as (select alpha, any_value(my) - sum(wm) as c, list(w order by i) as w from w, my group by alpha),
 scored as (select alpha as model, grade as truth, c + list_sum(list_transform(range(1, 5), lambda j: w[j] * x[j])) as score
  from items, c where part = 'val'), {METRICS_SQL}
 select n, {r('tau')} as kendall_tau_c, {r('rho')} as spearman, {r('mae')} as mae, {r('mse')} as mse, {r('acc')} as acc_pm1,
  case when tau is null then 'Undefined for constant truth or predictions' end as correlation_note, model as param from metrics"""


@query("ridge_grid", RIDGE_SQL)
def ridge_grid(spark, sf):
    """Ridge over a penalty grid, all penalties from one pass, with the metrics of the validation part."""
    _, trials, _ = models.select_model(_model_table(spark, sf), FEATURES, [0.1, 1.0, 10.0, 100.0, 1000.0], models.fit_ridge)
    return rounded(trials)


@query("gbt_predictions")
def gbt_predictions(spark, sf):
    """Boosted trees of 300 rounds in five sizes, chosen by depth on the validation part; scores of that part."""
    fit = models.one_by_one(lambda cells, cols, depth: models.gbt_pipeline(cells, cols, int(depth)), models.feature_cells)
    _, _, predictions = models.select_model(_model_table(spark, sf), FEATURES, [3, 4, 5, 6, 7], fit)
    return rounded(predictions)


LEAF_ROUNDS = 20          # every round takes as many passes as its trees are deep; README.md has the time of one


@query("leaf_trees")
def leaf_trees(spark, sf):
    """Trees bounded by leaves, with an L2 term, in five sizes from the same passes; scores of the validation part."""
    _, _, predictions = models.select_model(_model_table(spark, sf), FEATURES, [7, 15, 31, 63, 127], models.boosted_trees(rounds=LEAF_ROUNDS))
    return rounded(predictions)


@query("feature_arrays", """select l.doc_id as id, quality as grade, n_chars::double as n_chars, length(text)::double as n_text, toxic::double as toxic
 from labels l join documents d on d.doc_id = l.doc_id""")
def feature_arrays(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("grade"), "toxic")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array(F.col("n_chars").cast("double"), F.length("text").cast("double")).alias("features"))
    truth = labels.select("id", "grade")
    sides = [(truth.join(docs, "id"), ["n_chars", "n_text"]), (labels.select("id", "grade", F.array(F.col("toxic").cast("double")).alias("features")), ["toxic"])]
    out, names = models.stack_features(truth, sides)
    return out.select("id", "grade", *[F.get("features", F.lit(k)).alias(n) for k, n in enumerate(names)])


@query("release_check", f"""with {SPLIT} select id::varchar as subject, case when part = 'val' then 'missing_prediction' else 'unknown_id' end as problem
  from split where part = 'val' and p_type = 'SMALL' or part = 'test' and p_type = 'LARGE'
 union all select * from (values ('seed', 'seed_differs'), ('n_val', 'n_val_differs'))""")
def release_check(spark, sf):
    """A saved model, loaded by another session, scores the wrong rows and claims another seed and size than its split."""
    data = settled(_model_table(spark, sf))
    folder = step_folder(spark)
    model = models.fit_ridge(data.filter("part = 'train'"), FEATURES, [1.0])[1.0]
    models.save_ridge(spark, model, f"{folder}/model")
    kinds = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_type")
    again = models.load_ridge(spark.newSession(), f"{folder}/model")
    rows = settled(models.score(again, data, FEATURES).join(kinds, "id").select("id", "part", "p_type", F.col("grade").alias("truth"), "score"))
    chosen = rows.filter("part = 'val' and p_type != 'SMALL' or part = 'test' and p_type = 'LARGE'")
    split = data.select("id", "part")
    digest = registry.ids_digest(split.select(F.concat_ws(":", "part", "id").alias("id"))).first()["digest"]
    sizes = {f"n_{r['part']}": r["count"] for r in split.groupBy("part").count().collect()}
    claims = {"split_sha256": digest, "seed": 41, **sizes, "n_val": sizes["n_val"] + 1}
    members = data.filter("part = 'val'").select("id", "grade")
    return metrics.verify_release(chosen.select("id", "truth", "score"), members, metrics.evaluate(chosen), claims, split, digest, 42)


@query("length_batches", """select doc_id as id, n_chars as length, pos // 640 as bucket, pos as slot, pos // 32 as batch
 from (select doc_id, n_chars, row_number() over (order by n_chars, doc_id) - 1 as pos from documents)""")
def length_batches(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("length"))
    return models.length_batches(docs, 32)


@query("shuffled_batches", """with p as (select doc_id as id, n_chars as length, row_number() over (order by n_chars, doc_id) - 1 as pos from documents),
 q as (select *, pos // 640 as bucket from p), i as (select *, row_number() over (partition by bucket order by sha256('42:' || id), id) - 1 as k from q),
 s as (select bucket, coalesce(sum(n) over (order by sha256('42:' || bucket), bucket rows between unbounded preceding and 1 preceding), 0) as start
  from (select bucket, count(*) as n from q group by bucket))
 select id, length, i.bucket, (start + k)::bigint as slot, ((start + k) // 32)::bigint as batch from i join s on s.bucket = i.bucket""")
def shuffled_batches(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("length"))
    return models.length_batches(docs, 32, shuffle=True)


@query("pad_batches", """with seq as (select conv_id as id, row_number() over (partition by conv_id order by turn) - 1 as frame, length(text) as a,
   cast(role = 'user' as integer) as b from conversations),
 lens as (select id, count(*) as length from seq group by id),
 bt as (select *, (row_number() over (order by length, id) - 1) // 16 as batch from lens),
 mx as (select *, max(length) over (partition by batch) as top from bt)
 select batch, s.id, frame, cast(a as bigint) as a, cast(b as bigint) as b, true as real from seq s join bt on bt.id = s.id
 union all select batch, id, unnest(range(length, top)), 0, 0, false from mx where length < top""")
def pad_batches(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", F.array(
        F.length("text").cast("long"), (F.col("role") == "user").cast("long")).alias("values"))
    seq = positions(turns, ["id"], ["turn"], "frame").select("id", "frame", "values")
    lengths = seq.groupBy("id").agg(F.count(F.lit(1)).alias("length"))
    out = models.pad_batches(seq, models.length_batches(lengths, 16))
    return out.select("batch", "id", "frame", F.get("values", F.lit(0)).alias("a"), F.get("values", F.lit(1)).alias("b"), "real")
