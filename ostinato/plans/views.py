"""Views of the driver's tables in the shape the operators expect, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.operators.ordering import positions, previous
from ostinato.operators.skew import attach, row_count
from ostinato.operators.splits import assign_split
from ostinato.session import forget, settled

MODELS = {"hgb_cqt": 7919, "hgb_cqt_rhythm": 6101, "hgb_cqt_structure": 9973, "hgb_cqt_rhythm_structure": 3571}
HOUR = 3600


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[
        (F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def r(expression: str, digits: int = 6) -> str:
    """SQL twin of `rounded`."""
    return f"(round(cast({expression} as double), {digits}) + 0.0)"


def frames(spark: SparkSession, sf: str, stored: bool = True) -> DataFrame:
    """Vectors of one label in their order; stored once where a query reads them more than once."""
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("id"), "vec_id", F.col("embedding").alias("values"))
    numbered = positions(rows, ["id"], ["vec_id"], "frame").drop("vec_id")
    return settled(numbered) if stored else numbered


FRAMES = """frames as (select label as id, row_number() over (partition by label order by vec_id) - 1 as frame,
  cast(embedding as double[]) as v from embeddings),
 lens as (select id, count(*) as n from frames group by id),
 cells as (select id, frame, unnest(v) as x, generate_subscripts(v, 1) - 1 as channel from frames)"""


def windows_sql(win: int, hop: int, lens: str = "lens", name: str = "wins") -> str:
    return (f"{name} as (select id, n, unnest(list_distinct(list_concat(range(0, greatest(n - {win}, 0) + 1, {hop}),"
            f" [greatest(n - {win}, 0)]))) as start from {lens})")


def onsets(spark: SparkSession, sf: str, stored: bool = True) -> DataFrame:
    """Events per user; t counts seconds from the user's first event. Stored as `frames` are."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    first = events.groupBy("id").agg(F.min("us").alias("us0"), row_count())
    timed = attach(events, first, ["id"]).select("id", "event_id", ((F.col("us") - F.col("us0")) / 1e6).alias("t"), "value")
    return settled(timed) if stored else timed


ONSETS = """onsets as (select user_id as id, event_id, value,
  (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6 as t from events)"""


def durations(on: DataFrame) -> DataFrame:
    return on.groupBy("id").agg(F.max("t").alias("duration"))


def envelope(on: DataFrame) -> DataFrame:
    """Sum of the values per hour since the first event, hours without events as 0.

    An hour with events brings the empty ones ahead of it, so only hours with events are shuffled.
    """
    hour = F.floor(F.col("t") / HOUR)
    sums = settled(on.filter(hour.isNotNull()).groupBy("id", hour.alias("hour")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("s")))
    since = F.coalesce(F.col("before") + 1, F.lit(0).cast("long"))
    filled = previous(sums, ["id"], ["hour"], {"before": "hour"}).select("id", "hour", "s", F.explode(F.sequence(since, "hour")).alias("frame"))
    out = settled(filled.select("id", "frame", F.when(F.col("frame") == F.col("hour"), F.col("s")).otherwise(0.0).alias("strength")))
    forget(sums)
    return out


ENVELOPE = ONSETS + f""",
 hours as (select id, cast(floor(t / {HOUR}) as bigint) as frame, sum(value) as s from onsets group by 1, 2),
 envelope as (select g.id, g.frame, coalesce(s, 0) as strength from
  (select id, unnest(range(0, last + 1)) as frame from (select id, max(frame) as last from hours group by id)) g
  left join hours h on h.id = g.id and h.frame = g.frame),
 elens as (select id, count(*) as n from envelope group by id)"""


def graded(spark: SparkSession, sf: str, models: dict | None = None) -> DataFrame:
    """Truth and one score per model for each part."""
    models = MODELS if models is None else models
    key, truth = F.col("p_partkey"), F.col("p_size") % 11
    scores = F.array(*[F.struct(F.lit(m).alias("model"), (truth + ((key * k) % 601 - 300) / 100.0).alias("score"))
                       for m, k in models.items()])
    return table(spark, sf, "part").select(key.alias("id"), F.col("p_brand").alias("group"), truth.alias("truth"),
                                           F.explode(scores).alias("m")).select("id", "group", "truth", "m.model", "m.score")


GRADED = "graded as (" + " union all ".join(
    f"select p_partkey as id, p_brand as grp, p_size % 11 as truth, '{m}' as model,"
    f" (p_size % 11) + ((p_partkey * {k}) % 601 - 300) / 1e2 as score from part" for m, k in MODELS.items()) + ")"

# SQL twin of the metrics, over a relation `scored` with the columns model, truth, score
METRICS_SQL = """cellsm as (select model, truth, score, count(*) as c from scored group by all),
 pairsm as (select a.model, sum(a.c * b.c * sign(a.truth - b.truth) * sign(a.score - b.score)) / 2 as pq
   from cellsm a join cellsm b on a.model = b.model group by a.model),
 sizem as (select model, count(*) as n, least(count(distinct truth), count(distinct score)) as m,
   avg(abs(score - truth)) as mae, avg((score - truth) * (score - truth)) as mse,
   avg(case when abs(floor(least(greatest(score, 0), 10) + 0.5) - truth) <= 1 then 1.0 else 0.0 end) as acc from scored group by model),
 ranksm as (select model,
   rank() over (partition by model order by truth) + (count(*) over (partition by model, truth) - 1) / 2.0 as ry,
   rank() over (partition by model order by score) + (count(*) over (partition by model, score) - 1) / 2.0 as rs from scored),
 rhom as (select model, corr(ry, rs) as rho from ranksm group by model),
 metrics as (select s.model, s.n, case when m > 1 then 2 * pq / (cast(n as double) * n * (m - 1) / m) end as tau,
   case when m > 1 then rho end as rho, mae, mse, acc
   from sizem s join pairsm p on s.model = p.model join rhom h on s.model = h.model)"""


def split_items(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with brand as the group, label and assigned part; a split is made once and then read."""
    items = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("group"), (F.col("p_size") % 11).alias("grade"), "p_type", "p_name")
    return settled(assign_split(items))


SPLIT = """brands as (select p_brand as grp, row_number() over (order by sha256('42:' || p_brand)) - 1 as pos, count(*) over () as g
   from (select distinct p_brand from part)),
 gparts as (select grp, case when pos < ceil(g / 5.0) then 'test' when pos < ceil(g / 5.0) + ceil((g - ceil(g / 5.0)) / 4.0) then 'val'
   else 'train' end as part from brands),
 split as (select p_partkey as id, p_brand as grp, p_size % 11 as grade, p_type, p_name, part from part p join gparts q on p.p_brand = q.grp)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run"), "ts", "event_id", "value")
    numbered = positions(rows, ["run"], ["ts", "event_id"], "_at")
    return numbered.select("run", (F.col("_at") + 1).alias("epoch"), (F.col("value") / 500).alias("tau_c"),
                           F.abs(F.col("value") - 250).alias("mse"))


HISTORY = """history as (select user_id as run, row_number() over (partition by user_id order by ts, event_id) as epoch,
   value / 500 as tau_c, abs(value - 250) as mse from events)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("experiment_id"), F.col("o_orderstatus").alias("status"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("split_sha256"), F.year("o_orderdate").alias("n_validation"),
        (F.col("o_totalprice") / 500000).alias("kendall_tau_c"), (F.col("o_orderstatus") == "F").alias("test_evaluated"))


RUNS = """runs as (select o_orderkey as run, o_custkey as experiment_id, o_orderstatus as status,
   nullif(o_orderpriority, '5-LOW') as split_sha256, cast(year(o_orderdate) as integer) as n_validation,
   o_totalprice / 500000 as kendall_tau_c, o_orderstatus = 'F' as test_evaluated from orders)"""
