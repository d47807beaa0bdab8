"""Views of the supplied tables in the roles that the operators expect, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import in_order, ordered_mean

DOSES = {"click": 100.0, "error": 250.0, "purchase": 500.0, "signup": 1000.0, "view": 5000.0}
POINTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device, channel, date, timepoint, concentration, value, event_id: weeks since the device's first day."""
    dose = F.create_map(*[F.lit(x) for kv in DOSES.items() for x in kv])
    e = table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 10).alias("device"),
        F.col("user_id").alias("channel"),
        F.to_date("ts").alias("date"),
        F.get(F.array(F.element_at(dose, F.col("event_type"))), F.lit(0)).alias("concentration"),
        "event_type",
        "value",
        "props",
    )
    first = e.groupBy("device").agg(F.min("date").alias("d0"))
    days = F.datediff("date", "d0")
    return e.join(first, "device").withColumn("timepoint", (F.floor(days / 7) * 7).cast("long"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device, channel, timepoint, concentration, response, n_rep: means of the values in the order of the events."""
    keys = ["device", "channel", "timepoint", "concentration"]
    e = in_order(events(spark, sf_dir).select(*keys, "event_id", "value"), keys, "value", "event_id")
    return e.groupBy(*keys).agg(ordered_mean("value", "event_id").alias("response"), F.count("value").alias("n_rep"))


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("device", "channel", "timepoint", "concentration").orderBy("event_id")
    return events(spark, sf_dir).select(
        "device", "channel", "timepoint", "concentration", "event_id", "value", (F.row_number().over(w) - 1).cast("long").alias("rep")
    )


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, freq, z_real, z_imag arrays."""
    e = table(spark, sf_dir, "embeddings")
    index = F.sequence(F.lit(0), F.lit(POINTS - 1))
    e = e.withColumn("freq", F.transform(index, lambda i: F.pow(F.lit(10.0), i * 6 / F.lit(63.0))))
    size = lambda f, x: 1000.0 * F.pow(f, F.lit(-0.3)) * (1 + 0.4 * x.cast("double"))
    real = F.zip_with("freq", "embedding", lambda f, x: F.when(F.col("vec_id") % 10 == 3, -size(f, x)).otherwise(size(f, x)))
    flip = lambda i: (F.col("vec_id") % 4 == 0) & (i >= 50)
    imag = F.transform(
        F.arrays_zip(F.col("freq").alias("f"), F.col("embedding").alias("x")),
        lambda p, i: F.when(flip(i), size(p["f"], p["x"])).otherwise(-size(p["f"], p["x"])),
    )
    return e.select("vec_id", F.col("label").cast("long").alias("label"), "freq", real.alias("z_real"), imag.alias("z_imag"))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, voltage, current, background: a triangle sweep; the background is the label's lowest id."""
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("current")
    )
    # One partner per label: as many rows as labels.
    partner = e.groupBy("label").agg(F.min_by("current", "vec_id").alias("partner"))
    rise = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: -0.4 + i * F.lit(1.7) / 31)
    fall = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: 1.3 - i * F.lit(1.7) / 31)
    return e.join(partner, "label").select(
        "vec_id",
        "label",
        F.concat(rise, fall).alias("voltage"),
        "current",
        F.transform("partner", lambda x: F.abs(x) + 0.1).alias("background"),
    )


#: The values of an embedding.
FEATURES = [f"f{i:02d}" for i in range(64)]


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor, timepoint, y and f00.. columns, one per value of an embedding; some values are missing."""
    e = table(spark, sf_dir, "embeddings")
    cols = [F.get("embedding", F.lit(i)).cast("double") for i in range(len(FEATURES))]
    hole = lambda i: (F.col("vec_id") + i) % 17 == 0
    return e.select(
        "vec_id",
        F.col("label").cast("long").alias("sensor"),
        (F.col("vec_id") % 6).alias("timepoint"),
        (2 * cols[0] - cols[1] + 0.5 * cols[2] + 1).alias("y"),
        *[F.when(hole(i) & F.lit(i % 2 == 1), None).otherwise(c).alias(f"f{i:02d}") for i, c in enumerate(cols)],
    )


EVENTS_SQL = """
e0 as (
  select event_id, user_id % 10 as device, user_id as channel, cast(ts as date) as date, event_type, value, props,
    case event_type when 'click' then 100.0::double when 'error' then 250.0::double when 'purchase' then 500.0::double
      when 'signup' then 1000.0::double when 'view' then 5000.0::double end as concentration
  from events),
ev as (
  select e0.*, d0, cast(date_diff('day', d0, date) // 7 * 7 as bigint) as timepoint
  from e0 join (select device, min(date) as d0 from e0 group by device) using (device))"""
OBS_SQL = (
    EVENTS_SQL
    + """,
obs as (
  select device, channel, timepoint, concentration, avg(value) as response, count(value) as n_rep
  from ev group by device, channel, timepoint, concentration)"""
)
REPS_SQL = (
    EVENTS_SQL
    + """,
reps as (
  select device, channel, timepoint, concentration, event_id, value,
    row_number() over (partition by device, channel, timepoint, concentration order by event_id) - 1 as rep from ev)"""
)
SPECTRA_SQL = """
p0 as (
  select vec_id, cast(label as bigint) as label, unnest(embedding)::double as x, unnest(range(64)) as i from embeddings),
p1 as (select *, 10.0::double ** (i * 6 / 63.0::double) as f from p0),
pts as (
  select vec_id, label, i, f,
    case when vec_id % 10 = 3 then -1 else 1 end * (1000.0::double * f ** (-0.3::double) * (1 + 0.4::double * x)) as zr,
    case when vec_id % 4 = 0 and i >= 50 then 1 else -1 end * (1000.0::double * f ** (-0.3::double) * (1 + 0.4::double * x)) as zi
  from p1)"""
CYCLES_SQL = """
c0 as (
  select vec_id, cast(label as bigint) as label, unnest(embedding)::double as cur, unnest(range(64)) as i from embeddings),
partner as (select label, min(vec_id) as pid from c0 group by label),
cyc as (
  select a.vec_id, a.label, a.i, case when a.i < 32 then -0.4::double + a.i * 1.7::double / 31 else 1.3::double - (a.i - 32) * 1.7::double / 31 end as v,
    a.cur, abs(b.cur) + 0.1::double as bg
  from c0 a join partner p on a.label = p.label join c0 b on b.vec_id = p.pid and b.i = a.i)"""
MATRIX_SQL = (
    "mat as (select vec_id, cast(label as bigint) as sensor, vec_id % 6 as timepoint, "
    "2 * embedding[1]::double - embedding[2]::double + 0.5::double * embedding[3]::double + 1 as y, "
    + ", ".join(
        (f"case when (vec_id + {i}) % 17 = 0 then null else embedding[{i + 1}]::double end" if i % 2 else f"embedding[{i + 1}]::double")
        + f" as {f}"
        for i, f in enumerate(FEATURES)
    )
    + " from embeddings)"
)
MATRIX_LONG_SQL = MATRIX_SQL + f", long as (select * from mat unpivot include nulls (value for feature in ({', '.join(FEATURES)})))"


def long_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, sensor, timepoint, y, feature, value."""
    m = matrix(spark, sf_dir)
    return m.unpivot(["vec_id", "sensor", "timepoint", "y"], FEATURES, "feature", "value")


