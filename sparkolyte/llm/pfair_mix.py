"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions.

Each source is dealt into blocks of about BLOCK_DOCS documents by a hash of doc_id. A weight becomes u whole units
of a period of T slots, T the sum of all u. T is about UNITS where that grain holds every share within TOLERANCE of
its target; otherwise it grows with the least weight until it does. Block j of a source with weight w = u / T is
released at floor(j / w) and due at ceil((j + 1) / w); in each slot the released block with the earliest deadline goes
next. The weights sum to 1, so every block meets its deadline and every prefix of the schedule holds each source's
share to less than one block. The schedule repeats after T slots, so it is worked out for a period, or only up to the
last deadline of a first pass where that comes sooner. Sources of equal units take turns, so a slot costs a look at
each distinct number of units, not at each source.

Targets default to the sources' document counts to the power ALPHA. The mix ends where every source has had a whole
pass; a source that ends before begins a new epoch, so no document is left out and the shares hold throughout. Null
is a source of its own. Documents with a null doc_id share a block; rows that repeat are scheduled each for itself.
Weights that are null or not positive are left out together with their sources. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

BLOCK_DOCS = 32
ALPHA = 0.9
#: Slots of a period, about: the grain of the weights, at least.
UNITS = 1000
#: Largest relative error of a share; a coarser grain than that is made finer.
TOLERANCE = 0.01
#: Slots gathered in one array before it is put aside, so that appending does not copy the whole schedule.
STRETCH = 256


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs, without the rounding of a double."""
    return F.call_function("div", a, b)


def _due(j: Column, units: Column, total: Column) -> Column:
    return _div((j + 1) * total + units - 1, units)


def _period(units: Column, total: Column, length: Column) -> Column:
    """The sources' places in each of the first slots, earliest deadline first, then least place.

    Sources of the same units have the same releases and deadlines, so they take turns by place and a group needs
    only its next block.
    """

    def next_(u: Column, members: Column, c: Column) -> Column:
        j = _div(c, F.size(members).cast("long"))
        return F.struct(
            _due(j, u, total).alias("due"),
            F.get(members, F.pmod(c, F.size(members)).cast("int")).alias("i"),
            _div(j * total, u).alias("release"),
            u.alias("u"),
            members.alias("members"),
            c.alias("c"),
        )

    def slot(state: Column, t: Column) -> Column:
        ready = F.filter(state["groups"], lambda g: g["release"] <= t)
        # A one-element array binds the choice, so that it is made once.
        return F.get(
            F.transform(
                F.array(F.array_min(F.transform(ready, lambda g: F.struct(g["due"], g["i"])))["i"]),
                lambda p: F.struct(
                    F.transform(state["groups"], lambda g: F.when(g["i"] == p, next_(g["u"], g["members"], g["c"] + 1)).otherwise(g)).alias("groups"),
                    F.concat(state["order"], F.array(p)).alias("order"),
                ),
            ),
            F.lit(0),
        )

    def stretch(state: Column, k: Column) -> Column:
        slots = F.sequence(k * STRETCH, F.least((k + 1) * STRETCH, length) - 1)
        start = F.struct(state["groups"].alias("groups"), F.array().cast("array<int>").alias("order"))
        return F.get(
            F.transform(
                F.array(F.aggregate(slots, start, slot)),
                lambda x: F.struct(x["groups"].alias("groups"), F.concat(state["order"], F.array(x["order"])).alias("order")),
            ),
            F.lit(0),
        )

    groups = F.transform(units, lambda g: next_(g["u"], g["members"], F.lit(0).cast("long")))
    start = F.struct(groups.alias("groups"), F.array().cast("array<array<int>>").alias("order"))
    return F.flatten(F.aggregate(F.sequence(F.lit(0).cast("long"), _div(length - 1, F.lit(STRETCH))), start, stretch)["order"])


def sources(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, block_docs: int = BLOCK_DOCS, units: int = UNITS) -> DataFrame:
    """source, docs, blocks, units, total, slots (its slots in a period, in order): a row per source."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow("docs", F.lit(alpha)))
    else:
        given = weights.select(F.col("source").alias("_source"), "weight").where("weight > 0")
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    weighed = weighed.withColumn("weight", F.col("weight").cast("double")).withColumn(
        "blocks", F.ceil(F.col("docs") / block_docs).cast("long")
    )
    # One row holding all sources: their number bounds it, not that of documents.
    one = weighed.agg(
        F.array_sort(F.collect_list(F.struct("source", "docs", "weight", "blocks"))).alias("list"),
        F.sum("weight").alias("sum"),
        F.min("weight").alias("least"),
    ).where("sum > 0")
    whole = lambda grain: F.transform(
        "list", lambda s: F.greatest(F.lit(1), F.floor(s["weight"] / F.col("sum") * grain + 0.5)).cast("long")
    )
    added = lambda u: F.aggregate(u, F.lit(0).cast("long"), lambda a, x: a + x)
    one = one.withColumn("coarse", whole(F.lit(units))).withColumn("of", added("coarse"))
    share = lambda u: u / F.col("of") * F.col("sum")
    missed = F.exists(F.arrays_zip("list", "coarse"), lambda z: F.abs(share(z["coarse"]) / z["list"]["weight"] - 1) > TOLERANCE)
    # At this grain neither a source's units nor their sum is off by more than half the tolerance.
    fine = F.ceil((1 / TOLERANCE + 1) * F.col("sum") / F.col("least"))
    one = one.withColumn("u", F.when(missed, whole(F.greatest(F.lit(units), fine))).otherwise(F.col("coarse")))
    one = one.withColumn("total", added("u"))
    rows = one.select("total", "u", F.posexplode("list").alias("i", "s")).select(
        "i", "s.source", "s.docs", "s.blocks", F.get("u", F.col("i")).alias("units"), "total"
    )
    rows = shared.materialize(rows, "units")
    alike = rows.groupBy("units", "total").agg(
        F.array_sort(F.collect_list("i")).alias("members"), F.max(_due(F.col("blocks") - 1, F.col("units"), F.col("total"))).alias("last")
    )
    one = alike.agg(
        F.array_sort(F.collect_list(F.struct(F.col("units").alias("u"), "members"))).alias("groups"),
        F.max("total").alias("total"),
        F.least(F.max("total"), F.max("last")).alias("length"),
    ).where("total > 0")
    order = one.select(F.posexplode(_period(F.col("groups"), F.col("total"), F.col("length"))).alias("t", "i"))
    slots = order.groupBy("i").agg(F.array_sort(F.collect_list("t")).alias("slots"))
    return rows.join(slots, "i").select("source", "docs", "blocks", "units", "total", "slots")


def _scheduled(docs: DataFrame, weights: DataFrame | None, alpha: float, block_docs: int, units: int) -> DataFrame:
    """_row (all columns of docs), _doc, and the schedule's columns."""
    shared.prepare(docs.sparkSession)
    plan = shared.materialize(sources(docs.select("source"), weights, alpha, block_docs, units), "sources")
    plan = plan.withColumnRenamed("source", "_planned")
    last = F.col("blocks") - 1
    at = _div(last, F.col("units")) * F.col("total") + F.get("slots", F.pmod(last, F.col("units")).cast("int"))
    end = plan.agg(F.max(at + 1).alias("_end"))
    # One row joined to a row per source.
    turns = plan.join(F.broadcast(end)).select("_planned", "blocks", "units", "total", "_end", F.posexplode("slots").alias("j", "t"))
    turns = turns.withColumn("period", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("_end"), F.col("total")))))
    turns = turns.withColumn("slot", F.col("t") + F.col("period") * F.col("total")).where("slot < _end")
    turns = turns.withColumn("number", F.col("j") + F.col("period") * F.col("units"))
    turns = turns.select(
        F.col("_planned").alias("_turn"),
        F.pmod("number", "blocks").alias("_block"),
        _div(F.col("number"), F.col("blocks")).alias("epoch"),
        "number",
        "slot",
        _div(F.col("number") * F.col("total"), F.col("units")).alias("release"),
        _due(F.col("number"), F.col("units"), F.col("total")).alias("deadline"),
    )
    # A row per block of the mix, written so that Spark knows its size.
    turns = shared.materialize(turns, "turns")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("source").alias("_source"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"),
    )
    # Spark broadcasts the sources and the blocks only while they are few.
    found = rows.join(plan.select("_planned", "blocks"), F.col("_source").eqNullSafe(F.col("_planned")))
    found = found.withColumn("block", F.pmod(F.conv(F.substring(F.md5("_doc"), 1, 8), 16, 10).cast("long"), F.col("blocks")))
    return found.join(turns, F.col("_source").eqNullSafe(F.col("_turn")) & (F.col("block") == F.col("_block")))


def mix(
    docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, block_docs: int = BLOCK_DOCS, units: int = UNITS
) -> DataFrame:
    """docs with block, epoch, number (of the block in its source's sequence), slot, release and deadline.

    Columns of those names in docs give way. weights: source, weight.
    """
    own = ("block", "epoch", "number", "slot", "release", "deadline")
    found = _scheduled(docs, weights, alpha, block_docs, units)
    return found.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in own], *own)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix's rows in the schedule's order, with the columns of docs."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _scheduled(docs, None, ALPHA, BLOCK_DOCS, UNITS)
    return found.repartitionByRange(parts, "slot", "_doc").sortWithinPartitions("slot", "_doc").select("_row.*")


SQL = f"""
with recursive counts as (
  select source, count(*) as docs from documents group by source
), ranked as (
  select *, row_number() over (order by source nulls first) as i,
    cast(greatest(1, floor(docs ** {ALPHA} / (select sum(docs ** {ALPHA}) from counts) * {UNITS} + 0.5)) as bigint) as u,
    cast(ceil(docs / {BLOCK_DOCS}) as bigint) as blocks
  from counts
), period as (
  select cast(sum(u) as bigint) as total, list(u order by i) as us from ranked
), edf(t, done, pick) as (
  select cast(-1 as bigint), list_transform(us, lambda u: cast(0 as bigint)), cast(0 as bigint) from period
  union all
  select t + 1, list_transform(done, lambda c, i: case when i = p.i then c + 1 else c end), p.i from (
    select t, done, list_min(list_filter(
      list_transform(us, lambda u, i: struct_pack(due := (done[i] * total + total + u - 1) // u, i := cast(i as bigint), release := done[i] * total // u)),
      lambda x: x.release <= t + 1)) as p
    from edf, period where t + 1 < total)
), slots as (
  select pick as i, list(t order by t) as slots from edf where t >= 0 group by pick
), plan as (
  select ranked.*, total, slots, (max(((blocks - 1) // u) * total + slots[(blocks - 1) % u + 1] + 1) over ()) as ended
  from ranked join slots using (i), period
), dealt as (
  select d.doc_id, d.source, cast('0x' || substr(md5(coalesce(cast(d.doc_id as varchar), '')), 1, 8) as bigint) % blocks as block, plan.blocks, u, total, slots, ended
  from documents d join plan on d.source is not distinct from plan.source
), passes as (
  select *, unnest(range(cast(0 as bigint), ((ended // total + 1) * u) // blocks + 1)) as epoch from dealt
), numbered as (
  select *, block + epoch * blocks as number from passes
), placed as (
  select *, (number // u) * total + slots[number % u + 1] as slot from numbered
)
select doc_id, source, block, epoch, number, slot, number * total // u as release, ((number + 1) * total + u - 1) // u as deadline
from placed where slot < ended
"""
