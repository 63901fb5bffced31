"""Road networks: elevations agreed at junctions, their spread along roads, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geomill.operators.series import blend


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Aggregate: weighted mean of the rows that have a value and a weight, the plain mean of the values where all weights are 0."""
    v, w = (F.col(c) if isinstance(c, str) else c for c in (value, weight))
    return F.coalesce(F.sum(v * w) / F.nullif(F.sum(F.when(v.isNotNull(), w)), F.lit(0)), F.avg(v))


def junction_levels(members: DataFrame, junction: str, value: str, priority: str, distance: str) -> DataFrame:
    """(junction, level): mean weighted by priority over distance plus 0.1."""
    return members.groupBy(junction).agg(weighted_mean(value, F.col(priority) / (F.col(distance) + 0.1)).alias("level"))


def crossing_levels(members: DataFrame, junction: str, value: str, priority: str) -> DataFrame:
    """(junction, level): mean weighted by the square of the priority."""
    return members.groupBy(junction).agg(weighted_mean(value, F.col(priority) * F.col(priority)).alias("level"))


def equal_priority_levels(members: DataFrame, junction: str, road: str, value: str, length: str, angle: str, aligned: float = 140.0) -> DataFrame:
    """(junction, level) of junctions of equal roads.

    Two roads: their mean if the shorter is over 0.8 of the longer, else the
    longer's.  More: the mean of the two whose directions (degrees) are furthest
    apart, if by ``aligned`` or more, else the mean by length.
    """
    base = members.select(junction, road, value, length, angle)
    w = W.partitionBy(junction)
    ranked = base.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(length), road)))
    pick = lambda rank, column: F.max(F.when(F.col("_r") == rank, F.col(column)))
    simple = ranked.groupBy(junction).agg(F.max("_n").alias("n"), pick(1, value).alias("v1"), pick(2, value).alias("v2"), pick(1, length).alias("l1"), pick(2, length).alias("l2"), weighted_mean(value, length).alias("by_length"))
    best = _furthest_pair(base, junction, road, value, angle, aligned)
    two = F.when(F.col("l2") > 0.8 * F.col("l1"), (F.col("v1") + F.col("v2")) / 2).otherwise(F.col("v1"))
    level = F.when(F.col("n") == 1, F.col("v1")).when(F.col("n") == 2, two).otherwise(F.coalesce("pair", "by_length"))
    return simple.join(best, junction, "left").select(junction, level.alias("level"))


def _furthest_pair(roads: DataFrame, junction: str, road: str, value: str, angle: str, aligned: float) -> DataFrame:
    """(junction, pair): the mean value of the two roads whose directions are furthest apart, the first of equal ones.

    Directions lie in a circle, so the road furthest from one is a neighbour,
    in their order, of the direction opposite to it: no road meets all others.
    """
    turn = F.pmod(F.col(angle).cast("double"), F.lit(360.0))
    own = roads.filter(F.col(angle).isNotNull()).groupBy(junction, turn.alias("_at")).agg(F.min(F.struct(F.col(road).alias("r"), F.col(angle).alias("g"), F.col(value).alias("v"))).alias("_o"))
    asked = own.select(junction, F.pmod(F.col("_at") + 180, F.lit(360.0)).alias("_at"), F.lit(None).cast(own.schema["_o"].dataType).alias("_o"), F.col("_o").alias("_q"))
    both = own.withColumn("_q", F.lit(None).cast(own.schema["_o"].dataType)).select(junction, "_at", "_o", "_q").union(asked)
    before = W.partitionBy(junction).orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(junction).orderBy("_at").rangeBetween(0, W.unboundedFollowing)
    near = [F.last("_o", ignorenulls=True).over(before), F.first("_o", ignorenulls=True).over(after)]
    w = W.partitionBy(junction)
    ends = [F.max(F.when(F.col("_o").isNotNull(), F.struct("_at", "_o"))).over(w)["_o"], F.min(F.when(F.col("_o").isNotNull(), F.struct("_at", "_o"))).over(w)["_o"]]
    both = both.withColumn("_lo", F.coalesce(near[0], ends[0])).withColumn("_hi", F.coalesce(near[1], ends[1]))
    met = both.withColumn("_p", F.explode(F.array("_lo", "_hi"))).filter(F.col("_q").isNotNull() & (F.col("_q.r") != F.col("_p.r")))
    first, second = F.least("_q", "_p"), F.greatest("_q", "_p")
    raw = F.abs(first["g"] - second["g"]) % 360
    apart = F.when(raw > 180, 360 - raw).otherwise(raw)
    pairs = met.select(junction, apart.alias("apart"), first.alias("a"), second.alias("b")).filter(F.col("apart") >= aligned)
    return pairs.groupBy(junction).agg(F.max_by((F.col("a.v") + F.col("b.v")) / 2, F.struct("apart", -F.col("a.r"), -F.col("b.r"))).alias("pair"))


def t_junction_levels(members: DataFrame, junction: str, road: str, value: str, priority: str, through: str, close: float = 0.5) -> DataFrame:
    """(junction, level): the through road of highest priority; where the ending roads' mean by priority is within ``close``, the mean of all."""
    top = F.max_by(F.when(F.col(through), F.col(value)), F.when(F.col(through) & F.col(value).isNotNull(), F.struct(priority, -F.col(road))))
    ending = F.sum(F.when(~F.col(through), F.col(value) * F.col(priority))) / F.nullif(F.sum(F.when(~F.col(through) & F.col(value).isNotNull(), F.col(priority))), F.lit(0))
    both = members.groupBy(junction).agg(top.alias("top"), ending.alias("ending"), weighted_mean(value, priority).alias("all"))
    near = F.col("ending").isNotNull() & (F.abs(F.col("top") - F.col("ending")) < close)
    return both.select(junction, F.when(F.col("top").isNull() | near, F.col("all")).otherwise(F.col("top")).alias("level"))


def junction_kinds(members: DataFrame, junction: str, road: str, through: str) -> DataFrame:
    """(junction, roads, kind): Endpoint, T, Y, X or Complex by the roads that meet."""
    n = F.col("roads")
    kinds = members.groupBy(junction).agg(F.count_distinct(road).alias("roads"), F.max(through).alias("_t"))
    return kinds.select(junction, "roads", F.when(n == 1, "Endpoint").when(F.col("_t"), "T").when(n == 2, "Y").when(n <= 4, "X").otherwise("Complex").alias("kind"))


def influences_along(rows: DataFrame, key: list[str], along: str, crossings: DataFrame, at: str, level: str) -> DataFrame:
    """(key, along, level, distance): each row of a road with each crossing of that road, both ways along it; ``crossings`` has key, ``at`` and ``level``."""
    both = rows.select(*key, along).join(crossings.select(*key, at, level), key)
    return both.select(*key, along, level, F.abs(F.col(along) - F.col(at)).alias("distance"))


def plateaus(rows: DataFrame, junction: str, value: str, priority: str, distance: str, radius: str, reach: float) -> DataFrame:
    """``rows`` with ``flat``: within the radius the junction's level, the mean by priority of the rows nearest to ``reach``, one a road (``road``)."""
    w = W.partitionBy(junction, "road").orderBy(F.abs(F.col(distance) - reach), F.col(distance))
    sampled = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    levels = sampled.groupBy(junction).agg(weighted_mean(value, priority).alias("_level"))
    t = blend(F.col(distance) / F.col(radius), "cosine")
    return rows.join(levels, junction).withColumn("flat", F.when(F.col(distance) < F.col(radius), F.col("_level") * (1 - t) + F.col(value) * t).otherwise(F.col(value))).drop("_level")


def spread(rows: DataFrame, key: list[str], value: str, influences: DataFrame, level: str, distance: str, reach: float, kind: str = "cosine") -> DataFrame:
    """``rows`` with ``spread``: blended towards the levels of ``influences`` (key, level, distance) nearer than ``reach``.

    An influence weighs 1 less its blend of distance by reach; the weighted
    mean of a row's influences replaces its original value by as much as the
    weights add up to, 1 at most.
    """
    weight = 1 - blend(F.col(distance) / reach, kind)
    near = influences.filter(F.col(distance) < reach).groupBy(*key).agg(F.sum(F.col(level) * weight).alias("_vw"), F.sum(weight).alias("_w"))
    share = F.least(F.col("_w"), F.lit(1.0))
    blended = F.when(F.col("_w") > 0, F.col(value) * (1 - share) + F.col("_vw") / F.col("_w") * share).otherwise(F.col(value))
    return rows.join(near, key, "left").withColumn("spread", F.coalesce(blended, F.col(value))).drop("_vw", "_w")


def taper(value: str, ground: str, from_end: str, width: str) -> Column:
    """Elevation eased to the ground towards a loose end, over four widths, 10 at least and 50 at most."""
    reach = F.greatest(F.lit(10.0), F.least(F.lit(50.0), 4 * F.col(width)))
    t = blend(F.col(from_end) / reach, "quintic")
    return F.when(F.col(from_end) < reach, F.col(ground) * (1 - t) + F.col(value) * t).otherwise(F.col(value))


def plateau_radius(width: str, roads: str, reach: float) -> Column:
    """Radius of the level area of a junction of several roads."""
    return F.greatest(2 * F.col(width) + 0.5 * F.col(width) * (F.col(roads) - 2), F.lit(0.5 * reach))


def roundabout_level(members: DataFrame, ring: str, ground: str, value: str, priority: str) -> DataFrame:
    """(ring, level): the mean ground and the roads' mean by priority, the latter by the root of the mean priority; rows without a road count for the ground alone."""
    own = members.groupBy(ring).agg(F.avg(ground).alias("g"), (F.sum(F.col(value) * F.col(priority)) / F.sum(F.when(F.col(value).isNotNull(), F.col(priority)))).alias("c"), F.sqrt(F.sum(F.when(F.col(value).isNotNull(), F.col(priority))) / F.count(value)).alias("w"))
    return own.select(ring, F.coalesce((F.col("g") + F.col("c") * F.col("w")) / (1 + F.col("w")), F.col("g")).alias("level"))


def network_statistics(rows: DataFrame, groups: list[str], length: str) -> DataFrame:
    """Count and total length by each of ``groups`` on its own: dimension, name, n, length."""
    each = rows.select(length, F.explode(F.array(*[F.struct(F.lit(g).alias("dimension"), F.col(g).cast("string").alias("name")) for g in groups])).alias("d"))
    return each.groupBy("d.dimension", "d.name").agg(F.count("*").alias("n"), F.sum(length).alias("length"))
