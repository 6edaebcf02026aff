"""References to records that do not exist (problem 2).

A reference names a key at a time; a target answers a key from `since` until `until`
(null: for ever). The operator finds references that no target answers at their time.

Method: references and targets are pre-aggregated per key and period, which tells the
heavy keys. A key is answered at a time exactly if the latest end among its targets
that began until then lies after it. So the light keys take an anti-join by shuffle
that merges references and targets in order of time and carries the latest end along.
Heavy keys are cut by period: the latest end that a period begins with is found from
the aggregated periods and broadcast, which settles most references where they lie;
the rest are merged period by period. Both orphan sets are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import canonical, not_blank
from pagewright.runtime import HEAVY_PARTS, materialize, split_join

KEY = ["doc_id", "canon"]
#: The end of targets that have none, in microseconds.
FOREVER = (1 << 63) - 1
#: Heavy keys are cut into periods of so many microseconds (a day).
PERIOD = 86_400_000_000
#: Periods of heavy keys that are broadcast at most; more of them are joined by shuffle.
MAX_CARRIES = 500_000


def references(concepts: DataFrame, verification: DataFrame) -> DataFrame:
    """Non-blank references of both tables: src_table, src_id, ref_pos, doc_id, canon, at.

    Null lists, null or blank entries and null names refer to nothing. Repeated rows
    each refer. Deleted rows refer too.
    """
    entries = concepts.select(
        F.lit("concepts").alias("src_table"), F.col("concept_id").alias("src_id"), "doc_id",
        F.col("loaded_at").alias("at"), F.posexplode("prerequisites").alias("pos", "name"),
    ).select("src_table", "src_id", F.col("pos").cast("bigint").alias("ref_pos"), "doc_id", canonical("name").alias("canon"), "at")
    checks = verification.select(
        F.lit("verification").alias("src_table"), F.col("verification_id").alias("src_id"),
        F.lit(0).cast("bigint").alias("ref_pos"), "doc_id", canonical("concept").alias("canon"), F.col("checked_at").alias("at"),
    )
    return entries.unionByName(checks).filter(not_blank("canon"))


def targets(concepts: DataFrame) -> DataFrame:
    """What answers: doc_id, canon, since, until. A row deleted before it was loaded answers nothing."""
    return concepts.select(
        "doc_id", canonical("name").alias("canon"), F.col("loaded_at").alias("since"), F.col("deleted_at").alias("until"),
    ).filter(not_blank("canon") & F.col("doc_id").isNotNull() & F.col("since").isNotNull())


def period(micros: str) -> Column:
    return F.floor(F.col(micros) / PERIOD).alias("period")


def merged(refs: DataFrame, starts: DataFrame, part: list[str]) -> DataFrame:
    """The rows of refs that no start answers: both in order of time within `part`, starts first where times are equal."""
    other = [c for c in refs.columns if c not in (*part, "t")]
    rows = refs.select(*part, "t", F.lit(1).alias("is_ref"), F.lit(None).cast("bigint").alias("until"), F.struct(*other).alias("row"))
    shape = rows.schema["row"].dataType
    ends = starts.select(*part, "t", F.lit(0).alias("is_ref"), "until", F.lit(None).cast(shape).alias("row"))
    so_far = Window.partitionBy(*part).orderBy("t", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.unionByName(ends).withColumn("latest", F.max("until").over(so_far))
    lost = met.filter((F.col("is_ref") == 1) & ~F.coalesce(F.col("latest") > F.col("t"), F.lit(False)))
    return lost.select(*part, "t", "row.*").select(*refs.columns)


def orphans(refs: DataFrame, answering: DataFrame) -> DataFrame:
    """The rows of refs (KEY, at, any others) that nothing answers at their time.

    A reference with a null time or document has no target. Of targets that start at
    the same time only the latest end counts, so repeated ones cost one row.
    """
    columns = refs.columns
    ends = F.coalesce(F.unix_micros("until"), F.lit(FOREVER))
    starts = answering.select(*KEY, F.unix_micros("since").alias("t"), ends.alias("until")).groupBy(*KEY, "t").agg(
        F.max("until").alias("until")).filter(F.col("until") > F.col("t"))
    refs = refs.withColumn("t", F.unix_micros("at"))
    dated = F.col("t").isNotNull() & F.col("doc_id").isNotNull()
    timeless = refs.filter(~dated)
    refs = refs.filter(dated)

    one = F.lit(1).alias("n")
    periods = refs.select(*KEY, period("t"), one).unionByName(starts.select(*KEY, period("t"), one)).groupBy(*KEY, "period").agg(F.sum("n").alias("n"))
    per_key = materialize(periods.groupBy(*KEY).agg(F.sum("n").alias("n")))
    total = per_key.agg(F.sum("n")).first()[0] or 0
    # At most HEAVY_PARTS keys.
    heavy = F.broadcast(materialize(per_key.filter(F.col("n") * HEAVY_PARTS > total).select(*KEY)))
    light = merged(refs.join(heavy, KEY, "left_anti"), starts.join(heavy, KEY, "left_anti"), KEY)
    found = light.unionByName(heavy_orphans(refs.join(heavy, KEY, "left_semi"), starts.join(heavy, KEY, "left_semi")))
    return found.unionByName(timeless).select(*columns)


def heavy_orphans(refs: DataFrame, starts: DataFrame) -> DataFrame:
    """As merged, for at most HEAVY_PARTS keys with any number of rows: by key and period.

    A period's first latest end comes from the periods before it. References are
    reduced to their distinct times before they are merged, so a key and instant that
    many rows share is one row there; the orphan times are then looked up, hot ones by
    broadcast.
    """
    by_period = starts.groupBy(*KEY, period("t")).agg(F.max("until").alias("until"))
    wanted = refs.select(*KEY, period("t")).distinct()
    before = Window.partitionBy(*KEY).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    carry = materialize(
        by_period.join(wanted, [*KEY, "period"], "full").withColumn("carry", F.max("until").over(before)).select(*KEY, "period", "carry"))
    side = F.broadcast(carry) if carry.count() <= MAX_CARRIES else carry
    times = refs.groupBy(*KEY, "t").agg(F.count(F.lit(1)).alias("n")).withColumn("period", period("t"))
    open_ = times.join(side, [*KEY, "period"]).filter(~F.coalesce(F.col("carry") > F.col("t"), F.lit(False))).drop("carry")
    lost = materialize(merged(open_, starts.withColumn("period", period("t")), [*KEY, "period"]).select(*KEY, "t", "n"))
    hot = materialize(lost.filter(F.col("n") * HEAVY_PARTS > (lost.agg(F.sum("n")).first()[0] or 0)).select(*KEY, "t"))
    return split_join(refs, lost.select(*KEY, "t"), [*KEY, "t"], hot).select(*refs.columns)


def orphan_rows(concepts: DataFrame, verification: DataFrame) -> DataFrame:
    """One row per reference without a target: src_table, src_id, ref_pos."""
    found = orphans(references(concepts, verification), targets(concepts))
    return found.select("src_table", "src_id", "ref_pos")


def orphan_counts(concepts: DataFrame, verification: DataFrame) -> DataFrame:
    """References and orphans per table and month: src_table, month, n_refs, n_orphans.

    References are counted per key and instant before anything is joined, so a name
    that millions of rows refer to at one load costs one row.
    """
    cells = materialize(references(concepts, verification).groupBy("src_table", *KEY, "at").agg(F.count(F.lit(1)).alias("n")))
    lost = orphans(cells, targets(concepts))
    month = F.date_format("at", "yyyy-MM").alias("month")
    every = cells.groupBy("src_table", month).agg(F.sum("n").alias("n_refs"), F.lit(0).cast("bigint").alias("n_orphans"))
    gone = lost.groupBy("src_table", month).agg(F.lit(0).cast("bigint").alias("n_refs"), F.sum("n").alias("n_orphans"))
    return every.unionByName(gone).groupBy("src_table", "month").agg(
        F.sum("n_refs").alias("n_refs"), F.sum("n_orphans").alias("n_orphans"))
