"""Sessions of events separated by gaps of inactivity, by sweep-line deltas.

Every event opens an interval [t, t + gap]: +1 at t, -1 after t + gap. Where the running sum of the deltas falls to zero, a
session closes; its last event lies one gap earlier. The running sums are made in two levels, so that no task ever
sorts all events of one user: first within a user's time slice, then over the sums of the slices. A user who
writes a third of all rows is thus spread over as many tasks as there are slices in use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def sessionize(events: DataFrame, key: str, time: str, gap: int, slice_width: int | None = None) -> DataFrame:
    """One row per session: key, session_start, session_end, duration, n_events.

    key and time: columns of events; time is a whole number, gap in its unit. An event more than gap after the previous
    one starts a new session; exactly gap after it belongs to the same. Rows with a null key or time are left out; repeated
    rows count as events of the same moment. An empty table gives no rows. Other columns are ignored, so their names may
    clash with nothing. slice_width: time covered by one sorting task of a key; by default 2,000 gaps.
    """
    width = int(slice_width or 2000 * gap)
    if gap < 0 or width <= 0:
        raise ValueError("gap must not be negative and slice_width must be positive")
    moments = (
        events.select(F.col(key).alias("k"), F.col(time).cast("bigint").alias("t"))
        .where("k IS NOT NULL AND t IS NOT NULL")
        .groupBy("k", "t")
        .agg(F.count("*").alias("n"))
    )
    # +1 sorts before -1 of the same time: an event exactly one gap later still finds its session open.
    deltas = moments.select("k", F.explode(F.array(F.struct("t", F.lit(1).alias("d"), "n"), F.struct((F.col("t") + gap).alias("t"), F.lit(-1).alias("d"), F.lit(0).cast("bigint").alias("n")))).alias("x")).select("k", "x.*")
    deltas = deltas.withColumn("slice", F.floor(F.col("t") / F.lit(width)))

    per_slice = deltas.groupBy("k", "slice").agg(F.sum("d").alias("slice_sum"))
    before = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = per_slice.select(F.col("k").alias("k2"), F.col("slice").alias("slice2"), F.coalesce(F.sum("slice_sum").over(before), F.lit(0)).alias("open_before"))

    in_slice = Window.partitionBy("k", "slice").orderBy("t", F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    swept = deltas.join(opening, (F.col("k") == F.col("k2")) & (F.col("slice") == F.col("slice2"))).drop("k2", "slice2")
    swept = swept.withColumn("open", F.sum("d").over(in_slice) + F.col("open_before"))
    swept = swept.withColumn("closes", ((F.col("d") == -1) & (F.col("open") == 0)).cast("int"))

    # Sessions that lie within one slice are whole here; of the others, the parts are joined below.
    earlier = Window.partitionBy("k", "slice").orderBy("t", F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        swept.withColumn("no", F.coalesce(F.sum("closes").over(earlier), F.lit(0)))
        .groupBy("k", "slice", "no")
        .agg(
            F.min(F.when(F.col("d") == 1, F.col("t"))).alias("first"),
            F.max(F.when(F.col("d") == 1, F.col("t"))).alias("last"),
            F.sum("n").alias("n"),
            F.max("closes").alias("closed"),
            F.first("open_before").alias("entered"),
        )
    )
    # Only a part that its slice does not open and close itself can belong together with others; each of the rest is a group of
    # its own, so the last window holds two parts of a slice at most.
    crossing = (F.col("closed") == 0) | ((F.col("no") == 0) & (F.col("entered") > 0))
    parts = parts.withColumn("own_slice", F.when(~crossing, F.col("slice"))).withColumn("own_no", F.when(~crossing, F.col("no")))
    order = Window.partitionBy("k", "own_slice", "own_no").orderBy("slice", "no")
    return (
        parts.withColumn("session", F.coalesce(F.sum("closed").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .groupBy("k", "own_slice", "own_no", "session")
        .agg(F.min("first").alias("session_start"), F.max("last").alias("session_end"), F.sum("n").alias("n_events"))
        .select(F.col("k").alias(key), "session_start", "session_end", (F.col("session_end") - F.col("session_start")).alias("duration"), "n_events")
    )
