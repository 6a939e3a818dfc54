"""Per-user alerts from scored events: exponentially weighted scores, rules and a cooldown, in batch and stream.

A score that forgets by half in a time h is a sum of all events so far, each weighed by what it added and by 2 ** (-age / h). All
three are therefore running sums of columns: within a slice of a user's time the events' terms are summed up, scaled to the slice's
start, and the sums of the slices before, as far back as they still count, are added. A user with a third of all events is spread over as
many tasks as there are slices in use. The rules are columns of these scores; only the cooldown depends on what was
decided before, and is settled by a walk from alert to alert over the few events that meet a rule.

The stream is the same plan on every micro-batch. What it knows of a user is one row: the time of the last event, the number of
events, the scores, the last levels and the last alert.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kelk.session import cut


# Half-lives and cooldown in minutes, and the thresholds of the rules.
@dataclass(frozen=True)
class Rules:
    fast: float = 45.0
    sustained: float = 180.0
    baseline: float = 1440.0
    immediate_score: float = 7.5
    sustained_score: float = 6.5
    sustained_events: int = 2
    window: int = 5
    window_high: int = 3
    escalation: float = 1.5
    escalation_fast: float = 6.0
    cooldown: float = 60.0


SCORES = ("fast", "sustained", "baseline")
FLAGS = ("immediate", "is_sustained", "repeated", "escalating", "cooling", "alert")
STATE = "u long, at long, n long, fast double, sustained double, baseline double, levels array<boolean>, alerted long"
_MINUTE = 60_000_000
#: A slice of a user's time, in half-lives of the fastest score: terms grow to 2 ** 400 within it, and fit a double.
SLICE_HALF_LIVES = 400
#: Half-lives after which nothing is left of a score in a double.
GONE = 64


def _halved(age: Column, half_life: float) -> Column:
    """What is left after an age in microseconds."""
    return F.pow(F.lit(2.0), -age / F.lit(half_life * _MINUTE))


def _columns(df: DataFrame, user: str, event: str, at: str, score: str, level: str) -> DataFrame:
    rows = df.select(
        F.col(user).cast("long").alias("u"), F.col(event).cast("long").alias("e"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(score).cast("double").alias("s"),
        F.coalesce(F.col(level).isin("High", "Very High"), F.lit(False)).alias("high"), F.coalesce(F.col(level) == "Very High", F.lit(False)).alias("top"),
    )
    return rows.where("u IS NOT NULL AND t IS NOT NULL AND s IS NOT NULL")


def _scored(rows: DataFrame, state: DataFrame, rules: Rules) -> DataFrame:
    """rows with n (the event's number of its user), the three scores, and levels (of the last events up to it)."""
    half = {"fast": rules.fast, "sustained": rules.sustained, "baseline": rules.baseline}
    width = int(SLICE_HALF_LIVES * min(half.values()) * _MINUTE)
    reach = math.ceil(GONE * max(half.values()) * _MINUTE / width)
    rows = rows.withColumn("slice", F.floor(F.col("t") / F.lit(width)))
    start = F.col("slice") * F.lit(width)

    # Each slice learns the last event and the number of events before it; the first one of a user has them from the state.
    by_user = Window.partitionBy("u").orderBy("slice")
    ends = rows.groupBy("u", "slice").agg(F.count("*").alias("held"), F.max("t").alias("last"), F.min("t").alias("first"))
    ends = ends.join(state, "u", "left")
    earlier = by_user.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        "u", "slice", (F.coalesce(F.sum("held").over(earlier), F.lit(0)) + F.coalesce("n", F.lit(0))).alias("before"),
        # An event older than the last one finds the scores as they are, so these count as of its own time.
        F.coalesce(F.lag("last").over(by_user), F.when(F.col("at").isNotNull(), F.least("at", "first"))).alias("previous"),
    )
    within = Window.partitionBy("u", "slice").orderBy("t", "e")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    terms = rows.join(ends, ["u", "slice"]).withColumn("since", F.col("t") - F.coalesce(F.lag("t").over(within), F.col("previous")))
    for name, h in half.items():
        added = F.when(F.col("since").isNull(), 1.0).otherwise(1 - _halved(F.col("since"), h))
        terms = terms.withColumn(f"term_{name}", added * F.col("s") * _halved(start - F.col("t"), h))
    terms = terms.withColumns({
        "n": F.row_number().over(within) + F.col("before"), "recent": F.collect_list("high").over(within.rowsBetween(1 - rules.window, 0)), **{f"sum_{name}": F.sum(f"term_{name}").over(upto) for name in half},
    })
    terms = cut(terms.drop("before", "previous", "since"))

    totals = terms.groupBy("u", "slice").agg(F.min("t").alias("first"), F.max_by("recent", "n").alias("tail"), *[F.sum(f"term_{name}").alias(name) for name in half])
    near = by_user.rangeBetween(-reach, -1)
    totals = totals.withColumns({"past": F.collect_list(F.struct("slice", *half)).over(near), "tails": F.flatten(F.collect_list("tail").over(by_user.rowsBetween(1 - rules.window, -1))), "opens": F.row_number().over(by_user) == 1, "begin": F.min("first").over(by_user.rowsBetween(Window.unboundedPreceding, 0))})
    known = state.select("u", F.col("at").alias("k_at"), F.col("levels").alias("k_levels"), *[F.col(name).alias(f"k_{name}") for name in half])
    totals = totals.join(known, "u", "left")
    from_state = F.least("k_at", "begin")
    carried = {
        f"carry_{name}": F.aggregate("past", F.lit(0.0), lambda total, p: total + p[name] * _halved((F.col("slice") - p["slice"]) * F.lit(width), h))  # noqa: B023
        + F.coalesce(F.col(f"k_{name}") * _halved(start - from_state, h), F.lit(0.0))
        for name, h in half.items()
    }
    tails = F.concat(F.coalesce("k_levels", F.array().cast("array<boolean>")), "tails")
    carries = totals.select("u", "slice", tails.alias("tails"), *[c.alias(name) for name, c in carried.items()])
    out = terms.join(carries, ["u", "slice"])
    scores = {name: _halved(F.col("t") - start, h) * (F.col(f"sum_{name}") + F.col(f"carry_{name}")) for name, h in half.items()}
    return out.select("u", "e", "t", "s", "top", "n", F.expr(f"slice(concat(tails, recent), greatest(size(tails) + size(recent) - {rules.window - 1}, 1), {rules.window})").alias("levels"), *[c.alias(name) for name, c in scores.items()])


_ALERTED = "u long, n long, t long"


def _settle(candidates: DataFrame, rules: Rules) -> DataFrame:
    """u, n, t of the alerts among the events that meet a rule (u, n, t, immediate, alerted), each user's in order.

    From an alert the walk goes on to the next event that is immediate or lies a cooldown later. A task holds one batch of rows.
    """
    cooldown = int(rules.cooldown * _MINUTE)
    ordered = candidates.repartition("u").sortWithinPartitions("u", "n")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, last = None, None
        for batch in batches:
            u, t, now, known = (batch[c].to_numpy() for c in ("u", "t", "immediate", "alerted"))
            picked: list[int] = []
            ends = np.append(np.flatnonzero(u[1:] != u[:-1]) + 1, len(u)) if len(u) else []
            begin = 0
            for end in ends:
                if u[begin] != user:
                    user, last = u[begin], None if np.isnan(known[begin]) else int(known[begin])
                at = np.flatnonzero(now[begin:end].astype(bool)) + begin
                i = begin
                while i < end:
                    free = i if last is None else i + int(np.searchsorted(t[i:end], last + cooldown))
                    urgent = at[np.searchsorted(at, i) :][:1]
                    i = min(free, int(urgent[0]) if len(urgent) else end)
                    if i < end:
                        picked.append(i)
                        last = int(t[i])
                        i += 1
                begin = end
            yield batch.iloc[picked][["u", "n", "t"]]

    return ordered.mapInPandas(walk, _ALERTED)


def _flagged(rows: DataFrame, state: DataFrame, rules: Rules) -> DataFrame:
    """rows with the six flags."""
    known = state.select("u", F.col("alerted").cast("double").alias("alerted"))
    high = F.size(F.filter("levels", lambda x: x))
    rows = rows.withColumns({
        "immediate": F.col("top") & (F.col("s") >= rules.immediate_score), "is_sustained": (F.col("n") >= rules.sustained_events) & (F.col("sustained") >= rules.sustained_score),
        "repeated": (F.size("levels") == rules.window) & (high >= rules.window_high), "escalating": (F.col("fast") >= rules.escalation_fast) & (F.col("fast") - F.col("baseline") >= rules.escalation),
    })
    rows = cut(rows)
    candidates = rows.where("immediate OR is_sustained OR repeated OR escalating").join(known, "u", "left")
    alerts = cut(_settle(candidates.select("u", "n", "t", "immediate", "alerted"), rules))
    # The last alert before an event: of its own slice of numbers, else of those before, else of the state.
    marked = rows.join(alerts.select("u", "n", F.col("t").alias("at")), ["u", "n"], "left").withColumn("part", F.floor(F.col("n") / F.lit(100_000)))
    parts = alerts.groupBy("u", F.floor(F.col("n") / F.lit(100_000)).alias("part")).agg(F.max_by("t", "n").alias("at"))
    every = marked.select("u", "part").distinct().join(parts, ["u", "part"], "left")
    before = every.select("u", "part", F.last("at", True).over(Window.partitionBy("u").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("entered")).join(state.select("u", F.col("alerted").alias("k_alerted")), "u", "left")
    marked = marked.join(before, ["u", "part"])
    order = Window.partitionBy("u", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last("at", True).over(order), F.col("entered"), F.col("k_alerted"))
    cooling = F.coalesce(F.col("t") - last < int(rules.cooldown * _MINUTE), F.lit(False))
    return marked.withColumns({"cooling": cooling, "alert": F.col("at").isNotNull(), "alerted": F.coalesce("at", last)})


def _decide(rows: DataFrame, state: DataFrame, rules: Rules) -> DataFrame:
    return _flagged(_scored(rows, state, rules), state, rules)


def no_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def _shown(decided: DataFrame, user: str) -> DataFrame:
    return decided.select(F.col("u").alias(user), F.col("e").alias("event"), *SCORES, *FLAGS)


def alerts_batch(df: DataFrame, user: str, event: str, at: str, score: str, level: str, rules: Rules = Rules()) -> DataFrame:
    """Scores and flags of every event, each user's events taken in the order of time, then event number.

    A null score, time or user is left out; events of the same moment add nothing to the scores but the first; repeated
    rows are events of the same moment; a null level is neither high nor very high. An empty table gives no rows.
    """
    return _shown(_decide(_columns(df, user, event, at, score, level), no_state(df.sparkSession), rules), user)


def advance(state: DataFrame, decided: DataFrame, rules: Rules) -> DataFrame:
    """The state after the events of a micro-batch: of each user in it the last event's, of all others what it was."""
    last = decided.groupBy("u").agg(F.max_by(F.struct(F.col("t").alias("at"), "n", *SCORES, F.expr(f"slice(levels, greatest(size(levels) - {rules.window - 2}, 1), {rules.window - 1})").alias("levels"), "alerted"), "n").alias("x")).select("u", "x.*")
    return state.join(last.select("u"), "u", "left_anti").unionByName(last)


def alerts_stream(events: DataFrame, user: str, event: str, at: str, score: str, level: str, folder: str, rules: Rules = Rules(), forget: float | None = None):
    """A writer of the same from a streaming table into folder/table, one partition a micro-batch; start it with a trigger.

    Within a micro-batch a user's events are taken in order. An event that comes after later ones leaves the scores as they are,
    counts in the window and moves the clock back. The state is a table in folder/state with a version for each micro-batch, so a batch
    that is run again starts from the same state and overwrites its own output. With forget, users without an event for so many
    minutes before the latest one lose their state. Earlier versions than the last two are removed.
    """
    spark = events.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        state = session.read.parquet(f"{folder}/state/{number - 1}") if number else no_state(session)
        decided = cut(_decide(_columns(batch, user, event, at, score, level), state, rules))
        after = advance(state, decided, rules)
        if forget is not None:
            latest = after.agg(F.max("at").alias("latest"))
            after = after.join(F.broadcast(latest)).where(F.col("at") >= F.col("latest") - int(forget * _MINUTE)).drop("latest")  # one row
        _shown(decided, user).write.mode("overwrite").parquet(f"{folder}/table/batch={number}")
        after.write.mode("overwrite").parquet(f"{folder}/state/{number}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/{number - 2}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/log")
