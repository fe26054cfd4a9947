"""The event log as a stream: windowed counts with a watermark, and the review state machine kept per work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import read


def windowed(events: DataFrame, *, size="10 minutes", late="10 minutes") -> DataFrame:
    """event_type, opens, n, total: tumbling windows; rows later than the watermark are dropped where ``events`` is a stream."""
    opened = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return opened.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("window.start").alias("opens"), "n", "total")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


STATE = "clean_streak int, rounds int, seen array<string>, ended string"
ENDS = "work string, round long, termination string"


def advance(state: tuple, rows: list[tuple], *, clean=2, fixes=2):
    """(state, ends) after rounds (round, has_issues, summary, unresolved) in order; nothing moves after an end."""
    streak, n, seen, ended = state
    ends = []
    for number, bad, summary, unresolved in sorted(rows):
        if ended:
            break
        n += 1
        streak = 0 if bad else streak + 1
        seen = [*seen, summary or ""][-3:] if bad else seen
        if len(seen) == 3 and seen[0] == seen[2]:
            ended = "no_progress"
        elif streak >= clean:
            ended = "clean_confirmed"
        elif unresolved and not bad:
            ended = "unresolved_fixes"
        elif n >= (fixes + 1) * clean:
            ended = "max_rounds"
        if ended:
            ends.append((number, ended))
    return (streak, n, seen, ended), ends


def converging(rounds: DataFrame) -> DataFrame:
    """work, round, termination as reviews end: the state machine over a stream of rounds (work, round, has_issues, summary, unresolved)."""
    import pandas as pd

    def step(key, frames, state):
        now = state.get if state.exists else (0, 0, [], "")
        rows = [tuple(r) for f in frames for r in f[["round", "has_issues", "summary", "unresolved"]].itertuples(index=False)]
        now, ends = advance((int(now[0]), int(now[1]), list(now[2]), now[3]), rows)
        state.update(now)
        yield pd.DataFrame({"work": [key[0]] * len(ends), "round": [r for r, _ in ends], "termination": [e for _, e in ends]})

    return rounds.groupBy("work").applyInPandasWithState(step, ENDS, STATE, "append", "NoTimeout")
