"""Usage analytics over event logs: pairing, distributions, summaries, comparisons; and the session log."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR_WINDOW_MS = 120_000


def parse_since(text: str) -> int:
    """Milliseconds of ``30m``, ``12h``, ``7d`` or ``2w``."""
    m = re.fullmatch(r"(\d+)([mhdw])", text.strip())
    if not m:
        raise ValueError(f"not a duration: {text}")
    return int(m[1]) * {"m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}[m[2]]


def pair_runs(hooks: DataFrame, runs: DataFrame, window_ms: int = PAIR_WINDOW_MS) -> DataFrame:
    """(run_id, hook_id): each run takes the newest unused hook of its id at or before it, within the window; one to one.

    Hooks and runs: key, ts (ms), and a row id. A key's events are cut at gaps over the window, where no pair can
    reach across. Gaps are found inside spans of time and between them, so no sort holds a key's whole history; what stays
    together is one burst, matched in one sorted pass over each partition with the open hooks of the burst as its only state.
    """
    both = hooks.select("key", "ts", F.col("hook_id").alias("row"), F.lit(0).alias("side")).unionByName(runs.select("key", "ts", F.col("run_id").alias("row"), F.lit(1).alias("side")))
    both = both.where("key is not null and ts is not null").withColumn("span", F.floor(F.col("ts") / (64 * window_ms)))
    own = Window.partitionBy("key", "span").orderBy("ts", "side", "row")
    both = both.withColumn("gap", F.coalesce((F.col("ts") - F.lag("ts").over(own) > window_ms).cast("int"), F.lit(0))).withColumn("burst", F.sum("gap").over(own))
    spans = both.groupBy("key", "span").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("gap").alias("gaps"))
    order = Window.partitionBy("key").orderBy("span")
    border = F.coalesce((F.col("first") - F.lag("last").over(order) > window_ms).cast("int"), F.lit(0)) + F.coalesce(F.lag("gaps").over(order), F.lit(0))
    spans = spans.withColumn("border", border).select("key", "span", F.sum("border").over(order).alias("before"))
    both = both.join(spans, ["key", "span"]).withColumn("burst", F.col("burst") + F.col("before"))
    both = both.select(F.xxhash64("key", "burst").alias("b1"), F.xxhash64("burst", "key").alias("b2"), "ts", "side", "row").repartition("b1").sortWithinPartitions("b1", "b2", "ts", "side", "row")

    def match(batches):
        burst, open_ = None, []
        for pdf in batches:
            out = []
            for b1, b2, ts, side, row in zip(*(pdf[c].tolist() for c in ("b1", "b2", "ts", "side", "row")), strict=True):
                if (b1, b2) != burst:
                    burst, open_ = (b1, b2), []
                if side == 0:
                    open_.append((ts, row))
                elif open_ and ts - open_[-1][0] <= window_ms:
                    out.append((row, open_.pop()[1]))
            yield pd.DataFrame(out, columns=["run_id", "hook_id"]).astype("int64")

    return both.mapInPandas(match, "run_id long, hook_id long")


def latest_replay(replays: DataFrame, version: str | None = None) -> DataFrame:
    """The last replay of each id (of a version, if one is given)."""
    out = replays if version is None else replays.where(F.col("version") == version)
    return out.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ts")))).where("rn = 1").drop("rn")


def distribution(events: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, avg, min, p50, p95, p99, max and total of a value; percentiles are nearest-rank."""
    pick = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    return events.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("avg"), F.min(value).alias("min"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"), F.max(value).alias("max"), F.sum(value).alias("total"))


def mode_by(events: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties go to the smallest."""
    counts = events.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value))).where("rn = 1").select(*group, F.col(value).alias("mode"), "n")


def concentration(events: DataFrame, by: str, top: int = 3) -> DataFrame:
    """The share of all events that the ``top`` most frequent values have."""
    counts = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), by).limit(top).agg(F.sum("n").alias("top_events"))
    return best.crossJoin(counts.agg(F.sum("n").alias("events"))).select("top_events", "events", (F.col("top_events") / F.col("events")).alias("share"))


def sessions(events: DataFrame, session: str, ts: str, place: str) -> DataFrame:
    """Per session: first time, most frequent place, events."""
    base = events.groupBy(session).agg(F.min(ts).alias("first_ts"), F.count(F.lit(1)).alias("events"))
    return base.join(mode_by(events, [session], place).select(session, F.col("mode").alias("place")), session)


def compare_versions(runs: DataFrame, key: str, version: str, value: str, a: str, b: str) -> DataFrame:
    """Queries run under both versions: pairs, wins of b (lower), losses, ties and mean values."""
    per = runs.groupBy(key, version).agg(F.avg(value).alias("v"))
    left = per.where(F.col(version) == a).select(key, F.col("v").alias("va"))
    right = per.where(F.col(version) == b).select(key, F.col("v").alias("vb"))
    return left.join(right, key).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("vb") < F.col("va")).alias("wins"), F.count_if(F.col("vb") > F.col("va")).alias("losses"), F.count_if(F.col("vb") == F.col("va")).alias("ties"), F.avg("va").alias("avg_a"), F.avg("vb").alias("avg_b"))


def capped_tokens(tokens: Column, size: Column, cap: int) -> Column:
    """Tokens scaled to what a reader of at most ``cap`` bytes would see."""
    return F.when((F.lit(cap) == 0) | (size <= cap), tokens.cast("double")).otherwise(tokens * F.lit(float(cap)) / size)


def focus(log: DataFrame, most: int = 12) -> DataFrame:
    """Per session, the last distinct files, the most recent first. The log has session_id, t and files (an array)."""
    last = log.select("session_id", "t", F.explode("files").alias("file")).groupBy("session_id", "file").agg(F.max("t").alias("t"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("t"), "file"))).where(F.col("place") <= most)


def repeats(log: DataFrame, query: Column, back: int = 5) -> DataFrame:
    """How many of the last ``back`` queries of the session asked the same."""
    own = Window.partitionBy("session_id").orderBy("t").rowsBetween(-back, -1)
    same = log.withColumn("asked", query).withColumn("recent", F.coalesce(F.collect_list("asked").over(own), F.expr("cast(array() as array<string>)")))
    return same.withColumn("repeats", F.size(F.filter("recent", lambda q: q == F.col("asked")))).drop("recent")


def covered(shown: DataFrame) -> DataFrame:
    """Ranges (session_id, t, file, first, last, mtime) that an earlier range of the same session, file and mtime holds whole."""
    a, b = shown.alias("a"), shown.alias("b")
    hold = (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.file") == F.col("b.file")) & (F.col("a.mtime") == F.col("b.mtime")) & (F.col("b.t") < F.col("a.t")) & (F.col("b.first") <= F.col("a.first")) & (F.col("b.last") >= F.col("a.last"))
    return a.join(b, hold, "left_semi")


def compact(log: DataFrame, most: int = 2000) -> DataFrame:
    """A session's log past ``most`` records keeps its newest half."""
    own = Window.partitionBy("session_id")
    numbered = log.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("age", F.row_number().over(own.orderBy(F.desc("t"))))
    return numbered.where((F.col("n") <= most) | (F.col("age") <= most // 2)).drop("n", "age")


def chosen(events: DataFrame, since_ms: int | None = None, now_ms: int | None = None, directory: str | None = None, session: str | None = None, version: str | None = None) -> DataFrame:
    """Events (ts in ms, cwd, session, version) after a cut-off, below a directory, of sessions by prefix, of a version family."""
    out = events
    if since_ms is not None and now_ms is not None:
        out = out.where(F.col("ts") >= now_ms - since_ms)
    if directory:
        out = out.where((F.col("cwd") == directory) | F.col("cwd").startswith(directory.rstrip("/") + "/"))
    if session:
        out = out.where(F.col("session").startswith(session))
    if version:
        out = out.where((F.col("version") == version) | F.col("version").startswith(version + "."))
    return out


def summarize(events: DataFrame, by: list[str], value: str, failed: Column | None = None) -> DataFrame:
    """Runs, the sum and the mean of a value by class, directory, version or session, with its share of all runs and how many failed."""
    own = events.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.sum(value).alias("total"), F.avg(value).alias("avg"), F.count_if(failed if failed is not None else F.lit(False)).alias("failed"))
    return own.crossJoin(F.broadcast(events.agg(F.count(F.lit(1)).alias("all_runs")))).withColumn("share", F.col("runs") / F.col("all_runs")).drop("all_runs")


def loop_hint(log: DataFrame, query: Column, times: int = 2) -> DataFrame:
    """Records whose query was asked ``times`` times or more in the last five."""
    return repeats(log, query).where(F.col("repeats") >= times)


def backoff_seconds(failures: int) -> int:
    """How long to wait after so many failures in a row: doubling from 30 s to an hour."""
    return min(3600, 30 << min(max(failures, 1) - 1, 7)) if failures else 0
