"""Operational metrics over event logs: rates, look-back windows, histograms, breakers, cache policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, n, mean, low, high, std (of the population); zeros where nothing was measured."""
    v = F.col(value)
    zero = F.lit(0.0)
    return df.groupBy(*groups).agg(F.count(v).alias("n"), F.coalesce(F.avg(v), zero).alias("mean"), F.coalesce(F.min(v), zero).alias("low"), F.coalesce(F.max(v), zero).alias("high"), F.coalesce(F.stddev_pop(v), zero).alias("std"))


def operation_metrics(ops: DataFrame) -> DataFrame:
    """total, success_rate, error_rate, avg_time, and retry_rate where the log has ``retries``; 0 when there are none."""
    rate = lambda c: F.coalesce(F.try_divide(F.count_if(c).cast("double"), F.count("*")), F.lit(0.0))
    more = [rate(F.col("retries") > 0).alias("retry_rate")] if "retries" in ops.columns else []
    return ops.agg(F.count("*").alias("total"), rate(F.col("success")).alias("success_rate"), rate(~F.col("success")).alias("error_rate"), F.coalesce(F.avg("duration"), F.lit(0.0)).alias("avg_time"), *more)


def errors_per_minute(errors: DataFrame, ts: str = "ts") -> DataFrame:
    """n, rate a minute between the first and the last; 0 below two, or at one instant."""
    span = F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))
    rate = F.when(F.count("*") < 2, 0.0).otherwise(F.coalesce(F.try_divide(F.count("*") * 60_000_000.0, span), F.lit(0.0)))
    return errors.agg(F.count("*").alias("n"), rate.alias("per_minute"))


def trends(errors: DataFrame, reference: DataFrame, minutes: tuple[int, ...] = (15, 60, 240), ts: str = "ts") -> DataFrame:
    """window_min, n, rate: errors of the last minutes before the reference (one row with ``ref``), inclusive, a minute."""
    e = errors.select(F.col(ts).alias("_t")).join(F.broadcast(reference), F.lit(True))  # one row
    marks = [F.count_if(F.col("_t") >= F.col("ref") - F.expr(f"INTERVAL {m} MINUTES")).alias(f"w{m}") for m in minutes]
    one = e.agg(*marks)
    rows = F.array(*[F.struct(F.lit(m).alias("window_min"), F.col(f"w{m}").alias("n")) for m in minutes])
    return one.select(F.explode(rows).alias("r")).select("r.window_min", "r.n", (F.col("r.n") / F.col("r.window_min")).alias("rate"))


def rolling_rates(ops: DataFrame, seconds: int = 3600) -> DataFrame:
    """Each operation with n and success_rate of its type over the look-back, whose start is exclusive.

    A type may hold most rows, so the log is cut into spans as long as the look-back: a row is counted with its own span
    and the one before, and no window holds more than two spans of one type.
    """
    micros = seconds * 1_000_000
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    base = ops.select("*", t.alias("_t"), F.floor(t / micros).alias("_span"))
    both = base.withColumn("_at", F.explode(F.array(F.col("_span"), F.col("_span") + 1)))
    w = Window.partitionBy("op_type", "_at").orderBy("_t").rangeBetween(-(micros - 1), 0)
    out = both.withColumn("n", F.count("*").over(w)).withColumn("ok", F.count_if("success").over(w)).filter("_at = _span")
    return out.withColumn("success_rate", F.col("ok") / F.col("n")).drop("_t", "_span", "_at", "ok")


def throughput(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Each request with n, the requests of the last ``seconds`` up to it; the start is exclusive."""
    micros = seconds * 1_000_000
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    base = requests.select("*", t.alias("_t"), F.floor(t / micros).alias("_span"))
    both = base.withColumn("_at", F.explode(F.array(F.col("_span"), F.col("_span") + 1)))
    w = Window.partitionBy("_at").orderBy("_t").rangeBetween(-(micros - 1), 0)
    return both.withColumn("n", F.count("*").over(w)).filter("_at = _span").drop("_t", "_span", "_at")


def retained(rows: DataFrame, reference: DataFrame, hours: int, ts: str = "ts") -> DataFrame:
    """Rows younger than ``hours`` before the reference (one row with ``ref``); the border is exclusive."""
    return rows.join(F.broadcast(reference), F.lit(True)).filter(F.col(ts) > F.col("ref") - F.expr(f"INTERVAL {hours} HOURS")).drop("ref")  # one row


def latency_histogram(rows: DataFrame, value: str, buckets: tuple[int, ...] = (10, 50, 100, 500)) -> DataFrame:
    """bucket, n: values up to each bound, cumulative."""
    one = rows.agg(*[F.count_if(F.col(value) <= b).alias(f"b{b}") for b in buckets])
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"b{b}").alias("n")) for b in buckets])).alias("r")).select("r.bucket", "r.n")


def moving_average(rows: DataFrame, group: str, order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """group, n, ema: avg = (1 - alpha) avg + alpha x from 0, in closed form.

    Terms whose weight is below 1e-18 don't change a double, so only the last values count: they are found by rank.
    """
    import math

    last = math.ceil(math.log(1e-18) / math.log(1 - alpha))
    w = Window.partitionBy(group).orderBy(F.desc(order))
    ranked = rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= last)
    ema = ranked.groupBy(group).agg(F.sum(F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("_k") - 1) * F.col(value)).alias("ema"))
    return rows.groupBy(group).agg(F.count("*").alias("n")).join(ema, group)


def health(cpu: Column, memory: Column, disk: Column, error_rate: Column) -> Column:
    """Struct of status and issues: more than 80 is a warning, an error rate above 0.1 is unhealthy."""
    issues = F.array_compact(F.array(*[F.when(c > 80, F.lit(f"high_{n}")) for n, c in (("cpu", cpu), ("memory", memory), ("disk", disk))], F.when(error_rate > 0.1, F.lit("high_error_rate"))))
    return F.struct(F.when(error_rate > 0.1, "unhealthy").when(F.size(issues) > 0, "warning").otherwise("healthy").alias("status"), issues.alias("issues"))


def graph_health(connectivity: Column, missing: Column) -> Column:
    """Struct of status and issues of the graph: less than 80 % of the nodes connected, or rows that lack a required value."""
    issues = F.array_compact(F.array(F.when(connectivity < 0.8, F.lit("low_connectivity")), F.when(missing > 0, F.lit("missing_values"))))
    return F.struct(F.when(F.size(issues) > 0, "degraded").otherwise("healthy").alias("status"), issues.alias("issues"))


def severity(category: Column) -> Column:
    return F.when(category.isin("database", "system"), "critical").when(category.isin("validation", "processing"), "error").when(category == "network", "warning").otherwise("info")


def breaker_states(log: DataFrame, key: str = "circuit", failures: int = 5, window: int = 10, reset_seconds: float = 60.0) -> DataFrame:
    """key, t (microseconds), success, state after each call of a circuit breaker.

    Five failures among the last ten that lie within ten seconds open it; a call a minute later half-opens it; a success closes
    and clears it.  A success with fewer than five failures in the 70 seconds before it finds the circuit closed, or open for
    a minute or more, and clears it either way: what was before no longer matters.  Logs are cut at such successes, and the
    pieces are walked apart, each in order; its state is a few numbers.
    """

    def run(batches):
        import pyarrow as pa

        at, state, held, opened = None, "closed", [], 0.0
        for batch in batches:
            keys, pieces, times, oks = (c.to_pylist() for c in batch.columns)
            out = []
            for k, piece, t, ok in zip(keys, pieces, times, oks):
                if (k, piece) != at:
                    at, state, held, opened = (k, piece), "closed", [], 0.0
                s = t / 1e6
                if state == "open" and s - opened >= reset_seconds:
                    state = "half_open"
                if state != "open":
                    if ok:
                        state, held = "closed", []
                    else:
                        held = [*held, s][-window:]
                        if sum(s - x <= window for x in held) >= failures:
                            state, opened = "open", s
                out.append(state)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(out, pa.string())], names=[key, "t", "success", "state"])

    look = int((reset_seconds + window) * 1_000_000)
    rows = log.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "success").withColumn("_span", F.floor(F.col("t") / look))
    # A row sees its own span and the one before, so that no window holds more than two spans of a circuit.
    both = rows.withColumn("_at", F.explode(F.array(F.col("_span"), F.col("_span") + 1)))
    near = Window.partitionBy(key, "_at").orderBy("t").rangeBetween(-look, 0)
    free = both.withColumn("_new", F.coalesce("success", F.lit(False)) & (F.count_if(~F.coalesce("success", F.lit(False))).over(near) < failures)).filter("_at = _span").drop("_at")
    # Pieces are numbered inside each span, and counted before it.
    order = Window.partitionBy(key, "_span").orderBy("t", "success").rowsBetween(Window.unboundedPreceding, 0)
    own = free.withColumn("_own", F.sum(F.col("_new").cast("int")).over(order))
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    per = own.groupBy(key, "_span").agg(F.max("_own").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # a row a span
    placed = own.join(per, [key, "_span"]).select(key, (F.col("_base") + F.col("_own")).alias("_piece"), "t", "success").repartition(key, "_piece").sortWithinPartitions(key, "_piece", "t", "success")
    kind = log.schema[key].dataType.simpleString()
    return placed.mapInArrow(run, f"`{key}` {kind}, t long, success boolean, state string")


def lru_victim(entries: DataFrame) -> DataFrame:
    """The entry used longest ago (created, if never used); ties to the smaller key."""
    return entries.agg(F.min_by("key", F.struct(F.coalesce("last_accessed", "created_at"), "key")).alias("key"))


def evicted(entries: DataFrame, budget: int) -> DataFrame:
    """Oldest entries that go until the sizes of the rest fit the budget.  Sizes are added by day first, and only the border day is ranked."""
    day = F.to_date("mtime")
    total = entries.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    days = entries.groupBy(day.alias("_day")).agg(F.sum("size").alias("_s"))
    run = days.withColumn("_before", F.sum("_s").over(Window.orderBy("_day")) - F.col("_s")).drop("_s")  # a row a day
    w = Window.partitionBy("_day").orderBy("mtime", "key")
    ranked = entries.withColumn("_day", day).join(run, "_day").withColumn("_gone", F.col("_before") + F.sum("size").over(w) - F.col("size"))
    return ranked.join(F.broadcast(total), F.lit(True)).filter(F.col("_gone") < F.col("total") - budget).select(*entries.columns)  # one row


def hit_rates(lookups: DataFrame) -> DataFrame:
    """l1_rate, l2_rate, total_rate from lookups level (1, 2 or null for a miss)."""
    rate = lambda c: F.coalesce(F.try_divide(F.count_if(c).cast("double"), F.count("*")), F.lit(0.0))
    return lookups.agg(rate(F.col("level") == 1).alias("l1_rate"), rate(F.col("level") == 2).alias("l2_rate"), rate(F.col("level").isNotNull()).alias("total_rate"))
