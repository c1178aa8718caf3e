"""Streams over ``events``: windows, sessions, dedup, state, joins, sinks, and per-batch equivalents.

A stream reads the table's file with a schema and runs to the end of what is there
(``availableNow``); its result goes to a stored table, so a lost executor costs a re-read.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.plans.registry import Registry
from quarry.plans.scratch import scratch
from quarry.session import load

R = Registry()
EPOCH = "epoch_us(ts) // 1000000"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream with an event time that carries a zone, as watermarks need."""
    schema = load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def finish(spark: SparkSession, sf_dir: str, df: DataFrame, mode: str = "complete", transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a streaming frame over all there is and return what its sink holds."""
    base = f"{scratch(spark, sf_dir, 'streams')}/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(f"{base}/out")


def seconds(c: str):
    return F.col(c).cast("long")


@R.frame(f"SELECT ({EPOCH}) // 3600 * 3600 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return finish(spark, sf_dir, s.select(seconds("window.start").alias("start"), "event_type", "n", "total"))


@R.frame(f"SELECT w AS start, count(*) AS n FROM (SELECT unnest([({EPOCH}) // 1800 * 1800, ({EPOCH}) // 1800 * 1800 - 1800]) AS w FROM events) GROUP BY 1")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return finish(spark, sf_dir, s.select(seconds("window.start").alias("start"), "n"))


@R.frame(f"SELECT (({EPOCH}) - 900) // 3600 * 3600 + 900 AS start, count(*) AS n FROM events GROUP BY 1")
def stream_window_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir).groupBy(F.window("ts", "1 hour", "1 hour", "15 minutes")).agg(F.count("*").alias("n"))
    return finish(spark, sf_dir, s.select(seconds("window.start").alias("start"), "n"))


SESSIONS = "WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), g AS (SELECT user_id, ts, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)"


@R.frame(SESSIONS + " SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n FROM g GROUP BY user_id, s")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return finish(spark, sf_dir, s.select("user_id", seconds("session_window.start").alias("start"), "n"))


@R.frame("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(spark, sf_dir, stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append")


@R.frame("SELECT event_id FROM events")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    return finish(spark, sf_dir, s.union(s).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), "append")


@R.frame("SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR")
def stream_join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda kind, names: stream(spark, sf_dir).where(F.col("event_type") == kind).select(*[F.col(a).alias(b) for a, b in names.items()])
    a = side("click", {"event_id": "click", "user_id": "u", "ts": "t"}).withWatermark("t", "1 hour")
    b = side("purchase", {"event_id": "purchase", "user_id": "v", "ts": "s"}).withWatermark("s", "1 hour")
    met = a.join(b, F.expr("u = v AND s >= t AND s <= t + INTERVAL 2 HOURS"))
    return finish(spark, sf_dir, met.select("click", "purchase"), "append")


@R.frame("SELECT e.event_id, e.event_type, t.weight FROM events e JOIN (SELECT event_type, count(*)::BIGINT AS weight FROM events GROUP BY 1) t USING (event_type)")
def stream_join_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("weight"))
    return finish(spark, sf_dir, stream(spark, sf_dir).join(weights, "event_type").select("event_id", "event_type", "weight"), "append")


def _running(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, top = state.get if state.exists else (0, float("-inf"))
    for rows in batches:
        n, top = n + len(rows), max(top, rows["value"].max())
    state.update((n, float(top)))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})


@R.frame("SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arbitrary state per user, updated batch by batch; the last state of each is the result."""
    s = stream(spark, sf_dir).groupBy("user_id").applyInPandasWithState(_running, "user_id long, n long, top double", "n long, top double", "update", GroupStateTimeout.NoTimeout)
    out = finish(spark, sf_dir, s, "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max("top").alias("top"))


@R.frame("SELECT 5::BIGINT AS n, 5::BIGINT AS known")
def stream_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five different events of the table, whichever come first."""
    found = finish(spark, sf_dir, stream(spark, sf_dir).select("event_id").limit(5), "append")
    return found.join(load(spark, sf_dir, "events").select("event_id", F.lit(1).alias("k")), "event_id", "left").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("k") == 1, F.col("event_id"))).alias("known"))


@R.frame("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_memory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"sink_{uuid.uuid4().hex}"
    q = stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@R.frame("SELECT event_id, event_type FROM events WHERE value > 10")
def stream_file_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{scratch(spark, sf_dir, 'streams')}/{uuid.uuid4().hex}"
    stream(spark, sf_dir).where("value > 10").select("event_id", "event_type").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@R.frame("SELECT true AS ran, true AS ended, true AS counted")
def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate source under a processing-time trigger: it runs, reports progress and stops."""
    name = f"rate_{uuid.uuid4().hex}"
    q = spark.readStream.format("rate").option("rowsPerSecond", 50).option("numPartitions", 2).load().writeStream.format("memory").queryName(name).trigger(processingTime="200 milliseconds").start()
    for _ in range(40):
        if q.lastProgress and spark.table(name).take(1):
            break
        q.awaitTermination(0.25)
    ran, counted = q.isActive and q.id is not None and q.runId is not None, bool(spark.table(name).take(1))
    q.stop()
    return spark.createDataFrame([(bool(ran), not q.isActive, counted)], "ran boolean, ended boolean, counted boolean")


# What discretised streams do, batch by batch.
@R.frame("SELECT event_type AS k, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def dstream_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map, filter and reduceByKey of each batch, merged over batches."""
    s = stream(spark, sf_dir).where("user_id % 2 = 0").select(F.col("event_type").alias("k"))
    parts = finish(spark, sf_dir, s, "append", lambda b: b.groupBy("k").agg(F.count("*").alias("n")))
    return parts.groupBy("k").agg(F.sum("n").alias("n"))


@R.frame("SELECT event_id, unnest(string_split(event_type, '')) AS c FROM events")
def dstream_flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(spark, sf_dir, stream(spark, sf_dir).select("event_id", F.explode(F.split("event_type", "")).alias("c")), "append")


@R.frame("SELECT user_id, sum(value) > 100 AS rich, count(*) AS n FROM events GROUP BY user_id")
def dstream_update_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir).groupBy("user_id").agg((F.sum("value") > 100).alias("rich"), F.count("*").alias("n"))
    return finish(spark, sf_dir, s)


@R.frame("SELECT event_type, count(*) * 2 AS n FROM events GROUP BY 1")
def dstream_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    return finish(spark, sf_dir, s.union(s).groupBy("event_type").agg(F.count("*").alias("n")))


@R.frame(f"WITH h AS (SELECT event_type, ({EPOCH}) // 3600 AS h, count(*) AS n FROM events GROUP BY 1, 2) SELECT a.event_type, a.h, sum(b.n)::BIGINT AS n FROM h a JOIN h b ON a.event_type = b.event_type AND b.h BETWEEN a.h - 2 AND a.h GROUP BY 1, 2")
def dstream_reduce_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the last three hours by adding what enters and taking off what leaves: running sums and their differences."""
    s = stream(spark, sf_dir).groupBy("event_type", F.floor(seconds("ts") / 3600).alias("h")).agg(F.count("*").alias("n"))
    hourly = finish(spark, sf_dir, s)
    w = Window.partitionBy("event_type").orderBy("h")
    entered = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    left = F.coalesce(F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, -3)), F.lit(0))
    return hourly.select("event_type", "h", (entered - left).alias("n"))


@R.frame("SELECT event_type AS k, sum(user_id + 1)::BIGINT AS values, sum(user_id % 3)::BIGINT AS spread FROM events GROUP BY 1")
def dstream_map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mapValues keeps keys and their places; flatMapValues makes of a value none or several."""
    pairs = stream(spark, sf_dir).select(F.col("event_type").alias("k"), F.col("user_id").alias("v"))
    mapped = pairs.select("k", (F.col("v") + 1).alias("v"), F.lit(0).alias("s"))
    several = pairs.select("k", F.lit(0).cast("long").alias("v"), F.explode(F.array_repeat(F.lit(1), (F.col("v") % 3).cast("int"))).alias("s"))
    return finish(spark, sf_dir, mapped.union(several).groupBy("k").agg(F.sum("v").alias("values"), F.sum("s").alias("spread")))


@R.frame("SELECT event_id % 3 AS batch, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def dstream_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue of tables, one file after the other, a batch each."""
    base = f"{scratch(spark, sf_dir, 'streams')}/{uuid.uuid4().hex}"
    events = load(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).alias("batch"))
    for i in range(3):
        events.where(F.col("batch") == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    s = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return finish(spark, sf_dir, s, "append", lambda b: b.groupBy("batch").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")))


def _until_quiet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        n, last = state.get
        state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [last]})
        return
    n, last = state.get if state.exists else (0, 0)
    for rows in batches:
        n, last = n + len(rows), max(last, int(rows["at"].max()))
    state.update((n, last))
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))


@R.frame("SELECT user_id, count(*) AS n, max(epoch_us(ts) // 1000)::BIGINT AS last FROM events GROUP BY user_id HAVING max(epoch_us(ts) // 1000) < (SELECT max(epoch_us(ts) // 1000) FROM events)")
def stream_state_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State that ends by event time: users whose last event lies before the watermark are given out and forgotten."""
    s = stream(spark, sf_dir).select("user_id", "ts", F.unix_millis("ts").alias("at")).withWatermark("ts", "0 seconds").groupBy("user_id")
    out = s.applyInPandasWithState(_until_quiet, "user_id long, n long, last long", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)
    return finish(spark, sf_dir, out, "append")


POLICY = "spark.sql.streaming.multipleWatermarkPolicy"


@R.frame(f"WITH w AS (SELECT ({EPOCH}) // 86400 * 86400 + 86400 AS stop, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max({EPOCH}) AS m FROM events) SELECT 'max' AS policy, stop, 2 * n AS n FROM w, m WHERE stop <= m UNION ALL SELECT 'min', stop, 2 * n FROM w, m WHERE stop <= m - 864000")
def stream_watermark_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inputs whose watermarks are ten days apart: the windows that close by the earlier and by the later one."""
    out, before = None, spark.conf.get(POLICY)
    for policy in ("max", "min"):
        spark.conf.set(POLICY, policy)
        try:
            a, b = (stream(spark, sf_dir).select("ts").withWatermark("ts", delay) for delay in ("0 seconds", "10 days"))
            s = a.union(b).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
            one = finish(spark, sf_dir, s.select(F.lit(policy).alias("policy"), seconds("window.end").alias("stop"), "n"), "append")
        finally:
            spark.conf.set(POLICY, before)
        out = one if out is None else out.union(one)
    return out


@R.frame("SELECT unnest(['one', 'two', 'three']) AS value")
def stream_socket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from a socket, served on the driver's host."""
    import socket
    import threading

    with socket.create_server(("127.0.0.1", 0)) as server:
        server.settimeout(60)

        def serve() -> None:
            with contextlib.suppress(OSError):
                for _ in range(4):  # the source may knock once before it reads
                    peer, _ = server.accept()
                    with contextlib.suppress(OSError):
                        peer.sendall(b"one\ntwo\nthree\n")
                        ended.wait(60)
                    peer.close()

        ended = threading.Event()
        thread = threading.Thread(target=serve, daemon=True)
        thread.start()
        name = f"lines_{uuid.uuid4().hex}"
        lines = spark.readStream.format("socket").option("host", "127.0.0.1").option("port", server.getsockname()[1]).load()
        query = lines.writeStream.format("memory").queryName(name).start()
        for _ in range(120):
            query.processAllAvailable()
            if spark.table(name).count() >= 3:
                break
            query.awaitTermination(0.25)
        ended.set()
        query.stop()
    return spark.table(name)
