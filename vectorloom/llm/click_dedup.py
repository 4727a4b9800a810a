"""Expiring click deduplication by two chained stateful operators of one streaming query.

A key's first row opens a window of ``SPAN`` hours. Later rows up to its deadline are repeats, whatever their
hour; a row past it closes the window and opens the next. A window is also closed when the stream's lower
bound for hours, the largest hour of earlier batches less ``LATENESS``, passes its deadline.

1. The first operator keeps opener and deadline of each open window. It tags rows with the window they belong
   to, adds up the tags of a window in the batch, and sends a control event when it closes one.
2. The second, dealt by window, accumulates a window's counters, puts them out when the window's control event
   comes, and forgets the window.

Keys are dealt to shards of some ``SHARD_ROWS`` rows, so that the number of shards grows with the input; the state
of a shard is one block of bytes with fixed-width records, sorted by key. Every batch brings each shard one control
row with its bounds, so windows of shards without rows close too, and no clock is involved. Equal rows of a batch
are added up before they are written. The rows of one key in one batch are a sequence and meet in one task.

Batches are written once below ``spark.checkpoint.dir``; a batch is moved into the folder that the query watches,
and the query is started anew on its checkpoint until it has read it. A batch that was read is not read
again, and the file sink puts out each window once, whichever executors are lost.

Edge cases: a row without key or hour has no place in the stream and is left out; other nulls count as empty in the
hash; equal rows of a batch are repeats of one another; ties in the hour go by hash; an empty table gives an
empty result; other columns are ignored. A negative key has as many copies as its remainder from 0 to 2.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.session import make_folder, move, remove, shared_folder

SPAN, LATENESS, BATCHES = 72, 48, 12
SHARD_ROWS, PARTITION_SHARDS = 20_000, 4
#: Ends the last batch: every window is past its deadline.
NO_BOUND = 1 << 60
FED = "shard long, key long, hour long, hash binary, n long, floor long, close_below long, batch int"
TAGGED = "key long, start long, hash binary, repeats long, conflicts long, crc long, closed_batch int"
WINDOWS = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string"

_OPEN = np.dtype([("key", "<i8"), ("start", "<i8"), ("hash", "V32")])
_COUNTS = np.dtype([("key", "<i8"), ("start", "<i8"), ("repeats", "<i8"), ("conflicts", "<i8"), ("crc", "<i8")])


def utc_micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is taken as UTC, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_micros(column)
    day, second = F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("long"), F.hour(column) * 3600 + F.minute(column) * 60
    return (day * 86_400 + second) * 1_000_000 + F.expr(f"cast(extract(second from {column}) * 1000000 as long)")


def click_copies(clicks: DataFrame) -> DataFrame:
    """(key, hour, place, hash) of every copy of every row; place is the copy's order of arrival."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = clicks.select(
        F.col("click_id").cast("long").alias("key"), utc_micros(clicks, "arrived_at").alias("arrived"),
        F.concat_ws("|", text(F.col("client_id")), text(F.col("kind")), text(F.floor(F.lit(100) * F.col("value") + F.lit(0.5)).cast("long")), text(utc_micros(clicks, "ts")), text(F.col("props"))).alias("payload"),
    ).where("key is not null and arrived is not null")
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.pmod("key", F.lit(3)).cast("int"))))
    rows = rows.withColumn("c", F.crc32(F.concat_ws(":", "key", "j").cast("binary")))
    hour = F.expr("(arrived - pmod(arrived, 3600000000)) div 3600000000 + 6 * j * (c % 10)")
    rows = rows.withColumn("hour", hour).withColumn("place", F.expr("hour + (c div 10) % 200"))
    return rows.select("key", "hour", "place", F.unhex(F.sha2(F.concat_ws("|", "payload", (F.col("c") % 3).cast("string")), 256)).alias("hash"))


def cut(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The rows (key, hour, place, hash) with their batch: equal ranges of place over all rows. Two numbers reach the driver."""
    low, high = rows.agg(F.min("place"), F.max("place")).first()
    if low is None:
        return rows.select("key", "hour", "hash", F.lit(0).alias("batch"))
    return rows.select("key", "hour", "hash", F.expr(f"(place - {low}L) * {batches} div {high - low + 1}L").cast("int").alias("batch"))


def _by_batch(values: list[int | None]) -> Column:
    """A column's value by the row's batch."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("batch") + 1)


def write_batches(rows: DataFrame, path: str, batches: int, span: int, lateness: int) -> bool:
    """Write (key, hour, hash, batch) as one folder a batch, with bounds and control rows; False if there are no rows."""
    spark = rows.sparkSession
    found = {r["batch"]: r for r in rows.groupBy("batch").agg(F.max("hour").alias("hour"), F.count("*").alias("n")).collect()}  # one row a batch
    if not found:
        return False
    floors, most = [], None
    for b in range(batches):
        floors.append(None if most is None else most - lateness)
        if b in found:
            most = found[b]["hour"] if most is None else max(most, found[b]["hour"])
    bounds = [*floors[1:], NO_BOUND]
    shards = max(1, -(-sum(r["n"] for r in found.values()) // SHARD_ROWS))
    equal = rows.groupBy("batch", "key", "hour", "hash").agg(F.count("*").alias("n"))
    own = equal.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "hour", "hash", "n", _by_batch(floors).alias("floor"), F.lit(None).cast("long").alias("close_below"), "batch")
    none = F.lit(None)
    control = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    control = control.select("shard", none.cast("long").alias("key"), none.cast("long").alias("hour"), none.cast("binary").alias("hash"), F.lit(0).cast("long").alias("n"), none.cast("long").alias("floor"), _by_batch(bounds).alias("close_below"), "batch")
    own.unionByName(control).write.partitionBy("batch").parquet(path)
    return True


def advance(frame: pd.DataFrame, kept: np.ndarray, span: int) -> tuple[pd.DataFrame, np.ndarray]:
    """One batch of a shard: events for the second operator, and the windows that stay open (sorted by key).

    frame: rows and one control row (without key) of the batch; kept: the open windows.
    """
    control = frame["key"].isna()
    bound, batch = int(frame.loc[control, "close_below"].iloc[0]), int(frame["batch"].iloc[0])
    rows = frame.loc[~control, ["key", "hour", "hash", "n"]].sort_values(["key", "hour", "hash"], kind="stable")
    keys = rows["key"].to_numpy(np.int64)
    touched = np.isin(kept["key"], keys)
    before = {k: (s, bytes(h)) for k, s, h in kept[touched].tolist()}
    events: list[tuple] = []
    opened: list[tuple[int, int, bytes]] = []
    last = start = opener = None
    repeats = conflicts = crc = 0

    def leave(closing: bool) -> None:
        if closing or repeats:
            events.append((last, start, opener, repeats, conflicts, crc, batch if closing else None))

    for key, hour, digest, n in zip(keys.tolist(), rows["hour"].to_numpy(np.int64).tolist(), rows["hash"].tolist(), rows["n"].to_numpy(np.int64).tolist()):
        if key != last:
            if last is not None:
                closes = start + span < bound
                leave(closes)
                if not closes:
                    opened.append((last, start, opener))
            last, repeats, conflicts, crc = key, 0, 0, 0
            start, opener = before.get(key, (None, None))
        if start is None or hour > start + span:
            if start is not None:
                leave(True)
            start, opener, repeats, conflicts, crc = hour, digest, 0, 0, 0
            n -= 1
        repeats += n
        if digest != opener:
            conflicts += n
            crc += n * zlib.crc32(digest.hex().encode())
    if last is not None:
        closes = start + span < bound
        leave(closes)
        if not closes:
            opened.append((last, start, opener))
    rest = kept[~touched]
    expired = rest["start"] + span < bound
    events += [(k, s, bytes(h), 0, 0, 0, batch) for k, s, h in rest[expired].tolist()]
    stay = np.concatenate([rest[~expired], np.array(opened, dtype=_OPEN)])
    out = pd.DataFrame(events, columns=["key", "start", "hash", "repeats", "conflicts", "crc", "closed_batch"])
    out["closed_batch"] = out["closed_batch"].astype("Int32")
    return out, stay[np.argsort(stay["key"], kind="stable")]


def accumulate(events: pd.DataFrame, kept: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Add a batch's events to the counters of their windows: rows of the windows that close, counters of the others."""
    columns = ["key", "start", "repeats", "conflicts", "crc"]
    sums = pd.concat([pd.DataFrame({c: kept[c] for c in columns}), events[columns].astype(np.int64)]).groupby(["key", "start"], as_index=False).sum()
    ends = events.loc[events["closed_batch"].notna(), ["key", "start", "hash", "closed_batch"]]
    both = sums.merge(ends, on=["key", "start"], how="left")
    closed = both["closed_batch"].notna()
    stay = np.zeros(int((~closed).sum()), dtype=_COUNTS)
    for c in columns:
        stay[c] = both.loc[~closed, c].to_numpy()
    done = both[closed]
    return pd.DataFrame({
        "click_id": done["key"], "start_hour": done["start"], "closed_batch": done["closed_batch"].astype(np.int64), "n_repeats": done["repeats"],
        "n_conflicts": done["conflicts"], "conflict_crc": done["crc"], "hash": [h.hex() for h in done["hash"]],
    }), stay


def chained(fed: DataFrame, span: int, window_shards: int) -> DataFrame:
    """The two stateful operators over a stream of batches; appends windows as they close."""

    def first(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = np.frombuffer(state.get[0], dtype=_OPEN) if state.exists else np.zeros(0, dtype=_OPEN)
        events, stay = advance(pd.concat(list(frames)), kept, span)
        state.update((stay.tobytes(),))
        yield events

    def second(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = np.frombuffer(state.get[0], dtype=_COUNTS) if state.exists else np.zeros(0, dtype=_COUNTS)
        done, stay = accumulate(pd.concat(list(frames)), kept)
        if len(stay):
            state.update((stay.tobytes(),))
        elif state.exists:
            state.remove()
        yield done

    timely = fed.where("key is null or floor is null or hour >= floor")
    tagged = timely.groupBy("shard").applyInPandasWithState(first, TAGGED, "windows binary", "append", "NoTimeout")
    # dealt by window, so that the windows of a frequent key are spread
    tagged = tagged.withColumn("window_shard", F.pmod(F.xxhash64("key", "start"), F.lit(window_shards)))
    return tagged.groupBy("window_shard").applyInPandasWithState(second, WINDOWS, "counters binary", "append", "NoTimeout")


def stream_windows(rows: DataFrame, batches: int = BATCHES, span: int = SPAN, lateness: int = LATENESS) -> DataFrame:
    """Feed rows (key, hour, hash, batch) to the streaming query, batch by batch; one row per window.

    Every call works in a folder of its own below the shared one; the batches are deleted once they are read.
    """
    spark = rows.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/clicks-{uuid.uuid4().hex}"
    if not write_batches(rows, f"{base}/batches", batches, span, lateness):
        return spark.createDataFrame([], WINDOWS)
    shards = spark.read.schema(FED).parquet(f"{base}/batches").where("batch = 0 and key is null").count()
    session = _own_session(spark, shards)
    make_folder(spark, f"{base}/fed")
    fed = session.readStream.schema(FED).parquet(f"{base}/fed")
    query = chained(fed, span, shards).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    for b in range(batches):
        move(spark, f"{base}/batches/batch={b}", f"{base}/fed/batch={b}")
        query.start(f"{base}/windows").awaitTermination()
        remove(spark, f"{base}/fed/batch={b}")
    for left in ("batches", "fed", "checkpoint"):
        remove(spark, f"{base}/{left}")
    return spark.read.schema(WINDOWS).parquet(f"{base}/windows")


def _own_session(spark: SparkSession, shards: int) -> SparkSession:
    """A session with the same settings for the query.

    It lets one stateful operator follow another (sound here, as the second does not go by event time), keeps
    the state of two batches only and writes no second file of checksums beside each of its files. A partition of
    state writes files in every batch and keeps its place for the life of the checkpoint, so their number goes by
    the shards: at least ``PARTITION_SHARDS`` each, up to the session's number of partitions.
    """
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.streaming.unsupportedOperationCheck", "false")
    session.conf.set("spark.sql.streaming.statefulOperator.checkCorrectness.enabled", "false")
    session.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    session.conf.set("spark.sql.streaming.checkpoint.fileChecksum.enabled", "false")
    partitions = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // PARTITION_SHARDS))
    session.conf.set("spark.sql.streaming.internal.stateStore.partitions", str(partitions))
    return session


def dedup_clicks(clicks: DataFrame) -> DataFrame:
    """The windows of all copies of the clicks: id, start, closing batch, repeats, conflicts and the opener's hash."""
    return stream_windows(cut(click_copies(clicks)))
