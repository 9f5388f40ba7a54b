"""Stateful operators on streams: chunk scans, admission limits, suppression of repeats, windowed counts."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilframe.operators.scan import ScanConfig, prepared


def clamp(buffer_size: int = 4096, overlap: int = 256) -> tuple[int, int]:
    size = min(max(buffer_size, 1024), 100 * 1024 * 1024)
    return size, min(max(overlap, 0), size // 2)


def tail(text: str, most: int) -> str:
    """The last bytes of a text, cut at a character."""
    return text.encode("utf-8")[-most:].decode("utf-8", "ignore") if most else ""


def scan_chunks(chunks: DataFrame, buffer_size: int = 4096, overlap: int = 256, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings of a stream of (stream_id, seq, chunk): (stream_id, sub_category, match_text, span_start).

    A stream's text is gathered until the buffer is full, scanned, and its tail kept for matches on the border.
    Spans count bytes of the stream, and a match that lies wholly in the kept tail is reported once.
    """
    size, keep = clamp(buffer_size, overlap)
    every = replace(config, deduplicate=False)  # overlaps are left to the reader, who sees the borders

    def scanned(stream_id: str, held: str, offset: int, old: int) -> list[tuple]:
        found = prepared(every).scan(held, other_readings=False)[0]
        return [(stream_id, sub, value, offset + start) for _, sub, value, start, end, *_ in found if end > old]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, offset, old = state.get if state.exists else ("", 0, 0)
        out = []
        rows = [r for f in frames for r in zip(f["seq"], f["chunk"], f["last"])]
        for _, chunk, last in sorted(rows, key=lambda r: r[0]):
            held += chunk or ""
            if len(held.encode("utf-8")) >= size or last:
                out += scanned(key[0], held, offset, old)
                rest = "" if last else tail(held, keep)
                offset += len(held.encode("utf-8")) - len(rest.encode("utf-8"))
                held, old = rest, len(rest.encode("utf-8"))
        state.update((held, offset, old))
        yield pd.DataFrame(out, columns=["stream_id", "sub_category", "match_text", "span_start"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, sub_category string, match_text string, span_start bigint", "held string, offset bigint, old bigint", "append", GroupStateTimeout.NoTimeout)


def sliding_admission(requests: DataFrame, most: int, window_us: int) -> DataFrame:
    """(client_id, at_us, admitted) of a stream: admitted while fewer than ``most`` admitted ones lie in the window before."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for at in sorted(int(x) for f in frames for x in f["at_us"]):
            held = [x for x in held if x > at - window_us]
            admitted = len(held) < most
            if admitted:
                held.append(at)
            out.append((key[0], at, admitted))
        state.update((held,))
        yield pd.DataFrame(out, columns=["client_id", "at_us", "admitted"])

    return requests.groupBy("client_id").applyInPandasWithState(step, "client_id string, at_us bigint, admitted boolean", "held array<bigint>", "append", GroupStateTimeout.NoTimeout)


def with_island(rows: DataFrame, key: str, window_us: int) -> DataFrame:
    """Adds ``island``: runs of non-empty windows of a key.  Rows of different islands are more than a window
    apart, so a fold with that memory may start anew in each: a hot key falls into many independent groups."""
    held = rows.select(key, F.floor(F.col("at_us") / window_us).alias("w")).distinct()
    order = Window.partitionBy(key).orderBy("w")
    starts = held.withColumn("opens", (F.coalesce(F.col("w") - F.lag("w").over(order), F.lit(2)) > 1).cast("int"))
    islands = starts.withColumn("island", F.sum("opens").over(order)).select(key, "w", "island")
    return rows.withColumn("w", F.floor(F.col("at_us") / window_us)).join(islands, [key, "w"]).drop("w")


def folded(rows: DataFrame, key: str, fold, schema: str) -> DataFrame:
    """Streams the rows of every (key, island) in order of time through ``fold``; memory is one Arrow batch."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(n, key, "island").sortWithinPartitions(key, "island", "at_us", "id").mapInPandas(fold, schema)


def sliding_admission_batch(requests: DataFrame, most: int, window_us: int) -> DataFrame:
    """The same over a batch of (client_id, id, at_us): (client_id, id, admitted)."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for frame in frames:
            out = []
            for client, island, at in zip(frame["client_id"], frame["island"], frame["at_us"]):
                if (client, island) != now:
                    now, held = (client, island), []
                held = [x for x in held if x > at - window_us]
                out.append(len(held) < most)
                if out[-1]:
                    held.append(at)
            yield pd.DataFrame({"client_id": frame["client_id"], "id": frame["id"], "admitted": out})

    kind = requests.schema["id"].dataType.simpleString()
    return folded(with_island(requests, "client_id", window_us), "client_id", fold, f"client_id string, id {kind}, admitted boolean")


def remaining(admitted: DataFrame, most: int, window_us: int, now_us: int) -> DataFrame:
    """(client_id, left): requests that each client may still make now; clients without a request in the window have all."""
    live = (F.col("at_us") > now_us - window_us) & (F.col("at_us") <= now_us) & F.col("admitted")
    return admitted.groupBy("client_id").agg(F.greatest(F.lit(most) - F.count_if(live), F.lit(0)).alias("left"))


def fixed_window_admission(requests: DataFrame, most: int, window_us: int) -> DataFrame:
    """Requests with ``admitted``: the first ``most`` of each client and window, ties by id."""
    bucket = F.floor(F.col("at_us") / window_us)
    order = Window.partitionBy("client_id", bucket).orderBy("at_us", "id")
    return requests.withColumn("admitted", F.row_number().over(order) <= most)


def stored_once(writes: DataFrame, window_us: int) -> DataFrame:
    """Ids of the writes that are kept: none with an equal hash was kept in the window before."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for frame in frames:
            keep = []
            for h, island, at in zip(frame["input_hash"], frame["island"], frame["at_us"]):
                if (h, island) != now:
                    now, last = (h, island), None
                keep.append(last is None or at - last >= window_us)
                last = at if keep[-1] else last
            yield frame.loc[keep, ["id"]]

    kind = writes.schema["id"].dataType.simpleString()
    return folded(with_island(writes, "input_hash", window_us), "input_hash", fold, f"id {kind}")


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts per window and type with a watermark for late events; for streams and batches."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def deduplicated_stream(writes: DataFrame, time: str = "created_at", late: str = "60 seconds") -> DataFrame:
    return writes.withWatermark(time, late).dropDuplicatesWithinWatermark(["input_hash"])


# ---------------------------------------------------------------------------------- audit chain
def audit_chain(events: DataFrame, key: bytes) -> DataFrame:
    """Signs events of each stream in order; every signature covers the one before.

    A chain is sequential by nature: one chain per ``source``, so chains run in parallel and a task holds one batch
    of a sorted group at a time.
    """

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        previous: dict[str, str] = {}
        for frame in frames:
            made = []
            for r in frame.itertuples(index=False):
                before = previous.get(r.source, "")
                body = json.dumps({"id": r.id, "at_us": int(r.at_us), "action": r.action, "prev": before}, sort_keys=True)
                previous[r.source] = hmac.new(key, body.encode(), hashlib.sha256).hexdigest()
                made.append((r.source, r.id, int(r.at_us), r.action, before, previous[r.source]))
            yield pd.DataFrame(made, columns=["source", "id", "at_us", "action", "prev_signature", "signature"])

    rows = events.select("source", "id", "at_us", "action")
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(n, "source").sortWithinPartitions("source", "at_us", "id").mapInPandas(sign, "source string, id string, at_us bigint, action string, prev_signature string, signature string")


def broken_links(chain: DataFrame) -> DataFrame:
    """Rows whose previous signature isn't the signature of the row before."""
    before = F.lag("signature", 1, "").over(Window.partitionBy("source").orderBy("at_us", "id"))
    return chain.withColumn("expected", before).where("prev_signature <> expected")
