"""Streams: windows with watermarks, sliding early results, stateful last-seen times, and upsert sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenlog.operators.templates import Representatives, words


def interval_counts(stream: DataFrame, length: str = "10 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(source_id, message_id, start, n): messages (source_id, message_id, ts) per tumbling or sliding window.

    Late messages count in the window of their own time up to the watermark; later ones are dropped (a batch reference run
    would put them into the window that is open)."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(window.alias("w"), "source_id", "message_id").agg(F.count(F.lit(1)).alias("n")).select("source_id", "message_id", F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(source_id, start, end, n): runs without a gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "source_id").agg(F.count(F.lit(1)).alias("n")).select("source_id", "w.start", "w.end", "n")


def last_seen(stream: DataFrame, ttl_ms: int = 30 * 86_400_000) -> DataFrame:
    """(source_id, message_id, ms, since_ms, status): time since the id's last message in its source; NEW for the first.

    State is one number per source and id, dropped after ``ttl_ms`` without a message."""

    def step(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = sorted(t for b in batches for t in b["ms"])
        since = [None if p is None else t - p for p, t in zip([last, *times], times, strict=False)]
        state.update((max([times[-1], *([last] if last is not None else [])]),))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"source_id": key[0], "message_id": key[1], "ms": times, "since_ms": pd.array(since, "Int64"), "status": ["NEW" if s is None else "REGULAR" for s in since]})

    return stream.select("source_id", "message_id", "ms").groupBy("source_id", "message_id").applyInPandasWithState(step, "source_id string, message_id string, ms long, since_ms long, status string", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def text_ids(stream: DataFrame, ttl_ms: int = 90 * 86_400_000) -> DataFrame:
    """(component, text, message_id, is_new): each text's message id, that of the most recently used representative of its component within the threshold.

    State is a component's list of representatives in the order of their use, with its next number; it is dropped after ``ttl_ms`` without a
    message. Texts of a batch are taken in the order of ``ms``, then text. Components are independent of each other and spread over the tasks."""

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = Representatives()
        before = json.loads(state.get[0]) if state.exists else {"words": [], "used": []}
        for line in before["words"]:
            known.add(line)
        known.used, known.clock = before["used"], max(before["used"], default=0)
        rows = pd.concat(list(batches)).sort_values(["ms", "text"])
        ids, fresh = [], []
        for text in rows["text"]:
            mine = [w for w, _ in words(text)]
            number = known.find(mine)
            fresh.append(number is None)
            ids.append(known.add(mine) if number is None else number)
        state.update((json.dumps({"words": known.words, "used": known.used}),))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"component": key[0], "text": rows["text"].to_numpy(), "message_id": [f"{key[0]}_{n}" for n in ids], "is_new": fresh})

    kept = stream.where("text is not null").select(F.coalesce("component", F.lit("(NO_COMPONENT)")).alias("component"), "text", "ms")
    return kept.groupBy("component").applyInPandasWithState(step, "component string, text string, message_id string, is_new boolean", "representatives string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def idle_flushed(stream: DataFrame, length_ms: int, idle_ms: int = 30_000) -> DataFrame:
    """(source_id, frame, n, flushed): messages per frame of each source; a frame is closed by the first message of a later one, or (``flushed``) when nothing
    came from the source for ``idle_ms``. A message older than the open frame counts in the open one."""

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            frame, n = state.get
            state.remove()
            yield pd.DataFrame({"source_id": [key[0]], "frame": [frame], "n": [n], "flushed": [True]})
            return
        frame, n = state.get if state.exists else (None, 0)
        done: list[tuple[int, int]] = []
        for t in sorted(t for b in batches for t in b["ms"]):
            at = t - t % length_ms
            if frame is not None and at > frame:
                done.append((frame, n))
                n = 0
            frame, n = (at if frame is None else max(at, frame)), n + 1
        state.update((frame, n))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"source_id": key[0], "frame": [f for f, _ in done], "n": [k for _, k in done], "flushed": False})

    return stream.select("source_id", "ms").groupBy("source_id").applyInPandasWithState(step, "source_id string, frame long, n long, flushed boolean", "frame long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def fanned_out(stream: DataFrame, targets: dict[str, tuple[str, Callable[[DataFrame], None]]], checkpoint: str) -> object:
    """Starts a query that hands each micro-batch to several targets: name -> (condition on its rows, write). The batch is computed once."""

    def each(df: DataFrame, _: int) -> None:
        df = df.persist()
        try:
            for condition, write in targets.values():
                write(df.where(condition))
        finally:
            df.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).start()


def upserted(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str) -> object:
    """Starts a query that hands each micro-batch to ``write``; a batch that runs again replaces itself, as writes are upserts."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: write(df)).start()
