"""The streaming edition: trace ingestion, resume, rings, sessions and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

CALLS, PERIOD = 32, 60


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A Parquet folder or file as a stream, a bounded number of files to a batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run what is there into a Parquet folder and end; exactly once for each checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def resumed(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first row of each key, with state kept for as long as rows may be late."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def session_activity(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(key, w).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def window_counts(stream: DataFrame, ts: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(*keys, w).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("start"), "n")


def rate_limited(stream: DataFrame, ts: str, calls: int = CALLS, period: int = PERIOD, late: str = "10 minutes") -> DataFrame:
    """Sliding windows that hold more calls than allowed."""
    return window_counts(stream, ts, f"{period} seconds", f"{max(1, period // 4)} seconds", late).where(F.col("n") > calls)


def ring_states(stream: DataFrame, key: str, ts: str, item: str, size: int = 10) -> DataFrame:
    """The last `size` items of each key after every batch: key, items, seen (state in the store, bounded by `size`)."""
    kind = dict(stream.dtypes)[key]

    def step(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, seen = (list(map(tuple, zip(*state.get[:2]))), state.get[2]) if state.exists else ([], 0)
        for frame in frames:
            seen += len(frame)
            held += list(zip(frame[ts].astype("int64") // 1000, frame[item].astype("int64")))
            held = sorted(held)[-size:]
        state.update(([int(t) for t, _ in held], [int(i) for _, i in held], int(seen)))
        yield pd.DataFrame({key: [group[0]], "items": [[int(i) for _, i in held]], "seen": [seen]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, items array<long>, seen long", "ts array<long>, items array<long>, seen long", "update", "NoTimeout")


def admissions(stream: DataFrame, key: str, ts: str, item: str, calls: int = CALLS, period: int = PERIOD, retries: int = 4, backoff: int = 2) -> DataFrame:
    """(key, item, wait_us, attempts, admitted): each key's calls under a limit of `calls` in any `period` seconds.

    A call waits until the slot of the call `calls` before it is free. Attempts
    come after backoff, 2 backoff, ... seconds more each time; a call whose slot
    isn't free by the last retry is refused and takes none. State: the times of
    the last `calls` admitted ones. Calls of a batch are taken in order of time.
    """
    kinds = dict(stream.dtypes)
    waits = [sum(backoff * 1_000_000 * k for k in range(1, n + 1)) for n in range(retries + 1)]

    def step(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values([ts, item])
        out = []
        for at, name in zip(rows[ts].astype("int64") // 1000, rows[item]):
            free = held[0] + period * 1_000_000 if len(held) >= calls else at
            wait = max(0, int(free - at))
            attempt = next((n for n, w in enumerate(waits) if w >= wait), None)
            if attempt is not None:
                held = [*held, int(at) + wait][-calls:]
            out.append((group[0], name, wait, retries + 1 if attempt is None else attempt + 1, attempt is not None))
        state.update((held,))
        yield pd.DataFrame(out, columns=[key, item, "wait_us", "attempts", "admitted"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {item} {kinds[item]}, wait_us long, attempts int, admitted boolean", "held array<long>", "append", "NoTimeout")


TAGS = {"<thinking>": "thinking", "</thinking>": "answer", "<answer>": "answer", "</answer>": "answer"}
_LONGEST = max(map(len, TAGS))
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def split_step(mode: str, held: str, text: str) -> tuple[str, str, list[tuple[str, str]]]:
    """(mode, held, [(kind, text)]): what more text says, and what of its end is held back since it may begin a tag.

    Text inside thinking tags is thinking, other text the answer. What is held
    back has fewer letters than the longest tag.
    """
    text, out, at = held + text, [], 0

    def say(part: str) -> None:
        if part and out and out[-1][0] == mode:
            out[-1][1].append(part)
        elif part:
            out.append((mode, [part]))

    while at < len(text):
        nxt = text.find("<", at)
        if nxt < 0:
            say(text[at:])
            at = len(text)
            break
        say(text[at:nxt])
        at = nxt
        tag = next((t for t in TAGS if text.startswith(t, at)), None)
        if tag:
            mode, at = TAGS[tag], at + len(tag)
        elif len(text) - at < _LONGEST and any(t.startswith(text[at:]) for t in TAGS):
            break
        else:
            say("<")
            at += 1
    return mode, text[at:], [(kind, "".join(parts)) for kind, parts in out]


class TagSplitter(StatefulProcessor):
    """A key's tokens in, its thinking and answer out as they become certain.

    State: which of both is being said, the end that is held back, and how many
    pieces came; it doesn't grow with the text, and goes `idle` milliseconds after the last token (0: never).
    """

    def __init__(self, key: str, order: str, token: str, idle: int = 0):
        self.key, self.order, self.token, self.idle = key, order, token, idle

    def init(self, handle) -> None:
        self.state = handle.getValueState("split", "mode string, held string, n long", self.idle or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mode, held, n = self.state.get() if self.state.exists() else ("answer", "", 0)
        frame = pd.concat(list(rows)).sort_values(self.order)
        mode, held, found = split_step(mode, held, "".join(t for t in frame[self.token] if t is not None))
        self.state.update((mode, held, int(n) + len(found)))
        yield pd.DataFrame({self.key: [key[0]] * len(found), "n": range(int(n), int(n) + len(found)), "kind": pd.Series([k for k, _ in found], dtype=object), "text": pd.Series([t for _, t in found], dtype=object)})

    def close(self) -> None:
        pass


def split_tags(stream: DataFrame, key: str, order: str, token: str, idle: int = 0) -> DataFrame:
    """(key, n, kind, text): thinking and answer of each key's token stream, in pieces numbered from 0; tags may be cut anywhere.

    Tokens of a batch are taken in order, and batches as they come. Runs on the
    RocksDB store (set `spark.sql.streaming.stateStore.providerClass` to ROCKSDB).
    """
    kind = dict(stream.dtypes)[key]
    mode = "ProcessingTime" if idle else "None"
    return stream.groupBy(key).transformWithStateInPandas(TagSplitter(key, order, token, idle), f"{key} {kind}, n long, kind string, text string", "Append", mode)


def split_text(text: str) -> tuple[str, str]:
    """What is inside thinking tags, and what is outside of them; an end that may begin a tag is held back."""
    parts = {"thinking": [], "answer": []}
    for kind, part in split_step("answer", "", text)[2]:
        parts[kind].append(part)
    return "".join(parts["thinking"]).strip(), "".join(parts["answer"]).strip()
