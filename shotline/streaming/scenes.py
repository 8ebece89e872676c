"""The fold over streams: cuts per video with keyed state.

Scores of a video may come in any order: a score waits in a map until all before it are there, so a batch reads and writes
only what it needs of the state. One at or before the last frame folded (a replay) is ignored, so at-least-once delivery
gives each cut once. A gap that does not close fails the query once more than ``most_held`` scores wait for it, and no
score is dropped; with ``idle_ms`` a video that brings no score for so long, and for which none waits, leaves the state, while one
with a gap fails the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
TOLD = "video_id string, frame_number long, pts double, cut boolean, folded long"


def step(since: int, intra: int | None, score: int, base: tuple[int, int]) -> bool:
    """Whether a pair is a cut, ``since`` steps after the last one."""
    t1 = base[0] + (15 * (10 - since) ** 2 if 0 < since < 10 else 0)
    t2 = base[1] + (4 * (30 - since) if 0 < since < 30 else 0)
    return (intra is not None and intra > t1) or score > t2


class Follow(StatefulProcessor):
    """Folds the scores of a video. Tells cuts, every ``every``-th frame, and the last frame that a batch folds, with the frames folded so far."""

    def __init__(self, base: tuple[int, int], skip: int, most_held: int, every: int, idle_ms: int) -> None:
        self.base, self.by, self.most_held, self.every, self.idle_ms = base, skip + 1, most_held, every, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "since int, last long, held long, folded long, timer long")
        self.waiting = handle.getMapState("waiting", "number long", "intra int, score int, pts double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since, last, held, folded, timer = self.at.get() if self.at.exists() else (1, 0, 0, 0, 0)
        # scores of this batch are folded from memory; only those that must wait longer go to the state
        fresh = {}
        for batch in rows:
            times = batch["pts"] if "pts" in batch else [None] * len(batch)
            for number, intra, score, pts in zip(batch["frame_number"].tolist(), batch["intra_key"].tolist(), batch["ssad_score"].tolist(), times, strict=True):
                if number > last:
                    fresh[number] = (None if pd.isna(intra) else int(intra), score, None if pts is None or pd.isna(pts) else float(pts))
        told, before = [], folded
        while True:
            number = last + self.by
            if number in fresh:
                found = fresh.pop(number)
            elif held and self.waiting.containsKey((number,)):
                found = self.waiting.getValue((number,))
                self.waiting.removeKey((number,))
                held -= 1
            else:
                break
            last, folded = number, folded + 1
            cut = step(since, found[0], found[1], self.base)
            since = 1 if cut else min(since + 1, 30)
            if cut or (self.every and number % self.every == 0):
                told.append((key[0], number, found[2], cut, folded))
        for number, found in fresh.items():
            held += not self.waiting.containsKey((number,))
            self.waiting.updateValue((number,), found)
        if held > self.most_held:
            raise ValueError(f"video {key[0]}: {held} scores wait for frame {last + self.by}")
        if self.every and folded > before and (not told or told[-1][1] != last):
            told.append((key[0], last, None, False, folded))
        if self.idle_ms:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.at.update((since, last, held, folded, timer))
        if told:
            video, number, pts, cut, done = zip(*told, strict=True)
            yield pd.DataFrame({"video_id": video, "frame_number": pd.Series(number, dtype="int64"), "pts": pd.Series(pts, dtype="float64"), "cut": pd.Series(cut, dtype="bool"), "folded": pd.Series(done, dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, last, held, _, _ = self.at.get()
        if held:
            raise ValueError(f"video {key[0]}: {held} scores wait for frame {last + self.by}, and none came for {self.idle_ms} ms")
        self.at.clear()
        self.waiting.clear()
        yield from ()

    def close(self) -> None:
        pass


def followed(scores: DataFrame, base: tuple[int, int] = (2000, 90), skip: int = 0, most_held: int = 100_000, every: int = 0, idle_ms: int = 0) -> DataFrame:
    """(video_id, frame_number, pts, cut, folded): cuts, and with ``every`` also how far each batch got."""
    spark = scores.sparkSession
    if spark.conf.get(PROVIDER) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)  # state with maps and timers has no other store
    own = ["video_id", "frame_number", "intra_key", "ssad_score", *[c for c in scores.columns if c == "pts"]]
    processor = Follow(base, skip, most_held, every, idle_ms)
    return scores.select(*own).groupBy("video_id").transformWithStateInPandas(processor, TOLD, "Append", "ProcessingTime" if idle_ms else "None")


def stream_cuts(scores: DataFrame, base: tuple[int, int] = (2000, 90), skip: int = 0, most_held: int = 100_000, idle_ms: int = 0) -> DataFrame:
    """(video_id, frame_number) of cuts from a stream with video_id, frame_number, intra_key, ssad_score.

    Scores of a video are numbered ``skip + 1``, twice that, and so on, as ``score_frames`` gives them.
    """
    return followed(scores, base, skip, most_held, 0, idle_ms).select("video_id", "frame_number")
