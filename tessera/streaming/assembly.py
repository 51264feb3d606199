"""Frames from a stream of acquisition lines, and imaging frames that wait for their calibration.

Completion is by coverage: a frame is whole when its exact set of lines has come, whatever the time. State is kept by frame
key; what comes after a frame is whole is not dropped but given out as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def assembled_stream(lines: DataFrame, key: list[str], required: int, coordinate: str = "ky", policy: str = "reject", idle_ms: int | None = None) -> DataFrame:
    """key, status, covered, lines from a stream of lines (key, coordinate, payload string).

    status complete: a frame's required lines have all come (once a frame); late: a line for a complete frame; duplicate: a
    second line of a coordinate under policy reject (under ignore_identical only one that differs; under
    replace_before_seal none); incomplete: with `idle_ms` set, a frame without its lines for so many
    milliseconds. Without it the state of a whole frame, its coordinates, is kept, so that late lines are told from new ones.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen: dict[int, str] = {}
        done = False
        if state.exists:
            coords, payloads, done = state.get
            seen = dict(zip(coords, payloads, strict=True))
        out = []
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame([[*k, "incomplete", len(seen), sorted(seen)]], columns=[*key, "status", "covered", "lines"])
            return
        for batch in batches:
            for c, p in zip(batch[coordinate].tolist(), batch["payload"].tolist(), strict=True):
                c = int(c)
                if done:
                    out.append([*k, "late", len(seen), [c]])
                    continue
                if c in seen:
                    if policy == "reject" or policy == "ignore_identical" and seen[c] != p:
                        out.append([*k, "duplicate", len(seen), [c]])
                        continue
                    if policy == "replace_before_seal":
                        seen[c] = p
                    continue
                if not 0 <= c < required:
                    out.append([*k, "unexpected", len(seen), [c]])
                    continue
                seen[c] = p
                if len(seen) == required:
                    done = True
                    out.append([*k, "complete", required, sorted(seen)])
        # the payloads of a whole frame have gone out with it and needn't be kept
        state.update((sorted(seen), ["" if done else seen[c] for c in sorted(seen)], done))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=[*key, "status", "covered", "lines"])

    kinds = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in key)
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return lines.groupBy(*key).applyInPandasWithState(step, f"{kinds}, status string, covered int, lines array<int>", "coords array<int>, payloads array<string>, done boolean", "append", timeout)


def gated_stream(frames: DataFrame, tokens: DataFrame, key: str, idle_ms: int | None = None, most_waiting: int = 1024) -> DataFrame:
    """key, status, frame from a stream of frames (key, frame string) and one of calibration tokens (key).

    status pass: a frame whose token has come, at once or when it comes; duplicate_token: a second token of a key; horizon: a
    frame beyond `most_waiting` that wait for one token; missing_token: with `idle_ms` set, a frame that has waited so
    many milliseconds without one. The state of a key is whether its token came and the frames that wait for it, `most_waiting` of them at most; with `idle_ms`
    it ends when nothing more comes of the key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ready, waiting = state.get if state.exists else (False, [])
        waiting = list(waiting)
        out: list[tuple] = []
        if state.hasTimedOut:
            state.remove()
            out = [(*k, "missing_token", f) for f in waiting]
        else:
            for batch in batches:
                # tokens first: which of a batch came first isn't known
                for frame in sorted(batch["frame"].tolist(), key=lambda f: (f is not None, f or "")):
                    if frame is None:
                        if ready:
                            out.append((*k, "duplicate_token", None))
                        else:
                            ready = True
                            out += [(*k, "pass", f) for f in waiting]
                            waiting = []
                    elif ready:
                        out.append((*k, "pass", frame))
                    elif len(waiting) < most_waiting:
                        waiting.append(frame)
                    else:
                        out.append((*k, "horizon", frame))
            state.update((ready, waiting))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=[key, "status", "frame"])

    both = frames.select(key, F.col("frame").cast("string").alias("frame")).unionByName(tokens.select(key, F.lit(None).cast("string").alias("frame")))
    kind = frames.schema[key].dataType.simpleString()
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return both.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string, frame string", "ready boolean, waiting array<string>", "append", timeout)
