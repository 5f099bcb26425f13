"""Sequential rules: what happens to a row depends on all rows of its key before it.

A step keeps a small state by key and takes rows in order. ``ordered_fold`` runs
it over a table: rows are dealt by key and sorted, each task reads them in Arrow
batches and carries the state from one to the next, so a key of any size needs
memory for one batch only. ``fleetlake.streaming.folds`` runs the same steps over
streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Admission:
    """In order: a task is admitted if its watts still fit, else it waits and later ones may fit."""

    state, out = "used long", "task long, admitted boolean"

    def __init__(self, budget: int):
        self.budget = budget

    def start(self) -> tuple:
        return (0,)

    def advance(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        used, admitted = state[0], []
        for watts in rows["watts"].tolist():
            fits = used + watts <= self.budget
            used += watts if fits else 0
            admitted.append(fits)
        return (used,), pd.DataFrame({"task": rows["task"], "admitted": admitted})


class TokenBucket:
    """Starts full, fills by ``refill`` a second up to ``capacity``; a paused call is refused and leaves the clock as it is."""

    state, out = "tokens double, at double", "seq long, allowed boolean, tokens double"

    def __init__(self, capacity: float, refill: float):
        self.capacity, self.refill = float(capacity), float(refill)

    def start(self) -> tuple:
        return (self.capacity, None)

    def advance(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        tokens, at = state
        out = []
        for seq, now, size, paused in zip(rows["seq"].tolist(), rows["at"].tolist(), rows["bytes"].tolist(), rows["paused"].tolist(), strict=True):
            if not paused:
                tokens = min(self.capacity, tokens + (now - (now if at is None else at)) * self.refill)
                at = now
            allowed = not paused and tokens >= size
            tokens -= size if allowed else 0
            out.append((seq, allowed, tokens))
        return (tokens, at), pd.DataFrame(out, columns=["seq", "allowed", "tokens"])


class StrictOrder:
    """A position must be the expected one; others are rejected and change nothing, a reset starts again at 0."""

    state, out = "expected long", "ord long, accepted boolean, reason string"

    def start(self) -> tuple:
        return (0,)

    def advance(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        expected, out = state[0], []
        for order, pos, reset in zip(rows["ord"].tolist(), rows["pos"].tolist(), rows["reset"].tolist(), strict=True):
            expected = 0 if reset else expected
            good = pos == expected
            out.append((order, good, "" if good else f"out-of-order: got {pos}, expects {expected}"))
            expected += good
        return (expected,), pd.DataFrame(out, columns=["ord", "accepted", "reason"])


class Streak:
    """Failures since the last success."""

    state, out = "streak long", "seq long, streak long, offline boolean"

    def __init__(self, limit: int = 3):
        self.limit = limit

    def start(self) -> tuple:
        return (0,)

    def advance(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        streak, out = state[0], []
        for seq, verb in zip(rows["seq"].tolist(), rows["verb"].tolist(), strict=True):
            streak = streak + 1 if verb == "failure" else 0
            out.append((seq, streak, verb == "failure" and streak >= self.limit))
        return (streak,), pd.DataFrame(out, columns=["seq", "streak", "offline"])


class DeltaMemory:
    """A matrix by key that decays, learns the error of what it recalls for ``k`` and answers ``q``."""

    state, out = "s array<double>", "pos long, y array<double>"

    def __init__(self, size: int):
        self.size = size

    def start(self) -> tuple:
        return ([0.0] * self.size**2,)

    def advance(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        s = np.array(state[0], float).reshape(self.size, self.size)
        out = []
        for row in rows.itertuples(index=False):
            q, k, v = (np.asarray(x, float) for x in (row.q, row.k, row.v))
            s = s * np.exp(row.gate)
            s = s + np.outer(k, row.beta * (v - k @ s))
            out.append((row.pos, (q @ s).tolist()))
        return (s.ravel().tolist(),), pd.DataFrame(out, columns=["pos", "y"])


class Utf8Decoder:
    """Text of byte pieces as soon as its characters are whole; up to three bytes wait for the next piece."""

    state, out = "rest binary", "pos long, text string, waiting int"

    def start(self) -> tuple:
        return (b"",)

    def advance(self, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        decoder.setstate((bytes(state[0]), 0))
        out = []
        for pos, piece in zip(rows["pos"].tolist(), rows["piece"].tolist(), strict=True):
            text = decoder.decode(bytes(piece))
            out.append((pos, text, len(decoder.getstate()[0])))
        return (decoder.getstate()[0],), pd.DataFrame(out, columns=["pos", "text", "waiting"])

    def finish(self, state: tuple) -> pd.DataFrame | None:
        if not state[0]:
            return None
        return pd.DataFrame({"pos": [None], "text": [bytes(state[0]).decode("utf-8", "replace")], "waiting": [0]})


def ordered_fold(df: DataFrame, key: str, order: list, step) -> DataFrame:
    """(key, columns of the step). Rows without a key are left out; ``order`` should have no ties."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = state = None
        for rows in batches:
            starts = rows[key].ne(rows[key].shift()).cumsum()
            for _, part in rows.groupby(starts, sort=False):
                k = part[key].iat[0]
                if state is None or k != last:
                    yield from ended(last, state)
                    last, state = k, step.start()
                state, out = step.advance(state, part)
                yield named(k, out)
        yield from ended(last, state)

    def named(k, out: pd.DataFrame) -> pd.DataFrame:
        out.insert(0, key, k)
        return out

    def ended(k, state) -> Iterator[pd.DataFrame]:
        out = step.finish(state) if state is not None and hasattr(step, "finish") else None
        if out is not None:
            yield named(k, out)

    dealt = df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(run, f"{key} {kind}, {step.out}")
