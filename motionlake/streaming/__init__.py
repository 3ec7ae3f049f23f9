"""Streaming twins of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from motionlake.operators.match import REPLAY, Rules, State, Walk

_STATE = "points_a int, points_b int, games_a int, games_b int, sets_a int, sets_b int, server string, tiebreak_first string, ends_swapped boolean, winner string, set_scores string, unresolved int, last long"


def _pack(w: Walk, last: int) -> tuple:
    s = w.state
    return (*s.points, *s.games, *s.sets, s.server, s.tiebreak_first, s.ends_swapped, s.winner, w.sets, w.unresolved, last)


def _unpack(v: tuple, w: Walk) -> int:
    w.state, w.sets, w.unresolved = State(tuple(v[0:2]), tuple(v[2:4]), tuple(v[4:6]), v[6], v[7], v[8], v[9]), v[10], v[11]
    return v[12]


def replay_stream(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(match_id, sequence, ...): the score after each event of a stream (match_id, sequence, winner).

    The state of a match is its score and the last sequence number; an event at or before that has
    been seen and is passed over, so a replayed source changes nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        walk = Walk(rules)
        last = _unpack(state.get, walk) if state.exists else -1
        out = []
        rows = pd.concat(list(batches)).sort_values("sequence", kind="stable")
        for n, w in rows[["sequence", "winner"]].itertuples(index=False):
            if n <= last:
                continue
            walk.point(w)
            last = int(n)
            out.append((key[0], last, *walk.shown()))
        state.update(_pack(walk, last))
        yield pd.DataFrame(out, columns=["match_id", "sequence", *(x.split()[0] for x in REPLAY.split(", "))])

    return events.groupBy("match_id").applyInPandasWithState(step, f"match_id string, sequence long, {REPLAY}", _STATE, "append", GroupStateTimeout.NoTimeout)


def throttle_stream(opens: DataFrame, least_gap_s: float) -> DataFrame:
    """(user_id, at_s): opens that are recorded when each must follow the last recorded one by a gap."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(pd.concat(list(batches))["at_s"]):
            if last is None or t - last >= least_gap_s:
                last = float(t)
                out.append((key[0], last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "at_s"])

    return opens.groupBy("user_id").applyInPandasWithState(step, "user_id long, at_s double", "last double", "append", GroupStateTimeout.NoTimeout)


def quiet_sessions(events: DataFrame, key: str, time: str, quiet: str = "2500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(key, window, n, total): runs of events closed by quiet; late events count until the watermark passes."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, quiet), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sampled(events: DataFrame, key: str, time: str, width: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(key, window, dx, dy, n): one row for each tumbling window."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"), F.count(F.lit(1)).alias("n"))
