"""Who won a rally: ordered rules on its end, with fault memory and the running score."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from motionlake.operators.match import Rules, State, Walk, end_of, other, side

INFERRED = "winner string, basis string, needs_review boolean, fault boolean, display string, server string"

#: What a rally has to say, in columns.  Ends are near, far or null; calls are in, out, too_close or
#: null where none may be made.  first_end and first_call are of the rally's first landing, last_end and
#: last_call of the first bounce of its last shot; box_<end>_<side> is the call of the first landing
#: against that service box, one for each box, so that the running score only has to pick.
RALLY = ("strokes", "reason", "landings", "first_end", "first_call", "last_end", "last_call", "box_near_deuce", "box_near_ad", "box_far_deuce", "box_far_ad")


def swap(end: str) -> str:
    return "far" if end == "near" else "near"


def player_at(end: str, s: State) -> str:
    return "A" if end == end_of("A", s) else "B"


def serve_seen(rally: dict, s: State) -> bool:
    """Whether the first landing can be the serve's: nobody else is known to have struck it."""
    return bool(rally["landings"]) and rally["first_end"] in (None, end_of(s.server, s))


def serve_call(rally: dict, s: State) -> str | None:
    """The call of the serve against the box that it must land in."""
    if not serve_seen(rally, s) or rally["first_call"] is None:
        return None
    return rally[f"box_{swap(end_of(s.server, s))}_{side(s)}"]


def outcome(rally: dict, s: State, faults: int) -> tuple[str | None, str, bool, bool]:
    """(winner, basis, needs_review, fault) of one rally; a case without a certain winner needs review.

    In this order: a serve that was the only shot and is out, close or not to be called; the net; a
    bounce that nobody saw; a last bounce that cannot be called; a ball that is out; a second bounce;
    a last bounce too close to call; else the track was lost.
    """
    review = lambda basis: (None, basis, True, False)
    if serve_seen(rally, s) and rally["strokes"] <= 1:
        call = serve_call(rally, s)
        if call is None:
            return review("too_close")
        if call == "out":
            return (other(s.server), "double_fault", False, False) if faults else (None, "serve_fault", False, True)
        if call == "too_close":
            return review("too_close")
    final, hitter, reason = bool(rally["landings"]), rally["last_end"] if rally["landings"] else None, rally["reason"]
    if reason in ("net", "ball_out", "double_bounce"):
        if reason != "net" and final and rally["last_call"] is None:
            return review("too_close")
        if hitter is None:
            return review(reason)
        loser = reason != "double_bounce"
        striker = player_at(hitter, s)
        return other(striker) if loser else striker, reason, False, False
    if reason == "timeout":
        return review("unseen_bounce")
    if final and rally["last_call"] in (None, "too_close"):
        return review("too_close")
    return review("lost_track")


def infer_points(rallies: DataFrame, corrections: DataFrame, key: str, order: str, rules: Rules = Rules()) -> DataFrame:
    """(key, order, winner, basis, ...): a match's rallies in order, each judged by the score so far.

    ``rallies`` has the columns RALLY.  A correction (key, order, winner) replaces what the rules say
    about its rally, and the rallies after it see the corrected score, hence its server, side and
    ends.  The second fault in a row loses the point.  A match is one group.
    """
    kinds = dict(rallies.dtypes)
    names = [key, order, *(x.split()[0] for x in INFERRED.split(", "))]

    def judge(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        fixed = dict(zip(theirs[order], theirs["winner"])) if len(theirs) else {}
        walk, faults, out = Walk(rules), 0, []
        columns = [[None if x is None or x != x else x for x in ours[c].tolist()] for c in RALLY]
        for at in ours[order].argsort(kind="stable").tolist():
            r = dict(zip(RALLY, (c[at] for c in columns)))
            place = ours[order].iloc[at]
            winner, basis, review, fault = outcome(r, walk.state, faults)
            if place in fixed:
                winner, basis, review, fault = fixed[place], "user", False, False
            faults = 1 if fault else 0
            if not fault:
                walk.point(winner)
            shown = walk.shown()
            out.append((ours[key].iloc[at], place, winner, basis, review, fault, shown[0], shown[7]))
        return pd.DataFrame(out, columns=names)

    ours = rallies.select(key, order, *RALLY)
    return ours.groupBy(key).cogroup(corrections.select(key, order, "winner").groupBy(key)).applyInPandas(judge, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, {INFERRED}")
