"""Match score: corrections of an event log, and its replay."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.functions import cut

#: Fixed values of the scoring rules.
POINT_NAMES = ("0", "15", "30", "40")
TIEBREAK_POINTS, MATCH_TIEBREAK_POINTS, END_CHANGE_POINTS = 7, 10, 6


@dataclass(frozen=True)
class Rules:
    best_of: int = 3
    advantage: bool = True
    games: int = 6
    tiebreak_at: int | None = 6
    match_tiebreak: bool = False
    final_advantage: bool = False
    first_server: str = "A"


@dataclass(frozen=True)
class State:
    points: tuple[int, int] = (0, 0)
    games: tuple[int, int] = (0, 0)
    sets: tuple[int, int] = (0, 0)
    server: str = "A"
    tiebreak_first: str | None = None
    ends_swapped: bool = False
    winner: str | None = None


def other(player: str) -> str:
    return "B" if player == "A" else "A"


def tiebreak_server(first: str, played: int) -> str:
    """One point for the first server, then two each in turn."""
    return first if (played + 1) // 2 % 2 == 0 else other(first)


def _deciding(s: State, r: Rules) -> bool:
    return sum(s.sets) == r.best_of - 1


def _target(s: State, r: Rules) -> int | None:
    """Points that win the game in play, where it is a tiebreak."""
    if s.tiebreak_first is None:
        return None
    return MATCH_TIEBREAK_POINTS if r.match_tiebreak and _deciding(s, r) else TIEBREAK_POINTS


def after_point(s: State, winner: str, r: Rules) -> State:
    """The state after a point; a decided match stays as it is."""
    if s.winner:
        return s
    k = 0 if winner == "A" else 1
    points = tuple(p + (j == k) for j, p in enumerate(s.points))
    mine, theirs = points[k], points[1 - k]
    target = _target(s, r)
    if target is not None:
        if mine >= target and mine - theirs >= 2:  # ends change as after any set, not for the points as well
            return _after_game(s, k, r, True)
        played = sum(points)
        return replace(s, points=points, server=tiebreak_server(s.tiebreak_first, played), ends_swapped=s.ends_swapped ^ (played % END_CHANGE_POINTS == 0))
    won = mine >= 4 and (mine - theirs >= 2 or not r.advantage)
    return _after_game(s, k, r, False) if won else replace(s, points=points)


def _after_game(s: State, k: int, r: Rules, tiebreak: bool) -> State:
    final = _deciding(s, r)
    games = tuple(g + (j == k) for j, g in enumerate(s.games))
    server = other(s.tiebreak_first) if tiebreak else other(s.server)
    s = replace(s, points=(0, 0), games=games, server=server, tiebreak_first=None, ends_swapped=s.ends_swapped ^ (sum(games) % 2 == 1))
    if tiebreak or games[k] >= r.games and games[k] - games[1 - k] >= 2:
        sets = tuple(x + (j == k) for j, x in enumerate(s.sets))
        s = replace(s, games=(0, 0), sets=sets)
        if sets[k] > r.best_of // 2:
            return replace(s, winner="AB"[k])
        return replace(s, tiebreak_first=server) if r.match_tiebreak and _deciding(s, r) else s
    if r.tiebreak_at is not None and games == (r.tiebreak_at, r.tiebreak_at) and not (final and r.final_advantage):
        s = replace(s, tiebreak_first=s.server)
    return s


def side(s: State) -> str:
    """The half of the court that the next point is served from."""
    return "deuce" if sum(s.points) % 2 == 0 else "ad"


def end_of(player: str, s: State, first: str = "near") -> str:
    """The player's end, where A began at ``first``."""
    swapped = s.ends_swapped ^ (player == "B")
    return first if not swapped else "far" if first == "near" else "near"


def shown(s: State, r: Rules) -> str:
    """How the game's score is called."""
    a, b = s.points
    if s.tiebreak_first is not None:
        return f"{a}-{b}"
    if a >= 3 and b >= 3:
        if a == b or not r.advantage:
            return "Deuce"
        return "Ad-40" if a > b else "40-Ad"
    return f"{POINT_NAMES[min(a, 3)]}-{POINT_NAMES[min(b, 3)]}"


def start(r: Rules) -> State:
    s = State(server=r.first_server)
    return replace(s, tiebreak_first=s.server) if r.match_tiebreak and _deciding(s, r) else s


REPLAY = (
    "display string, points_a int, points_b int, games_a int, games_b int, sets_a int, sets_b int, server string, match_winner string, "
    "serve_side string, a_end string, set_scores string, unresolved int"
)


def row(s: State, r: Rules) -> tuple:
    return (shown(s, r), *s.points, *s.games, *s.sets, s.server, s.winner, side(s), end_of("A", s))


class Walk:
    """A match as it goes: the state, the games of each finished set, points without a winner.

    Matches pass through the same few thousand states, so transitions and rows are kept.
    """

    def __init__(self, rules: Rules):
        self.rules, self.first = rules, start(rules)
        self.step = lru_cache(1 << 16)(lambda s, w: after_point(s, w, rules))
        self.row = lru_cache(1 << 16)(lambda s: row(s, rules))
        self.begin()

    def begin(self) -> None:
        self.state, self.sets, self.unresolved = self.first, "", 0

    def point(self, winner) -> None:
        if winner not in ("A", "B"):
            self.unresolved += 1
            return
        before, self.state = self.state, self.step(self.state, winner)
        if self.state.sets != before.sets:
            a, b = before.games
            self.sets = f"{self.sets} {a + (winner == 'A')}-{b + (winner == 'B')}".lstrip()

    def shown(self) -> tuple:
        return (*self.row(self.state), self.sets, self.unresolved)


def replay(events: DataFrame, key: str, order: str, winner: str, rules: Rules = Rules()) -> DataFrame:
    """(key, order, ...): the state after each event of a match; an event without a winner is unresolved and changes nothing.

    set_scores lists the games of each finished set, a deciding match tiebreak as 1-0.  Events are
    dealt by match and sorted; each task folds over its stream, whatever the length of a match.
    """
    kind = dict(events.dtypes)
    names = [key, order, *(x.split()[0] for x in REPLAY.split(", "))]
    kinds = [pa.int32() if x.endswith("int") else pa.string() for x in REPLAY.split(", ")]

    def fold(batches):
        walk, last = Walk(rules), object()
        for batch in batches:
            rows = []
            for k, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != last:
                    walk.begin()
                    last = k
                walk.point(w)
                rows.append(walk.shown())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    dealt = events.select(key, order, F.col(winner).cast("string")).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInArrow(fold, f"`{key}` {kind[key]}, `{order}` {kind[order]}, {REPLAY}")


def effective_events(events: DataFrame, key: str, event_id: str, sequence: str, supersedes: str, source: str) -> DataFrame:
    """The surviving events, each with ``slot``, the place of the head of its chain of corrections.

    Of the events that supersede the same one the latest counts, by sequence and id; an inferred one
    never replaces one of the user, and none itself.  An event that another replaces is gone, as is a
    correction that did not count; one of an unknown event stands for itself.  Chains may have any
    length: heads are found by pointer jumping, which doubles its reach each round.  Events that
    replace each other in a circle are all gone.
    """
    d = events.select(key, F.col(event_id).alias("id"), F.col(sequence).alias("seq"), F.col(supersedes).alias("up"), F.col(source).alias("source"))
    known = d.select(key, F.col("id").alias("up"), F.struct("source").alias("of"))
    wishes = d.where("up is not null").join(known, [key, "up"])
    allowed = wishes.where((F.col("id") != F.col("up")) & ~((F.col("source") == "inferred") & (F.col("of.source") == "user")))
    links = cut(allowed.groupBy(key, "up").agg(F.max(F.struct("seq", "id")).alias("last")).select(key, F.col("last.id").alias("id"), "up"))
    standing = d.join(links.select(key, F.col("up").alias("id")), [key, "id"], "left_anti")
    refused = wishes.select(key, "id").join(links, [key, "id"], "left_anti")
    standing = cut(standing.join(refused, [key, "id"], "left_anti").select(key, "id"))
    # survivors end chains, so none is in a circle: once their heads stay, all is found
    heads, now = links.withColumnRenamed("up", "head"), standing.select(key, "id", F.col("id").alias("head"))
    while True:
        up = heads.select(key, F.col("id").alias("head"), F.col("head").alias("next"))
        moved = cut(now.join(up, [key, "head"], "left").select(key, "id", F.coalesce("next", "head").alias("head"), F.col("next").isNotNull().alias("more")))
        now = moved.drop("more")
        if moved.where("more").isEmpty():
            break
        heads = cut(heads.join(up, [key, "head"], "left").select(key, "id", F.coalesce("next", "head").alias("head")))
    slots = now.join(d.select(key, F.col("id").alias("head"), F.col("seq").alias("slot")), [key, "head"]).select(key, F.col("id").alias(event_id), "slot")
    return events.join(slots, [key, event_id])
