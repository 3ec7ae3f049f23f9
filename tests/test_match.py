import random

import pandas as pd
import pytest

from motionlake.operators import match
from motionlake.operators.inference import infer_points, outcome, serve_call
from motionlake.operators.match import Rules


def log(spark, winners):
    return spark.createDataFrame([("m", i, w) for i, w in enumerate(winners)], "k string, n int, w string")


def test_game_display(spark):
    got = [r.display for r in match.replay(log(spark, "AAABBBABBB"), "k", "n", "w").orderBy("n").collect()]
    assert got == ["15-0", "30-0", "40-0", "40-15", "40-30", "Deuce", "Ad-40", "Deuce", "40-Ad", "0-0"]


def test_tiebreak_servers():
    assert "".join(match.tiebreak_server("A", n) for n in range(10)) == "ABBAABBAAB"


def test_unknown_winners_change_nothing(spark):
    got = match.replay(log(spark, ["A", None, "A", "x", None]), "k", "n", "w").orderBy("n").collect()
    assert [(r.points_a, r.points_b) for r in got] == [(1, 0), (1, 0), (2, 0), (2, 0), (2, 0)]


def test_whole_match(spark):
    got = match.replay(log(spark, "A" * 60), "k", "n", "w").orderBy("n").collect()
    assert (got[47].match_winner, got[47].sets_a, got[59].sets_a) == ("A", 2, 2)
    even = ("AAAA" + "BBBB") * 6  # six games all
    end = match.replay(log(spark, even + "A" * 7), "k", "n", "w").orderBy("n").collect()
    assert (end[-1].sets_a, end[-1].games_a) == (1, 0) and end[-2].display == "6-0"
    assert match.after_point(match.State(points=(3, 3)), "B", Rules(advantage=False)).games == (0, 1)


def test_effective_events(spark):
    rows = [("e1", 1, None, "inferred"), ("e2", 2, "e1", "user"), ("e3", 3, "e2", "inferred"), ("e4", 4, None, "inferred"), ("e5", 5, "e4", "inferred"), ("e6", 6, "gone", "user"), ("e7", 7, "e1", "user")]
    df = spark.createDataFrame([("m", *r) for r in rows], "k string, id string, seq int, up string, source string")
    got = {(r.id, r.slot) for r in match.effective_events(df, "k", "id", "seq", "up", "source").collect()}
    assert got == {("e7", 1), ("e5", 4), ("e6", 6)}


def test_chain_of_three_hundred(spark):
    rows = [("m", f"e{i}", i, f"e{i - 1}" if i else None, "user") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, id string, seq int, up string, source string")
    assert [(r.id, r.slot) for r in match.effective_events(df, "k", "id", "seq", "up", "source").collect()] == [("e299", 0)]


def rally(n, strokes=5, reason="lost_track", landings=2, first_end="near", first_call="in", last_end="near", last_call="in", **box):
    boxes = {f"box_{e}_{h}": box.get(f"{e}_{h}", "in") for e in ("near", "far") for h in ("deuce", "ad")}
    return {"k": "m", "n": n, "strokes": strokes, "reason": reason, "landings": landings, "first_end": first_end, "first_call": first_call, "last_end": last_end, "last_call": last_call, **boxes}


def test_inference_and_correction(spark):
    """A serves from near to far; A's first point is a double fault, the next ones follow the score."""
    out = {"strokes": 1, "far_deuce": "out"}
    rows = [rally(0, **out), rally(1, **out), rally(2, reason="net", last_end="far"), rally(3)]
    fixed = spark.createDataFrame([("m", 3, "B"), ("m", 9, "A")], "k string, n int, winner string")
    kinds = ", ".join(f"{c} {'string' if isinstance(v, str) else 'int'}" for c, v in rows[0].items())
    got = infer_points(spark.createDataFrame([tuple(r.values()) for r in rows], kinds), fixed, "k", "n").orderBy("n").collect()
    assert [(r.winner, r.basis, r.needs_review, r.fault) for r in got] == [(None, "serve_fault", False, True), ("B", "double_fault", False, False), ("A", "net", False, False), ("B", "user", False, False)]
    assert got[-1].display == "15-30"


@pytest.mark.parametrize(
    "given,want",
    [
        (dict(strokes=1, first_call=None), (None, "too_close", True, False)),
        (dict(strokes=1, far_deuce=None), (None, "too_close", True, False)),
        (dict(strokes=1, far_deuce="too_close"), (None, "too_close", True, False)),
        (dict(strokes=1, far_deuce="out"), (None, "serve_fault", False, True)),
        (dict(strokes=1, far_deuce="out", faults=1), ("B", "double_fault", False, False)),
        (dict(strokes=1, far_deuce="out", first_end="far", reason="net"), ("B", "net", False, False)),  # the receiver's shot, no serve
        (dict(strokes=1, far_deuce="in", reason="double_bounce"), ("A", "double_bounce", False, False)),
        (dict(strokes=1, landings=0, reason="timeout"), (None, "unseen_bounce", True, False)),
        (dict(reason="net", last_call=None), ("B", "net", False, False)),
        (dict(reason="net", last_end=None), (None, "net", True, False)),
        (dict(reason="net", landings=0), (None, "net", True, False)),
        (dict(reason="timeout", last_call=None), (None, "unseen_bounce", True, False)),
        (dict(reason="ball_out", last_call=None), (None, "too_close", True, False)),
        (dict(reason="ball_out", last_end="far"), ("A", "ball_out", False, False)),
        (dict(reason="double_bounce", last_end="far"), ("B", "double_bounce", False, False)),
        (dict(reason="double_bounce", last_end=None), (None, "double_bounce", True, False)),
        (dict(reason="double_bounce", landings=0), (None, "double_bounce", True, False)),
        (dict(last_call="too_close"), (None, "too_close", True, False)),
        (dict(), (None, "lost_track", True, False)),
    ],
)
def test_every_branch_of_the_outcome(given, want):
    given = dict(given)
    faults = given.pop("faults", 0)
    assert outcome(rally(0, **given), match.start(Rules()), faults) == want


def test_serve_box_follows_score_and_ends():
    s = match.start(Rules())
    only = rally(0, strokes=1, near_ad="out")
    for w in "AAAA" + "B":  # one game: ends change, B serves; one point: the ad side
        s = match.after_point(s, w, Rules())
    assert (s.server, match.side(s), match.end_of("B", s)) == ("B", "ad", "near")
    assert serve_call(only, s) == "in" and outcome(only, s, 0)[1] == "lost_track"
    s = match.after_point(s, "A", Rules())
    far = rally(0, strokes=1, far_deuce="out")
    assert outcome(far, s, 0) == (None, "serve_fault", False, True)


def test_replay_is_append_only():
    rules, s, states = Rules(), match.start(Rules()), []
    for w in "ABBAAABABBBAAAABBB":
        s = match.after_point(s, w, rules)
        states.append(s)
    again, t = [], match.start(rules)
    for w in "ABBAAABAB":
        t = match.after_point(t, w, rules)
        again.append(t)
    assert states[:9] == again and pd.Series(states).map(lambda x: sum(x.games)).is_monotonic_increasing


@pytest.mark.parametrize("winners,swaps", [("AAAA", True), ("AAAABBBB", True), ("AAAABBBBAAAA", False)])
def test_ends_change_after_odd_games(winners, swaps):
    s = match.start(Rules())
    for w in winners:
        s = match.after_point(s, w, Rules())
    assert s.ends_swapped == swaps


def test_tiebreak_ends_and_set_scores(spark):
    """Ends change after every six points of a tiebreak but not on its last, where the set's end counts."""
    even, rules = ("AAAA" + "BBBB") * 6, Rules()
    s = match.start(rules)
    for w in even:
        s = match.after_point(s, w, rules)
    before = s.ends_swapped
    for n, w in enumerate("ABABABABAB" + "AA", 1):  # 7-5, twelve points
        s = match.after_point(s, w, rules)
        assert s.ends_swapped == (before ^ (n >= 6) if n < 12 else not before ^ True), n
    assert s.sets == (1, 0) and s.games == (0, 0) and s.server == "B"
    got = match.replay(log(spark, even + "ABABABABABAA" + "BBBB" * 6), "k", "n", "w").orderBy("n").collect()
    assert (got[-1].set_scores, got[-1].sets_a, got[-1].sets_b, got[-1].serve_side) == ("7-6 0-6", 1, 1, "deuce")
    long = Rules(best_of=1, final_advantage=True)
    assert match.replay(log(spark, even + "AAAABBBB"), "k", "n", "w", long).orderBy("n").collect()[-1].games_a == 7
    decider = Rules(best_of=1, match_tiebreak=True)
    end = match.replay(log(spark, "AB" * 8 + "AAAA"), "k", "n", "w", decider).orderBy("n").collect()
    assert end[-1].match_winner == "A" and end[-1].set_scores == "1-0"


def test_against_a_plain_count_of_points(spark):
    """Random matches, interleaved, against games counted without a state."""
    r = random.Random(3)
    logs = {m: "".join(r.choice("AAB") for _ in range(r.randrange(0, 150))) for m in range(8)}
    rows = [(m, i, w) for m, ws in logs.items() for i, w in enumerate(ws)]
    r.shuffle(rows)
    last = {}
    for x in match.replay(spark.createDataFrame(rows, "k int, n int, w string"), "k", "n", "w").collect():
        last[x.k] = max(last.get(x.k, x), x, key=lambda y: y.n)
    for m, x in last.items():
        sets, games, points, done = [], [0, 0], [0, 0], False
        for w in logs[m]:
            if done:
                break
            k = "AB".index(w)
            points[k] += 1
            tie = games == [6, 6]
            if points[k] >= (7 if tie else 4) and points[k] - points[1 - k] >= 2:
                games[k] += 1
                points = [0, 0]
                if tie or games[k] >= 6 and games[k] - games[1 - k] >= 2:
                    sets.append(tuple(games))
                    games = [0, 0]
                    done = sum(a > b for a, b in sets) == 2 or sum(a < b for a, b in sets) == 2
        assert x.set_scores == " ".join(f"{a}-{b}" for a, b in sets) and [x.games_a, x.games_b] == games and [x.points_a, x.points_b] == points


def test_corrections_in_a_circle_and_side_chains(spark):
    rows = [("a", 1, "c", "user"), ("b", 2, "a", "user"), ("c", 3, "b", "user"), ("d", 4, "d", "user"), ("e1", 5, None, "user"), ("e2", 6, "e1", "user"), ("e8", 9, "e2", "user"), ("e7", 8, "e1", "user")]
    df = spark.createDataFrame([("m", *r) for r in rows], "k string, id string, seq int, up string, source string")
    got = {(r.id, r.slot) for r in match.effective_events(df, "k", "id", "seq", "up", "source").collect()}
    assert got == {("e7", 5), ("e8", 6)}
