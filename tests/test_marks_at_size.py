"""Bodies are worked out once a frame, and only the landmarks asked for travel on."""

from test_normalized import frames, sequence

from motionlake.operators import normalized, pose


def test_no_body_within_a_body(spark):
    """No filter of the plan works bodies out (F8): the optimiser's own did so once a landmark and more."""
    fr = frames(spark, sequence(1, 6))
    plan = normalized.swing_direction(normalized.normalized(fr, pose.WRISTS))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "transform(" in x]
    assert max(x.count("transform(") for x in plan.splitlines()) <= 1


def test_named_landmarks_as_among_all(spark):
    fr = frames(spark, [r for k, gaps in ((1, [(5, 7), (15, 20)]), (2, [(0, 12)]), (3, [])) for r in sequence(k, 12 + k, gaps)])
    some = (*pose.HIPS, *pose.WRISTS)
    every = normalized.normalized(fr)
    few = normalized.normalized(fr, some)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in every.collect() if r.landmark in some}
    assert sorted(normalized.swing_direction(few).collect()) == sorted(normalized.swing_direction(every).collect())
    assert normalized.normalized(fr.limit(0), some).count() == 0


def test_marks_of_named_landmarks_keep_their_places(spark):
    """Two landmarks a frame travel for a turn of the hips (F10), not 33."""
    fr = frames(spark, sequence(1, 12, [(5, 7)]))
    every = {r.pos: r.marks for r in normalized.marks_of(normalized.normalized(fr)).collect()}
    few = {r.pos: r.marks for r in normalized.marks_of(normalized.normalized(fr, pose.HIPS), pose.HIPS).collect()}
    assert few == {p: [m if k in pose.HIPS else None for k, m in enumerate(marks)] for p, marks in every.items()}
