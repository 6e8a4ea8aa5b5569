"""The lifecycle's state: what it keeps is enough, however the evidence is cut into windows."""

from hypothesis import given, settings, strategies as st

from logwarden.operators import incidents as I, lifecycle as L

EVENTS = st.lists(st.tuples(st.just("e"), st.sampled_from(["sensitive", "api_a", "api_b", "login", "static", "root"]), st.integers(0, 100).map(float)), max_size=30)


def plain(evidence):
    """The rule itself: the best score in the most sensitive group, the earliest of equal ones."""
    if not evidence:
        return 0.0
    best = min(L.sensitivity(group) for _, group, _ in evidence)
    lead = next(group for _, group, _ in evidence if L.sensitivity(group) == best)
    return max(score for _, group, score in evidence if group == lead)


def condensed(evidence):
    """One entry per most sensitive group, as ``incident_scores`` gives them."""
    best = min((L.sensitivity(g) for _, g, _ in evidence), default=0)
    tops = {}
    for _, group, score in evidence:
        if L.sensitivity(group) == best:
            tops[group] = max(tops.get(group, 0.0), score)
    return [(None, group, score) for group, score in tops.items()]


@settings(max_examples=300, deadline=None)
@given(EVENTS, st.lists(st.integers(0, 30), max_size=4))
def test_fold_over_any_windows(events, cuts):
    cuts = sorted({0, len(events), *(c for c in cuts if c <= len(events))})
    lead = whole = None
    for a, b in zip(cuts, cuts[1:]):
        lead, whole = L.extend(lead, condensed(events[a:b])), L.extend(whole, events[a:b])
    assert lead == whole and L.priority_score(events) == plain(events) == (lead.score if lead else 0.0)


def test_scores_of_all_events(spark):
    """More events than a stored list holds: the best one is the first of 250."""
    rows = [("e000", "a", "2026-05-31T12:00:00Z", "/api/x", "xss", 99.0)] + [
        (f"e{i:03d}", "a", f"2026-05-31T12:0{1 + i // 100}:{i % 60:02d}Z", "/api/y" if i % 2 else "/z", "xss", 30.0) for i in range(1, 250)]
    df = spark.createDataFrame(rows, "event_id string, source_ip string, timestamp string, uri string, attack_type string, risk_score double")
    got = I.incident_scores(df).first().evidence
    assert [(e.event_id, e.grp, e.score) for e in got] == [("e000", "api_x", 99.0), ("e001", "api_y", 30.0)]
    action = L.process_incidents(I.correlate(df), I.incident_scores(df)).first()
    assert (action.severity, action.max_risk_score) == ("critical", 99.0)
