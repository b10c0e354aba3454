import random
from datetime import date, timedelta

from conftest import rows

from studyloom import operators as op

LABELS = ["Dose 1", "Dose 2", "Dose 3"]
START = date(2021, 1, 1)


def _data(frame, seed, per_label_once):
    rng = random.Random(seed)
    day = lambda: None if rng.random() < 0.08 else START + timedelta(days=rng.randrange(12))
    marks = []
    for k in [None, 1, 2, 3, 4]:
        labels = LABELS if per_label_once else [rng.choice(LABELS) for _ in range(8)]
        marks += [(k, day(), l) for l in labels if rng.random() < 0.8]
    events = [(i, rng.choice([None, 1, 2, 3, 9]), day()) for i in range(120)]
    return events, marks, frame("i int, k int, on date", *events), frame("k int, at date, dose string", *marks)


def _expected(events, marks):
    out = {}
    for i, k, on in events:
        past = [(at, -LABELS.index(l)) for mk, at, l in marks if mk == k and at and on and at <= on]
        if past:
            at, place = max(past)
            out[i] = (LABELS[-place], (on - at).days)
        else:
            out[i] = (None, None)
    return out


def test_last_before_against_brute_force(frame):
    for seed in range(3):
        events, marks, e, m = _data(frame, seed, False)
        out = op.last_before(e, m, "k", "on", "at", "dose", LABELS)
        assert out.count() == len(events)
        assert {r.i: (r.last_dose, r.days_since) for r in out.collect()} == _expected(events, marks)


def test_wide_and_long_form_agree(frame):
    for seed in range(3, 6):
        events, marks, e, m = _data(frame, seed, True)
        wide = op.last_of_labels(e, m, "k", "on", "at", "dose", LABELS)
        long = op.last_before(e, m, "k", "on", "at", "dose", LABELS)
        assert rows(wide, "i", "last_dose", "days_since") == rows(long, "i", "last_dose", "days_since")
        assert {r.i: (r.last_dose, r.days_since) for r in wide.collect()} == _expected(events, marks)


def test_edges(frame):
    marks = frame("k int, at date, dose string", (1, "2021-01-05", "Dose 2"), (1, "2021-01-05", "Dose 1"), (1, "2021-01-09", "Other"))
    events = frame("k int, on date", (1, "2021-01-04"), (1, "2021-01-05"), (1, "2021-01-20"), (2, "2021-01-05"))
    expected = [(1, date(2021, 1, 4), None), (1, date(2021, 1, 5), "Dose 1"), (1, date(2021, 1, 20), "Dose 1"), (2, date(2021, 1, 5), None)]
    for out in (
        op.last_before(events, marks, "k", "on", "at", "dose", LABELS),
        op.last_of_labels(events, marks, "k", "on", "at", "dose", LABELS),
    ):
        assert sorted(rows(out, "k", "on", "last_dose"), key=lambda r: r[:2]) == expected
    # Without a list every label is a mark and the smallest wins a day.
    free = op.last_before(events, marks, "k", "on", "at", "dose")
    assert dict(rows(free, "on", "last_dose"))[date(2021, 1, 20)] == "Other"
