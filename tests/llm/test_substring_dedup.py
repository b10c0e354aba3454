from collections import Counter

import numpy as np
import pytest

from studyloom.llm import substring_dedup


def brute(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((d, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.fixture(scope="module")
def rows(prose, awkward):
    passage = prose(60, 7)
    w = passage.split()
    texts = [*awkward, prose(200, 1), prose(200, 2) + "\n" + passage, passage + "  " + prose(90, 3), prose(50, 4) + " " + " ".join(w[10:45]) + " end", " ".join(w[10:44])]
    texts += ["la " * 80 + "di " + "la " * 40, prose(40, 5) + " x " + prose(40, 5), prose(35, 6), prose(35, 6), prose(34, 8), prose(34, 8), " ".join(w[:50] + w[5:60])]
    texts += [" ".join(prose(300, 1).split()[k : k + 70]) for k in range(0, 200, 37)]
    out = [(100 - i, t) for i, t in enumerate(texts)]
    return [*out, (None, passage), (None, None), out[8], (92, prose(35, 9)), (7, "é" + passage)]


@pytest.mark.parametrize("window", [35, 12, 3])
def test_removed_words_are_those_of_all_windows(documents, rows, window):
    out = substring_dedup.cut_repeats(documents(rows), window, keep=["source", "hash"]).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    got = [(r.doc_id, r.n_words, r.n_removed, b" ".join((r.kept_text or "").encode().split()).decode()) for r in out]
    assert sorted(got, key=key) == sorted(brute(rows, window), key=key)
    assert all((r.kept_text is None) == (r.text is None) and r.hash == "mine" for r in out)
    assert all(r.kept_text == r.text for r in out if not r.n_removed)


def test_factors_cover_what_goes_and_name_another_place(documents, rows):
    texts = {}
    for d, t in rows:
        texts.setdefault(-(2**63) if d is None else d, []).append((t or "").encode().split())
    for r in substring_dedup.cut_repeats(documents(rows), 35).collect():
        own = (r.text or "").encode().split()
        covered = np.zeros(len(own), bool)
        for f in r.factors:
            assert f.length >= 35
            covered[f.start : f.start + f.length] = True
            if f.ref_id is not None:
                assert any(w[f.ref_start : f.ref_start + f.length] == own[f.start : f.start + f.length] for w in texts[f.ref_id])
        assert covered.sum() == r.n_removed


def test_empty_table(documents):
    assert substring_dedup.cut_repeats(documents([])).count() == 0


def test_run_hashes_do_not_depend_on_the_place():
    h = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    twice = np.concatenate([h, h])
    runs = substring_dedup.Runs(twice)
    assert (runs.of(np.arange(40), 10) == runs.of(np.arange(50, 90), 10)).all()
    assert runs.of(np.array([3]), 5)[0] != runs.of(np.array([4]), 5)[0]


@pytest.mark.parametrize("short", [True, False])
def test_texts_without_an_id_are_told_apart(documents, prose, monkeypatch, short):
    """Null ids, repeated ids and repeated rows, also where the short hashes of all texts collide."""
    if short:
        monkeypatch.setattr(substring_dedup, "_short_hash", lambda text: substring_dedup.F.lit(5).cast("long"))
    a, b = prose(60, 1), prose(40, 2)
    rows = [(None, a), (None, b), (1, a), (1, b + " " + prose(40, 3)), *[(2, prose(20, 4) + " " + a)] * 30]
    out = substring_dedup.cut_repeats(documents(rows), 35).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in out), key=repr) == sorted([x[:3] for x in brute(rows, 35)], key=repr)
    assert max(len(r.factors) for r in out) < 10
