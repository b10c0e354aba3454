import re
from collections import Counter

from studyloom.llm import quality_rules as qr

WORD, LENGTHS = re.compile(r"[^\x20\x09-\x0D]+"), sorted(qr.RUN_LIMITS)


def brute(text):
    text = text or ""
    words = WORD.findall(text)

    def inside(width):
        runs = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        n = Counter(runs)
        return sorted({i + k for i, r in enumerate(runs) if n[r] > 1 for k in range(width)})

    seen, repeated = set(), []
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += [line] if line in seen else []
            seen.add(line)
    line_chars = sum(len("".join(WORD.findall(x))) for x in repeated)
    covered = [sum(len(words[i]) for i in inside(w)) for w in LENGTHS]
    chars, n_repeat = sum(map(len, words)), len(inside(3))
    failed = len(words) < 50 or 100 * n_repeat > 50 * len(words)
    good = 100 * line_chars <= qr.LINE_LIMIT * chars and all(100 * c <= qr.RUN_LIMITS[w] * chars for c, w in zip(covered, LENGTHS))
    return (len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), len(repeated), n_repeat, line_chars, covered, failed, good and not failed)


def texts(prose):
    out = [prose(n, n) for n in (1, 49, 50, 120, 700)]
    for share in (5, 10, 20, 30, 60, 120):  # a passage said twice in texts of all proportions, and lines said twice
        out.append(f"{prose(120, 1)} {prose(share, 2)} {prose(30, 3)} {prose(share, 2)}")
        out.append("\n".join([prose(8, i) for i in range(20)] + [prose(share // 3 + 1, 4)] * 3))
    out.append(" ".join(prose(60, 5).split() * 2))
    out.append("é|ü # ñ$$ " * 30 + "\r\n same \r\n same \r\n\n\n" + prose(60, 6))
    out.append(" ".join(f"{w} x y z" for w in prose(60, 7).split()))
    return out


def test_each_text_as_counted_plainly(spark, documents, prose, awkward):
    rows = [(i, t) for i, t in enumerate(texts(prose) + awkward)]
    rows += [(None, prose(80, 9)), (3, prose(80, 10)), rows[3], rows[3]]
    got = qr.repetition_rules(documents(rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "covered_chars", "base_failed", "kept"]
    show = lambda r: repr(r)
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=show) == sorted(((i, *brute(t)) for i, t in rows), key=show)
    verdicts = {(r.base_failed, r.kept) for r in got}
    assert verdicts == {(True, False), (False, True), (False, False)}


def test_other_limits(spark, documents, prose):
    text = f"{prose(200, 1)} a b {prose(100, 2)} a b"
    kept = lambda **how: qr.repetition_rules(documents([(1, text)]), **how).first().kept
    assert kept() and kept(limits={}) and not kept(limits={2: 0}) and kept(limits={3: 0})


def test_empty_table(spark, documents):
    assert qr.repetition_rules(documents([])).count() == 0
