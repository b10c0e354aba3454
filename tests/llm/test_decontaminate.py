import pytest

from studyloom.llm import decontaminate


def words(text):
    return (text or "").lower().encode().split()


def grams(w, width):
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, items, width, percent):
    out = set()
    for d, dt in docs:
        for i, it in items:
            a, b = grams(words(it), width), grams(words(dt), width)
            if d is not None and i is not None and a and 100 * len(a & b) >= percent * len(a):
                out.add((d, i, len(a), len(a & b)))
    return out


@pytest.fixture(scope="module")
def tables(prose, awkward):
    items = [(n, prose(15 + 7 * n, 100 + n)) for n in range(14)]
    docs = [(n, t) for n, t in enumerate(awkward)]
    for n, (_, text) in enumerate(items):
        w = text.split()
        docs.append((100 + n, prose(3000, n) + "\n" + text.upper() + "\t" + prose(50, n)))
        docs.append((200 + n, prose(80, 50 + n) + " " + " ".join(w[:-2]) + " tail"))
        docs.append((300 + n, prose(80, 50 + n) + " " + " ".join([*w[: len(w) // 2], "cut", *w[len(w) // 2 + 1 :]])))
        docs.append((400 + n, " ".join(w[: len(w) // 2])))
    items += [(90, None), (91, ""), (92, "one"), (93, "a b"), (None, prose(20, 9)), (94, items[2][1]), (0, items[0][1]), (95, "same same same same same same same")]
    docs += [(500, "ONE"), (501, "a b"), (502, "a b c"), (None, items[1][1]), docs[20], (503, "one two")]
    return docs, items


def test_leaks_are_those_of_all_pairs(spark, documents, tables):
    docs, items = tables
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    out = decontaminate.find_leaks(documents(docs), bench, 5, 80)
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in out.collect()}
    assert got == brute(docs, items, 5, 80)
    assert len(got) == out.count() and {d // 100 for d, *_ in got} >= {1, 2, 5}


def test_shuffle_join_beyond_the_broadcast_bound(spark, documents, tables, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = tables
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.find_leaks(documents(docs), bench).count() == len(brute(docs, items, 5, 80))


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(documents([(1, "a b c")]), bench).count() == 0
    assert decontaminate.find_leaks(documents([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_no_python_on_the_main_path(spark, documents):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontaminate.find_leaks(documents([(1, "a b c")]), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
