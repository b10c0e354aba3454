import pytest
from conftest import rows
from pyspark.sql import functions as F

from studyloom import operators as op


@pytest.fixture(scope="module")
def facts(frame):
    return frame(
        "r string, c string", ("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), (None, "y"), ("b", None), ("b", "x")
    )


def test_crosstab_totals(facts):
    out = op.crosstab(facts, "r", "c", ["x", "y", None, "never"])
    assert out.columns == ["r", "x", "y", "NA", "never", "Other", "Total"]
    assert rows(out) == [
        ("Total", 4, 2, 1, 0, 0, 7), ("a", 2, 1, None, None, None, 3), ("b", 2, None, 1, None, None, 3),
        (None, None, 1, None, None, None, 1),
    ]


def test_crosstab_keeps_unlisted_and_missing_values(facts):
    out = op.crosstab(facts, "r", "c", ["x"])
    assert out.columns == ["r", "x", "Other", "NA", "Total"]
    assert [tuple(r) for r in out.collect()] == [
        ("a", 2, 1, None, 3), ("b", 2, None, 1, 3), (None, None, 1, None, 1), ("Total", 4, 2, 1, 7),
    ]
    assert op.crosstab(facts, "r", "c", ["x"], totals=()).columns == ["r", "x", "Other", "NA"]


def test_row_totals_equal_column_totals(facts):
    table = op.crosstab(facts, "r", "c", ["x"])
    body, total = table.filter("r is null or r <> 'Total'"), table.filter("r = 'Total'").first()
    cols = ("x", "Other", "NA", "Total")
    sums = body.agg(*[F.sum(c).alias(c) for c in cols]).first()
    assert [total[c] for c in cols] == list(sums)


def test_crosstab_pct_counts_all_rows(facts):
    out = [tuple(r) for r in op.crosstab_pct(facts, "r", "c", ["x"]).collect()]
    assert out[0] == ("a", "50% (2)", "50% (1)", "0% (0)", "43% (3)")
    assert out[-1] == ("Total", "100% (4)", "100% (2)", "100% (1)", "100% (7)")


def test_crosstab_pct_rounds_half_up(frame):
    df = frame("r string, c string", *([("a", "x")] * 1 + [("b", "x")] * 7 + [("a", "y")] * 2))
    out = {r.r: (r.x, r.y, r.Total) for r in op.crosstab_pct(df, "r", "c", ["x", "y"]).collect()}
    assert out["a"] == ("13% (1)", "100% (2)", "30% (3)")
    assert out["b"] == ("88% (7)", "0% (0)", "70% (7)")
    assert out["Total"] == ("100% (8)", "100% (2)", "100% (10)")
    empty = {r.r: r.z for r in op.crosstab_pct(df, "r", "c", ["x", "z"]).collect()}
    assert empty["a"] == "- (0)"


def test_share_rounds_half_to_even(frame):
    df = frame("g string", *([("a",)] * 1 + [("b",)] * 3 + [("c",)] * 36))
    assert rows(op.share(df, "g", 0)) == [("a", 1, 2.0), ("b", 3, 8.0), ("c", 36, 90.0)]
    assert rows(op.share(df, "g", 1))[0] == ("a", 1, 2.5)
    weighted = df.groupBy("g").agg(F.count("*").alias("w"))
    assert rows(op.share(weighted, "g", 0, F.col("w"))) == rows(op.share(df, "g", 0))


def test_percent_text(frame):
    df = frame("a long, b long", (1, 8), (3, 8), (None, 8), (1, 0), (1200, 1000))
    assert [r[0] for r in df.select(op.percent_text(F.col("a"), F.col("b"), 0)).collect()] == ["12%", "38%", None, None, "120%"]
    assert [r[0] for r in df.select(op.percent_text(F.col("a"), F.col("b"), 1)).collect()][0] == "12.5%"


def test_total_row_ignores_missing_and_dashes_text(frame):
    df = frame("k int, n long, m long, t string, d date", (1, 2, None, "x", "2021-01-01"), (2, 3, None, "y", None), (None, None, None, "z", None))
    out = op.add_total_row(df, "k", ["n", "m"])
    assert rows(out, "k", "n", "m", "t") == [("1", 2, None, "x"), ("2", 3, None, "y"), ("Total", 5, 0, "-"), (None, None, None, "z")]
    assert [r.k for r in out.collect()] == ["1", "2", None, "Total"]
    assert op.add_total_col(df, ["n", "m"]).agg(F.sum("Total")).first()[0] == 5
    assert rows(op.add_total_row(df.limit(0), "k", ["n"])) in ([], [("Total", 0, None, "-", None)])


def test_count_where(frame):
    df = frame("g string, v int", ("a", 1), ("a", None), ("b", 0), ("c", 9))
    tests = {"one": F.col("v") == 1, "big": F.col("v") > 5}
    assert rows(op.count_where(df, ["g"], tests)) == [("a", 1, 0), ("b", 0, 0), ("c", 0, 1)]
    assert rows(op.count_where(df, ["g"], tests, keep_any=True)) == [("a", 1, 0), ("c", 0, 1)]
    assert rows(op.count_where(df, ["g"], tests, zero_as_null=True))[0] == ("a", 1, None)


def test_total_row_keeps_repeated_labels(frame):
    df = frame("k string, n long", ("a", 1), ("a", 2), ("Total", 4))
    out = op.add_total_row(df, "k", ["n"], order=[F.desc("n")])
    assert [tuple(r) for r in out.collect()] == [("Total", 4), ("a", 2), ("a", 1), ("Total", 7)]


def test_listed_values_may_have_the_names_of_the_table(frame):
    """A value named Other, NA or Total is counted under its own column, and the cells add up."""
    values = ["Other", "X", "Y", "NA", "Total", None, None, "X"]
    df = frame("r string, c string", *[("a", v) for v in values])
    out = op.crosstab(df, "r", "c", ["Other"])
    assert out.columns == ["r", "Other", "Other*", "NA", "Total"]
    assert rows(out)[1] == ("a", 1, 5, 2, 8)
    out = op.crosstab(df, "r", "c", ["NA", None, "Total", "Other", "X"])
    assert out.columns == ["r", "NA", "NA*", "Total", "Other", "X", "Other*", "Total*"]
    assert rows(out)[1] == ("a", 1, 2, 1, 1, 2, 1, 8)
    out = op.crosstab_pct(df, "r", "c", ["Total"])
    assert out.columns == ["r", "Total", "Other", "NA", "Total*"] and out.first()["Total*"] == "100% (8)"


def test_crosstab_long_needs_no_list(facts):
    out = op.crosstab_long(facts, "r", "c")
    assert rows(out.filter("row_total and col_total"), "n") == [(7,)]
    assert rows(out.filter("not row_total and not col_total"), "r", "c", "n") == [
        ("a", "x", 2), ("a", "y", 1), ("b", "x", 2), ("b", None, 1), (None, "y", 1),
    ]
    assert rows(out.filter("row_total and not col_total"), "c", "n") == [("x", 4), ("y", 2), (None, 1)]
    assert rows(out.filter("col_total and not row_total"), "r", "n") == [("a", 3), ("b", 3), (None, 1)]
    shares = op.shares_long(out, "r", "c")
    assert shares.count() == out.count()
    assert rows(shares.filter("col_total"), "r", "percentage") == [("a", 43), ("b", 43), (None, 100), (None, 14)]
    assert rows(shares.filter("c = 'y'"), "r", "percentage") == [("a", 50), (None, 100), (None, 50)]


def test_crosstab_long_of_an_empty_table(facts):
    assert [r.n for r in op.crosstab_long(facts.limit(0), "r", "c").collect()] in ([], [None])
