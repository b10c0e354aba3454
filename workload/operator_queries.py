"""One query per operator, on the driver tables as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom import functions as fn
from studyloom import operators as op
from studyloom.operators.cohort import waterfall, waterfall_counts
from studyloom.plans.cases import share_table
from studyloom.plans.labs import complete_panel
from studyloom.plans.schedule import weekday_table
from workload.registry import AS_OF, EVENTS_AS_OF, query

# ---------------------------------------------------------------- cohorts


def _customer_orders(L):
    return op.join_ns(L.customer, L.orders, [("c_custkey", "o_custkey")])


def _reasons():
    return [
        ("low_balance", F.col("c_acctbal") < -500),
        ("machinery_pending", (F.col("c_mktsegment") == "MACHINERY") & (F.col("o_orderstatus") == "P")),
        ("large", F.col("o_totalprice") > 490000),
        ("small_urgent", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") < 20000)),
    ]


_CHAIN = """
    WITH b AS (SELECT * FROM customer LEFT JOIN orders ON c_custkey = o_custkey),
    r1 AS (SELECT * FROM b WHERE c_acctbal < -500),
    a1 AS (SELECT * FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM r1)),
    r2 AS (SELECT * FROM a1 WHERE c_mktsegment = 'MACHINERY' AND o_orderstatus = 'P'),
    a2 AS (SELECT * FROM a1 WHERE c_custkey NOT IN (SELECT c_custkey FROM r2)),
    r3 AS (SELECT * FROM a2 WHERE o_totalprice > 490000),
    a3 AS (SELECT * FROM a2 WHERE c_custkey NOT IN (SELECT c_custkey FROM r3)),
    r4 AS (SELECT * FROM a3 WHERE o_orderpriority = '1-URGENT' AND o_totalprice < 20000),
    a4 AS (SELECT * FROM a3 WHERE c_custkey NOT IN (SELECT c_custkey FROM r4))
"""


@query(
    "cohort_waterfall",
    _CHAIN
    + """SELECT 'low_balance' AS cohort, count(*) AS n FROM r1 UNION ALL SELECT 'machinery_pending', count(*) FROM r2
    UNION ALL SELECT 'large', count(*) FROM r3 UNION ALL SELECT 'small_urgent', count(*) FROM r4
    UNION ALL SELECT 'remaining', count(*) FROM a4
    UNION ALL SELECT 'excluded', (SELECT count(*) FROM b) - (SELECT count(*) FROM a4)""",
)
def cohort_waterfall(L):
    return waterfall_counts(_customer_orders(L), "c_custkey", _reasons())


@query(
    "exclusion_rows",
    _CHAIN
    + """, tagged AS (SELECT *, 'low_balance' AS reason FROM r1 UNION ALL SELECT *, 'machinery_pending' FROM r2
    UNION ALL SELECT *, 'large' FROM r3 UNION ALL SELECT *, 'small_urgent' FROM r4)
    SELECT b.c_custkey, b.o_orderkey, b.c_custkey NOT IN (SELECT c_custkey FROM a4) AS excluded, t.reason
    FROM b LEFT JOIN tagged t ON b.c_custkey = t.c_custkey AND b.o_orderkey IS NOT DISTINCT FROM t.o_orderkey""",
)
def exclusion_rows(L):
    rows = waterfall(_customer_orders(L), "c_custkey", _reasons())
    return rows.select("c_custkey", "o_orderkey", "excluded", "reason")


def _cohorts():
    arm_a, arm_b = F.col("o_custkey") <= 500, F.col("o_custkey") > 500
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return {
        "all": ("All orders", F.lit(True)),
        "urgent": ("Urgent", urgent),
        "urgent_a": ("Urgent Group A", urgent & arm_a),
        "urgent_b": ("Urgent Group B", urgent & arm_b),
        "filled": ("Filled", F.col("o_orderstatus") == "F"),
        "open_large": ("Open and large", (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300000)),
    }


@query(
    "cohort_counts",
    """WITH c AS (
    SELECT 'all' AS cohort, count(*) AS n, 'All orders' AS label FROM orders
    UNION ALL SELECT 'urgent', count(*), 'Urgent' FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'urgent_a', count(*), 'Urgent Group A' FROM orders
        WHERE o_orderpriority = '1-URGENT' AND o_custkey <= 500
    UNION ALL SELECT 'urgent_b', count(*), 'Urgent Group B' FROM orders
        WHERE o_orderpriority = '1-URGENT' AND o_custkey > 500
    UNION ALL SELECT 'filled', count(*), 'Filled' FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'open_large', count(*), 'Open and large' FROM orders
        WHERE o_orderstatus = 'O' AND o_totalprice > 300000)
    SELECT cohort, n, label, label || ' (n = ' || n || ')' AS text FROM c""",
)
def cohort_counts(L):
    return op.cohort_counts(L.orders, _cohorts())


@query(
    "cohort_members",
    """SELECT 'urgent' AS cohort, o_orderkey, o_custkey, NULL::DOUBLE AS o_totalprice FROM orders
    WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'open_large', o_orderkey, NULL, o_totalprice FROM orders
    WHERE o_orderstatus = 'O' AND o_totalprice > 300000""",
)
def cohort_members(L):
    tests = _cohorts()
    urgent = op.cohort_members(L.orders, "urgent", tests["urgent"][1]).select("cohort", "o_orderkey", "o_custkey")
    large = op.cohort_members(L.orders, "open_large", tests["open_large"][1])
    return op.union_fill(urgent, large.select("cohort", "o_orderkey", "o_totalprice"))


@query(
    "cohort_union_rows",
    """SELECT o_orderkey, 'pending' AS cohort FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT o_orderkey, 'low' FROM orders WHERE o_orderpriority = '5-LOW'
    UNION ALL SELECT o_orderkey, 'cheap' FROM orders WHERE o_totalprice < 100000""",
)
def cohort_union_rows(L):
    tests = {
        "pending": F.col("o_orderstatus") == "P",
        "low": F.col("o_orderpriority") == "5-LOW",
        "cheap": F.col("o_totalprice") < 100000,
    }
    return op.cohort_rows(L.orders, tests).select("o_orderkey", "cohort")


@query(
    "arm_split",
    """SELECT CASE WHEN c_custkey <= 700 THEN 'Group A' WHEN c_custkey > 700 THEN 'Group B' END AS arm, count(*) AS n
    FROM customer GROUP BY 1""",
)
def arm_split(L):
    return op.count_by(L.customer.withColumn("arm", op.arm("c_custkey", 700)), "arm")


# ---------------------------------------------------------- counts and tables

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "crosstab_totals",
    """WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
    t AS (SELECT o_orderstatus, o_orderpriority, n FROM c UNION ALL SELECT 'Total', o_orderpriority, n FROM c)
    SELECT o_orderstatus,
        sum(n) FILTER (WHERE o_orderpriority = '1-URGENT')::BIGINT AS "1-URGENT",
        sum(n) FILTER (WHERE o_orderpriority = '2-HIGH')::BIGINT AS "2-HIGH",
        sum(n) FILTER (WHERE o_orderpriority = '3-MEDIUM')::BIGINT AS "3-MEDIUM",
        sum(n) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED')::BIGINT AS "4-NOT SPECIFIED",
        CASE WHEN o_orderstatus = 'Total' THEN coalesce(sum(n) FILTER (WHERE o_orderpriority = '5-LOW'), 0)
            ELSE sum(n) FILTER (WHERE o_orderpriority = '5-LOW') END::BIGINT AS "Other",
        CASE WHEN o_orderstatus = 'Total' THEN coalesce(sum(n) FILTER (WHERE o_orderpriority IS NULL), 0)
            ELSE sum(n) FILTER (WHERE o_orderpriority IS NULL) END::BIGINT AS "NA",
        sum(n)::BIGINT AS "Total"
    FROM t GROUP BY 1""",
)
def crosstab_totals(L):
    return op.crosstab(L.orders, "o_orderstatus", "o_orderpriority", PRIORITIES[:4])


@query(
    "crosstab_pct",
    """WITH c AS (SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
        GROUP BY ALL),
    t AS (SELECT n_name, c_mktsegment, n FROM c UNION ALL SELECT 'Total', c_mktsegment, n FROM c),
    u AS (SELECT * FROM t UNION ALL SELECT n_name, 'Total', n FROM t),
    w AS (SELECT n_name, c_mktsegment, sum(n)::BIGINT AS n FROM u GROUP BY ALL),
    g AS (SELECT r.n_name, s.c_mktsegment, coalesce(w.n, 0) AS n, tot.n AS whole
        FROM (SELECT DISTINCT n_name FROM w) r CROSS JOIN (SELECT DISTINCT c_mktsegment FROM w) s
        LEFT JOIN w ON w.n_name = r.n_name AND w.c_mktsegment = s.c_mktsegment
        JOIN w tot ON tot.n_name = 'Total' AND tot.c_mktsegment = s.c_mktsegment),
    p AS (SELECT n_name, c_mktsegment, round(n * 100 / whole)::BIGINT || '% (' || n || ')' AS cell FROM g)
    SELECT n_name, max(cell) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS "AUTOMOBILE",
        max(cell) FILTER (WHERE c_mktsegment = 'BUILDING') AS "BUILDING",
        max(cell) FILTER (WHERE c_mktsegment = 'FURNITURE') AS "FURNITURE",
        max(cell) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS "HOUSEHOLD",
        max(cell) FILTER (WHERE c_mktsegment = 'MACHINERY') AS "Other", '- (0)' AS "NA",
        max(cell) FILTER (WHERE c_mktsegment = 'Total') AS "Total"
    FROM p GROUP BY 1""",
)
def crosstab_pct(L):
    rows = op.join_ns(L.customer, L.nation, [("c_nationkey", "n_nationkey")], "inner")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
    return op.crosstab_pct(rows, "n_name", "c_mktsegment", segments)


@query(
    "count_share",
    """WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1),
    p AS (SELECT l_returnflag, n, round_even(n * 100.0 / (SELECT sum(n) FROM c), 1)::DOUBLE AS percentage FROM c)
    SELECT * FROM p UNION ALL SELECT 'Total', sum(n)::BIGINT, round(sum(percentage), 1) FROM p""",
)
def count_share(L):
    shares = op.share(L.lineitem, "l_returnflag", 1)
    total = op.add_total_row(shares, "l_returnflag", ["n", "percentage"])
    return total.withColumn("percentage", F.round("percentage", 1))


@query(
    "conditional_counts",
    """SELECT l_returnflag, l_linenumber,
        count(*) FILTER (WHERE d < 31) AS last_month, count(*) FILTER (WHERE d BETWEEN 31 AND 365) AS last_year,
        count(*) FILTER (WHERE d > 365) AS older
    FROM (SELECT *, DATE '2001-01-01' - CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY ALL
    HAVING count(*) FILTER (WHERE d < 31) > 0 OR count(*) FILTER (WHERE d BETWEEN 31 AND 365) > 0
        OR count(*) FILTER (WHERE d > 365) > 0""",
)
def conditional_counts(L):
    days = fn.days_between(AS_OF, F.to_date("l_shipdate"))
    tests = {"last_month": days < 31, "last_year": days.between(31, 365), "older": days > 365}
    return op.count_where(L.lineitem, ["l_returnflag", "l_linenumber"], tests, keep_any=True)


@query(
    "total_row",
    """WITH c AS (SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS price,
        min(o_orderstatus) AS first_status FROM orders GROUP BY 1)
    SELECT * FROM c UNION ALL SELECT 'Total', sum(n)::BIGINT, round(sum(price), 2), '-' FROM c""",
)
def total_row(L):
    table = L.orders.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"),
        F.min("o_orderstatus").alias("first_status"),
    )
    total = op.add_total_row(table, "o_orderpriority", ["n", "price"])
    return total.withColumn("price", F.round("price", 2))


@query(
    "metric_matrix",
    """WITH e AS (SELECT event_type, DATE '2024-02-01' - CAST(ts AS DATE) AS d FROM events),
    m AS (SELECT 'overall' AS period, event_type FROM e UNION ALL SELECT 'month', event_type FROM e WHERE d < 30
        UNION ALL SELECT 'week', event_type FROM e WHERE d < 7)
    SELECT period, count(*) FILTER (WHERE event_type = 'click') AS click,
        count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
        count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS view,
        count(*) AS total
    FROM m GROUP BY 1""",
)
def metric_matrix(L):
    days = fn.days_between(EVENTS_AS_OF, F.to_date("ts"))
    periods = {"overall": F.lit(True), "month": days < 30, "week": days < 7}
    rows = op.cohort_rows(L.events, periods, "period")
    kinds = ["click", "error", "purchase", "signup", "view"]
    counts = op.count_where(rows, ["period"], {k: F.col("event_type") == k for k in kinds})
    return op.add_total_col(counts, kinds, "total")


@query(
    "weekday_by_type",
    """WITH c AS (SELECT event_type, count(*) AS n,
        count(*) FILTER (WHERE dayname(ts) = 'Thursday') AS n_thursday,
        count(*) FILTER (WHERE dayname(ts) = 'Friday') AS n_friday,
        count(*) FILTER (WHERE dayname(ts) = 'Saturday') AS n_saturday,
        count(*) FILTER (WHERE dayname(ts) = 'Sunday') AS n_sunday,
        count(*) FILTER (WHERE dayname(ts) = 'Monday') AS n_monday,
        count(*) FILTER (WHERE dayname(ts) = 'Tuesday') AS n_tuesday,
        count(*) FILTER (WHERE dayname(ts) = 'Wednesday') AS n_wednesday FROM events GROUP BY 1)
    SELECT *, round(n_thursday * 100.0 / n, 1)::DOUBLE AS pct_thursday, round(n_friday * 100.0 / n, 1)::DOUBLE AS pct_friday,
        round(n_saturday * 100.0 / n, 1)::DOUBLE AS pct_saturday, round(n_sunday * 100.0 / n, 1)::DOUBLE AS pct_sunday,
        round(n_monday * 100.0 / n, 1)::DOUBLE AS pct_monday, round(n_tuesday * 100.0 / n, 1)::DOUBLE AS pct_tuesday,
        round(n_wednesday * 100.0 / n, 1)::DOUBLE AS pct_wednesday FROM c""",
)
def weekday_by_type(L):
    rows = L.events.withColumn("day", F.to_date("ts"))
    return weekday_table(rows, ["event_type"], "day", EVENTS_AS_OF)


@query(
    "distinct_pairs",
    "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
)
def distinct_pairs(L):
    return L.lineitem.select("l_partkey", "l_suppkey").distinct()


# ------------------------------------------------------------------- joins


@query(
    "left_join_nullsafe",
    """WITH o AS (SELECT o_orderkey, nullif(o_custkey, 0) AS k, o_orderpriority FROM orders),
    c AS (SELECT nullif(c_custkey, 0) AS k, c_name, c_acctbal FROM customer)
    SELECT o.o_orderkey, o.k, o.o_orderpriority, c.c_name, c.c_acctbal
    FROM o LEFT JOIN c ON o.k IS NOT DISTINCT FROM c.k""",
)
def left_join_nullsafe(L):
    orders = L.orders.select("o_orderkey", F.nullif("o_custkey", F.lit(0)).alias("k"), "o_orderpriority")
    customers = L.customer.select(F.nullif("c_custkey", F.lit(0)).alias("k"), "c_name", "c_acctbal")
    return op.join_ns(orders, customers, "k")


@query(
    "join_many_to_one",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_custkey, o_orderstatus
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def join_many_to_one(L):
    lines = L.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = L.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return op.join_ns(lines, orders, [("l_orderkey", "o_orderkey")], expect="m:1")


@query(
    "anti_one_key",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def anti_one_key(L):
    pending = L.orders.filter(F.col("o_orderstatus") == "P")
    return op.anti(L.customer.select("c_custkey", "c_name"), pending, [("c_custkey", "o_custkey")])


@query(
    "anti_two_keys",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem a WHERE NOT EXISTS (
        SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R'
        AND a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber)""",
)
def anti_two_keys(L):
    returned = L.lineitem.filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")
    lines = L.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return op.anti(lines, returned, ["l_orderkey", "l_linenumber"])


@query(
    "reconcile_values",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem a WHERE NOT EXISTS (
        SELECT 1 FROM lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
        AND a.l_partkey = b.l_partkey
        AND a.l_extendedprice = CASE WHEN b.l_returnflag = 'N' THEN b.l_extendedprice + 1 ELSE b.l_extendedprice END)""",
)
def reconcile_values(L):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    price = F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice"))
    return op.anti(L.lineitem.select(*keys), L.lineitem.withColumn("l_extendedprice", price), keys)


@query(
    "full_outer_extract",
    """WITH f AS (SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem
        WHERE l_linestatus = 'F' GROUP BY ALL),
    o AS (SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS d, max(l_tax) AS t, max(l_discount) AS c FROM lineitem
        WHERE l_linestatus = 'O' GROUP BY ALL),
    w AS (SELECT coalesce(f.k, o.k) AS k, coalesce(f.d, o.d) AS d, q, t, c
        FROM f FULL JOIN o ON f.k = o.k AND f.d = o.d)
    SELECT k, d, 'q' AS measure, q AS value FROM w UNION ALL SELECT k, d, 't', t FROM w
    UNION ALL SELECT k, d, 'c', c FROM w""",
)
def full_outer_extract(L):
    lines = L.lineitem.withColumns({"k": F.col("l_partkey"), "d": F.to_date("l_shipdate")})
    left = lines.filter("l_linestatus = 'F'").groupBy("k", "d").agg(F.sum("l_quantity").alias("q"))
    right = lines.filter("l_linestatus = 'O'").groupBy("k", "d").agg(
        F.max("l_tax").alias("t"), F.max("l_discount").alias("c")
    )
    wide = op.full_outer(left, right, ["k", "d"])
    return op.to_long(wide, ["k", "d"], ["q", "t", "c"], "measure", "value")


@query(
    "exclude_pairs",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
    WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')
        AND NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') GROUP BY ALL""",
)
def exclude_pairs(L):
    pairs = [("F", "5-LOW"), ("P", "1-URGENT")]
    return op.count_by(
        op.exclude_pairs(L.orders, ["o_orderstatus", "o_orderpriority"], pairs), "o_orderstatus", "o_orderpriority"
    )


@query(
    "team_split",
    """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN 'fast'
        WHEN '3-MEDIUM' THEN 'normal' ELSE 'others' END AS team FROM orders""",
)
def team_split(L):
    roster = [("1-URGENT", "fast"), ("2-HIGH", "fast"), ("3-MEDIUM", "normal")]
    return op.split_by_team(L.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", roster)


@query(
    "overlap_keys",
    """SELECT a.l_partkey, a.l_suppkey, count(*) AS pairs FROM
        (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A') a
        JOIN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') b
        ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey GROUP BY ALL""",
)
def overlap_keys(L):
    keys = ["l_partkey", "l_suppkey"]

    def side(flag, name):
        return op.count_by(L.lineitem.filter(F.col("l_returnflag") == flag), *keys, name=name)

    # Each side is counted per key first, so pairs are multiplied, not listed.
    both = op.join_ns(side("A", "a"), side("R", "r"), keys, "inner")
    return both.select(*keys, (F.col("a") * F.col("r")).alias("pairs"))


@query(
    "two_way_missing",
    """SELECT 'no_orders' AS side, c_custkey AS k FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    UNION ALL SELECT 'no_supplier', o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
        AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def two_way_missing(L):
    urgent = L.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    left = op.anti(L.customer, urgent, [("c_custkey", "o_custkey")]).select(
        F.lit("no_orders").alias("side"), F.col("c_custkey").alias("k")
    )
    right = op.anti(urgent, L.supplier, [("o_custkey", "s_suppkey")]).select(
        F.lit("no_supplier").alias("side"), F.col("o_custkey").alias("k")
    )
    return op.union_same(left, right)


@query(
    "multi_agg_join",
    """WITH o AS (SELECT o_custkey, count(*) AS open,
        nullif(count(*) FILTER (WHERE DATE '2001-01-01' - CAST(o_orderdate AS DATE) > 365), 0) AS open_long
        FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
    f AS (SELECT o_custkey, count(*) AS closed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT o.*, f.closed FROM o LEFT JOIN f USING (o_custkey)""",
)
def multi_agg_join(L):
    is_open = F.col("o_orderstatus") == "O"
    old = fn.days_between(AS_OF, F.to_date("o_orderdate")) > 365
    tests = {"open": is_open, "open_long": is_open & old, "closed": F.col("o_orderstatus") == "F"}
    counts = op.count_where(L.orders, ["o_custkey"], tests).filter("open > 0")
    return counts.withColumns({c: fn.null_if_zero(c) for c in ("open_long", "closed")})


# ------------------------------------------------------------------- as-of

_ASOF = """
    WITH p AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'),
    v AS (SELECT user_id, event_type, CAST(ts AS DATE) AS d FROM events WHERE event_type IN ('view', 'click')),
    m AS (SELECT p.event_id, p.user_id, p.d, v.event_type, v.d AS vd,
        row_number() OVER (PARTITION BY p.event_id ORDER BY v.d DESC NULLS LAST,
            CASE v.event_type WHEN 'view' THEN 1 ELSE 2 END) AS rn
        FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.d <= p.d),
    r AS (SELECT event_id, user_id, event_type AS last_event_type, vd AS last_day, (d - vd)::INTEGER AS days_since
        FROM m WHERE rn = 1)
"""


def _asof(L):
    purchases = L.events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    marks = L.events.filter(F.col("event_type").isin("view", "click")).select(
        "user_id", "event_type", F.to_date("ts").alias("day")
    )
    return op.last_before(purchases, marks, "user_id", "ts", "day", "event_type", ["view", "click"])


@query("asof_last_before", _ASOF + "SELECT * FROM r")
def asof_last_before(L):
    return _asof(L).drop("ts")


@query(
    "asof_wide_labels",
    """WITH f AS (SELECT user_id, event_type, min(CAST(ts AS DATE)) AS d FROM events
        WHERE event_type IN ('signup', 'view', 'click') GROUP BY ALL),
    p AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('purchase', 'error')),
    m AS (SELECT p.*, f.event_type, day - f.d AS since, row_number() OVER (PARTITION BY event_id
        ORDER BY CASE WHEN day >= f.d THEN day - f.d END NULLS LAST,
            CASE f.event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 ELSE 3 END) AS rn
        FROM p LEFT JOIN f ON p.user_id = f.user_id)
    SELECT event_id, user_id, day, CASE WHEN since >= 0 THEN event_type END AS last_event_type,
        CASE WHEN since >= 0 THEN since END::INTEGER AS days_since FROM m WHERE rn = 1""",
)
def asof_wide_labels(L):
    cases = L.events.filter(F.col("event_type").isin("purchase", "error")).select(
        "event_id", "user_id", F.to_date("ts").alias("day")
    )
    marks = L.events.select("user_id", "event_type", F.to_date("ts").alias("mark"))
    return op.last_of_labels(cases, marks, "user_id", "day", "mark", "event_type", ["signup", "view", "click"])


@query(
    "asof_share",
    _ASOF
    + """, c AS (SELECT last_event_type, count(*) AS n FROM r GROUP BY 1)
    SELECT last_event_type, n, round_even(n * 100.0 / (SELECT sum(n) FROM c), 1)::DOUBLE AS percentage FROM c""",
)
def asof_share(L):
    return op.share(_asof(L), "last_event_type", 1)


_NUMBERED = """
    WITH n AS (SELECT event_id, user_id, 'MLR-' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
        AS case_number FROM events WHERE event_type = 'purchase')
"""


def _numbered(L):
    rows = L.events.filter(F.col("event_type") == "purchase")
    numbers = {"case_number": None}
    return op.number_within(rows, "user_id", ["ts", "event_id"], numbers, "MLR-").select(
        "event_id", "user_id", "case_number"
    )


@query("case_number", _NUMBERED + "SELECT * FROM n")
def case_number(L):
    return _numbered(L)


@query(
    "case_number_distribution",
    _NUMBERED
    + """, c AS (SELECT case_number, count(*) AS n FROM n GROUP BY 1)
    SELECT case_number, n, round_even(n * 100.0 / (SELECT sum(n) FROM c), 1)::DOUBLE AS percentage,
        CAST(substr(case_number, 5) AS BIGINT) AS place FROM c""",
)
def case_number_distribution(L):
    counts = op.number_counts(L.events.filter(F.col("event_type") == "purchase"), "user_id", "number")
    label = F.concat(F.lit("MLR-"), F.col("number").cast("string"))
    shares = op.share(counts.withColumn("case_number", label), "case_number", 1, weight=F.col("n"))
    return op.arrange(shares.withColumn("place", fn.numeric_suffix("case_number", 5)), "place")


# ----------------------------------------------------------------- reshape


@query(
    "presence_pivot",
    """SELECT user_id, max(CASE WHEN event_type = 'signup' THEN 'signup' END) AS signup,
        max(CASE WHEN event_type = 'error' THEN 'error' END) AS error,
        max(CASE WHEN event_type = 'purchase' THEN 'purchase' END) AS purchase FROM events GROUP BY 1""",
)
def presence_pivot(L):
    return op.presence_wide(L.events, ["user_id"], "event_type", ["signup", "error", "purchase"])


@query(
    "value_pivot",
    """WITH f AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1)
    SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS click,
        max(value) FILTER (WHERE event_type = 'error') AS error, max(value) FILTER (WHERE event_type = 'purchase') AS purchase,
        max(value) FILTER (WHERE event_type = 'signup') AS signup, max(value) FILTER (WHERE event_type = 'view') AS view
    FROM f GROUP BY 1""",
)
def value_pivot(L):
    first = op.first_per(L.events, ["user_id", "event_type"], ["ts", "event_id"])
    return op.to_wide(first, ["user_id"], "event_type", "value", ["click", "error", "purchase", "signup", "view"])


@query(
    "panel_complete",
    """WITH f AS (SELECT l_suppkey, l_returnflag, l_linenumber, CASE WHEN l_discount > 0.01 THEN l_quantity END AS q
        FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linenumber
            ORDER BY l_shipdate, l_orderkey, l_partkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1)
    SELECT l_suppkey, l_returnflag, coalesce(bool_or(l_linenumber = 1 AND q IS NOT NULL), false)
            AND coalesce(bool_or(l_linenumber = 2 AND q IS NOT NULL), false)
            AND coalesce(bool_or(l_linenumber = 3 AND q IS NOT NULL), false) AS small,
        coalesce(bool_or(l_linenumber = 6 AND q IS NOT NULL), false)
            AND coalesce(bool_or(l_linenumber = 7 AND q IS NOT NULL), false) AS large
    FROM f GROUP BY ALL""",
)
def panel_complete(L):
    rows = L.lineitem.withColumn("q", F.when(F.col("l_discount") > 0.01, F.col("l_quantity")))
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_extendedprice"]
    panels = {"small": [1, 2, 3], "large": [6, 7]}
    return complete_panel(rows, ["l_suppkey", "l_returnflag"], "l_linenumber", "q", panels, order)


@query(
    "first_per_key",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (
        PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def first_per_key(L):
    rows = L.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return op.first_per(rows, ["o_custkey"], ["o_orderdate", "-o_totalprice", "o_orderkey"])


@query(
    "unpivot_keep_null",
    """WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN l_quantity END AS quantity,
        l_tax AS tax FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, 'quantity' AS name, quantity AS value FROM w
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'tax', tax FROM w""",
)
def unpivot_keep_null(L):
    quantity = F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))
    wide = L.lineitem.withColumns({"quantity": quantity, "tax": F.col("l_tax")})
    return op.to_long(wide, ["l_orderkey", "l_linenumber", "l_partkey"], ["quantity", "tax"])


@query(
    "union_distinct",
    """SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey FROM supplier""",
)
def union_distinct(L):
    return op.union_distinct(
        L.lineitem.select(F.col("l_suppkey").alias("k")),
        L.supplier.select(F.col("s_suppkey").alias("k")),
    )


@query(
    "tag_before_after",
    """WITH u AS (SELECT c_custkey, c_mktsegment AS status, c_acctbal, NULL::BIGINT AS n FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT o_custkey, 'ordered', NULL, count(*) FROM orders GROUP BY 1),
    t AS (SELECT status, CASE WHEN n IS NULL THEN 'Before' ELSE 'After' END AS time FROM u)
    SELECT status, nullif(count(*) FILTER (WHERE time = 'Before'), 0) AS "Before",
        nullif(count(*) FILTER (WHERE time = 'After'), 0) AS "After", NULL::BIGINT AS "Other", NULL::BIGINT AS "NA"
        FROM t GROUP BY 1""",
)
def tag_before_after(L):
    debtors = L.customer.filter("c_acctbal < 0").select("c_custkey", F.col("c_mktsegment").alias("status"), "c_acctbal")
    buyers = op.count_by(L.orders, "o_custkey").select(
        F.col("o_custkey").alias("c_custkey"), F.lit("ordered").alias("status"), "n"
    )
    rows = op.union_fill(debtors, buyers)
    tagged = rows.withColumn("time", F.when(F.col("n").isNull(), "Before").otherwise("After"))
    return op.crosstab(tagged, "status", "time", ["Before", "After"], totals=())


@query(
    "facet_values",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY ALL"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    )
    + """ UNION ALL SELECT 'big', CASE WHEN o_totalprice > 400000 THEN 'big' END, count(*) FROM orders GROUP BY ALL""",
)
def facet_values(L):
    rows = L.orders.withColumn("big", F.when(F.col("o_totalprice") > 400000, "big"))
    return op.facets(rows)


@query(
    "snapshot_persist",
    """SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_quantity FROM lineitem a JOIN
        (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'A'
            UNION SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'O') b
        ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey
    WHERE a.l_returnflag <> 'R'""",
)
def snapshot_persist(L):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    earlier = L.lineitem.filter("l_returnflag <> 'R'").select(*keys, "l_quantity")
    today = op.union_distinct(
        L.lineitem.filter("l_returnflag = 'A'").select(*keys), L.lineitem.filter("l_linestatus = 'O'").select(*keys)
    )
    return op.matching(earlier, today, keys)


# ------------------------------------------------------- columns and values


@query(
    "range_rules",
    """WITH r(flag, lo_line, hi_line, lo, hi) AS (VALUES ('A', 1, 3, 5, 30), ('A', 4, 7, 10, 40), ('N', 1, 7, 3, 48),
        ('R', 1, 2, 20, 25))
    SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, 'Review ' || flag AS text
    FROM lineitem JOIN r ON l_returnflag = flag AND l_linenumber BETWEEN lo_line AND hi_line
    WHERE NOT (l_quantity BETWEEN lo AND hi)""",
)
def range_rules(L):
    rows = [("A", 1, 3, 5.0, 30.0), ("A", 4, 7, 10.0, 40.0), ("N", 1, 7, 3.0, 48.0), ("R", 1, 2, 20.0, 25.0)]
    rules = op.inline_table(L.lineitem, rows, "flag string, lo_line int, hi_line int, lo double, hi double")
    banded = L.lineitem.join(
        rules,
        (F.col("l_returnflag") == F.col("flag")) & F.col("l_linenumber").between(F.col("lo_line"), F.col("hi_line")),
    )
    return banded.filter(~F.col("l_quantity").between(F.col("lo"), F.col("hi"))).select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.concat(F.lit("Review "), "flag").alias("text")
    )


@query(
    "age_months",
    """WITH d AS (SELECT o_orderkey, DATE '1990-01-31' AS s, CAST(o_orderdate AS DATE) AS e FROM orders)
    SELECT o_orderkey, ((year(e) * 12 + month(e)) - (year(s) * 12 + month(s))
        - CASE WHEN day(e) < day(s) THEN 1 ELSE 0 END)::INTEGER AS months FROM d""",
)
def age_months(L):
    rows = L.orders.withColumns({"s": F.lit("1990-01-31").cast("date"), "e": F.to_date("o_orderdate")})
    return rows.select("o_orderkey", fn.months_complete("s", "e").alias("months"))


@query(
    "date_parse",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%d-%b-%Y')
        WHEN 1 THEN strftime(o_orderdate, '%d-%b-%Y %H:%M') WHEN 2 THEN strftime(o_orderdate, '%d %m %Y')
        WHEN 3 THEN strftime(o_orderdate, '%Y %m %d') WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y')
        WHEN 5 THEN strftime(o_orderdate, '%d-%m-%Y %H:%M') WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%d')
        WHEN 7 THEN '30-Feb-2001' ELSE 'unknown' END AS raw, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, raw, CASE WHEN o_orderkey % 9 < 7 THEN d END AS parsed FROM t""",
)
def date_parse(L):
    layouts = [
        "dd-MMM-yyyy", "dd-MMM-yyyy HH:mm", "dd MM yyyy", "yyyy MM dd", "dd/MM/yyyy", "dd-MM-yyyy HH:mm", "yyyy-MM-dd",
    ]
    pick = F.col("o_orderkey") % 9
    raw = F.when(pick == 7, "30-Feb-2001").when(pick == 8, "unknown")
    for i, layout in enumerate(layouts):
        raw = raw.when(pick == i, F.date_format("o_orderdate", layout))
    rows = L.orders.select("o_orderkey", raw.alias("raw"))
    return rows.withColumn("parsed", fn.parse_date("raw", layouts))


@query(
    "day_windows",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, (DATE '2001-01-01' - d)::INTEGER AS days, strftime(d, '%Y%b%d') AS text, dayname(d) AS weekday,
        ((isodow(d) - 1 - 0 + 7) % 7)::INTEGER AS rank
    FROM d WHERE d >= DATE '2001-01-01' - 7 AND d < DATE '2001-01-01' + 7""",
)
def day_windows(L):
    rows = L.orders.withColumn("d", F.to_date("o_orderdate"))
    days = fn.days_between(AS_OF, "d")
    near = rows.filter((F.col("d") >= F.date_sub(F.lit(AS_OF), 7)) & (F.col("d") < F.date_add(F.lit(AS_OF), 7)))
    return near.select(
        "o_orderkey", days.alias("days"), fn.date_text("d").alias("text"), fn.weekday_name("d").alias("weekday"),
        fn.weekday_rank("d", AS_OF).alias("rank"),
    )


@query(
    "level_order",
    """SELECT CASE o_orderpriority WHEN '5-LOW' THEN 'low' WHEN '3-MEDIUM' THEN 'medium' WHEN '1-URGENT' THEN 'urgent' END
            AS o_orderpriority,
        CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '1-URGENT' THEN 3 END AS o_orderpriority_rank,
        count(*) AS n FROM orders GROUP BY ALL""",
)
def level_order(L):
    rows = fn.with_level(L.orders, "o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"], ["low", "medium", "urgent"])
    return op.arrange(op.count_by(rows, "o_orderpriority", "o_orderpriority_rank"), "o_orderpriority_rank")


@query(
    "value_fold",
    """SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 'HOUSEHOLD' ELSE c_mktsegment END AS segment, count(*) AS n
    FROM customer GROUP BY 1""",
)
def value_fold(L):
    rows = L.customer.withColumn("segment", fn.recode("c_mktsegment", {"MACHINERY": "HOUSEHOLD"}))
    return op.count_by(rows, "segment")


@query(
    "consent_status",
    """SELECT coalesce(CASE WHEN c_acctbal < 0 THEN 'No' WHEN c_acctbal > 3000 THEN 'Yes' END, 'Pending') AS answer,
        count(*) AS n FROM customer GROUP BY 1""",
)
def consent_status(L):
    answer = F.when(F.col("c_acctbal") < 0, "No").when(F.col("c_acctbal") > 3000, "Yes")
    return op.count_by(L.customer.withColumn("answer", F.coalesce(answer, F.lit("Pending"))), "answer")


@query(
    "blank_to_null",
    """SELECT p_partkey, nullif(CASE WHEN p_size < 10 THEN '' ELSE p_brand END, '') AS p_brand, p_size FROM part""",
)
def blank_to_null(L):
    brand = F.when(F.col("p_size") < 10, "").otherwise(F.col("p_brand"))
    return fn.blank_to_null(L.part.select("p_partkey", brand.alias("p_brand"), "p_size"))


@query(
    "replace_first",
    """SELECT event_id, regexp_replace(props, '"', '_') AS props FROM events""",
)
def replace_first(L):
    return fn.replace_first(L.events.select("event_id", "props"), "props", '"', "_")


@query(
    "strip_punctuation",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, regexp_replace(event_type, '[\\p{P}\\p{S}]', '', 'g') AS event_type,
        regexp_replace(props, '[\\p{P}\\p{S}]', '', 'g') AS props FROM events""",
)
def strip_punctuation(L):
    return fn.strip_punctuation(L.events.select("event_id", "event_type", "props"))


@query(
    "text_tests",
    """WITH t AS (SELECT p_partkey, CASE WHEN p_size <= 45 THEN p_name END AS name FROM part)
    SELECT p_partkey, coalesce(regexp_matches(name, 'ring|bolt'), false) AS has,
        regexp_matches(name, 'ring|bolt') AS maybe, NOT coalesce(name IN ('small ring', 'red widget'), false) AS unlisted
    FROM t""",
)
def text_tests(L):
    rows = L.part.select("p_partkey", F.when(F.col("p_size") <= 45, F.col("p_name")).alias("name"))
    return rows.select(
        "p_partkey",
        fn.has_text("name", "ring|bolt").alias("has"),
        fn.matches_text("name", "ring|bolt").alias("maybe"),
        fn.not_in("name", ["small ring", "red widget"]).alias("unlisted"),
    )


@query(
    "number_parse",
    """SELECT p_partkey, TRY_CAST(CASE p_size % 3 WHEN 0 THEN ' ' || p_size || '.5 ' WHEN 1 THEN p_brand
        ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS number FROM part""",
)
def number_parse(L):
    pick = F.col("p_size") % 3
    raw = (
        F.when(pick == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 ")))
        .when(pick == 1, F.col("p_brand"))
        .otherwise(F.col("p_size").cast("string"))
    )
    return L.part.select("p_partkey", fn.to_number(raw).alias("number"))


@query(
    "not_all_null",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE (l_returnflag = 'A' OR l_quantity > 45 OR l_tax < 0.01) AND l_discount > 0.02""",
)
def not_all_null(L):
    a = F.when(F.col("l_returnflag") == "A", "a")
    b = F.when(F.col("l_quantity") > 45, F.col("l_quantity"))
    c = F.when(F.col("l_tax") < 0.01, F.col("l_tax"))
    d = F.when(F.col("l_discount") > 0.02, F.col("l_discount"))
    rows = fn.keep_present(L.lineitem.filter(fn.any_present(a, b, c)).withColumn("d", d), "d")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "dose_share_table",
    """WITH c AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Dose 1' WHEN '2-HIGH' THEN 'Dose 2'
            WHEN '3-MEDIUM' THEN 'Dose 3' WHEN '4-NOT SPECIFIED' THEN 'Booster' END AS dose, count(*) AS n
        FROM orders GROUP BY 1),
    p AS (SELECT dose, n, round_even(n * 100.0 / (SELECT sum(n) FROM c), 0)::DOUBLE AS p FROM c),
    u AS (SELECT * FROM p UNION ALL SELECT 'Total', sum(n)::BIGINT, sum(p) FROM p)
    SELECT dose, n, CAST(p AS BIGINT) || '%' AS percentage FROM u""",
)
def dose_share_table(L):
    names = {"1-URGENT": "Dose 1", "2-HIGH": "Dose 2", "3-MEDIUM": "Dose 3", "4-NOT SPECIFIED": "Booster"}
    return share_table(L.orders.withColumn("dose", fn.recode("o_orderpriority", names)), "dose", 0)


# ------------------------------------------- categories from the data, bands, several picks

# Priorities renamed so that values look like the names a table gives itself; one is missing.
_MARKED = """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Total' WHEN '2-HIGH' THEN 'Other' WHEN '3-MEDIUM' THEN 'NA'
        WHEN '5-LOW' THEN NULL ELSE o_orderpriority END AS grade, nullif(o_orderstatus, 'P') AS status FROM orders"""


def _marked(L):
    names = {"1-URGENT": "Total", "2-HIGH": "Other", "3-MEDIUM": "NA", "5-LOW": None}
    grade = F.col("o_orderpriority")
    for value, name in names.items():
        grade = F.when(F.col("o_orderpriority") == value, F.lit(name)).otherwise(grade)
    return L.orders.select(grade.alias("grade"), F.nullif("o_orderstatus", F.lit("P")).alias("status"))


@query(
    "crosstab_long",
    f"""WITH m AS ({_MARKED}), t AS (SELECT grade, status, grouping(grade) = 1 AS row_total, grouping(status) = 1 AS col_total,
        count(*) AS n FROM m GROUP BY CUBE (grade, status)),
    w AS (SELECT status, col_total, n AS whole FROM t WHERE row_total)
    SELECT grade, t.status, row_total, t.col_total, n, CAST(round(n * 100 / whole) AS BIGINT) AS percentage FROM t
    JOIN w ON t.status IS NOT DISTINCT FROM w.status AND t.col_total = w.col_total""",
)
def crosstab_long(L):
    return op.shares_long(op.crosstab_long(_marked(L), "grade", "status"), "grade", "status")


@query(
    "crosstab_taken_names",
    f"""WITH m AS ({_MARKED}), t AS (SELECT coalesce(status, 'none') AS status, grade FROM m UNION ALL SELECT 'Total', grade FROM m),
    c AS (SELECT status, count(*) FILTER (WHERE grade = 'Other') AS a, count(*) FILTER (WHERE grade = 'NA') AS b,
        count(*) FILTER (WHERE grade = 'Total') AS c, count(*) FILTER (WHERE grade NOT IN ('Other', 'NA', 'Total')) AS d,
        count(*) FILTER (WHERE grade IS NULL) AS e, count(*) AS n FROM t GROUP BY 1)
    SELECT status, a AS "Other", b AS "NA", c AS "Total", d AS "Other*", e AS "NA*", n AS "Total*" FROM c""",
)
def crosstab_taken_names(L):
    rows = _marked(L).withColumn("status", F.coalesce("status", F.lit("none")))
    return op.crosstab(rows, "status", "grade", ["Other", "NA", "Total"])


@query(
    "band_join",
    """WITH b AS (SELECT s_nationkey, s_suppkey, s_suppkey * 7 % 300 AS low, s_suppkey * 7 % 300 + s_suppkey % 40 - 2 AS high FROM supplier),
    p AS (SELECT c_custkey, c_nationkey, nullif(c_custkey % 350, 11) AS place FROM customer)
    SELECT c_custkey, place, s_suppkey, low, high FROM p LEFT JOIN b ON c_nationkey = s_nationkey AND place BETWEEN low AND high""",
)
def band_join(L):
    low = F.col("s_suppkey") * 7 % 300
    bands = L.supplier.select("s_nationkey", "s_suppkey", low.alias("low"), (low + F.col("s_suppkey") % 40 - 2).alias("high"))
    points = L.customer.select("c_custkey", "c_nationkey", F.nullif(F.col("c_custkey") % 350, F.lit(11)).alias("place"))
    return op.band_join(points, bands, [("c_nationkey", "s_nationkey")], "place").select("c_custkey", "place", "s_suppkey", "low", "high")


@query(
    "picks_per_rule",
    """WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    p AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
        WHERE event_type = 'purchase')
    SELECT r.user_id, r.event_id AS first_event, p.event_id AS first_purchase, p.ts AS purchase_ts
    FROM r LEFT JOIN p ON r.user_id IS NOT DISTINCT FROM p.user_id AND p.k = 1 WHERE r.k = 1""",
)
def picks_per_rule(L):
    rules = {"every": F.lit(True), "bought": F.col("event_type") == "purchase"}
    picks = op.picks_per(L.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], rules)
    return picks.select("user_id", F.col("every.event_id").alias("first_event"), F.col("bought.event_id").alias("first_purchase"), F.col("bought.ts").alias("purchase_ts"))
