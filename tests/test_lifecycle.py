"""Retention, second purchases, gaps, growth and migration against plain Python; one scan of the lines."""

import random
from bisect import bisect_left, bisect_right
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from helpers import lines, ts
from pyspark.sql import functions as F

from tillroll.operators import customers, lifecycle
from tillroll.operators.lifecycle import Rules
from tillroll.sources import clean_transactions

CUSTOMERS = 12


def random_orders(seed, months=150, n=220):
    """(invoice, date, amount, customer), two thirds of them in the first and last year."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        span = months * 30
        day = rng.choice([rng.randrange(360), rng.randrange(span), span - rng.randrange(360)])
        when = datetime(2010, 1, 1) + timedelta(days=day, minutes=rng.randrange(1440))
        out.append((f"I{i}", when, rng.randrange(1, 500), rng.randrange(CUSTOMERS) + 1))
    out += [("T1", datetime(2012, 5, 5, 8), 7, 1), ("T2", datetime(2012, 5, 5, 8), 9, 1)]  # at the same instant
    return out


@pytest.fixture(scope="module")
def table():
    return random_orders(3)


@pytest.fixture(scope="module")
def orders(spark, table):
    tx = lines(spark, [(inv, "A", "Red Mug", 1, when.isoformat(), amount, c, "UK") for inv, when, amount, c in table]
               + [(None, "A", "Red Mug", 1, "2011-01-01T00:00:00", 5, 1, "UK")])
    return customers.customer_base(clean_transactions(tx)).orders


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame([(c, f"S{c % 3}") for c in range(1, CUSTOMERS + 1)], "CustomerID long, Segment string")


def by_customer(table):
    out = {}
    for inv, when, amount, c in sorted(table, key=lambda r: (r[1], r[0])):
        out.setdefault(c, []).append((when, inv, amount))
    return out


def month(when):
    return 12 * when.year + when.month - 1


def name(number):
    return f"{number // 12:04d}-{number % 12 + 1:02d}"


def test_retention_over_more_than_two_words_of_months(orders, table):
    active = {c: {month(w) for w, _, _ in own} for c, own in by_customer(table).items()}
    last, want = max(max(m) for m in active.values()), {}
    for months in active.values():
        first = min(months)
        for k in range(last - first + 1):
            now, before = first + k in months, first + k - 1 in months
            cell = want.setdefault((name(first), k), [0] * 5)
            for i, x in enumerate((True, now, now and before, before and not now, now and not before and k > 0)):
                cell[i] += x
    got = lifecycle.cohort_retention(orders).collect()
    assert {(r.Cohort, r.Offset): [r.Customers, r.Active, r.Retained, r.Churned, r.Returned] for r in got} == want
    assert len(got) == len(want) and max(k for _, k in want) > 128
    for r in got:
        assert r.RetentionRate == pytest.approx(r.Active / r.Customers, abs=5.1e-5)
        before = r.Churned + r.Retained
        assert r.ChurnRate == (pytest.approx(r.Churned / before, abs=5.1e-5) if before else None)


def test_bitmaps_begin_with_the_cohort_month(orders, table):
    active = {c: {month(w) for w, _, _ in own} for c, own in by_customer(table).items()}
    for r in lifecycle.activity_bitmaps(orders).collect():
        bits = {r.Cohort + 64 * i + k for i, w in enumerate(r.Active) for k in range(64) if w >> k & 1}
        assert r.Cohort == min(active[r.CustomerID]) and bits == active[r.CustomerID]


def test_first_two_orders(orders, table):
    want = {}
    for c, own in by_customer(table).items():
        second = own[1][0] if len(own) > 1 else None
        want[c] = (len(own), own[0][0], second, (second - own[0][0]).days if second else None)
    got = lifecycle.first_two_orders(orders).collect()
    assert {r.CustomerID: (r.Orders, r.FirstOrder, r.SecondOrder, r.DaysToSecond) for r in got} == want


def test_second_purchase_counts_single_orders_and_same_instants(spark):
    tx = lines(spark, [
        ("1", "A", "X", 1, "2024-01-01T10:00:00", 1, 1, "UK"),
        ("2", "A", "X", 1, "2024-01-01T10:00:00", 1, 2, "UK"), ("3", "A", "X", 1, "2024-01-01T10:00:00", 1, 2, "UK"),
        ("4", "A", "X", 1, "2024-01-01T10:00:00", 1, 3, "UK"), ("5", "A", "X", 1, "2024-02-01T09:00:00", 1, 3, "UK"), ("6", "A", "X", 1, "2024-03-01T09:00:00", 1, 3, "UK"),
        (None, "A", "X", 1, "2024-01-02T10:00:00", 1, 1, "UK"),
    ])
    segments = spark.createDataFrame([(1, "S"), (2, "S"), (3, "S")], "CustomerID long, Segment string")
    rows = lifecycle.second_purchase(customers.customer_base(clean_transactions(tx)).orders, segments, within=(29, 30)).collect()
    assert [tuple(r) for r in rows] == [("S", 3, 2, 0.6667, 15.0, 1, 2, 0.3333, 0.6667)]


def all_gaps(table):
    return {c: [(b[0] - a[0]).days for a, b in zip(own, own[1:])] for c, own in by_customer(table).items()}


def test_time_between_purchases(orders, segments, table):
    want = {}
    for c, gaps in all_gaps(table).items():
        want.setdefault(f"S{c % 3}", []).extend(gaps)
    got = {r.Segment: r for r in lifecycle.time_between_purchases(orders, segments).collect()}
    assert set(got) == set(want)
    for s, gaps in want.items():
        gaps.sort()
        r = got[s]
        assert (r.Gaps, r.MinDays, r.MaxDays, r.MedianDays) == (len(gaps), gaps[0], gaps[-1], gaps[(len(gaps) - 1) // 2])
        assert r.MeanDays == pytest.approx(sum(gaps) / len(gaps), abs=0.0051)


@pytest.mark.parametrize("bucket", ["hour", "month"])
def test_gap_rows_hold_every_gap(orders, table, bucket):
    got = {(r.CustomerID, r.GapDays): r.n for r in customers.gap_rows(orders, bucket).collect()}
    want = Counter((c, g) for c, gaps in all_gaps(table).items() for g in gaps)
    assert got == dict(want)


def test_sketches_keep_their_rank_error_also_when_merged(spark):
    rng = random.Random(8)
    k, bound = 400, 0.009
    for seed in range(3):
        whens, table = {c: datetime(2000, 1, 1) for c in (1, 2)}, []
        for i in range(6000):
            c = 1 + i % 2
            whens[c] += timedelta(days=int(rng.expovariate(1 / (3 if c == 1 else 20))), minutes=1)
            table.append((f"I{i}", "A", "X", 1, whens[c].isoformat(), 1, c, "UK"))
        orders = customers.customer_base(clean_transactions(lines(spark, table))).orders
        own = spark.createDataFrame([(1, "S1"), (2, "S2")], "CustomerID long, Segment string")
        sketches = lifecycle.gap_sketches(orders, own, k)
        gaps = {}
        for inv, _, _, _, when, _, c, _ in table:
            gaps.setdefault(c, []).append(ts(when))
        gaps = {c: sorted((b - a).days for a, b in zip(w, w[1:])) for c, w in gaps.items()}
        both = sorted(gaps[1] + gaps[2])
        shares = [0.05, 0.25, 0.5, 0.75, 0.95]
        quantile = F.kll_sketch_get_quantile_bigint("Sketch", F.array(*[F.lit(q) for q in shares])).alias("q")
        rows = {r.Segment: r.q for r in sketches.select("Segment", quantile).collect()}
        merged = sketches.agg(F.kll_merge_agg_bigint("Sketch").alias("Sketch")).select(quantile).first().q
        for found, exact in ((rows["S1"], gaps[1]), (rows["S2"], gaps[2]), (merged, both)):
            for q, value in zip(shares, found):
                assert bisect_left(exact, value) / len(exact) - bound <= q <= bisect_right(exact, value) / len(exact) + bound
        assert {r.Segment: r.Gaps for r in sketches.collect()} == {"S1": len(gaps[1]), "S2": len(gaps[2])}


def slope(points):
    n, sx, sy = len(points), sum(x for x, _ in points), sum(y for _, y in points)
    den = n * sum(x * x for x, _ in points) - sx * sx
    return float((n * sum(x * y for x, y in points) - sx * sy) / den) if den else None


def test_growth_equals_the_filled_series(orders, table):
    monthly = lifecycle.monthly_orders(orders)
    last = monthly.agg(F.max("Month")).first()[0]
    series = {}
    for r in lifecycle.calendar_series(monthly, F.lit(last)).collect():
        series.setdefault(r.CustomerID, []).append((r.X, r.Orders, r.Spend))
    own = by_customer(table)
    for r in lifecycle.value_growth(orders).collect():
        filled, first = sorted(series[r.CustomerID]), min(month(w) for w, _, _ in own[r.CustomerID])
        assert [x for x, _, _ in filled] == list(range(last - first + 1))
        assert (r.Months, r.FirstMonth, r.Orders) == (len(filled), name(first), len(own[r.CustomerID]))
        assert r.ActiveMonths == sum(o > 0 for _, o, _ in filled) < r.Months  # empty months count
        assert r.FrequencyGrowth == pytest.approx(slope([(x, o) for x, o, _ in filled]), rel=1e-9)
        assert r.SpendGrowth == pytest.approx(slope([(x, s) for x, _, s in filled]), rel=1e-9)
        assert r.OrderValueGrowth == pytest.approx(slope([(x, s / o) for x, o, s in filled if o]), rel=1e-5)


def test_growth_of_a_single_month_is_null(spark):
    tx = lines(spark, [("1", "A", "X", 1, "2024-01-01T10:00:00", 3, 1, "UK")])
    row = lifecycle.value_growth(customers.customer_base(clean_transactions(tx)).orders).first()
    assert tuple(row) == (1, "2024-01", 1, 1, 1, None, None, None)


def test_migration_matrix(orders, table):
    rules = Rules(active_days=200, recent_days=900, loyal_orders=15, regular_orders=8, high_value=4000, mid_value=2000)
    last = max(month(w) for _, w, _, _ in table)

    def label(own, m):
        own = [(w, a) for w, _, a in own if month(w) <= m]
        if not own:
            return "(new)", 0
        end = datetime((m + 1) // 12, (m + 1) % 12 + 1, 1)
        r, f, v = (end - max(w for w, _ in own)).days, len(own), sum(a for _, a in own)
        return " ".join(["Active" if r < 200 else "Recent" if r < 900 else "Inactive", "Loyal" if f > 15 else "Regular" if f > 8 else "Occasional",
                         "High-Value" if v > 4000 else "Mid-Value" if v > 2000 else "Low-Value"]), v

    for back in (0, 24, 400):
        want = {}
        for own in by_customer(table).values():
            (a, before), (b, now) = label(own, last - back), label(own, last)
            cell = want.setdefault((a, b), [0, 0, 0])
            for i, x in enumerate((1, before, now)):
                cell[i] += x
        got = lifecycle.segment_migration(orders, back, rules).collect()
        assert {(r.FromSegment, r.ToSegment): [r.Customers, r.MonetaryBefore, r.MonetaryNow] for r in got} == {
            k: [n, Decimal(b), Decimal(a)] for k, (n, b, a) in want.items()}
        for r in got:
            assert r.ShareOfFrom == pytest.approx(r.Customers / sum(v[0] for k, v in want.items() if k[0] == r.FromSegment), abs=5.1e-5)


def test_no_orders_give_no_rows(spark, segments):
    orders = customers.customer_base(clean_transactions(lines(spark, []))).orders
    for rows in (lifecycle.cohort_retention(orders), lifecycle.second_purchase(orders, segments), lifecycle.time_between_purchases(orders, segments),
                 lifecycle.value_growth(orders), lifecycle.segment_migration(orders), lifecycle.gap_sketches(orders, segments)):
        assert rows.count() == 0


def test_migration_and_retention_scan_the_lines_once(spark):
    from tillroll.plans import catalog
    from tillroll import session

    written = []
    keep = session.materialize

    def spy(df, *args, **kwargs):
        written.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, *args, **kwargs)

    for name, module in (("segment_migration", lifecycle), ("cohort_retention", lifecycle)):
        written.clear()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(module, "materialize", spy)
            patch.setattr(customers, "_materialize", spy)
            df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
            plans = [*written, df._jdf.queryExecution().optimizedPlan().toString()]
        assert sum(p.count("l_orderkey#") > 0 and "l_returnflag" in p for p in plans) == 1
