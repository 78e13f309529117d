"""Category penetration: every level of the cube against sets in Python, empty cells, ids far apart."""

import random

from helpers import lines

from tillroll.operators.penetration import category_penetration
from tillroll.sources import clean_transactions


def test_all_levels_and_empty_cells(spark):
    rng = random.Random(4)
    ids = [1, 2, 32_768, 32_769, 5_000_000_000, 7, 8, -3]
    segment = {c: f"S{i % 3}" for i, c in enumerate(ids)} | {99: "Quiet"}  # a segment that bought nothing
    table = []
    for i in range(60):
        c, word = rng.choice(ids), rng.choice(["Red", "Blue", None, " led"])
        if not (segment[c] == "S1" and word == "Red"):
            table.append((f"I{i}", "A", word and f"{word} mug", rng.choice([1, 2, -1]), "2024-01-01T10:00:00", 3, c, "UK"))
    table += [("X", "A", "Green mug", 1, "2024-01-01T10:00:00", 3, 4242, "UK")]  # a customer without a segment
    segments = spark.createDataFrame(list(segment.items()), "CustomerID long, Segment string")
    got = {(r.Level, r.Segment, r.Category): (r.Customers, r.SegmentCustomers, float(r.Revenue), r.Penetration)
           for r in category_penetration(clean_transactions(lines(spark, table)), segments).collect()}
    own = [(segment[c], "(none)" if d is None else d.split(" ")[0], c, q * 3) for _, _, d, q, _, _, c, _ in table if q > 0 and c in segment]
    want = {}
    names, categories = sorted(set(segment.values())), sorted({k for _, k, _, _ in own})
    for level, cells in ((0, [(s, k) for s in names for k in categories]), (1, [(s, None) for s in names]), (2, [(None, k) for k in categories]), (3, [(None, None)])):
        for s, k in cells:
            rows = [r for r in own if s in (None, r[0]) and k in (None, r[1])]
            size = sum(s in (None, x) for x in segment.values())
            n = len({r[2] for r in rows})
            want[level, s, k] = (n, size, float(sum(r[3] for r in rows)), round(n / size + 1e-12, 4))
    assert got == want
    assert got[0, "Quiet", "Blue"] == (0, 1, 0.0, 0.0) and got[0, "S1", "Red"][0] == 0


def test_no_lines(spark):
    segments = spark.createDataFrame([(1, "S")], "CustomerID long, Segment string")
    rows = category_penetration(clean_transactions(lines(spark, [])), segments).collect()
    assert [(r.Level, r.Segment, r.Customers) for r in rows] in ([(1, "S", 0)], [(1, "S", 0), (3, None, 0)])
