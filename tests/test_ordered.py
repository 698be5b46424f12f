"""Running totals in ranges: only the groups that ranges cut meet offsets."""

from pyspark.sql import functions as F

from vigil.operators import joins as J
from vigil.operators.ordered import running_totals


def test_many_groups_in_ranges_broadcast_few_rows(spark, monkeypatch):
    rows = [(f"g{i % 500}" if i % 500 else None, i, 1 + i % 3) for i in range(2000)] + [("hot", i, 2) for i in range(3000)]
    sides, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (sides.append(df), broadcast(df))[1])
    got = running_totals(spark.createDataFrame(rows, "g string, v long, w long"), ["g"], "v", ["w"], ranges=8, small_rows=0)
    want, cum, total = set(), {}, {}
    for g, v, w in sorted(rows, key=lambda r: r[1]):
        cum[g] = cum.get(g, 0) + w
        want.add((g, v, w, cum[g]))
        total[g] = total.get(g, 0) + w
    assert {tuple(r) for r in got.collect()} == {(*x, total[x[0]]) for x in want}
    assert sides and max(s.count() for s in sides) <= 16


def test_no_groups_in_ranges(spark):
    got = running_totals(spark.range(100), [], "id", ["id"], ranges=4, small_rows=0, descending=True)
    assert {(r.id, r.id_cum, r.id_total) for r in got.collect()} == {(i, sum(range(i, 100)), 4950) for i in range(100)}


def test_a_broadcast_side_fits_a_small_driver():
    assert J.BROADCAST_MAX_ROWS * 300 <= 64 << 20
