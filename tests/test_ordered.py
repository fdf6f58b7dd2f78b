"""Bucketed ordered work must not depend on where the buckets are cut."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidelake.operators import aggregates as A
from tidelake.operators import ordered as O

SMALL = 50  # rows per bucket that forces cuts


def _rows(seed=7, n=4000):
    rng = random.Random(seed)
    # a third of the rows in one key, one rare key, a NULL key
    keys = ["hot"] * (n // 3) + ["rare"] * 3 + [None] * 40 + [f"k{rng.randrange(20)}" for _ in range(n)]
    return [(k, i, rng.choice([1, 1, 2, 7])) for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.createDataFrame(_rows(), "k string, pos long, w long").repartition(5).cache()


def _expected_totals():
    run, out = {}, {}
    for k, pos, w in _rows():
        run[k] = run.get(k, 0) + w
        out[pos] = run[k]
    return out, run


@pytest.mark.parametrize("limit", [SMALL, 1_000_000])
def test_running_total(keyed, limit):
    out = O.running_total(keyed, "pos", {"t": "w"}, ["k"], {"all": "w"}, rows_per_bucket=limit).collect()
    upto, whole = _expected_totals()
    assert len(out) == len(_rows())
    for r in out:
        assert (r["t"], r["all"]) == (upto[r["pos"]], whole[r["k"]])


def test_running_total_without_keys(keyed):
    out = O.running_total(keyed, "pos", {"t": "w"}, rows_per_bucket=SMALL).collect()
    total, want = 0, {}
    for _, pos, w in _rows():
        total += w
        want[pos] = total
    assert {r["pos"]: r["t"] for r in out} == want


def test_buckets_are_bounded_and_ordered(keyed):
    cut, split = O.bucket_by_order(keyed, ["k"], "pos", SMALL)
    assert split
    sizes = cut.groupBy("k", O.BUCKET).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * SMALL
    spans = cut.groupBy("k", O.BUCKET).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()
    by_key = {}
    for r in spans:
        by_key.setdefault(r["k"], []).append((r[O.BUCKET], r["lo"], r["hi"]))
    for parts in by_key.values():
        parts.sort()
        assert all(a[2] < b[1] for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("limit", [SMALL, 1_000_000])
def test_forward_fill(spark, limit):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else "cold", i, rng.choice([None, "", "  ", None, None, f"v{i}"])) for i in range(1500)]
    rows += [("blank", i, "") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, pos long, v string").repartition(4)
    got = {(r["k"], r["pos"]): r["v"] for r in O.forward_fill(df, ["k"], "pos", ["v"], limit).collect()}
    last = {}
    for k, pos, v in rows:
        if v and v.strip():
            last[k] = v
        assert got[(k, pos)] == last.get(k)
    assert len(got) == len(rows)


def _reference_groups(days, gap=6):
    """Join the run with the nearest member less than ``gap`` days away, for sorted dates."""
    groups = []
    for d in sorted(days):
        near = [g for g in groups if min(abs((d - x).days) for x in g) < gap]
        near[0].append(d) if near else groups.append([d])
    return groups


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_gap_groups(spark, limit):
    rng = random.Random(11)
    days = {dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(900)) for _ in range(150)}
    df = spark.createDataFrame([(d,) for d in days for _ in range(2)] + [(None,)], "day date")
    got = {}
    for r in O.gap_groups(df, "day", rows_per_bucket=limit).collect():
        got.setdefault(r["group_id"], []).append(r["day"])
    assert sorted(sorted(g) for g in got.values()) == _reference_groups(days)
    one = O.gap_groups(df.filter("day IS NOT NULL").limit(1), "day").collect()
    assert [r["group_id"] for r in one] == [1]
    assert O.gap_groups(df.filter("day IS NULL"), "day").collect() == []


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_gap_groups_within_keys(spark, limit):
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 2, None]), dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(900))) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, day date")
    want = {}
    for k in (1, 2, None):
        n, before = 0, None
        for day in sorted({d for x, d in rows if x == k}):
            n += before is None or (day - before).days >= 6
            want[k, day], before = n, day
    got = O.gap_groups(df, "day", rows_per_bucket=limit, keys=["k"])
    assert {(r["k"], r["day"]): r["group_id"] for r in got.collect()} == want
    ranges = O.gap_ranges(got, "day", ["k"]).collect()
    assert len(ranges) == len({(k, n) for (k, _), n in want.items()})


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_row_budget_groups(spark, limit):
    rng = random.Random(5)
    counts = [(dt.date(2021, 1, 1) + dt.timedelta(days=i), rng.choice([5, 30, 70, 250])) for i in range(200)]
    df = spark.createDataFrame([*counts, (None, 33)], "day date, cnt long")
    got = {r["day"]: (r["running"], r["group_id"]) for r in O.row_budget_groups(df, "day", "cnt", 100, limit).collect()}
    total, group, before = 0, 0, 0
    for i, (day, cnt) in enumerate(counts):
        total += cnt
        inside = total % 100
        if (i and inside < before) or cnt > 100:
            group += 1
        before = inside
        assert got[day] == (total, group)
    assert got[None] == (None, -1)


def _quantile(xs, f):
    xs = sorted(xs)
    pos = (len(xs) - 1) * f
    low = int(pos)
    high = min(low + 1, len(xs) - 1)
    return xs[low] + (xs[high] - xs[low]) * (pos - low)


@pytest.mark.parametrize("limit", [20, 1_000_000])
def test_spread(spark, limit):
    rng = random.Random(9)
    values = {"hot": [rng.gauss(100, 30) for _ in range(900)] + [5.0] * 500, "one": [3.5], "two": [1.0, 2.0],
              "ints": [float(rng.randrange(6)) for _ in range(300)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("hot", None)], "k string, v double")
    got = {r["k"]: r for r in A.spread_of(df, "v", ["k"], rows_per_bucket=limit).collect()}
    for k, vs in values.items():
        skip = int(len(vs) * 0.2)
        kept = sorted(vs)[skip:len(vs) - skip]
        med = statistics.median(vs)
        assert got[k]["n"] == len(vs)
        assert got[k]["trimmed_mean"] == pytest.approx(statistics.fmean(kept))
        assert got[k]["median"] == pytest.approx(med)
        assert got[k]["mad"] == pytest.approx(1.4826 * statistics.median(abs(v - med) for v in vs))
        assert got[k]["sd"] == (None if len(vs) == 1 else pytest.approx(statistics.stdev(vs)))
    whole = A.spread_of(df, "v", rows_per_bucket=limit).first()
    assert whole["median"] == pytest.approx(statistics.median([v for vs in values.values() for v in vs]))
    quantiles = {r["k"]: r["quantile"] for r in A.quantile_of(df, "v", 0.875, ["k"], limit).collect()}
    for k, vs in values.items():
        assert quantiles[k] == pytest.approx(_quantile(vs, 0.875))


def test_concat_in_parts(spark):
    rows = [("hot", i, f"line {i}") for i in range(400)] + [("cold", i, f"c{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "k string, pos long, t string").repartition(6)
    whole = {r["k"]: r["joined"] for r in A.concat_per_key(df, "k", "pos", "t", 1 << 20).collect()}
    assert whole["hot"].split("\n") == [f"line {i}" for i in range(400)]
    for limit in (SMALL, 1_000_000):
        parts = A.concat_per_key(df, "k", "pos", "t", bytes_per_part=500, rows_per_bucket=limit).orderBy("k", "part").collect()
        hot = [r["joined"] for r in parts if r["k"] == "hot"]
        assert len(hot) > 5 and max(map(len, hot)) <= 500
        assert "\n".join(hot) == whole["hot"]
        assert [r["joined"] for r in parts if r["k"] == "cold"] == [whole["cold"]]


def test_buckets_follow_the_rows(spark):
    """More buckets than one step of cuts can make; none above twice the budget."""
    df = spark.range(200_000).select(F.lit("hot").alias("k"), "id").repartition(8)
    cut, split = O.bucket_by_order(df, ["k"], "id", 50)
    sizes = cut.groupBy(O.BUCKET).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy(O.BUCKET).collect()
    assert split and len(sizes) > O.MAX_CUTS and max(r["n"] for r in sizes) <= 100
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))
    total = O.running_total(df, "id", {"upto": F.lit(1)}, ["k"], rows_per_bucket=50)
    assert total.filter("upto <> id + 1").isEmpty()
