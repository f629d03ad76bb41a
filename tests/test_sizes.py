"""What only larger or denser tables show."""

import random
import time
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd

from tests.plain_learner import PlainLearner
from tidewatch import catalogue
from tidewatch.operators import clustering, intervals, leaktests
from tidewatch.operators import relational as rel
from tidewatch.operators import signal

T0 = datetime(2024, 1, 1)


def test_baselines_have_the_last_bits_of_the_sql(spark):
    """A drop of exactly the threshold is decided by the last bits of the mean, so they must be those of the SQL."""
    rng = random.Random(4)
    rows = [("k", i, T0 + timedelta(seconds=i // 3), rng.randrange(20000) / 100) for i in range(3000)]
    r = pd.DataFrame(rows, columns=["circuit", "id", "ts", "value"])  # noqa: F841, read by the SQL
    want = dict(duckdb.connect().execute("SELECT id, CASE WHEN count(value) OVER w = 80 THEN avg(value) OVER w END FROM r WINDOW w AS (PARTITION BY circuit ORDER BY ts, id ROWS BETWEEN 199 PRECEDING AND 120 PRECEDING)").fetchall())
    df = spark.createDataFrame(rows, "circuit string, id long, ts timestamp_ntz, value double")
    got = {x.id: x.baseline for x in signal.lagged_baseline(df, "circuit", ["ts", "id"], "value").collect()}
    assert got == want and sum(v is not None for v in want.values()) == 2801


def test_nearest_by_pivots_over_a_table_of_several_files(spark):
    """Ten thousand vectors in several files: the plan that picks pivots and gathers them at once has no column to read there."""
    d = "/root/testdata/check_s"
    got = {r["vec_id"]: (r["center_id"], r["distance"]) for r in catalogue.QUERIES["jn11_pivots"](spark, d).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    want = {v: (c, x) for v, c, x in con.execute(catalogue.SQL["jn11_pivots"]).fetchall()}
    assert got == want and len(got) == 10256


def test_slices_of_centers_and_copies(spark):
    """Many slices on both sides, copies of one center, and components that are no numbers."""
    dice = np.random.default_rng(8)
    centers = np.round(np.concatenate([dice.normal(0, 1, (400, 4)), np.zeros((100, 4))]), 2)
    points = np.round(np.concatenate([dice.normal(0, 1, (120, 4)), np.zeros((30, 4))]), 2)
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centers)], "center_id long, c array<double>")
    pdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)] + [(900, [1.0, None, 0.0, 0.0])], "id long, v array<double>")
    got = {r["id"]: (r["center_id"], r["distance"]) for r in rel.nearest_by_pivots(pdf, cdf, "v", "c", pivots=5, block=7, slice_rows=20).collect()}
    assert got.pop(900) == (None, None) and len(got) == 150
    for i, v in enumerate(points):
        gaps = (centers - v) ** 2
        d = np.sqrt(((gaps[:, 0] + gaps[:, 1]) + gaps[:, 2]) + gaps[:, 3])
        assert got[i] == (int(d.argmin()), d.min())


def test_first_reading_that_ends_a_run_by_levels(spark):
    """Runs of any length look through few nodes: against a plain search, with four levels and runs that nothing ends."""
    dice = random.Random(9)
    readings = [("a" if i < 400 else "b", i, T0 + timedelta(seconds=(i % 400) // 2 * 10), dice.choice([40.0] * 40 + [43.5, 36.5, None]), dice.choice([0.0] * 60 + [11.0])) if dice.random() < 0.9 else ("a", i, T0, None, None) for i in range(500)]
    runs = [(dice.choice("abc"), i, T0 + timedelta(seconds=dice.randrange(-5, 2100)), dice.choice([None, 40.0, 43.5])) for i in range(300)]
    pdf = spark.createDataFrame(readings, "circuit string, id long, ts timestamp_ntz, pressure double, drop_5s double")
    rdf = spark.createDataFrame(runs, "circuit string, id long, begin timestamp_ntz, baseline double")
    got = {r["id"]: (r["beyond"]["pid"], r["beyond"]["r"]) for r in leaktests.first_beyond(rdf, pdf, 3.0, 10.0, fan=4).collect()}
    want = {}
    for circuit, run, begin, base in runs:
        for _, pid, _, pressure, drop in sorted((x for x in readings if x[0] == circuit and x[2] >= begin), key=lambda x: (x[2], x[1])):
            fall = None if base is None or pressure is None else base - pressure
            r = 4 if fall is not None and fall < -3 else 9 if drop is not None and drop > 10 else 3 if fall is not None and fall > 3 else None
            if r:
                want[run] = (pid, r)
                break
    assert got == want and 0 < len(want) < 300


def test_means_of_spans_without_pairs(spark):
    """Against the pairs themselves: copies of spans, points at the ends, nulls, values that are no numbers, and a small value beside large ones."""
    dice = random.Random(10)
    points = [(dice.choice("ab"), T0 + timedelta(seconds=dice.randrange(2000)), dice.choice([None, 0.25, 3.1, 1e14]) if dice.random() < 0.99 else dice.choice([float("inf"), float("nan")])) for _ in range(400)]
    spans = [(dice.randrange(60), dice.choice(["a", "b", None]), T0 + timedelta(seconds=(s := dice.randrange(2000))), T0 + timedelta(seconds=s + dice.choice([-90, -10, 0, 5, 400]))) for _ in range(90)]
    pdf = spark.createDataFrame(points, "circuit string, ts timestamp_ntz, value double")
    sdf = spark.createDataFrame(spans, "id long, circuit string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = {(r.id, r.circuit): (r.n, r.inside, r.baseline) for r in intervals.range_means(sdf, pdf, "circuit", "id", "start_ts", "end_ts", "ts", "value", 30.0).collect()}
    want = {}
    for i, c, start, end in spans:
        for circuit, ts, v in points:
            if circuit == c and start - timedelta(seconds=30) <= ts <= end:
                own = want.setdefault((i, c), [0, [], []])
                own[0] += 1
                own[1] += [v] if v is not None and ts >= start else []
                own[2] += [v] if v is not None and ts <= start else []
    assert got.keys() == want.keys() and len(want) > 30
    for k, (n, inside, base) in want.items():
        mean = lambda x: float(np.mean(x)) if x else None
        assert got[k][0] == n and all(a == b or a is not None and np.isclose(a, b, rtol=1e-12, equal_nan=True) for a, b in zip(got[k][1:], (mean(inside), mean(base)), strict=True)), k


def test_learner_equals_a_plain_one_in_less_time(spark):
    """To the last bit, with few far groups and with many that overlap; the far ones, as in the tables, in well under the time."""
    dice = np.random.default_rng(11)
    for rows, most in ((dice.normal(0, 3.0, (2500, 9)), 0.7), (dice.normal(0, 0.9, (1500, 3)), None)):
        took, found = [], []
        for learner in (PlainLearner(1.5, 0.05), clustering.MicroClusters(1.5, 0.05)):
            began = time.process_time()
            own = []
            for x in rows:
                learner.learn(x)
                own.append(learner.nearest(x))
            took.append(time.process_time() - began)
            found.append((own, {i: (g, c.tolist()) for i, (g, c) in learner.groups().items()}))
        assert found[0] == found[1]
        assert most is None or took[1] < most * took[0]
