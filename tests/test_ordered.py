import random

from pyspark.sql import functions as F

from pageproof.operators.ordered import latest_per_key, ordered_scan, sequence_number


def test_scan_equals_brute_force_over_segments(spark):
    rng = random.Random(7)
    rows = [(g, o, rng.choice([None, None, "x", "y", "z"]), rng.randint(0, 3)) for g in ("hot", "b") for o in rng.sample(range(400), 150 if g == "hot" else 9)]
    df = spark.createDataFrame(rows, "g string, o bigint, v string, n bigint")
    out = ordered_scan(
        df, ["g"], "o", sums={"total": F.col("n")}, last={"upto": F.col("v")}, prev={"before": F.col("v")}, next={"onward": F.col("v")}, segment_rows=25
    )
    got = {(r.g, r.o): (r.total, r.upto, r.before, r.onward) for r in out.collect()}
    for g in ("hot", "b"):
        group = sorted(r for r in rows if r[0] == g)
        group.sort(key=lambda r: r[1])
        for k, (_, o, _, _) in enumerate(group):
            seen = [r[2] for r in group[: k + 1] if r[2]]
            earlier = [r[2] for r in group[:k] if r[2]]
            later = [r[2] for r in group[k:] if r[2]]
            want = (sum(r[3] for r in group[: k + 1]), (seen or [None])[-1], (earlier or [None])[-1], (later or [None])[0])
            assert got[(g, o)] == want


def test_sequence_and_latest(spark):
    df = spark.createDataFrame([("a", 5, "p"), ("a", 900, "q"), ("a", 41, "r"), ("b", 1, "s")], "k string, o bigint, v string")
    seq = {(r.k, r.v): r.i for r in sequence_number(df, ["k"], "o", "i", segment_rows=10).collect()}
    assert seq == {("a", "p"): 1, ("a", "r"): 2, ("a", "q"): 3, ("b", "s"): 1}
    assert {(r.k, r.v) for r in latest_per_key(df, ["k"], "o").collect()} == {("a", "q"), ("b", "s")}


def test_no_window_is_partitioned_by_the_group_alone(spark):
    """Rows are windowed per segment; only segment summaries per group."""
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"))
    plan = sequence_number(df, ["g"], "o", "i", 10)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_seg" in line for line in windows)
