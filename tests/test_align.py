from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageproof.functions import align

seqs = st.lists(st.integers(0, 5), max_size=40)


def table_walk(a, b):
    """Plain quadratic table and walk, as the definition reads."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [None] * n, 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out[i] = j
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


@settings(max_examples=400, deadline=None)
@given(seqs, seqs)
def test_alignment_equals_the_table(a, b):
    assert align.lcs_alignment(a, b) == table_walk(a, b)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=200), st.lists(st.integers(0, 3), max_size=200))
def test_banded_alignment_equals_the_table(a, b):
    kept, align._DIRECT_CELLS = align._DIRECT_CELLS, 1
    try:
        assert align.lcs_alignment(a, b) == table_walk(a, b)
    finally:
        align._DIRECT_CELLS = kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "C", "d"]), max_size=15), st.lists(st.sampled_from(["a", "B", "c", "e"]), max_size=15))
def test_diff_rebuilds_both_sides(e, a):
    segments = align.word_diff(" ".join(e), " ".join(a))
    assert [s[1] for s in segments if s[1] is not None] == e
    assert [s[2] for s in segments if s[2] is not None] == a
    assert all(s[1].lower() == s[2].lower() for s in segments if s[0] == "same")


def test_diff_cases():
    assert align.word_diff("same words", "Same words") == [("same", "same", "Same"), ("same", "words", "words")]
    assert ("changed", "red", "blue") in align.word_diff("a red car", "a blue car")
    assert align.word_diff("a b c", "a c") == [("same", "a", "a"), ("removed", "b", None), ("same", "c", "c")]
    assert align.word_diff("a c", "a b c")[1] == ("added", None, "b")


def test_summary_sentences(spark):
    rows = spark.createDataFrame([("a red car", "a blue car now"), ("one two", "one"), ("x", "x y z")], "e string, a string")
    got = [
        r[0]
        for r in rows.withColumn("d", align.diff_words("e", "a")).select(align.diff_summary("d", "H2 heading")).collect()
    ]
    assert got == [
        'H2 heading has changed — 1 word changed, 1 word added (e.g. "red" → "blue").',
        'H2 heading has changed — 1 word missing (e.g. missing "two").',
        'H2 heading has changed — 2 words added (e.g. extra "y").',
    ]


def test_udf_keeps_null(spark):
    rows = spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("a"), F.lit(None).cast("array<string>").alias("b"))
    assert rows.select(align.lcs_align("a", "b")).first()[0] is None


def test_diffs_of_a_batch_are_not_held_as_objects():
    import tracemalloc

    import pyarrow as pa

    words = " ".join(f"w{i}" for i in range(2000))
    expected = pa.array([words, None, "", "a b", *[words.replace("w7 ", "")] * 100])
    actual = pa.array([words, "x", "", "A c d", *[words] * 100])
    tracemalloc.start()
    found = align.diff_array(expected, actual)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # 200,000 segments
    for e, a, got in zip(expected[:6].to_pylist(), actual[:6].to_pylist(), found[:6].to_pylist()):
        want = None if e is None else [dict(zip(("type", "expected", "actual"), s)) for s in align.word_diff(e, a)]
        assert got == want
    assert [len(x) for x in found[4:].to_pylist()] == [2000] * 100
