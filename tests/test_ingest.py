import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest

HEAD = "number_of_samples int, active_channels int, available_channels int, trajectory_dimensions int, discard_pre int, discard_post int, center_sample int, samples array<struct<re:float,im:float>>, trajectory array<float>, flags long"
Z = [(0.0, 1.0)] * 6


def record(**change):
    r = {"number_of_samples": 3, "active_channels": 2, "available_channels": 2, "trajectory_dimensions": 1, "discard_pre": 1, "discard_post": 0, "center_sample": 2, "samples": Z, "trajectory": [0.0] * 3, "flags": 0}
    return tuple((r | change).values())


def bit(*names):
    return ingest.mask(*names)


BAD = {
    "samples": {"samples": Z[:5]}, "trajectory": {"trajectory": [0.0]}, "available_channels": {"available_channels": 1}, "discard": {"discard_pre": 3, "discard_post": 1}, "center": {"center_sample": 3},
    "nonfinite": {"samples": Z[:5] + [(float("nan"), 0.0)]}, "empty": {"number_of_samples": 0, "active_channels": 0, "discard_pre": 0, "samples": [], "trajectory": []},
}


def test_layout_rules(spark):
    df = spark.createDataFrame([record(), *[record(**c) for c in BAD.values()]], HEAD)
    assert [r.e for r in df.select(ingest.layout_error().alias("e")).collect()] == [None, *BAD]
    good, bad = ingest.quarantine(df)
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == sorted(BAD)
    with pytest.raises(Exception, match="rejected"):
        ingest.admitted(df).collect()


def test_lanes_and_flags(spark):
    flags = {
        0: "imaging", bit("noise_measurement"): "noise", bit("parallel_calibration"): "calibration", bit("parallel_calibration", "parallel_calibration_and_imaging"): "calibration_and_imaging",
        bit("phase_correction"): "phase_correction", bit("navigation"): "navigator", bit("dummy_scan", "noise_measurement", "navigation"): "ignored_explicitly", bit("noise_measurement", "navigation"): "ambiguous",
        bit("first_in_slice", "last_in_measurement"): "imaging",
    }
    df = ingest.classify(spark.createDataFrame([(f,) for f in flags], "flags long"))
    assert {r.flags: r.lane for r in df.collect()} == flags
    assert ingest.route(df, "imaging").count() == 3 and ingest.route(df, "calibration").count() == 2
    bad = spark.createDataFrame([(bit("reverse"),), (bit("user_8"),), (1 << 40,), (bit("compression_2"),)], "flags long")
    assert bad.where(ingest.unsupported_flags(F.col("flags"))).count() == 4
    assert df.where(ingest.unsupported_flags(F.col("flags"))).count() == 0
    assert ingest.control_flags(df).where("first_in_slice and last_in_measurement").count() == 1


def test_duplicates(spark):
    cols = "k int, ky int, arrival int, payload string"
    same = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "a"), (1, 1, 3, "b")], cols)
    other = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "c"), (1, 1, 3, "b")], cols)
    run = lambda df, policy: sorted(map(tuple, ingest.deduplicated(df, ["k"], ["ky"], "arrival", ["payload"], policy).collect()))
    assert run(same, "ignore_identical") == [(1, 0, 1, "a"), (1, 1, 3, "b")]
    assert run(other, "replace_before_seal") == [(1, 0, 2, "c"), (1, 1, 3, "b")]
    for df, policy in ((same, "reject"), (other, "ignore_identical")):
        with pytest.raises(Exception, match="duplicate acquisition"):
            run(df, policy)
    with pytest.raises(ValueError):
        run(same, "other")


def test_frames_by_their_exact_set_of_lines(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0)], "k int, ky int")
    need = spark.createDataFrame([(0,), (1,)], "ky int")
    run = lambda policy: ingest.assembled(df, need, ["k"], ["ky"], policy).count()
    assert run("emit_partial") == 4 and run("certified_skip") == 3
    with pytest.raises(Exception, match="incomplete"):
        run("fail")
    with pytest.raises(ValueError):
        run("other")
    assert [tuple(r) for r in ingest.missing_coordinates(df, need, ["k"], ["ky"]).collect()] == [(2, 1)]
    # as many lines as asked for, but not the ones
    other = spark.createDataFrame([(3, 0), (3, 9), (4, 0), (4, 1), (4, 2)], "k int, ky int")
    assert sorted(map(tuple, ingest.coverage(other, need, ["k"], ["ky"]).collect())) == [(3, 1, 1, 1, False), (4, 2, 0, 1, False)]
    for policy in ingest.INCOMPLETE:
        with pytest.raises(Exception, match="unexpected coordinate|incomplete"):
            ingest.assembled(other, need, ["k"], ["ky"], policy).collect()
    # frames of their own: one of which nothing came is incomplete
    own = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (5, 0)], "k int, ky int")
    assert {r.k: r.complete for r in ingest.coverage(df, own, ["k"], ["ky"]).collect()} == {1: True, 2: True, 5: False}


def test_arrival_bounds(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 1), (2, 1, 99), (3, 0, 1), (3, 1, 1), (3, 2, 1)], "k int, ky int, at int")
    assert {r.k: r.error for r in ingest.bounded_arrivals(df, ["k"], ["ky"], "at", 2, 50).collect()} == {2: "span", 3: "lines"}


def test_gate_and_identity(spark):
    frames, tokens = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert {r.k: r.state for r in ingest.gated(frames, tokens, ["k"]).collect()} == {1: "pass", 2: "wait"}
    with pytest.raises(Exception, match="duplicate calibration"):
        ingest.gated(frames, tokens.union(tokens), ["k"]).collect()
    assert ingest.exact_join(frames, frames.withColumn("x", F.lit(1)), ["k"]).count() == 2
    with pytest.raises(Exception, match="identities"):
        ingest.exact_join(frames, tokens, ["k"]).collect()
    late = spark.createDataFrame([(1, 1), (3, 2), (2, 3), (3, 4)], "o int, a int")
    assert [r.o for r in ingest.arrival_violations(late, "o", "a").collect()] == [2]


def test_resolution(spark):
    df = spark.createDataFrame([(0, 1, 5), (1, 1, 6), (2, 2, 6), (3, 1, 6)], "n int, slice int, phase int")
    assert ingest.resolve(df, {"slice": 1, "phase": 6}, "n").first().n == 1
    assert ingest.resolve(df, {"slice": 9, "phase": 6}, "n").first().n == 1
