import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import diagnostics
from tessera.__main__ import main as command
from tessera.functions import special
from tessera.grid import from_numpy, to_numpy
from tessera.operators import arrays, fft, image, linalg, signal
from tessera.plans import runs
from tessera.plans.runs import ArtifactStore
from tessera.registry import OPERATORS, contract
from tessera.sources import formats
from tessera.streaming.assembly import assembled_stream, gated_stream


@pytest.mark.parametrize("compressed", [False, True])
def test_mat_round_trip(tmp_path, compressed):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=(3, 4)), "z": rng.normal(size=(2, 3, 2)) + 1j * rng.normal(size=(2, 3, 2)), "f": rng.normal(size=(2, 2, 2, 2)).astype("f4"), "i": np.arange(6, dtype="i4").reshape(2, 3)}
    sparse = ((4, 3), np.array([0, 3, 1]), np.array([0, 0, 2]), np.array([1.5, -2.0, 4.0]))
    path = str(tmp_path / "x.mat")
    formats.write_mat(path, data | {"s": sparse, "v": np.arange(3.0)}, compressed)
    back = formats.read_mat(path)
    for k, a in data.items():
        assert back[k].shape == a.shape and np.array_equal(back[k], a)
    assert back["s"][0] == (4, 3) and [x.tolist() for x in back["s"][1:]] == [[0, 3, 1], [0, 0, 2], [1.5, -2.0, 4.0]]
    assert back["v"].shape == (3, 1)
    with pytest.raises(ValueError):
        (tmp_path / "y").write_bytes(b"x" * 200)
        formats.read_mat(str(tmp_path / "y"))


def test_small_formats(tmp_path, monkeypatch):
    a = np.arange(6).reshape(2, 3) + 1j
    formats.write_cfl(str(tmp_path / "c"), a)
    assert np.allclose(formats.read_cfl(str(tmp_path / "c")), a)
    formats.write_pgm(str(tmp_path / "p"), np.array([[0.0, 300.0, np.nan]]))
    assert formats.read_pgm(str(tmp_path / "p")).tolist() == [[0, 255, 0]]
    log = str(tmp_path / "l")
    assert not formats.append_jsonl(log, "x")
    monkeypatch.setenv("TESSERA_DEBUG", "1")
    assert formats.append_jsonl(log, 'x"', {"a": 1}) and '"event": "x\\""' in open(log).read()


def test_header():
    xml = """<h xmlns="u"><acquisitionSystemInformation><receiverChannels>2</receiverChannels></acquisitionSystemInformation><encoding><encodedSpace><matrixSize><x>4</x><y>2</y><z>1</z></matrixSize>
    <fieldOfView_mm><x>4.0</x><y>2</y><z>1</z></fieldOfView_mm></encodedSpace><encodingLimits><slice><minimum>0</minimum><maximum>3</maximum><center>1</center></slice></encodingLimits><trajectory>radial</trajectory></encoding></h>"""
    d = formats.scan_header(xml)
    e = d["encodings"][0]
    assert d["receiver_channels"] == 2 and e["encoded"] == {"x": 4, "y": 2, "z": 1} and e["trajectory"] == "radial" and e["limits"]["slice"]["maximum"] == 3


def test_image_sink(spark, tmp_path):
    g = from_numpy(spark, np.array([[1.0, 2.0]]))
    formats.write_images(g.df, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2
    with pytest.raises(Exception, match="negative"):
        formats.write_images(g.map(lambda v: -v).df, str(tmp_path / "j"))


def stream(spark, tmp_path, batches, schema):
    src = tmp_path / "src"
    src.mkdir(exist_ok=True)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def test_frames_from_a_stream(spark, tmp_path):
    batches = [[(1, 0, "a"), (2, 0, "x")], [(1, 1, "b"), (1, 1, "c")], [(1, 0, "late"), (2, 5, "?")]]
    lines = stream(spark, tmp_path, batches, "k int, ky int, payload string")
    out = assembled_stream(lines, ["k"], 2)
    q = out.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.k, r.status) for r in spark.table("frames").collect())
    assert got.count((1, "complete")) == 1 and (2, "unexpected") in got and (2, "complete") not in got
    assert len([g for g in got if g in ((1, "late"), (1, "duplicate"))]) == 2


def test_calibration_stream(spark, tmp_path):
    """A frame waits for its token; a second token of a key is told, not joined; what waits beyond the bound is told too."""
    frames = stream(spark, tmp_path, [[(1, "f1"), (1, "g1"), (1, "h1")], [(2, "f2")], [(2, "g2")]], "k int, frame string")
    (tmp_path / "t").mkdir()
    tokens = stream(spark, tmp_path / "t", [[(2, "t2")], [(2, "t2"), (3, "t3")]], "k int, token string")
    q = gated_stream(frames, tokens, "k", most_waiting=2).writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.k, r.status, r.frame or "") for r in spark.table("gate").collect())
    assert got == [(1, "horizon", "h1"), (2, "duplicate_token", ""), (2, "pass", "f2"), (2, "pass", "g2")]


def test_frames_whose_token_never_comes(spark, tmp_path):
    frames = stream(spark, tmp_path, [[(1, "f1")], [(2, "f2")]], "k int, frame string")
    (tmp_path / "t").mkdir()
    tokens = stream(spark, tmp_path / "t", [[(2, "t2")]], "k int, token string")
    q = gated_stream(frames, tokens, "k", idle_ms=2000).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp3")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if any(r.status == "missing_token" for r in spark.table("idle").collect()):
                break
            time.sleep(1)
    finally:
        q.stop()
    assert {(r.k, r.status, r.frame) for r in spark.table("idle").collect()} == {(1, "missing_token", "f1"), (2, "pass", "f2")}


def test_frames_whose_lines_never_come(spark, tmp_path):
    lines = stream(spark, tmp_path, [[(1, 0, "a"), (2, 0, "x")], [(2, 1, "y")]], "k int, ky int, payload string")
    q = assembled_stream(lines, ["k"], 2, idle_ms=2000).writeStream.format("memory").queryName("slow").option("checkpointLocation", str(tmp_path / "cp4")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if any(r.status == "incomplete" for r in spark.table("slow").collect()):
                break
            time.sleep(1)
    finally:
        q.stop()
    assert {(r.k, r.status) for r in spark.table("slow").collect()} == {(1, "incomplete"), (2, "complete")}


def test_artifact_store(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path / "a"), ("noise", "phase"))
    assert store.acquire("noise") is None
    store.publish("noise", spark.range(3))
    assert store.acquire("noise").count() == 3
    with pytest.raises(ValueError, match="published already"):
        store.publish("noise", spark.range(4))
    with pytest.raises(KeyError):
        store.acquire("other")
    assert store.end_of_input() == ["phase"] and store.acquire("noise").count() == 3
    for call in (lambda: store.publish("phase", spark.range(1)), lambda: store.acquire("phase")):
        with pytest.raises(RuntimeError):
            call()
    store.abort()
    with pytest.raises(RuntimeError):
        store.acquire("noise")


def test_run_records(spark):
    course = [e for _, e in runs.COURSE[:-1]]
    cases = {
        1: (course, ("completed", "none", True, 0)), 2: (course[:2] + ["reject", "admit"], ("rejected", "none", False, 1)), 3: (["begin_planning", "request_cancel"], ("cancelled", "none", False, 1)),
        4: (course[:7] + ["request_cancel", "begin_terminal_cleanup", "finish_terminal_cleanup"], ("cancelled", "cancel", True, 0)),
        5: (course[:7] + ["request_cancel", "begin_terminal_cleanup", "fail", "request_cancel", "finish_terminal_cleanup", "start"], ("failed", "failure", True, 1)),
        6: (course[:3] + ["fail_invariant", "fail", "begin_terminal_cleanup", "finish_terminal_cleanup"], ("failed", "invariant", False, 0)), 7: (course[:6] + ["reject"], ("running", "none", True, 1)),
    }
    events = spark.createDataFrame([(k, i, e) for k, (es, _) in cases.items() for i, e in enumerate(es)], "scan_id int, seq int, event string").repartition(3)
    got = {r.scan_id: (r.state, r.cause, r.admitted, r.refused) for r in runs.run_records(events).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}


def test_containers_and_limits(spark, tmp_path):
    row = spark.range(2).select(F.col("id").alias("ordinal"), F.array(F.struct(F.lit(1.0).cast("float").alias("re"), F.lit(0.0).cast("float").alias("im"))).alias("samples"), F.array().cast("array<float>").alias("trajectory"))
    row.write.parquet(str(tmp_path / "r/scan1/acquisitions.parquet"))
    row.write.parquet(str(tmp_path / "r/deep/scan2/images"))
    spark.range(1).write.parquet(str(tmp_path / "r/deep/scan2/header.parquet"))
    found = formats.discover_containers(spark, str(tmp_path / "r"))
    assert [(c["path"].rsplit("/", 1)[1], c["has_header"], c["has_acquisitions"], c["has_images"], c["acquisition_count"], c["image_count"]) for c in found] == [("scan2", True, False, True, 0, 2), ("scan1", False, True, False, 2, 0)]
    for limits in (formats.ReadLimits(group_depth=0), formats.ReadLimits(group_count=2), formats.ReadLimits(acquisition_count=1)):
        with pytest.raises(ValueError):
            formats.discover_containers(spark, str(tmp_path / "r"), limits)
    assert formats.bounded_acquisitions(row).count() == 2
    for limits in (formats.ReadLimits(acquisition_payload_bytes=4), formats.ReadLimits(acquisition_count=1)):
        with pytest.raises(Exception, match="limit"):
            formats.bounded_acquisitions(row, limits).collect()


@pytest.mark.parametrize("f, ref", [(special.erf, math.erf), (special.erfc, math.erfc), (special.gamma, math.gamma), (special.log_gamma, math.lgamma)])
def test_special_functions_of_any_number(spark, f, ref):
    xs = [None, float("nan"), float("inf"), -float("inf"), 0.0, -1.0, -2.5, 1e6, -1e6, 1e300, 0.5, 5.0, 26.0, -26.0, 1e-300]

    def want(x):
        try:
            return None if x is None else ref(x)
        except ValueError:
            return float("nan") if ref is math.gamma else float("inf")
        except OverflowError:
            return float("inf")

    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for r in df.select("i", f(F.col("x")).alias("y")).collect():
        assert r.y == want(xs[r.i]) or r.y != r.y and want(xs[r.i]) != want(xs[r.i]) or r.y == pytest.approx(want(xs[r.i]), rel=1e-12), (xs[r.i], r.y)


def test_bessel_functions_do_not_depend_on_their_neighbours(spark):
    xs = [0.0, 1.5, 49.0, 51.0, 1e6, 1e300, float("inf"), -float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for n in (0, 1, 7):
        together = {r.i: r.y for r in df.select("i", special.bessel_j(n, F.col("x")).alias("y")).coalesce(1).collect()}
        for i, x in enumerate(xs[:4]):
            alone = df.where(F.col("i") == i).select(special.bessel_j(n, F.col("x")).alias("y")).first().y
            t = (np.arange(4000) + 0.5) * math.pi / 4000
            assert alone == together[i] == pytest.approx(np.cos(n * t - x * np.sin(t)).mean(), abs=1e-14)
        assert together[6] == together[7] == 0.0 and math.isnan(together[8]) and together[9] is None and abs(together[4]) < 1e-3


def test_kernels_against_numpy(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(4, 6)) + 1j * rng.normal(size=(4, 6))
    g = from_numpy(spark, a)
    assert np.allclose(to_numpy(fft.transform(g, centered=True)), np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(a))))
    assert np.allclose(to_numpy(fft.ifft2(fft.fft2(g, "forward"), "none")), a / 24 * 24)
    v = rng.normal(size=(2, 3, 4))
    assert np.allclose(to_numpy(fft.fft3(from_numpy(spark, v))), np.fft.fftn(v))
    sq = rng.normal(size=(3, 3))
    m = from_numpy(spark, sq)
    assert np.allclose(to_numpy(linalg.pseudo_inverse(m)), np.linalg.inv(sq)) and np.allclose(to_numpy(linalg.determinant(m)), np.linalg.det(sq))
    w, vec = to_numpy(linalg.eigenvalues(m)), to_numpy(linalg.eigenvectors(m))
    assert np.allclose(sq @ vec, vec * w)
    u, s, vh = linalg.svd(m)
    assert np.allclose(to_numpy(u) @ np.diag(to_numpy(s)) @ to_numpy(vh), sq)
    tall, b = rng.normal(size=(6, 2)), rng.normal(size=6)
    want = np.linalg.lstsq(tall, b, rcond=None)[0]
    for method in linalg.LEAST_SQUARES:
        assert np.allclose(to_numpy(linalg.solve_least_squares(from_numpy(spark, tall), from_numpy(spark, b), method)), want)
    low = linalg.downhill_simplex(from_numpy(spark, np.array([2.0, 2.0])), lambda x: (x[0] - 0.5) ** 2 + (x[1] - 9) ** 2, [-5, -5], [5, 3])
    assert np.allclose(to_numpy(low), [0.5, 3.0], atol=1e-3)
    inv, sigma = linalg.cholesky_prewhiten_calibration(from_numpy(spark, rng.normal(size=(2, 50)) * [[1.0], [3.0]]))
    assert to_numpy(inv).shape == (2, 2) and sigma.first().largest > sigma.first().least


def test_images_against_numpy(spark):
    x = np.zeros((7, 9))
    x[1:4, 1:4] = 1
    x[5, 5:8] = 1
    x[2, 2] = 0
    g = from_numpy(spark, x)
    assert to_numpy(image.connected_components(g)).max() == 2
    assert to_numpy(image.fill_holes(g))[2, 2] == 1 and to_numpy(image.keep_largest_component(g))[5, 6] == 0
    k = np.ones((3, 3))
    pad = np.pad(x, 1, mode="edge")
    assert np.allclose(to_numpy(image.filter2d(g, k)), sum(pad[i : i + 7, j : j + 9] for i in range(3) for j in range(3)))
    assert np.allclose(to_numpy(image.rotate_cubic(g, 0.0)), x)
    y, z = np.mgrid[0:24, 0:24]
    blob = np.exp(-(((y - 11) / 5.0) ** 2 + ((z - 12) / 3.0) ** 2))
    moved = np.exp(-(((y - 12) / 5.0) ** 2 + ((z - 11.5) / 3.0) ** 2))
    p = to_numpy(image.align_ecc_euclidean(from_numpy(spark, blob), from_numpy(spark, moved), 60))
    assert abs(p[1] - 1) < 0.1 and abs(p[2] + 0.5) < 0.1 and abs(p[0]) < 0.05
    cube = np.zeros((5, 5, 5))
    cube[1:4, 1:4, 1:4] = 9
    cube[2, 2, 2] = 0
    assert to_numpy(image.calculate_volume_foreground_mask(from_numpy(spark, cube))).sum() == 27
    ramp = np.cumsum(np.full((6, 8), 0.9), 1) + np.arange(6)[:, None] * 0.7
    wrapped = from_numpy(spark, np.angle(np.exp(1j * ramp)))
    for f in (signal.unwrap_phase_2d, signal.unwrap_phase_laplacian_2d):
        d = to_numpy(f(wrapped)) - ramp
        assert np.allclose(d, d[0, 0])
    g4 = from_numpy(spark, np.arange(2 * 3 * 3 * 2.0).reshape(2, 3, 3, 2))
    assert arrays.extract_sliding_patch_matrix(g4, 2, 2, 1).shape == (8, 8)


def test_diagnostics(spark):
    g = from_numpy(spark, np.array([0.0, np.nan, np.inf, 2.0]))
    r = diagnostics.summarize_array(g).first()
    assert (r.elements, r.finite, r["nan"], r["inf"], r.zero, r.most) == (4, 2, 1, 1, 1, 2.0)
    assert diagnostics.describe_layout(g)["strides"] == [1] and diagnostics.format_shape((2, 3)) == "2 x 3"
    h = diagnostics.delta_histogram(from_numpy(spark, np.array([3.0, 1.0])), from_numpy(spark, np.array([1.0, -1.0])))
    assert [(x.delta, x.n) for x in h.collect()] == [(2, 2)]
    assert '"elements": 4' in diagnostics.format_row(r)


def test_command_line(tmp_path, capsys):
    assert command(["operators"]) == 0 and "coil-combine/coil_combine_rss" in capsys.readouterr().out.split()
    assert command(["contract", "coil-combine/coil_combine_rss"]) == 0
    assert json.loads(capsys.readouterr().out)["outputs"] == [{"name": "image", "type": "image-frame"}]
    for route in ("cartesian", "radial", "noncartesian"):
        assert command(["new", route]) == 0
        (tmp_path / route).write_text(capsys.readouterr().out)
        assert command(["check", str(tmp_path / route)]) == 0 and capsys.readouterr().out.endswith("nodes\n")
    (tmp_path / "bad").write_text('{"kind": "x"}')
    assert command(["check", str(tmp_path / "bad")]) == 1 and command([]) == 2 and command(["contract", "no/such"]) == 2


def test_every_contract_names_its_options():
    for op in OPERATORS.values():
        c = contract(op)
        assert json.loads(json.dumps(c)) == c and set(c["config"]) == set(op.config)


def test_pictures_and_tables_for_other_programs(spark, tmp_path):
    rng = np.random.default_rng(3)
    for a in (rng.integers(0, 256, (5, 7)), rng.integers(0, 256, (4, 3, 3))):
        formats.write_png(str(tmp_path / "p.png"), a)
        assert np.array_equal(formats.read_png(str(tmp_path / "p.png")), a)
    formats.write_svg(str(tmp_path / "c.svg"), np.arange(5.0), np.array([0.0, 1.0, np.nan, 2.0, 4.0]))
    text = (tmp_path / "c.svg").read_text()
    assert text.count("<polyline") == 2 and "640.00,0.00" in text
    df = spark.range(3).select("id", F.array("id", "id").alias("both"))
    for kind in ("csv", "json"):
        formats.export_table(df, str(tmp_path / kind), kind)
    assert sorted(r.both for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["[0,0]", "[1,1]", "[2,2]"]
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "json")).collect()) == [0, 1, 2]
    spark.createDataFrame([], formats.WAVEFORMS).write.parquet(str(tmp_path / "w"))
    spark.createDataFrame([], formats.IMAGES).write.parquet(str(tmp_path / "i"))
    assert formats.waveforms(spark, str(tmp_path / "w")).count() == formats.image_messages(spark, str(tmp_path / "i")).count() == 0
