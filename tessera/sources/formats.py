"""Files of arrays: level-5 MAT files, CFL/HDR pairs, portable grey maps, JSON lines, and tables of acquisitions."""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- MAT, level 5 (codes are fixed values of the format)
NUMBERS = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8"}
CLASS_OF = {"f8": 6, "f4": 7, "i1": 8, "u1": 9, "i2": 10, "u2": 11, "i4": 12, "u4": 13, "i8": 14, "u8": 15}
CODE_OF = {v.lstrip("<"): k for k, v in NUMBERS.items()}
MATRIX, COMPRESSED, SPARSE = 14, 15, 5


def _element(code: int, data: bytes) -> bytes:
    return struct.pack("<II", code, len(data)) + data + b"\0" * (-len(data) % 8)


def _matrix(name: str, a: np.ndarray) -> bytes:
    kind = a.dtype.str.lstrip("<>|=")
    z = kind.startswith("c")
    real = kind.replace("c16", "f8").replace("c8", "f4")
    parts = [a.real, a.imag] if z else [a]
    body = _element(6, struct.pack("<II", CLASS_OF[real] | (0x0800 if z else 0), 0)) + _element(5, struct.pack(f"<{a.ndim}i", *a.shape)) + _element(1, name.encode())
    for p in parts:
        body += _element(CODE_OF[real], np.asarray(p, real).tobytes(order="F"))
    return _element(MATRIX, body)


def _sparse(name: str, shape: tuple[int, int], row: np.ndarray, col: np.ndarray, v: np.ndarray) -> bytes:
    at = np.lexsort((row, col))
    row, col, v = row[at], col[at], v[at]
    starts = np.searchsorted(col, np.arange(shape[1] + 1))
    z = np.iscomplexobj(v)
    body = _element(6, struct.pack("<II", SPARSE | (0x0800 if z else 0), max(1, len(v)))) + _element(5, struct.pack("<2i", *shape)) + _element(1, name.encode())
    body += _element(5, row.astype("<i4").tobytes()) + _element(5, starts.astype("<i4").tobytes())
    for p in [v.real, v.imag] if z else [v]:
        body += _element(9, np.asarray(p, "<f8").tobytes())
    return _element(MATRIX, body)


def write_mat(path: str, arrays: dict[str, np.ndarray | tuple], compressed: bool = False) -> None:
    """Dense arrays of rank 1 to 4 (a vector is a column), or (shape, row, col, v) of a sparse matrix."""
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<HH", 0x0100, 0x4D49)
    with open(path, "wb") as f:
        f.write(head)
        for name, a in arrays.items():
            if isinstance(a, tuple):
                e = _sparse(name, *a)
            else:
                a = np.asarray(a)
                e = _matrix(name, a.reshape(-1, 1) if a.ndim == 1 else a)
            if compressed:
                data = zlib.compress(e)
                e = struct.pack("<II", COMPRESSED, len(data)) + data
            f.write(e)


def _elements(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        code, size = struct.unpack_from("<II", data, at)
        if code >> 16:  # a small element: size and data in one word
            size, code = code >> 16, code & 0xFFFF
            yield code, data[at + 4 : at + 4 + size]
            at += 8
            continue
        yield code, data[at + 8 : at + 8 + size]
        at += 8 + size + (0 if code == COMPRESSED else -size % 8)


def read_mat(path: str) -> dict[str, np.ndarray | tuple]:
    """All numeric variables of a file: arrays, or (shape, row, col, v) of sparse ones."""
    with open(path, "rb") as f:
        data = f.read()
    if data[126:128] != b"IM":
        raise ValueError(f"{path} is not a little-endian level-5 MAT file")
    out: dict[str, np.ndarray | tuple] = {}
    for code, body in _elements(data[128:]):
        if code == COMPRESSED:
            code, body = next(iter(_elements(zlib.decompress(body))))
        if code != MATRIX:
            continue
        parts = list(_elements(body))
        flags = struct.unpack_from("<I", parts[0][1])[0]
        shape = np.frombuffer(parts[1][1], "<i4")
        name = parts[2][1].decode()
        values = [np.frombuffer(b, NUMBERS[c]) for c, b in parts[3:]]
        z = bool(flags & 0x0800)
        if flags & 0xFF == SPARSE:
            starts = values[1]
            v = values[2].astype(float) + (1j * values[3] if z else 0)
            n = int(starts[-1])
            out[name] = (tuple(int(s) for s in shape), values[0][:n].astype(int), np.repeat(np.arange(shape[1]), np.diff(starts)), v[:n])
        elif flags & 0xFF in CLASS_OF.values():
            a = values[0] + 1j * values[1] if z else values[0]
            out[name] = a.reshape(shape, order="F")
    return out


def read_array(spark: SparkSession, path: str, name: str):
    """A dense variable of a MAT file as a keyless grid; one column is a vector."""
    from tessera.grid import from_numpy

    a = read_mat(path)[name]
    return from_numpy(spark, a.ravel() if a.ndim == 2 and a.shape[1] == 1 else a)


def write_array(path: str, name: str, grid, compressed: bool = False) -> None:
    """One keyless grid, small enough for the driver, as a MAT file."""
    from tessera.grid import to_numpy

    write_mat(path, {name: to_numpy(grid)}, compressed)


def read_sparse(spark: SparkSession, path: str, name: str) -> DataFrame:
    """row, col, v (or re, im) of a sparse variable."""
    _, row, col, v = read_mat(path)[name]
    z = np.iscomplexobj(v)
    values = [v.real.tolist(), v.imag.tolist()] if z else [v.tolist()]
    rows = list(zip(row.tolist(), col.tolist(), *values, strict=True))
    return spark.createDataFrame(rows, "row int, col int, " + ("re double, im double" if z else "v double"))


def write_sparse(path: str, name: str, coo: DataFrame, shape: tuple[int, int], compressed: bool = False) -> None:
    got = coo.select("row", "col", "v").toPandas()
    write_mat(path, {name: (shape, got["row"].to_numpy(), got["col"].to_numpy(), got["v"].to_numpy(float))}, compressed)


def dump_mat_array(grid, prefix: str, name: str, enabled: str = "TESSERA_DUMP") -> str | None:
    """prefix_name.mat, if the named environment variable is set."""
    if not array_dump_enabled(enabled):
        return None
    write_array(path := f"{prefix}_{name}.mat", name, grid)
    return path


def array_dump_enabled(name: str = "TESSERA_DUMP") -> bool:
    return bool(os.environ.get(name))


# ---------------------------------------------------------------- CFL, PGM, JSON lines
def write_cfl(base: str, a: np.ndarray) -> None:
    """base.hdr with the dimensions, base.cfl with single-precision complex numbers, first axis fastest."""
    with open(f"{base}.hdr", "w", encoding="ascii") as f:
        f.write("# Dimensions\n" + " ".join(map(str, a.shape)) + "\n")
    np.asarray(a, "<c8").ravel(order="F").tofile(f"{base}.cfl")


def read_cfl(base: str) -> np.ndarray:
    with open(f"{base}.hdr", encoding="ascii") as f:
        shape = tuple(map(int, f.read().split("\n")[1].split()))
    return np.fromfile(f"{base}.cfl", "<c8").reshape(shape, order="F")


def write_pgm(path: str, a: np.ndarray) -> None:
    """An 8-bit grey map of values from 0 to 255."""
    b = np.clip(np.nan_to_num(a), 0, 255).astype(np.uint8)
    with open(path, "wb") as f:
        f.write(f"P5 {b.shape[1]} {b.shape[0]} 255\n".encode() + b.tobytes())


def read_pgm(path: str) -> np.ndarray:
    with open(path, "rb") as f:
        data = io.BytesIO(f.read())
    _, cols, rows, _ = data.readline().split()
    return np.frombuffer(data.read(), np.uint8).reshape(int(rows), int(cols))


def append_jsonl(path: str, event: str, payload: dict | None = None, enabled: str = "TESSERA_DEBUG") -> bool:
    """One event as a line of JSON, if the named environment variable is set; whether it was written."""
    if not os.environ.get(enabled):
        return False
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps({"event": event, "at": datetime.now(timezone.utc).isoformat(), "payload": payload or {}}, sort_keys=True) + "\n")
    return True


def debug_event_enabled(name: str = "TESSERA_DEBUG") -> bool:
    return bool(os.environ.get(name))


def append_debug_timing_event(path: str, name: str, milliseconds: float) -> bool:
    return append_jsonl(path, "timing", {"name": name, "duration_ms": milliseconds})


def json_escape(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)[1:-1]


# ---------------------------------------------------------------- pictures and tables for other programs
def write_png(path: str, a: np.ndarray) -> None:
    """An 8-bit grey (rows, cols) or colour (rows, cols, 3: red, green, blue) picture of values from 0 to 255."""
    b = np.clip(np.nan_to_num(a), 0, 255).astype(np.uint8)
    rows, cols = b.shape[:2]
    lines = np.concatenate([np.zeros((rows, 1), np.uint8), b.reshape(rows, -1)], axis=1)  # each line begins with its filter, none
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 2 if b.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b""))


def read_png(path: str) -> np.ndarray:
    """A picture that write_png() wrote: 8 bits, no filters."""
    with open(path, "rb") as f:
        data = f.read()
    at, body, head = 8, b"", (0, 0, 0, 0)
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        head = struct.unpack_from(">IIBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    cols, rows, _, colour = head
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(rows, -1)[:, 1:]
    return lines.reshape(rows, cols, 3) if colour == 2 else lines


def write_svg(path: str, x: np.ndarray, y: np.ndarray, width: int = 640, height: int = 360) -> None:
    """A curve as a polyline; points that aren't finite part it."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    ok = np.isfinite(x) & np.isfinite(y)
    span = lambda v: (float(v[ok].min()), float(np.ptp(v[ok])) or 1.0) if ok.any() else (0.0, 1.0)
    (x0, dx), (y0, dy) = span(x), span(y)
    parts = np.split(np.flatnonzero(ok), np.flatnonzero(np.diff(np.flatnonzero(ok)) > 1) + 1)
    lines = [" ".join(f"{(x[i] - x0) / dx * width:.2f},{height - (y[i] - y0) / dy * height:.2f}" for i in p) for p in parts if len(p)]
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">' + "".join(f'<polyline fill="none" stroke="black" points="{p}"/>' for p in lines) + "</svg>\n")


def export_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A table as CSV with a head line, or as JSON lines, in as many files as it has partitions; nested columns as JSON in CSV."""
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown kind {kind}")
    nested = ("array", "struct", "map")
    flat = df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if kind == "csv" and t.startswith(nested) else F.col(f"`{c}`") for c, t in df.dtypes])
    (flat.write.option("header", True).csv if kind == "csv" else flat.write.json)(path)


# ---------------------------------------------------------------- tables
#: Messages beside acquisitions: physiological waveforms, and images with their meta attributes.
WAVEFORMS = """
scan_id string, ordinal long, version int, flags long, measurement_uid long, scan_counter long, time_stamp long,
number_of_samples int, channels int, sample_time_us float, waveform_id int, data array<array<long>>
"""
IMAGES = """
scan_id string, series string, ordinal long, version int, data_type int, flags long, measurement_uid long, matrix_size array<int>,
field_of_view array<float>, channels int, position array<float>, average int, slice int, contrast int, phase int, repetition int,
`set` int, acquisition_time_stamp long, image_type int, image_index int, image_series_index int, meta map<string,array<string>>,
pixels array<float>
"""


def waveforms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WAVEFORMS).parquet(path)


def image_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IMAGES).parquet(path)


ACQUISITIONS = """
scan_id string, ordinal long, version int, flags long, measurement_uid long, scan_counter long, acquisition_time_stamp long,
physiology_time_stamp array<long>, number_of_samples int, available_channels int, active_channels int, discard_pre int,
discard_post int, center_sample int, encoding_space int, trajectory_dimensions int, sample_time_us float,
position array<float>, kspace_encode_step_1 int, kspace_encode_step_2 int, average int, slice int, contrast int, phase int,
repetition int, `set` int, segment int, samples array<struct<re:float,im:float>>, trajectory array<float>
"""


def acquisitions(spark: SparkSession, path: str) -> DataFrame:
    """A table of acquisitions in Parquet; columns that aren't used are never read."""
    return spark.read.schema(ACQUISITIONS).parquet(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Acquisitions without their payload."""
    return acquisitions(spark, path).drop("samples", "trajectory")


def acquisition(df: DataFrame, ordinal: int) -> DataFrame:
    return df.where(F.col("ordinal") == ordinal)


def acquisition_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(ACQUISITIONS).option("maxFilesPerTrigger", files).parquet(path)


def write_images(df: DataFrame, path: str) -> None:
    """Images (keys, i0, i1, v) as Parquet; a negative or not finite magnitude stops the write before it is committed."""
    bad = F.isnan("v") | (F.col("v") < 0) | (F.abs("v") == F.lit(float("inf")))
    df.where(F.when(bad, F.raise_error(F.lit("a magnitude is negative or not finite")).cast("boolean")).otherwise(F.lit(True))).write.parquet(path)


def scan_header(xml: str) -> dict:
    """Encodings, matrices, fields of view, limits and trajectory of a scan's XML header."""
    import xml.etree.ElementTree as ET

    if len(xml) > 4 << 20:
        raise ValueError("the header is over 4 MiB")
    root = ET.fromstring(xml)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    child = lambda e, n: next((c for c in e if local(c) == n), None)
    text = lambda e, n: (c.text or "").strip() if (c := child(e, n)) is not None else None
    xyz = lambda e, kind: {a: kind(text(e, a)) for a in "xyz"} if e is not None else None
    out = []
    for enc in (e for e in root if local(e) == "encoding"):
        space = lambda n, e=enc: child(e, n)
        matrix = lambda s: xyz(child(s, "matrixSize"), int) if s is not None else None
        fov = lambda s: xyz(child(s, "fieldOfView_mm"), float) if s is not None else None
        lim = child(enc, "encodingLimits")
        limits = {local(e): {n: int(text(e, n)) for n in ("minimum", "maximum", "center") if text(e, n)} for e in (lim if lim is not None else [])}
        out.append({"trajectory": text(enc, "trajectory"), "encoded": matrix(space("encodedSpace")), "encoded_fov": fov(space("encodedSpace")), "recon": matrix(space("reconSpace")), "recon_fov": fov(space("reconSpace")), "limits": limits})
    system = child(root, "acquisitionSystemInformation")
    return {"receiver_channels": int(text(system, "receiverChannels")) if system is not None and text(system, "receiverChannels") else None, "encodings": out}


# ---------------------------------------------------------------- containers and limits
@dataclass(frozen=True)
class ReadLimits:
    """Bounds on what an inspection may read (defaults are fixed values of the public reader)."""

    xml_header_bytes: int = 4 << 20
    acquisition_count: int = 1_000_000
    acquisition_payload_bytes: int = 64 << 20
    group_count: int = 4_096
    group_depth: int = 16
    group_path_bytes: int = 4 << 10
    image_series: int = 128
    images_per_series: int = 100_000
    image_payload_bytes: int = 256 << 20


def bounded_acquisitions(df: DataFrame, limits: ReadLimits = ReadLimits()) -> DataFrame:
    """df, where an acquisition whose payload is over the limit, or more acquisitions of a scan than allowed, stop the query."""
    size = F.coalesce(F.size("samples"), F.lit(0)) * 8 + F.coalesce(F.size("trajectory"), F.lit(0)) * 4
    stop = lambda why: F.raise_error(F.lit(why)).cast("boolean")
    ok = F.when(size > limits.acquisition_payload_bytes, stop("an acquisition's payload is over the limit")).when(F.col("ordinal") >= limits.acquisition_count, stop("more acquisitions than the limit")).otherwise(F.lit(True))
    return df.where(ok)


def discover_containers(spark: SparkSession, root: str, limits: ReadLimits = ReadLimits()) -> list[dict]:
    """Folders under `root` that hold tables header, acquisitions or images (Parquet), by path: what each has, and the number of
    its acquisitions and images, read from the files' footers. Paths, depth and number of folders are bounded."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    todo, out, seen = [(top, 0)], [], 0
    while todo:
        folder, depth = todo.pop()
        seen += 1
        if seen > limits.group_count or depth > limits.group_depth or len(str(folder.toString()).encode()) > limits.group_path_bytes:
            raise ValueError(f"{root}: more folders, deeper ones or longer paths than the limits")
        inside = {s.getPath().getName(): s for s in fs.listStatus(folder)}
        tables = {n.removesuffix(".parquet"): s.getPath().toString() for n, s in inside.items() if n.removesuffix(".parquet") in ("header", "acquisitions", "images")}
        todo += [(s.getPath(), depth + 1) for n, s in inside.items() if s.isDirectory() and n.removesuffix(".parquet") not in tables and not n.startswith("_")]
        if tables:
            count = lambda n, t=tables: spark.read.parquet(t[n]).count() if n in t else 0
            found = {"path": folder.toString(), **{f"has_{n}": n in tables for n in ("header", "acquisitions", "images")}, "acquisition_count": count("acquisitions"), "image_count": count("images")}
            if found["acquisition_count"] > limits.acquisition_count or found["image_count"] > limits.image_series * limits.images_per_series:
                raise ValueError(f"{found['path']}: more acquisitions or images than the limits")
            out.append(found)
    return sorted(out, key=lambda c: c["path"])
