"""Acquisition records: validation, classification, keys, frame assembly, duplicates, coverage, gating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.grid import Grid
from tessera.operators.stats import bucket_of, midpoint_percentile, split_points

#: Bits (from 1) of acquisition flags (fixed values of the public record format).
FLAG_BITS = {
    "first_in_encode_step_1": 1, "last_in_encode_step_1": 2, "first_in_encode_step_2": 3, "last_in_encode_step_2": 4, "first_in_average": 5,
    "last_in_average": 6, "first_in_slice": 7, "last_in_slice": 8, "first_in_contrast": 9, "last_in_contrast": 10, "first_in_phase": 11,
    "last_in_phase": 12, "first_in_repetition": 13, "last_in_repetition": 14, "first_in_set": 15, "last_in_set": 16, "first_in_segment": 17,
    "last_in_segment": 18, "noise_measurement": 19, "parallel_calibration": 20, "parallel_calibration_and_imaging": 21, "reverse": 22,
    "navigation": 23, "phase_correction": 24, "last_in_measurement": 25, "hp_feedback": 26, "dummy_scan": 27, "rt_feedback": 28,
    "surface_coil_correction": 29, "phase_stabilization_reference": 30, "phase_stabilization": 31, "compression_1": 53, "compression_2": 54,
    "compression_3": 55, "compression_4": 56, "user_1": 57, "user_2": 58, "user_3": 59, "user_4": 60, "user_5": 61, "user_6": 62, "user_7": 63, "user_8": 64,
}
CONTROL_FLAGS = tuple(n for n, b in FLAG_BITS.items() if b <= 18) + ("last_in_measurement",)
UNSUPPORTED = ("hp_feedback", "rt_feedback", "surface_coil_correction", "phase_stabilization_reference", "phase_stabilization", "reverse", *[n for n, b in FLAG_BITS.items() if b >= 53])
FRAME_KEY = ("encoding_space", "slice", "contrast", "repetition", "set", "phase", "average", "segment")
KINDS = ("imaging", "noise_measurement", "parallel_calibration", "navigation", "phase_correction", "hp_feedback", "rt_feedback", "dummy_scan", "surface_coil_correction", "phase_stabilization_reference", "phase_stabilization")


def mask(*names: str) -> int:
    """The flags as a signed 64-bit number."""
    m = sum(1 << (FLAG_BITS[n] - 1) for n in names)
    return m - (1 << 64) if m >= 1 << 63 else m


def flag(flags: Column, name: str) -> Column:
    return F.getbit(flags, F.lit(FLAG_BITS[name] - 1)) == 1


def control_flags(df: DataFrame, flags: str = "flags") -> DataFrame:
    """One boolean column for each first/last flag; they never decide completion."""
    return df.withColumns({n: flag(F.col(flags), n) for n in CONTROL_FLAGS})


def unsupported_flags(flags: Column) -> Column:
    """Whether unknown bits, or ones that need a policy of their own, are set."""
    known = mask(*FLAG_BITS)
    return (flags.bitwiseAND(F.lit(~known).cast("long")) != 0) | (flags.bitwiseAND(F.lit(mask(*UNSUPPORTED)).cast("long")) != 0)


def lane_of(noise: Column, calibration: Column, both: Column, phase: Column, navigation: Column, dummy: Column, ignored: Column, ignore_dummies: bool = True) -> Column:
    """The one lane of an acquisition: ignored, then dummies, then the exclusive lanes; `ambiguous` for several of these."""
    cal = calibration | both
    several = noise.cast("int") + cal.cast("int") + phase.cast("int") + navigation.cast("int") > 1
    return (
        F.when(ignored | (dummy & F.lit(ignore_dummies)), "ignored_explicitly").when(several, "ambiguous").when(noise, "noise").when(both, "calibration_and_imaging")
        .when(calibration, "calibration").when(phase, "phase_correction").when(navigation, "navigator").otherwise("imaging")
    )


def classify(df: DataFrame, ignore_dummies: bool = True, flags: str = "flags") -> DataFrame:
    f = lambda n: flag(F.col(flags), n)
    return df.withColumn("lane", lane_of(f("noise_measurement"), f("parallel_calibration"), f("parallel_calibration_and_imaging"), f("phase_correction"), f("navigation"), f("dummy_scan"), F.lit(False), ignore_dummies))


def layout_error(r: str = "") -> Column:
    """Why a record's header and payload don't fit, or null."""
    c = lambda n: F.col(r + n)
    n, ch = c("number_of_samples"), c("active_channels")
    finite = lambda a, f: F.forall(a, f)
    ok = lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (
        F.when(F.size(c("samples")) != n * ch, "samples")
        .when(F.size(c("trajectory")) != n * c("trajectory_dimensions"), "trajectory")
        .when((n != 0) & (ch == 0), "channels")
        .when(c("available_channels") < ch, "available_channels")
        .when((c("discard_pre") > n) | (c("discard_post") > n - c("discard_pre")), "discard")
        .when((n == 0) & ((c("center_sample") != 0) | (c("discard_pre") != 0) | (c("discard_post") != 0)), "empty")
        .when((n != 0) & (c("center_sample") >= n), "center")
        .when(~finite(c("samples"), lambda z: ok(z["re"]) & ok(z["im"])) | ~finite(c("trajectory"), ok), "nonfinite")
    )


def admitted(df: DataFrame) -> DataFrame:
    """df, where the first record that breaks a rule stops the query; quarantine() keeps them apart instead."""
    ambiguous = F.when(F.col("lane") == "ambiguous", "lane")
    df = df if "lane" in df.columns else classify(df)
    why = F.coalesce(layout_error(), F.when(unsupported_flags(F.col("flags")), "flags"), ambiguous)
    return df.where(F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("acquisition rejected: "), why)).cast("boolean")).otherwise(F.lit(True)))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that pass, and those that don't with their reason."""
    why = F.coalesce(layout_error(), F.when(unsupported_flags(F.col("flags")), "flags"))
    judged = classify(df).withColumn("reason", F.coalesce(why, F.when(F.col("lane") == "ambiguous", "lane")))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def route(df: DataFrame, lane: str) -> DataFrame:
    """The records of a lane; combined calibration and imaging belongs to both."""
    lanes = {"imaging": ["imaging", "calibration_and_imaging"], "calibration": ["calibration", "calibration_and_imaging"]}.get(lane, [lane])
    return df.where(F.col("lane").isin(lanes))


# ---------------------------------------------------------------- frames
DUPLICATES = ("reject", "ignore_identical", "replace_before_seal")
INCOMPLETE = ("fail", "emit_partial", "certified_skip")


def deduplicated(lines: DataFrame, key: list[str], coordinate: list[str], arrival: str, payload: list[str], policy: str = "reject") -> DataFrame:
    """One line for each coordinate: a second is an error (reject), must be equal (ignore_identical), or replaces the first
    (replace_before_seal). A partial aggregate goes before the shuffle."""
    if policy not in DUPLICATES:
        raise ValueError(f"unknown duplicate policy {policy}")
    at = [*key, *coordinate]
    others = [c for c in lines.columns if c not in at]
    row = F.struct(arrival, *[c for c in others if c != arrival])
    last = (F.max if policy == "replace_before_seal" else F.min)(row).alias("r")
    if policy == "replace_before_seal":
        one = lines.groupBy(*at).agg(last)
    else:
        body = F.xxhash64(*payload)
        one = lines.groupBy(*at).agg(last, F.count("*").alias("n"), F.min(body).alias("h0"), F.max(body).alias("h1"))
        bad = F.col("n") > 1 if policy == "reject" else F.col("h0") != F.col("h1")
        why = "duplicate acquisition" if policy == "reject" else "duplicate acquisition differs"
        one = one.where(F.when(bad, F.raise_error(F.lit(why)).cast("boolean")).otherwise(F.lit(True)))
    return one.select(*at, *[F.col(f"r.{c}").alias(c) for c in others])


def _needed(lines: DataFrame, required: DataFrame, key: list[str]) -> DataFrame:
    """key and coordinate of all required lines; required: coordinates with their frames' keys, or for every frame there is."""
    return required if set(key) <= set(required.columns) else lines.select(*key).distinct().crossJoin(required)


def missing_coordinates(lines: DataFrame, required: DataFrame, key: list[str], coordinate: list[str]) -> DataFrame:
    """key and coordinate of each required line that no acquisition covers. required: coordinates, with keys or for all."""
    return _needed(lines, required, key).join(lines.select(*key, *coordinate).distinct(), [*key, *coordinate], "left_anti")


def unexpected_coordinates(lines: DataFrame, required: DataFrame, key: list[str], coordinate: list[str]) -> DataFrame:
    """Lines whose coordinate their frame doesn't ask for."""
    on = [*key, *coordinate] if set(key) <= set(required.columns) else coordinate
    return lines.join(required.select(*on).distinct(), on, "left_anti")


def coverage(lines: DataFrame, required: DataFrame, key: list[str], coordinate: list[str]) -> DataFrame:
    """key, covered, missing, unexpected, complete of each frame by its exact set of coordinates: how many of the required ones
    have come, how many haven't, and how many came that aren't asked for; complete: all came and no other did.

    required: coordinates for every frame, or with keys; then a frame of which nothing came is there too. One sum by frame:
    the lines and the required coordinates are laid over each other, so that frames need no list."""
    came = lines.select(*key, *coordinate).distinct().withColumn("came", F.lit(True))
    need = _needed(lines, required, key).select(*key, *coordinate).distinct().withColumn("need", F.lit(True))
    both = came.join(need, [*key, *coordinate], "full_outer")
    state = both.groupBy(*key).agg(F.count_if(F.col("came") & F.col("need")).alias("covered"), F.count_if(F.col("came").isNull()).alias("missing"), F.count_if(F.col("need").isNull()).alias("unexpected"))
    return state.withColumn("complete", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def assembled(lines: DataFrame, required: DataFrame, key: list[str], coordinate: list[str], incomplete: str = "fail") -> DataFrame:
    """Lines of complete frames; incomplete ones are an error (fail), kept (emit_partial) or left out (certified_skip). A line
    that its frame doesn't ask for is an error under any policy."""
    if incomplete not in INCOMPLETE:
        raise ValueError(f"unknown incomplete policy {incomplete}")
    state = coverage(lines, required, key, coordinate)
    stop = lambda why: F.raise_error(F.lit(why)).cast("boolean")
    keep = F.lit(True) if incomplete == "emit_partial" else F.col("complete")
    if incomplete == "fail":
        keep = F.when(F.col("missing") > 0, stop("incomplete frame at the end of input")).otherwise(F.lit(True))
    keep = F.when(F.col("unexpected") > 0, stop("unexpected coordinate in a frame")).otherwise(keep)
    return lines.join(state.where(keep).select(*key), key, "left_semi")


def bounded_arrivals(lines: DataFrame, key: list[str], coordinate: list[str], arrival: str, most_lines: int, most_span: int) -> DataFrame:
    """key, lines, span, error of frames beyond the bounds of arrival: more lines than `most_lines`, or more than `most_span`
    between a frame's first and last line."""
    state = lines.groupBy(*key).agg(F.count("*").alias("lines"), (F.max(arrival) - F.min(arrival)).alias("span"))
    error = F.when(F.col("lines") > most_lines, "lines").when(F.col("span") > most_span, "span")
    return state.withColumn("error", error).where("error is not null")


def line_elements(lines: DataFrame, keys: tuple[str, ...], channels: int, rows: int, samples: int, ky: str = "ky") -> Grid:
    """k-space (channel, ky, kx) from lines whose samples are ordered channel by channel."""
    rows_df = lines.select(*keys, F.col(ky).alias("ky"), F.posexplode("samples").alias("p", "z"))
    df = rows_df.select(*keys, F.floor(F.col("p") / F.lit(samples)).cast("int").alias("i0"), F.col("ky").cast("int").alias("i1"), (F.col("p") % samples).cast("int").alias("i2"), F.col("z.re").cast("double").alias("re"), F.col("z.im").cast("double").alias("im"))
    return Grid(df, (channels, rows, samples), keys, True)


def gated(frames: DataFrame, ready: DataFrame, key: list[str]) -> DataFrame:
    """frames with state: pass where their calibration token is there, else wait; two tokens of a key are an error."""
    tokens = ready.groupBy(*key).agg(F.count("*").alias("tokens"))
    tokens = tokens.where(F.when(F.col("tokens") > 1, F.raise_error(F.lit("duplicate calibration token")).cast("boolean")).otherwise(F.lit(True)))
    return frames.join(tokens, key, "left").withColumn("state", F.when(F.col("tokens").isNull(), "wait").otherwise("pass")).drop("tokens")


def exact_join(left: DataFrame, right: DataFrame, on: list[str], *more: DataFrame) -> DataFrame:
    """An inner join of two to four inputs, which must have the same identities: one that any input lacks stops the query."""
    if len(more) > 2:
        raise ValueError("exact_join takes two to four inputs")
    both, has = None, []
    for n, side in enumerate((left, right, *more)):
        has.append(f"has_{n}")
        side = side.withColumn(has[-1], F.lit(True))
        both = side if both is None else both.join(side, on, "full_outer")
    bad = F.array_contains(F.array(*[F.col(h).isNull() for h in has]), True)
    return both.where(F.when(bad, F.raise_error(F.lit("the inputs' identities differ")).cast("boolean")).otherwise(F.lit(True))).drop(*has)


def arrival_violations(df: DataFrame, order_key: str, arrival: str) -> DataFrame:
    """Frames whose order key is smaller than one that came before. Running maxima over ranges of arrival, and over the
    ranges' maxima: no task sees all frames."""
    firsts = df.groupBy(order_key).agg(F.min(arrival).alias(arrival))
    parts = firsts.withColumn("part", bucket_of(arrival, split_points(firsts, arrival)))
    tops = parts.groupBy("part").agg(F.max(order_key).alias("top"))
    tops = tops.select("part", F.max("top").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    inside = F.max(order_key).over(Window.partitionBy("part").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return parts.join(tops, "part").withColumn("before", F.greatest(inside, "earlier")).where(F.col(order_key) < F.col("before")).select(order_key, arrival, "before")


# ---------------------------------------------------------------- inspection
def kinds(df: DataFrame, flags: str = "flags") -> DataFrame:
    """A row for each record and kind that it belongs to."""
    f = lambda n: flag(F.col(flags), n)
    cal = ~f("parallel_calibration_and_imaging") & f("parallel_calibration")
    member = {k: cal if k == "parallel_calibration" else f(k) for k in KINDS[1:]}
    other = F.lit(False)
    for m in member.values():
        other = other | m
    names = F.array(F.when(~other, "imaging"), *[F.when(m, k) for k, m in member.items()])
    return df.withColumn("kind", F.explode(F.array_compact(names)))


def kind_counts(df: DataFrame) -> DataFrame:
    return kinds(df).groupBy("kind").agg(F.count("*").alias("n"))


def catalog(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value: the different values of each, from one scan of these columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("long").alias("value")) for d in dimensions]))
    return df.select(pairs.alias("p")).select("p.*").distinct()


def readout_range(df: DataFrame) -> DataFrame:
    """first and last coordinate of the samples that count; null without any."""
    n = F.col("number_of_samples")
    usable = (n > 0) & (F.col("active_channels") > 0) & (F.col("discard_pre") + F.col("discard_post") < n) & (F.col("center_sample") < n)
    return df.withColumns({"first": F.when(usable, F.col("discard_pre") - F.col("center_sample")), "last": F.when(usable, n - F.col("discard_post") - 1 - F.col("center_sample"))})


def limit_violations(df: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Records with a counter outside [minimum, maximum], and which."""
    bad = F.array_compact(F.array(*[F.when(~F.col(d).between(lo, hi), F.lit(d)) for d, (lo, hi) in limits.items()]))
    return df.withColumn("outside", bad).where(F.size("outside") > 0)


def resolve(df: DataFrame, fixed: dict[str, int], ordinal: str) -> DataFrame:
    """The record that matches most of the fixed dimensions, the first of equals."""
    score = F.lit(0)
    for d, v in fixed.items():
        score = score + F.when(F.col(d) == v, 1).otherwise(0)
    best = df.agg(F.max_by(F.struct("*"), F.struct(score, -F.col(ordinal))).alias("r"), F.max(score).alias("score"))
    return best.where("r is not null").select("r.*", "score")


def plane(df: DataFrame, rows: str, cols: str, fixed: dict[str, int], value: str) -> DataFrame:
    """row, col, value of the plane that two dimensions span, the others fixed."""
    where = F.lit(True)
    for d, v in fixed.items():
        where = where & (F.col(d) == v)
    return df.where(where).select(F.col(rows).alias("row"), F.col(cols).alias("col"), F.col(value).alias("value"))


DISPLAY = ("magnitude", "real", "imaginary", "phase", "phase_degrees")


def display(re: Column, im: Column, component: str) -> Column:
    phase = F.atan2(im, re)
    return {"magnitude": F.hypot(re, im), "real": re, "imaginary": im, "phase": phase, "phase_degrees": F.degrees(phase)}[component]


RANGES = ("percentile", "minimum_maximum")


def data_range(df: DataFrame, keys: list[str], value: str, calculation: str = "percentile", percentile: float = 99.0) -> DataFrame:
    """keys, minimum, maximum of the finite values of each image: the extremes, or the percentile and, below, the percentile of
    the negated values; 0 and 0 where none is finite."""
    if calculation not in RANGES:
        raise ValueError(f"unknown range calculation {calculation}")
    finite = df.where(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))
    if calculation == "minimum_maximum":
        found = finite.groupBy(*keys).agg(F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    else:
        low, high = (midpoint_percentile(finite, keys, value, p, n) for p, n in ((100.0 - percentile, "minimum"), (percentile, "maximum")))
        found = low.join(high, keys)
    every = df.select(*keys).distinct().join(found, keys, "left")
    return every.select(*keys, F.coalesce("minimum", F.lit(0.0)).alias("minimum"), F.coalesce("maximum", F.lit(0.0)).alias("maximum"))


def resolved_window(ranges: DataFrame, persistence: str = "reset", center: float | None = None, width: float | None = None) -> DataFrame:
    """ranges with center and width of the display window: relative (shares of the range), absolute, or reset: the whole range
    unless a window is given."""
    span = F.col("maximum") - F.col("minimum")
    if persistence == "relative":
        return ranges.withColumns({"center": F.col("minimum") + F.lit(center) * span, "width": F.lit(width) * span})
    if persistence == "absolute" or center is not None:
        return ranges.withColumns({"center": F.lit(float(center)), "width": F.lit(float(width))})
    return ranges.withColumns({"center": F.col("minimum") + 0.5 * span, "width": span})


def windowed(value: Column, center: Column, width: Column) -> Column:
    """A value on [0, 1] of a display window; a window without width parts at its centre."""
    return F.when(width > 0, F.greatest(F.least((value - (center - width / 2)) / F.when(width > 0, width), F.lit(1.0)), F.lit(0.0))).otherwise(F.when(value > center, 1.0).otherwise(0.0))
