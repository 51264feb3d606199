"""Runs of scans: their lifecycle as a fold over recorded events, and a store of published calibration artifacts."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ordinary course of a scan: each state, and the event that leads to the next (fixed values of the run records).
COURSE = (
    ("input_candidate", "begin_describing"), ("describing", "begin_planning"), ("planning", "begin_verifying"), ("verifying", "begin_admitting"), ("admitting", "admit"), ("starting", "start"),
    ("running", "close_ingress"), ("ingress_closed", "begin_draining"), ("draining", "begin_finalizing"), ("finalizing", "begin_sink_flush"), ("sink_flushing", "complete"), ("completed", ""),
)
BEFORE_ADMISSION = tuple(s for s, _ in COURSE[:5])
TERMINAL = ("completed", "rejected", "cancelled", "failed")
#: Causes, the weaker first: a later one only replaces a weaker.
CAUSES = ("none", "cancel", "failure", "invariant")


def transitions() -> dict[tuple[str, str], str]:
    """The state that an event leads to; what isn't there is refused."""
    out = {(state, event): after for (state, event), (after, _) in pairwise(COURSE)}
    for state in [s for s, _ in COURSE[:-1]] + ["cancelling", "failing", "terminal_cleanup"]:
        early = state in BEFORE_ADMISSION
        if early:
            out[state, "reject"] = "rejected"
        stays = state in ("failing", "terminal_cleanup")
        out[state, "request_cancel"] = "cancelled" if early else state if stays else "cancelling"
        for event in ("fail", "fail_invariant"):
            out[state, event] = state if state == "terminal_cleanup" else "failing"
    for state in ("cancelling", "failing"):
        out[state, "begin_terminal_cleanup"] = "terminal_cleanup"
    out["terminal_cleanup", "finish_terminal_cleanup"] = "failed"
    return out


def run_records(events: DataFrame, scan: str = "scan_id", order: str = "seq", event: str = "event") -> DataFrame:
    """scan, state, cause, admitted, refused, n_events of each scan after its events in order.

    An event that the state doesn't allow is refused: it changes nothing and is counted. Cancelling and failing set the cause,
    which only grows; cleanup ends a scan as cancelled or failed by its cause. One row a scan, folded in the JVM."""
    table = F.create_map(*[x for (s, e), t in transitions().items() for x in (F.lit(f"{s}>{e}"), F.lit(t))])
    causes = F.create_map(*[x for e, c in (("request_cancel", 1), ("fail", 2), ("fail_invariant", 3)) for x in (F.lit(e), F.lit(c))])
    start = F.struct(F.lit("input_candidate").alias("state"), F.lit(0).alias("cause"), F.lit(False).alias("admitted"), F.lit(0).alias("refused"))

    def step(a, e):
        after = table[F.concat_ws(">", a["state"], e["event"])]
        late = ~a["state"].isin(*BEFORE_ADMISSION)
        cause = F.when(after.isNotNull() & late, F.greatest(a["cause"], F.coalesce(causes[e["event"]], F.lit(0)))).when(after.isNotNull() & (e["event"] != "request_cancel"), F.greatest(a["cause"], F.coalesce(causes[e["event"]], F.lit(0)))).otherwise(a["cause"])
        ended = F.when(e["event"] == "finish_terminal_cleanup", F.when(a["cause"] == 1, F.lit("cancelled")).otherwise(F.lit("failed"))).otherwise(after)
        return F.struct(F.when(after.isNull(), a["state"]).otherwise(ended).alias("state"), cause.alias("cause"), (a["admitted"] | (after.isNotNull() & (e["event"] == "admit"))).alias("admitted"), (a["refused"] + F.when(after.isNull(), 1).otherwise(0)).alias("refused"))

    rows = events.select(F.col(scan).alias(scan), F.struct(F.col(order).alias("seq"), F.col(event).alias("event")).alias("e"))
    folded = rows.groupBy(scan).agg(F.array_sort(F.collect_list("e")).alias("es")).select(scan, F.aggregate("es", start, step).alias("r"), F.size("es").alias("n_events"))
    return folded.select(scan, "r.state", F.array(*[F.lit(c) for c in CAUSES])[F.col("r.cause")].alias("cause"), "r.admitted", "r.refused", "n_events")


class ArtifactStore:
    """Calibration artifacts by binding, as Parquet tables under one folder that driver and executors share.

    One that is published can't be overwritten. A binding that isn't there yet gives None while input may come; once it has
    ended, it is an error. After abort() nothing is given out or taken."""

    def __init__(self, spark: SparkSession, path: str, bindings: tuple[str, ...]):
        self.spark, self.path, self.bindings = spark, path.rstrip("/"), frozenset(bindings)
        self.ended = self.aborted = False

    def _exists(self, binding: str) -> bool:
        if binding not in self.bindings:
            raise KeyError(f"unknown binding {binding!r}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{binding}/_SUCCESS")
        return bool(p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p))

    def publish(self, binding: str, artifact: DataFrame) -> None:
        if self.ended or self.aborted:
            raise RuntimeError("the store takes no more artifacts")
        if self._exists(binding):
            raise ValueError(f"an artifact of {binding!r} is published already")
        artifact.write.mode("error").parquet(f"{self.path}/{binding}")

    def acquire(self, binding: str) -> DataFrame | None:
        if self.aborted:
            raise RuntimeError("the store was aborted")
        if self._exists(binding):
            return self.spark.read.parquet(f"{self.path}/{binding}")
        if self.ended:
            raise RuntimeError(f"input ended without an artifact of {binding!r}")
        return None

    def end_of_input(self) -> list[str]:
        """No more is taken; the bindings that are missing for good."""
        self.ended = True
        return sorted(b for b in self.bindings if not self._exists(b))

    def abort(self) -> None:
        self.aborted = True
