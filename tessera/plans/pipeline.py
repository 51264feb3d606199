"""Pipeline documents: a JSON graph of registered operators, checked as a whole and then run as one Spark plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

import tessera.operators.recon  # noqa: F401  registers the operators
from tessera.registry import OPERATORS, ConfigError, Operator

TOP = {"kind", "pipeline", "input_profile", "allowed_profiles", "parameters", "provider_requirements", "nodes", "edges", "bindings", "annotations"}
BINDINGS = {"ingress", "egress", "calibration", "merge"}


@dataclass(frozen=True)
class Node:
    id: str
    op: Operator
    config: dict


@dataclass(frozen=True)
class Pipeline:
    id: str
    nodes: dict[str, Node]
    sources: dict[tuple[str, str], tuple[str, str]]  # (node, input port) -> (node or "", output port or binding)
    egress: dict[str, tuple[str, str]]
    ingress: dict[str, str]
    order: list[str] = field(default_factory=list)


def short(name: str) -> str:
    """The last part of a dotted name: providers and types are known by it."""
    return name.rsplit(".", 1)[-1]


def _only(what: str, d: dict, allowed: set[str], required: set[str] | None = None) -> None:
    if not isinstance(d, dict):
        raise ConfigError(f"{what} must be an object")
    if extra := set(d) - allowed:
        raise ConfigError(f"{what}: unknown fields {sorted(extra)}")
    if lost := (allowed if required is None else required) - set(d):
        raise ConfigError(f"{what}: fields {sorted(lost)} are missing")


def parse(document: str | dict) -> Pipeline:
    """Check a document: fields, names, ports of equal type, each input bound once, no cycle."""
    d = json.loads(document) if isinstance(document, str) else document
    _only("document", d, TOP)
    if d["kind"] != "PipelineDefinition":
        raise ConfigError(f"kind {d['kind']} is not a pipeline definition")
    _only("pipeline", d["pipeline"], {"id", "display_name"}, {"id"})
    _only("input_profile", d["input_profile"], {"kind", "container"}, {"kind"})
    container = d["input_profile"].get("container", {"mode": "auto"})
    _only("container", container, {"mode", "path"} if container.get("mode") == "explicit" else {"mode"}, {"mode"})
    if container["mode"] not in ("auto", "explicit"):
        raise ConfigError(f"container mode {container['mode']}")
    _only("bindings", d["bindings"], BINDINGS)
    if d["bindings"]["merge"]:
        raise ConfigError("merge bindings are not supported")
    providers = {}
    for p in d["provider_requirements"]:
        _only("provider requirement", p, {"alias", "provider_id"})
        if p["alias"] in providers:
            raise ConfigError(f"provider alias {p['alias']} is repeated")
        providers[p["alias"]] = short(p["provider_id"])
    nodes: dict[str, Node] = {}
    for n in d["nodes"]:
        _only("node", n, {"id", "operator", "config"})
        _only("operator", n["operator"], {"provider", "id"})
        if n["id"] in nodes:
            raise ConfigError(f"node {n['id']} is repeated")
        if n["operator"]["provider"] not in providers:
            raise ConfigError(f"node {n['id']}: unknown provider alias {n['operator']['provider']}")
        op = OPERATORS.get((providers[n["operator"]["provider"]], n["operator"]["id"]))
        if op is None:
            raise ConfigError(f"node {n['id']}: the provider has no operator {n['operator']['id']}")
        nodes[n["id"]] = Node(n["id"], op, op.checked(n["config"]))
    sources: dict[tuple[str, str], tuple[str, str]] = {}
    used: set[str] = set()

    def port(ref: dict, side: str) -> tuple[str, str, str]:
        _only("port", ref, {"node", "port"})
        if ref["node"] not in nodes:
            raise ConfigError(f"unknown node {ref['node']}")
        ports = getattr(nodes[ref["node"]].op, side)
        if ref["port"] not in ports:
            raise ConfigError(f"node {ref['node']} has no {side[:-1]} port {ref['port']}")
        return ref["node"], ref["port"], ports[ref["port"]]

    def bind(to: tuple[str, str], source: tuple[str, str]) -> None:
        if to in sources:
            raise ConfigError(f"input {to[0]}.{to[1]} is bound twice")
        sources[to] = source

    def named(x: dict) -> None:
        if x["id"] in used:
            raise ConfigError(f"{x['id']} names two edges or bindings")
        used.add(x["id"])

    for e in d["edges"]:
        _only("edge", e, {"id", "from", "to"})
        named(e)
        a, b = port(e["from"], "outputs"), port(e["to"], "inputs")
        if a[2] != b[2]:
            raise ConfigError(f"edge {e['id']}: {a[2]} does not fit {b[2]}")
        bind(b[:2], a[:2])
    ingress: dict[str, str] = {}
    for kind in ("ingress", "calibration"):
        for x in d["bindings"][kind]:
            _only(kind, x, {"id", "type", "to"})
            named(x)
            to = port(x["to"], "inputs")
            if short(x["type"]) != to[2]:
                raise ConfigError(f"binding {x['id']}: {x['type']} does not fit {to[2]}")
            bind(to[:2], ("", x["id"]))
            ingress[x["id"]] = to[2]
    egress: dict[str, tuple[str, str]] = {}
    for x in d["bindings"]["egress"]:
        _only("egress", x, {"id", "type", "from"})
        named(x)
        a = port(x["from"], "outputs")
        if short(x["type"]) != a[2]:
            raise ConfigError(f"binding {x['id']}: {x['type']} does not fit {a[2]}")
        egress[x["id"]] = a[:2]
    if not egress:
        raise ConfigError("a pipeline needs an output")
    for n in nodes.values():
        for p in n.op.inputs:
            if (n.id, p) not in sources:
                raise ConfigError(f"input {n.id}.{p} is not bound")
    order: list[str] = []
    waiting = {n: {s for (to, _), (s, _) in sources.items() if to == n and s} for n in nodes}
    while waiting:
        free = sorted(n for n, w in waiting.items() if w <= set(order))
        if not free:
            raise ConfigError(f"nodes {sorted(waiting)} form a cycle")
        order += free
        for n in free:
            del waiting[n]
    return Pipeline(d["pipeline"]["id"], nodes, sources, egress, ingress, order)


def run(pipeline: Pipeline, inputs: dict) -> dict:
    """Results by egress name for inputs by ingress or calibration name. Nothing runs before a result is used."""
    if set(inputs) != set(pipeline.ingress):
        raise ConfigError(f"inputs {sorted(inputs)} for bindings {sorted(pipeline.ingress)}")
    made: dict[tuple[str, str], object] = {("", k): v for k, v in inputs.items()}
    for name in pipeline.order:
        n = pipeline.nodes[name]
        out = n.op.run(**{p: made[pipeline.sources[name, p]] for p in n.op.inputs}, **n.config)
        if not isinstance(out, dict):
            out = {next(iter(n.op.outputs)): out}
        made |= {(name, p): v for p, v in out.items()}
    return {k: made[v] for k, v in pipeline.egress.items()}


def graph(spark: SparkSession, pipeline: Pipeline) -> DataFrame:
    """from_node, from_port, to_node, to_port of each connection; bindings have an empty node."""
    rows = [(s, sp, t, tp) for (t, tp), (s, sp) in pipeline.sources.items()] + [(n, p, "", k) for k, (n, p) in pipeline.egress.items()]
    return spark.createDataFrame(rows, "from_node string, from_port string, to_node string, to_port string")


def byte_size(text: str) -> int:
    """32G, 4M, 512 and the like in bytes."""
    units = {"K": 10, "M": 20, "G": 30, "T": 40}
    t = text.strip().upper().removesuffix("B").removesuffix("I")
    n, shift = (t[:-1], units[t[-1]]) if t and t[-1] in units else (t, 0)
    if not n.isdigit():
        raise ConfigError(f"{text!r} is not a size")
    return int(n) << shift


def cartesian_rss(noise: bool = False, phase: bool = False, virtual_channels: int = 0, crop: tuple[int, int] | None = None) -> dict:
    """The document of the Cartesian route: conditioning as asked for, inverse transform, root sum of squares."""
    nodes, edges, ingress = [], [], []
    at: tuple[str, str] | None = None

    def link(node: str, port: str, out: str) -> None:
        nonlocal at
        if at is None:
            ingress.append({"id": "kspace", "type": "kspace-frame", "to": {"node": node, "port": port}})
        else:
            edges.append({"id": f"to_{node}", "from": {"node": at[0], "port": at[1]}, "to": {"node": node, "port": port}})
        at = (node, out)

    def add(name: str, provider: str, op: str, port: str, out: str, **config) -> None:
        nodes.append({"id": name, "operator": {"provider": provider, "id": op}, "config": config})
        link(name, port, out)

    if noise:
        nodes.append({"id": "noise", "operator": {"provider": "calibration", "id": "noise_model_estimate"}, "config": {}})
        ingress.append({"id": "noise_samples", "type": "noise-calibration-frame", "to": {"node": "noise", "port": "noise"}})
        add("whiten", "conditioning", "noise_prewhiten", "kspace", "prewhitened_kspace")
        edges.append({"id": "model", "from": {"node": "noise", "port": "noise_model"}, "to": {"node": "whiten", "port": "noise_model"}})
    if phase:
        nodes.append({"id": "phase", "operator": {"provider": "calibration", "id": "phase_correction_estimate"}, "config": {}})
        ingress.append({"id": "phase_reference", "type": "phase-reference-frame", "to": {"node": "phase", "port": "reference"}})
        add("unphase", "conditioning", "phase_correct", "kspace", "corrected_kspace")
        edges.append({"id": "phasor", "from": {"node": "phase", "port": "phase_model"}, "to": {"node": "unphase", "port": "phase_model"}})
    if virtual_channels:
        nodes.append({"id": "basis", "operator": {"provider": "calibration", "id": "coil_compression_basis_estimate"}, "config": {"virtual_channels": virtual_channels}})
        ingress.append({"id": "calibration", "type": "kspace-frame", "to": {"node": "basis", "port": "kspace"}})
        add("compress", "conditioning", "coil_compress", "kspace", "compressed_kspace")
        edges.append({"id": "components", "from": {"node": "basis", "port": "basis"}, "to": {"node": "compress", "port": "basis"}})
    if crop:
        add("crop", "conditioning", "readout_oversampling_remove", "kspace", "cropped_kspace", offset=crop[0], output_columns=crop[1])
    add("transform", "cartesian", "cartesian_ifft2_coil_images", "kspace", "coil_images")
    add("combine", "coils", "coil_combine_rss", "coil_images", "image")
    alias = {"calibration": "calibration", "conditioning": "kspace-conditioning", "cartesian": "cartesian-recon", "coils": "coil-combine"}
    return {
        "kind": "PipelineDefinition", "pipeline": {"id": "cartesian-rss", "display_name": "Cartesian root sum of squares"},
        "input_profile": {"kind": "acquisitions", "container": {"mode": "auto"}}, "allowed_profiles": [], "parameters": {},
        "provider_requirements": [{"alias": a, "provider_id": p} for a, p in alias.items()], "nodes": nodes, "edges": edges,
        "bindings": {"ingress": ingress, "egress": [{"id": "image", "type": "image-frame", "from": {"node": "combine", "port": "image"}}], "calibration": [], "merge": []},
        "annotations": {},
    }


def noncartesian_rss(rows: int, cols: int, radial: bool = False, noise: bool = False, phase: bool = False, virtual_channels: int = 0) -> dict:
    """The document of the routes for samples along a trajectory: conditioning as asked for, the direct adjoint or (radial)
    ramp-weighted gridding, root sum of squares."""
    nodes, edges = [], []
    ingress = [{"id": "trajectory", "type": "trajectory-frame", "to": {"node": "transform", "port": "trajectory"}}]
    at: tuple[str, str] | None = None

    def step(name: str, provider: str, op: str, out: str, side: tuple | None = None, **config) -> None:
        """A node on the samples' way, and (side) the node that estimates its model from an ingress of its own."""
        nonlocal at
        nodes.append({"id": name, "operator": {"provider": provider, "id": op}, "config": config})
        if at is None:
            ingress.append({"id": "kspace", "type": "noncartesian-kspace-frame", "to": {"node": name, "port": "kspace"}})
        else:
            edges.append({"id": f"to_{name}", "from": {"node": at[0], "port": at[1]}, "to": {"node": name, "port": "kspace"}})
        if side:
            node, estimate, source, kind, port, model, options = side
            nodes.append({"id": node, "operator": {"provider": "calibration", "id": estimate}, "config": options})
            ingress.append({"id": source, "type": kind, "to": {"node": node, "port": port}})
            edges.append({"id": f"{node}_model", "from": {"node": node, "port": model}, "to": {"node": name, "port": model}})
        at = (name, out)

    if noise:
        step("whiten", "conditioning", "noncartesian_noise_prewhiten", "prewhitened_kspace", ("noise", "noise_model_estimate", "noise_samples", "noise-calibration-frame", "noise", "noise_model", {}))
    if phase:
        step("unphase", "conditioning", "noncartesian_phase_correct", "corrected_kspace", ("phase", "noncartesian_phase_correction_estimate", "phase_reference", "phase-reference-frame", "reference", "phase_model", {}))
    if virtual_channels:
        step("compress", "conditioning", "noncartesian_coil_compress", "compressed_kspace", ("basis", "coil_compression_basis_estimate", "calibration", "kspace-frame", "kspace", "basis", {"virtual_channels": virtual_channels}))
    step("transform", "noncartesian", "radial_gridding_reconstruct" if radial else "noncartesian_adjoint_reconstruct", "coil_images", rows=rows, cols=cols)
    nodes.append({"id": "combine", "operator": {"provider": "coils", "id": "coil_combine_rss"}, "config": {}})
    edges.append({"id": "to_combine", "from": {"node": "transform", "port": "coil_images"}, "to": {"node": "combine", "port": "coil_images"}})
    alias = {"calibration": "calibration", "conditioning": "kspace-conditioning", "noncartesian": "noncartesian-recon", "coils": "coil-combine"}
    used = {n["operator"]["provider"] for n in nodes}
    name = "radial-rss" if radial else "noncartesian-rss"
    return {
        "kind": "PipelineDefinition", "pipeline": {"id": name, "display_name": "Root sum of squares of samples along a trajectory"},
        "input_profile": {"kind": "acquisitions", "container": {"mode": "auto"}}, "allowed_profiles": [], "parameters": {},
        "provider_requirements": [{"alias": a, "provider_id": p} for a, p in alias.items() if a in used], "nodes": nodes, "edges": edges,
        "bindings": {"ingress": ingress, "egress": [{"id": "image", "type": "image-frame", "from": {"node": "combine", "port": "image"}}], "calibration": [], "merge": []},
        "annotations": {},
    }
