"""Operators by name: typed ports and configuration, as pipeline documents refer to them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


class ConfigError(ValueError):
    """A pipeline document or an operator's configuration isn't valid."""


@dataclass(frozen=True)
class Option:
    kind: type
    least: float | None = None
    most: float | None = None
    required: bool = True
    default: Any = None


@dataclass(frozen=True)
class Operator:
    name: str
    provider: str
    inputs: dict[str, str]
    outputs: dict[str, str]
    config: dict[str, Option]
    run: Callable

    def checked(self, config: dict) -> dict:
        """The configuration with defaults; unknown keys, wrong types and values out of bounds are errors."""
        if extra := set(config) - set(self.config):
            raise ConfigError(f"{self.name}: unknown configuration {sorted(extra)}")
        out = {}
        for key, o in self.config.items():
            if key not in config:
                if o.required:
                    raise ConfigError(f"{self.name}: {key} is missing")
                out[key] = o.default
                continue
            v = config[key]
            if isinstance(v, str) and o.kind in (int, float):
                v = o.kind(v)
            if isinstance(v, bool) != (o.kind is bool) or not isinstance(v, (int, float) if o.kind is float else o.kind):
                raise ConfigError(f"{self.name}: {key} must be {o.kind.__name__}")
            if o.kind in (int, float) and (v != v or o.least is not None and v < o.least or o.most is not None and v > o.most):
                raise ConfigError(f"{self.name}: {key} = {v} is out of bounds")
            out[key] = v
        return out


OPERATORS: dict[tuple[str, str], Operator] = {}


def operator(provider: str, name: str, inputs: dict[str, str], outputs: dict[str, str], **config: Option):
    """Register a function of its input ports and configuration; it gives one result, or a dict by output port."""

    def wrap(f: Callable) -> Callable:
        OPERATORS[provider, name] = Operator(name, provider, inputs, outputs, config, f)
        return f

    return wrap


def contract(op: Operator) -> dict:
    """An operator's contract as a document: its ports with their types, and its options with kind, bounds and default."""

    def option(o: Option) -> dict:
        out = {"type": {int: "integer", float: "number", str: "string", bool: "boolean"}[o.kind], "required": o.required}
        out |= {} if o.required else {"default": o.default}
        return out | {k: v for k, v in (("minimum", o.least), ("maximum", o.most)) if v is not None}

    ports = lambda side: [{"name": n, "type": t} for n, t in side.items()]
    return {"kind": "OperatorContract", "operator": {"provider": op.provider, "id": op.name}, "inputs": ports(op.inputs), "outputs": ports(op.outputs), "config": {k: option(o) for k, o in op.config.items()}}
