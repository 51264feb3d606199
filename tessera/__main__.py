"""Operators and pipeline documents from the command line.

    python -m tessera operators             every operator, as provider/name
    python -m tessera contract PROVIDER/ID  its ports and options as JSON
    python -m tessera check FILE            whether a pipeline document is valid
    python -m tessera new ROUTE             a document of a route: cartesian, radial or noncartesian
"""

from __future__ import annotations

import json
import sys

from tessera.plans import pipeline
from tessera.registry import OPERATORS, ConfigError, contract

ROUTES = {"cartesian": pipeline.cartesian_rss, "radial": lambda: pipeline.noncartesian_rss(64, 64, radial=True), "noncartesian": lambda: pipeline.noncartesian_rss(64, 64)}


def main(args: list[str]) -> int:
    match args:
        case ["operators"]:
            print("\n".join(sorted(f"{p}/{n}" for p, n in OPERATORS)))
        case ["contract", name] if tuple(name.split("/", 1)) in OPERATORS:
            print(json.dumps(contract(OPERATORS[tuple(name.split("/", 1))]), indent=2))
        case ["check", path]:
            try:
                with open(path, encoding="utf-8") as f:
                    print(f"{path}: valid, {len(pipeline.parse(f.read()).nodes)} nodes")
            except (ConfigError, ValueError, KeyError, TypeError) as e:
                print(f"{path}: {e}")
                return 1
        case ["new", route] if route in ROUTES:
            print(json.dumps(ROUTES[route](), indent=2))
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
