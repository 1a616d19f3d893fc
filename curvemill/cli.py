"""Command line: a table of handlers, each of which returns what is to be said."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence

from curvemill import __version__


def version() -> dict:
    return {"tool": "curvemill", "version": __version__}


def capabilities() -> dict:
    return version() | {"purpose": "Evaluate and curate chart-extraction data on Spark.", "status": "alpha", "commands": sorted(HANDLERS), "readme": "README.md"}


HANDLERS: dict[str, Callable[[], dict]] = {"capabilities": capabilities, "version": version}
FORMS: dict[str, Callable[[dict], str]] = {
    "json": lambda said: json.dumps(said, ensure_ascii=False),
    "text": lambda said: "\n".join(f"{name}: {value if isinstance(value, str) else ', '.join(value)}" for name, value in said.items()),
}


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="curvemill")
    parser.add_argument("command", choices=HANDLERS)
    parser.add_argument("--format", choices=FORMS, default="json")
    asked = parser.parse_args(argv)
    print(FORMS[asked.format](HANDLERS[asked.command]()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
