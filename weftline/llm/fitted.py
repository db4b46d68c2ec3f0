"""Weights of the models that are fitted on examples made here: kept in fitted.json, made anew by running this module."""

from __future__ import annotations

import json
from pathlib import Path

FILE = Path(__file__).with_name("fitted.json")


def load(name: str) -> dict:
    """The kept weights of a model."""
    return json.loads(FILE.read_text())[name]


def main() -> None:
    from weftline.llm import pii, secrets

    FILE.write_text(json.dumps({"pii": pii.fitted(), "secrets": secrets.fitted()}, separators=(",", ":")) + "\n")


if __name__ == "__main__":
    main()
