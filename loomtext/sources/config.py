"""Run settings: YAML files that extend one another, a table of rules they have to meet, and command-line values.

Settings are looked at as leaves by path ("split.test_size"): layering files is layering their leaves, a rule
names the paths it reads, and a command-line value is one more leaf.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

Leaves = dict[tuple[str, ...], Any]


def leaves(tree: Any, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Any]]:
    """Path and value of everything that is no filled section; an empty section is a leaf."""
    if isinstance(tree, dict) and (tree or not at):
        for name, below in tree.items():
            yield from leaves(below, (*at, name))
    else:
        yield at, tree


def put(held: Leaves, path: tuple[str, ...], value: Any) -> None:
    """Lays a leaf over others: a value hides the section at its place and a section the value above it."""
    below = [p for p in held if p[: len(path)] == path and p != path]
    if value == {} and below:
        return
    for p in [*below, *(path[:i] for i in range(1, len(path)))]:
        held.pop(p, None)
    held[path] = value


def tree(held: Leaves) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for path, value in held.items():
        section = out
        for name in path[:-1]:
            section = section.setdefault(name, {})
        section[path[-1]] = list(value) if isinstance(value, list) else dict(value) if isinstance(value, dict) else value
    return out


def layered(*trees: dict[str, Any]) -> dict[str, Any]:
    """One tree of all, later ones over earlier ones."""
    held: Leaves = {}
    for t in trees:
        for path, value in leaves(t):
            put(held, path, value)
    return tree(held)


def look(config: dict[str, Any], dotted: str, default: Any = None) -> Any:
    found: Any = config
    for name in dotted.split("."):
        found = found.get(name) if isinstance(found, dict) else None
    return default if found is None else found


@dataclass(frozen=True)
class Rule:
    """``holds`` gets the values at ``paths`` (or their defaults); where it doesn't, ``says`` is the error."""

    says: str
    paths: tuple[tuple[str, Any], ...]
    holds: Callable[..., bool]


def _sections(*names: str) -> list[Rule]:
    return [Rule(f"the section {n} is missing", ((n, None),), lambda x: x is not None) for n in names]


#: Held-out shares by split and their defaults.
HELD_OUT = (("split.validation_size", 0.15), ("split.test_size", 0.15), ("split.calibration_size", 0.0))
RULES = [
    *_sections("experiment", "data", "split", "features", "representations", "classifiers"),
    Rule("split sizes have to leave a positive training share", HELD_OUT, lambda *s: sum(map(float, s)) < 1),
    Rule("validation and test need a share each", HELD_OUT[:2], lambda *s: min(map(float, s)) > 0),
    Rule("split.calibration_size may not be negative", HELD_OUT[2:], lambda c: float(c) >= 0),
    Rule("data.target_columns has to name columns", (("data.target_columns", ()),), bool),
    Rule(
        "fine-tuning needs a positive split.calibration_size",
        (("finetuning.enabled", False), HELD_OUT[2]),
        lambda on, c: float(c) > 0 if on else True,
    ),
    Rule(
        "features.field_weights have to sum to a positive number",
        (("features.field_weights", None),),
        lambda w: w is None or sum(float(x) for x in w.values()) > 0,
    ),
]


def complaints(config: dict[str, Any]) -> list[str]:
    """What the rules say against the settings."""
    return [r.says for r in RULES if not r.holds(*(look(config, p, d) for p, d in r.paths))]


def lineage(path: str | Path) -> list[dict[str, Any]]:
    """The settings of a file and of those it extends, the farthest first."""
    import yaml

    out, place = [], Path(path).expanduser().resolve()
    while place:
        own = yaml.safe_load(place.read_text(encoding="utf-8")) or {}
        parent = own.pop("extends", None)
        out.insert(0, own)
        place = (place.parent / parent).resolve() if parent else None
    return out


def load(path: str | Path, **more: Any) -> dict[str, Any]:
    """A file's settings over those it extends, with values by dotted path on top (None leaves what is there)."""
    held: Leaves = dict(leaves(layered(*lineage(path))))
    for dotted, value in more.items():
        if value is not None:
            put(held, tuple(dotted.split(".")), value)
    config = tree(held)
    found = complaints(config)
    if found:
        raise ValueError("; ".join(found))
    return config


def dump(config: dict[str, Any]) -> str:
    """The settings as YAML, without sections that begin with an underscore, which are the run's own."""
    import yaml

    return yaml.safe_dump(dict(filter(lambda kv: kv[0][0] != "_", config.items())), allow_unicode=True, sort_keys=False)


#: Command-line options, the settings they stand for, and what they say.
OPTIONS = {
    "metadata": ("data.metadata_csv", "CSV of the items' metadata"),
    "fulltext": ("data.fulltext_source", "folder or Parquet of the full texts"),
    "mapping": ("data.mapping_csv", "CSV from text files to handles"),
    "output": ("experiment.output_dir", "folder of the runs"),
}
STAGES = ("prepare", "sparse", "sbert", "labse", "finetune", "finalize", "all")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Runs the corpus classification pipeline.")
    parser.add_argument("--config", required=True)
    for option, (dotted, about) in OPTIONS.items():
        parser.add_argument(f"--{option}", help=f"{about} ({dotted})")
    parser.add_argument("--stage", default="all", choices=STAGES)
    return parser.parse_args(argv)


def from_arguments(args: argparse.Namespace) -> dict[str, Any]:
    return load(args.config, **{dotted: getattr(args, option) for option, (dotted, _) in OPTIONS.items()})
