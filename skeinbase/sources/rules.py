"""Settings: defaults under the user's under a project's, with a floor that no project can lower.

A setting is a row of SETTINGS: where it stands, its default, how a layer's value is read, and what becomes of the
value of the layers below. One fold over the layers does the rest.
"""

from __future__ import annotations

import math
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, make_dataclass, replace
from functools import reduce
from pathlib import Path
from typing import Any

from ..functions.words import FACET_WEIGHTS, TAG_ALIASES, TAGS

#: Facets whose weight no layer can lower, and that no list of tags can leave out.
CORE = {"security": 2.0}


class Unfit(ValueError):
    """A value that a setting cannot have; the layer that it is in does not count."""


# How a value is read.
def number(kind: type, least: float = 0, most: float = math.inf) -> Callable[[Any], Any]:
    def read(given: Any):
        try:
            found = None if isinstance(given, bool) else kind(given)
        except (TypeError, ValueError, OverflowError):
            found = None
        if found is None or not (math.isfinite(found) and least <= found <= most):
            raise Unfit(f"{given!r} should be a number from {least} to {most}")
        return found

    return read


def truth(given: Any) -> bool:
    word = str(given).lower()
    for said, words in ((True, "true 1 yes on"), (False, "false 0 no off")):
        if word in words.split():
            return said
    raise Unfit(f"{given!r} should be true or false")


def names(given: Any) -> frozenset[str]:
    several = given if isinstance(given, list) else [] if given is None else [given]
    return frozenset(str(x) for x in several)


def low_names(given: Any) -> frozenset[str]:
    return frozenset(x.lower() for x in names(given))


def table(read: Callable[[Any], Any]) -> Callable[[Any], dict]:
    """A map; anything else says nothing."""
    return lambda given: {str(k): read(v) for k, v in given.items()} if isinstance(given, dict) else {}


# What becomes of the value below: it gives way, it grows, or it is never gone under.
def instead(_: Any, new: Any) -> Any:
    return new


def joined(old: Any, new: Any) -> Any:
    return old | new


@dataclass(frozen=True)
class Setting:
    default: Any
    read: Callable[[Any], Any]
    join: Callable[[Any, Any], Any] = instead
    under: str = ""  # the key that it is indented below


# Names and defaults.
SETTINGS = {
    "silence_floor": Setting(2, number(int)),
    "silence_floor_min": Setting(2, number(int), max, under="core"),
    "dedup_threshold": Setting(0.45, number(float, most=1.0)),
    "context_multiplier": Setting(1.5, number(float)),
    "predicate_nudge": Setting(True, truth),
    "stay_silent_on": Setting(frozenset({"chore"}), names, joined),
    "query_stopwords": Setting(frozenset(), low_names, joined),
    "surface_on": Setting(frozenset({"edit", "write"}), names),
    "edge_kinds": Setting(frozenset("implements decided_by supersedes guarded_by warns_about recurs_with presents relates_to depends_on co_changed".split()), names),
    "allowed_tags": Setting(frozenset(TAGS), names),
    "facet_weights": Setting(FACET_WEIGHTS, table(number(float)), joined),
    "context_boost": Setting({}, table(str), joined),
    "tag_aliases": Setting(TAG_ALIASES, table(str), joined),
}
Rules = make_dataclass("Rules", [(name, Any, field(default_factory=lambda s=s: s.default)) for name, s in SETTINGS.items()], frozen=True)

_BLOCK = re.compile(r"\A[ \t]*---[ \t]*\n(.*?)^[ \t]*---[ \t]*$", re.DOTALL | re.MULTILINE)
_ENTRY = re.compile(r"^(?P<indent>[ \t]*)(?P<key>[^\s#:][^:\n]*?)[ \t]*:[ \t]*(?P<value>.*?)[ \t]*$", re.MULTILINE)
_ITEM = re.compile(r"""\s*(?:"([^"]*)"|'([^']*)'|([^,]+))\s*(?:,|\Z)""")


def value(text: str) -> Any:
    """What stands behind a key: a list of texts in brackets, a truth value, a number, or a text, quoted or bare."""
    text = text.strip()
    if text[:1] == "[" and text[-1:] == "]":
        found = (next((g for g in m.groups() if g is not None), "").strip() for m in _ITEM.finditer(text[1:-1]))
        return [x for x in found if x]
    try:
        known = tomllib.loads(f"x = {text.lower() if text.isalpha() else text}")["x"]
    except tomllib.TOMLDecodeError:
        return text.strip("'\"")
    return known if isinstance(known, (bool, int, float, str)) else text


def settings(text: str) -> dict[str, Any]:
    """The block between --- lines at the top: ``key: value``, and below a key without a value its own, indented. A
    block that isn't closed is none; indented lines below a key with a value, or none, say nothing."""
    block = _BLOCK.match(text.replace("\r\n", "\n"))
    found: dict[str, Any] = {}
    last = None
    for entry in _ENTRY.finditer(block[1] if block else ""):
        if not entry["indent"]:
            last = entry["key"]
            found[last] = value(entry["value"]) if entry["value"] else {}
        elif last is not None and isinstance(found[last], dict):
            found[last][entry["key"]] = value(entry["value"])
    return found


def layered(base: Rules, own: dict[str, Any]) -> Rules:
    """``base`` with what a layer says in place of, or added to, what was there. Raises :class:`Unfit`."""
    changed = {}
    for name, s in SETTINGS.items():
        there = own.get(s.under) if s.under else own
        if isinstance(there, dict) and name in there:
            changed[name] = s.join(getattr(base, name), s.read(there[name]))
    return replace(base, **changed)


def _read(path: Path) -> str:
    try:
        return path.read_text(encoding="utf-8")
    except (OSError, ValueError):
        return ""


def load(*paths: str | Path) -> Rules:
    """Defaults under the settings of the files in order; a file that isn't there or isn't valid changes
    nothing. At the end the core holds: its floor, and the weight and the tag of its facets."""

    def add(rules: Rules, path: str | Path) -> Rules:
        try:
            return layered(rules, settings(_read(Path(path))))
        except Unfit:
            return rules

    rules = reduce(add, paths, Rules())
    weights = {**rules.facet_weights, **{facet: max(least, rules.facet_weights.get(facet, least)) for facet, least in CORE.items()}}
    return replace(rules, silence_floor=max(rules.silence_floor, rules.silence_floor_min), facet_weights=weights, allowed_tags=rules.allowed_tags.union(CORE))


def build_settings(path: str | Path) -> dict[str, Any]:
    """A TOML file's tables; empty if it isn't there or isn't valid."""
    try:
        return tomllib.loads(_read(Path(path)))
    except tomllib.TOMLDecodeError:
        return {}
