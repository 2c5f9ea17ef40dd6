"""Settings files on literal cases."""

import pytest

from skeinbase.functions.words import FACET_WEIGHTS
from skeinbase.sources import rules


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("12", 12), ("-0.5", -0.5), ("True", True), ("FALSE", False), ("plain words", "plain words"), ("'quoted'", "quoted"), ('"a: b"', "a: b"), ("[]", []), ('[a, "b, c", \'d\', ]', ["a", "b, c", "d"]), ("[1, 2]", ["1", "2"]), ("", ""), ("nan-ish", "nan-ish"), ("2024-01-01", "2024-01-01"), ("don't", "don't"),
    ],
)
def test_values(text, want):
    assert rules.value(text) == want and type(rules.value(text)) is type(want)


def test_blocks():
    text = "---\n# note\na: 1\nmap:\n  x: 2\n\ty: [p, q]\nb: 3\n  lost: 1\n---\nc: 4\n---\n"
    assert rules.settings(text) == {"a": 1, "map": {"x": 2, "y": ["p", "q"]}, "b": 3}
    assert rules.settings(text.replace("\n", "\r\n")) == rules.settings(text)
    assert rules.settings("  lost: 1\n") == {} and rules.settings("") == {} and rules.settings("---\na: 1\n") == {} and rules.settings("---\n  lost: 1\na:\n---\n") == {"a": {}}
    assert rules.settings("---\n---\n") == {}


@pytest.mark.parametrize("own", [{"silence_floor": -1}, {"silence_floor": "x"}, {"silence_floor": True}, {"dedup_threshold": 1.5}, {"dedup_threshold": float("nan")}, {"context_multiplier": float("inf")}, {"predicate_nudge": "maybe"}, {"facet_weights": {"ui": -1}}, {"core": {"silence_floor_min": "?"}}])
def test_values_that_do_not_fit(own):
    with pytest.raises(rules.Unfit):
        rules.layered(rules.Rules(), own)


def test_what_becomes_of_the_values_below():
    one = rules.layered(rules.Rules(), {"stay_silent_on": "docs", "surface_on": ["read"], "facet_weights": {"ui": 3}, "core": {"silence_floor_min": 5}, "predicate_nudge": "no", "context_boost": {"deploy": "backend"}, "query_stopwords": ["Foo"], "unknown": 1})
    two = rules.layered(one, {"stay_silent_on": [], "surface_on": [], "facet_weights": "none", "core": {"silence_floor_min": 1}, "query_stopwords": ["bar"], "tag_aliases": {"x": "bugfix"}})
    assert two.stay_silent_on == {"chore", "docs"} and two.surface_on == frozenset() and two.facet_weights == FACET_WEIGHTS | {"ui": 3.0}
    assert two.silence_floor_min == 5 and two.predicate_nudge is False and two.context_boost == {"deploy": "backend"} and two.query_stopwords == {"foo", "bar"} and two.tag_aliases["x"] == "bugfix"
    assert rules.Rules().facet_weights == FACET_WEIGHTS


def test_files_that_are_not_there_or_not_valid(tmp_path):
    bad, good = tmp_path / "bad.md", tmp_path / "good.md"
    bad.write_bytes(b"---\nsilence_floor: 9\n\xff\n---\n")
    good.write_text("---\nsilence_floor: 4\nallowed_tags: [x]\n---\n")
    found = rules.load(bad, good, tmp_path / "none")
    assert found.silence_floor == 4 and found.allowed_tags == {"x", "security"}
