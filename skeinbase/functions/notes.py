"""What commits, notes and tasks say, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import normal

# States of a task, kinds that claim something, words by drift and edge kind, noise.
STATUSES = ("open", "done", "dropped", "deferred")
CLAIMS = ("lesson", "decision", "task", "plan")
LEVELS = ("fresh", "committed", "uncommitted", "broken")
SHOWN = {"fresh": "fresh", "committed": "moved", "uncommitted": "moved", "broken": "broken"}
FAMILIES = {
    "depends_on": "depends", "implements": "depends", "calls": "depends", "co_changed": "co", "guarded_by": "guards", "guards": "guards",
    "warns_about": "guards", "relates_to": "relates", "supersedes": "relates", "decided_by": "relates", "presents": "relates",
}
NOISE = r"^(?:proof|experiments|\.venv|node_modules|dist|build|\.mind|__pycache__|\.git)/|/_runs/|past-incident|/run_with/|/run_without/"
QUIET_PREFIXES = ("chore", "build", "ci", "style", "test", "docs")
NO_SOURCE = r"\.(?:md|json|lock|lockb|txt|yml|yaml|toml)$|/docs/"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def status(facets: Column, order=STATUSES) -> Column:
    """The first state of ``order`` among the facets; open without any."""
    return F.coalesce(*(F.when(F.array_contains(facets, s), s) for s in order), F.lit("open"))


#: What counts when tasks are shown: an end outweighs open.
ENDED_FIRST = ("done", "dropped", "deferred", "open")


def mapped(words: dict[str, str], column: Column, default: str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    return F.coalesce(F.try_element_at(table, column), F.lit(default))


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1


def trailer(message: Column, key: str, prefix: str = "Note") -> Column:
    """The value of a commit message's line ``Note-<key>: value``; null without one."""
    found = F.trim(F.regexp_extract(message, rf"(?m)^{prefix}-{key}:\s*(.+)$", 1))
    return F.when(found != "", found)


def trailer_edges(message: Column, prefix: str = "Note") -> Column:
    """array<struct<kind, target>> of lines ``Note-edge: kind -> target``."""
    lines = F.regexp_extract_all(message, F.lit(rf"(?m)^{prefix}-edge:\s*\w+\s*->\s*.+$"), F.lit(0))
    part = lambda x, i: F.trim(F.regexp_extract(x, rf"^{prefix}-edge:\s*(\w+)\s*->\s*(.+)$", i))
    return F.transform(lines, lambda x: F.struct(part(x, 1).alias("kind"), part(x, 2).alias("target")))


def is_trailer(line: Column, prefix: str = "Note") -> Column:
    return F.trim(line).rlike(rf"(?i)^({prefix}-\w+|Co-Authored-By|Signed-off-by):")


def explanation(message: Column) -> Column:
    """A commit message without its first line and trailers."""
    lines = F.split(_strip(message), "\n")
    return _strip(F.array_join(F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~is_trailer(x)), "\n"))


def note_title(message: Column) -> Column:
    """The reason given, else the first line; but of a message of trailers only, its anchors."""
    first = F.substring_index(_strip(message), "\n", 1)
    return F.coalesce(trailer(message, "why"), F.when(is_trailer(first), trailer(message, "anchors")), first)


def commit_facets(title: Column, files: Column) -> Column:
    """By the first word of a conventional title; without one, commits of ignore rules, locks and settings
    alone are chores."""
    prefix = F.lower(F.regexp_extract(F.trim(title), r"^(\w+)", 1))
    real = F.filter(files, lambda f: ~F.lower(f).rlike(r"(?:^|/)\.git(?:ignore|attributes)$") & ~F.lower(f).rlike(r"(?:\.lock|lock\.json|\.toml)$"))
    return (
        F.when(prefix == "feat", F.array(F.lit("feature"))).when(prefix == "fix", F.array(F.lit("bugfix")))
        .when(prefix.isin(*QUIET_PREFIXES), F.array(F.lit("chore"))).when((F.size(files) > 0) & (F.size(real) == 0), F.array(F.lit("chore"))).otherwise(_none())
    )


def knowledge_facets(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("decisions") | low.contains("concept"), F.array(F.lit("foundation"))).when(low.rlike("memory|session-handoff|feedback"), F.array(F.lit("docs"))).otherwise(_none())


def feature(title: Column) -> Column:
    """The scope of a conventional title, ``feat(scope): ...``; null without one."""
    scope = F.regexp_extract(title, r"^\s*(?:feat|fix|refactor|perf|chore|docs|test)\s*\(([^)]+)\)", 1)
    name = F.lower(F.trim(F.substring_index(F.trim(scope), ",", 1)))
    return F.when(scope != "", name)


def sources_only(files: Column) -> Column:
    """The files that change together with meaning: no docs, settings or locks."""
    return F.transform(F.filter(files, lambda f: ~F.lower(f).rlike(NO_SOURCE)), normal)


def main_file(files: Column) -> Column:
    """The first file that is no document, else the first."""
    return F.coalesce(F.get(F.filter(files, lambda f: ~F.lower(f).rlike(r"\.(?:md|json|lock)$|/docs/")), 0), F.get(files, 0))


def is_noise(path: Column) -> Column:
    return F.regexp_replace(path, r"^[./]+", "").rlike(NOISE)


def own_prose(section: Column) -> Column:
    """Characters of a section's lines that are no heading, rule or lone link."""
    lines = F.transform(F.split(section, "\n"), _strip)
    prose = F.filter(lines, lambda s: (s != "") & ~s.rlike(r"^#{1,6}\s") & ~s.rlike(r"^[-*_]{3,}\s*$") & ~s.rlike(r"^\[[^\]]*\]\([^)]*\)[.,;]?\s*$"))
    return F.aggregate(prose, F.lit(0), lambda n, s: n + F.length(s))


def trust(drift: Column, predicate: Column) -> Column:
    """What is known of a claim with a check: broken, holds or unverified; nothing without a check."""
    return F.when(F.coalesce(predicate, F.lit("")) == "", "").when(drift == "broken", "broken").when(drift == "fresh", "holds").otherwise("unverified")


def context_facet(context: Column, boosts: dict[str, str]) -> Column:
    """The facet of the first word, in order, that a context has; null if none."""
    low = F.lower(context)
    return F.coalesce(*(F.when(low.contains(k), v) for k, v in boosts.items()), F.lit(None).cast("string"))


def phrase(terms: Column, wanted: Column) -> Column:
    """Whether ``wanted`` is a run of ``terms``, both arrays of words; an empty one is none."""
    run = lambda words: F.concat(F.lit("\x01"), F.array_join(words, "\x01"), F.lit("\x01"))
    return (F.size(wanted) > 0) & (F.size(terms) > 0) & F.contains(run(terms), run(wanted))


def path_mentions(text: Column) -> Column:
    """Distinct paths with a folder and a suffix, or a known suffix, that a text names."""
    return F.array_distinct(F.regexp_extract_all(normal(text), F.lit(r"[\w./-]*[\w-]\.(?:py|tsx?|jsx?|go|rs|java|rb|php|cs|md|json)\b"), F.lit(0)))


def suggested_check(path: Column, added: Column) -> Column:
    """A claim about the added lines of a source file: the first function or class, else the first
    constant that they define; null without one."""
    define = r"^\s*(?:export\s+)?(?:async\s+)?(?:def|class|function)\s+([A-Za-z_]\w{2,})\b"
    constant = r"^\s*(?:export\s+)?(?:const\s+)?([A-Z][A-Z0-9_]{3,})\s*[:=]"
    first = lambda pattern: F.get(F.filter(F.transform(added, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != ""), 0)
    name = F.coalesce(first(define), first(constant))
    return F.when(F.lower(path).rlike(r"\.(?:py|tsx?|jsx?|go|rs|java|rb|php|c|cpp|h|hpp|cs|swift|kt)$") & name.isNotNull(), F.concat(F.lit("contains:"), name))


def _bracket_spans(text: Column) -> Column:
    """array<struct<a, b>> of all spans from an opening bracket to the one that closes it, by start, the longest first.
    Brackets in strings do not count, nor quotes and backslashes outside of brackets."""
    start = F.expr("struct(cast(array() as array<int>) as open, false as quoted, false as escaped, 1 as at, cast(array() as array<struct<a:int,b:int>>) as spans)")

    def step(s: Column, c: Column) -> Column:
        inside = F.size(s["open"]) > 0
        opens, closes = ~s["quoted"] & c.isin("{", "["), ~s["quoted"] & inside & c.isin("}", "]")
        return F.struct(
            F.when(opens, F.concat(s["open"], F.array(s["at"]))).when(closes, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"]).alias("open"),
            F.when(inside & ~s["escaped"] & (c == '"'), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"), (s["at"] + 1).alias("at"),
            F.when(closes, F.concat(s["spans"], F.array(F.struct(F.element_at(s["open"], -1).alias("a"), s["at"].alias("b"))))).otherwise(s["spans"]).alias("spans"),
        )

    spans = F.aggregate(F.split(text, ""), start, step)["spans"]
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["a"].alias("a"), (-s["b"]).alias("b")))), lambda s: F.struct(s["a"].alias("a"), (-s["b"]).alias("b")))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _if_json(part: Column) -> Column:
    """``part``, a span of brackets, if it is valid, or else null."""
    return F.when(F.try_parse_json(part).isNotNull(), part)


def _whole_json(part: Column) -> Column:
    """``part`` if all of it is one valid span of brackets, or else null."""
    whole = F.exists(_bracket_spans(part), lambda s: (s["a"] == 1) & (s["b"] == F.length(part)))
    return F.when(part.rlike(r"(?s)^[{\[].*[}\]]$"), F.when(whole, _if_json(part)))


def json_part(text: Column) -> Column:
    """The first whole object or list of a noisy text, null if there is none: all of it, else what the first fence
    encloses, else the first span of brackets that is valid JSON. A fence that is not closed goes on to the end."""
    fenced = _trimmed(F.regexp_extract(text, r"(?s)```(?:[A-Za-z]*[^\S\n]*\n)?(.*?)(?:```|\z)", 1))
    spans = _bracket_spans(text)
    tried = F.aggregate(spans, F.lit(None).cast("string"), lambda found, s: F.when(found.isNotNull(), found).otherwise(_if_json(text.substr(s["a"], s["b"] - s["a"] + 1))))
    return F.coalesce(_whole_json(_trimmed(text)), _whole_json(fenced), tried)


def edge_labels(reply: Column, targets: Column) -> Column:
    """map<target, kind> of a reply {"edges": [{"target", "kind"}]}, of the targets that were asked about."""
    edges = F.from_json(json_part(reply), "edges array<struct<target string, kind string>>")["edges"]
    clean = F.transform(F.coalesce(edges, F.expr("cast(array() as array<struct<target string, kind string>>)")), lambda e: F.struct(F.trim(e["target"]).alias("target"), F.lower(F.trim(e["kind"])).alias("kind")))
    good = F.filter(clean, lambda e: F.array_contains(targets, e["target"]) & (e["kind"] != ""))
    return F.map_from_entries(F.filter(good, lambda e: e == F.element_at(F.filter(good, lambda x: x["target"] == e["target"]), -1)))
