"""Path predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of tests and entry points, suffixes of source files.
TEST_FILE = r"(?:^|/)tests?/|(?:^|/)test_[^/]*$|_test\.[a-z0-9]+$|\.(?:spec|test)\.[a-z0-9]+$"
ENTRY_FILE = (
    r"(?:^|/)(?:__main__|__init__|conftest|setup|manage|main|index|app|wsgi|asgi)\.[a-z]+$"
    r"|(?:^|/)(?:page|layout|route|loading|error|not-found|middleware|proxy|template|head|sitemap|robots|opengraph-image|default)\.[a-z]+$"
    r"|\.config\.[a-z]+$|\.d\.ts$"
)
CODE_SUFFIXES = "py ts tsx js jsx go rs java rb php c cpp h hpp cs swift kt".split()


def normal(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_test(path: Column) -> Column:
    return F.lower(normal(F.coalesce(path, F.lit("")))).rlike(TEST_FILE)


def mentions_test(path: Column) -> Column:
    """The resolver's own, looser predicate."""
    return F.lower(F.coalesce(path, F.lit(""))).contains("test")


def is_entry(path: Column) -> Column:
    return F.lower(normal(path)).rlike(ENTRY_FILE)


def is_code(path: Column) -> Column:
    return path.contains(".") & F.lower(F.substring_index(path, ".", -1)).isin(CODE_SUFFIXES)
