"""Imports resolved to files: ranked candidates of each import meet an index of the names that files go by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may be left out of a file's name, the files that stand for their folder, and what is no module.
SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".rb", ".php", ".c", ".cpp", ".cs")
FOLDER_FILES = ("index", "__init__", "mod")
ASSETS = (".css", ".scss", ".sass", ".less", ".json", ".svg", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".md", ".txt", ".yaml", ".yml", ".toml")


def _words(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def walked(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty parts; what leads out of the tree keeps its ``..`` and so names no file."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when((part == ".") | (part == ""), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    # A leading part keeps the last one there; it is taken off again.
    parts = F.aggregate(F.split(path, "/"), F.expr("cast(array('..') as array<string>)"), step)
    return F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/")


def names(files: DataFrame) -> DataFrame:
    """(name, rank, target): what each file (path) can be imported as, the lower rank first where files share a name: its
    path, its path without a suffix, and its folder if it stands for that."""
    ending = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    at = F.array_position(_words(SUFFIXES), ending).cast("int")
    bare = F.regexp_replace("path", r"\.[^./]+$", "")
    stands = F.array_position(_words(FOLDER_FILES), F.substring_index(bare, "/", -1)).cast("int")
    folder = F.regexp_replace(bare, r"/?[^/]*$", "")
    ways = F.array(
        F.struct(F.col("path").alias("name"), F.lit(0).alias("rank")),
        F.struct(F.when(at > 0, bare).alias("name"), at.alias("rank")),
        F.struct(F.when((at > 0) & (stands > 0) & (folder != ""), folder).alias("name"), (stands * 100 + at).alias("rank")),
    )
    return files.select(F.col("path").alias("target"), F.inline(ways)).where("name is not null").select("name", "rank", "target")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def candidates(spec: Column, path: Column, bare: bool = False) -> Column:
    """The names that an import ``spec`` in the file ``path`` may mean, the likeliest first; none for what is a package's.

    ``./a`` and ``../a`` go from the file's folder; ``.a``, ``..a.b`` from the module's package, each further dot one
    folder up; ``@/a`` from each folder above the file, the nearest first, by its ``src`` and then itself; ``a.b``
    is a module of the tree, or of its ``src``, and with ``bare`` so is a name alone.
    """
    base = _folder(path)
    none = F.expr("cast(array() as array<string>)")
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    tail = F.translate(F.substring(spec, dots + 1, F.length(spec)), ".", "/")
    package = F.concat(base, F.lit("/"), F.repeat(F.lit("../"), dots - 1), tail)
    relative = F.array(walked(F.when(spec.contains("/"), F.concat_ws("/", base, spec)).otherwise(package)))
    rest = F.substring(spec, F.lit(3), F.length(spec))
    parts = F.filter(F.split(base, "/"), lambda x: x != "")
    roots = F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    alias = F.flatten(F.transform(roots, lambda r: F.array(walked(F.concat_ws("/", r, F.lit("src"), rest)), walked(F.concat_ws("/", r, rest)))))
    module = F.translate(spec, ".", "/")
    asset = F.lower(spec).rlike("(" + "|".join(a.replace(".", r"\.") for a in ASSETS) + ")$")
    dotted = F.when((spec.contains(".") | F.lit(bare)) & ~spec.contains("/") & ~asset, F.array(module, F.concat(F.lit("src/"), module))).otherwise(none)
    found = F.when(spec.startswith("."), relative).when(spec.startswith("@/"), alias).otherwise(dotted)
    return F.when(spec == "", none).otherwise(found)


def resolved(specs: DataFrame, files: DataFrame, bare: bool = False) -> DataFrame:
    """(path, spec, target): the file that each import (path, spec) means, if it is one of ``files`` (path).

    Of several candidates the first that is there counts, and under its name the file of least rank, so that a name
    that is shared gives one file. Imports of packages, and of what is not there, have no row: no edge is better
    than a wrong one. Nulls have none; repeated imports have one.
    """
    asked = specs.select("path", F.trim("spec").alias("wanted"), "spec").where("path is not null and spec is not null").distinct()
    ways = asked.select("path", "spec", F.posexplode(candidates(F.col("wanted"), F.col("path"), bare)).alias("at", "name"))
    met = ways.join(names(files.where("path is not null").select("path").distinct()), "name")
    return met.groupBy("path", "spec").agg(F.min_by("target", F.struct("at", "rank", "target")).alias("target"))


def file_links(specs: DataFrame, files: DataFrame, bare: bool = False) -> DataFrame:
    """(path, target): distinct edges between different files."""
    return resolved(specs, files, bare).where("path <> target").select("path", "target").distinct()
