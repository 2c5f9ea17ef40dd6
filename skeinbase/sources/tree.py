"""Source trees: files, symbols, imports and knowledge notes."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import links

SKIPPED = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", "vendor")
MOST_BYTES = 2_000_000


def source_files(spark: SparkSession, root: str, suffixes=("py",)) -> DataFrame:
    """(path, text) of the files below ``root`` with the suffixes, 2 MB at most, outside skipped folders.
    Spark hides files whose names begin with an underscore or a dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    inside = ~F.col("path").rlike("/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/")
    return files.where((F.col("length") <= MOST_BYTES) & inside).select("path", F.col("content").cast("string").alias("text"))


@udtf(returnType="symbol string, kind string, line int, doc string")
class PythonSymbols:
    """Functions and classes of a Python file, with the first line of their docstring."""

    def eval(self, source: str):
        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError):
            return
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                doc = ast.get_docstring(node)
                yield node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, doc.splitlines()[0] if doc else None


@udtf(returnType="spec string")
class PythonImports:
    """Modules that a Python file imports."""

    def eval(self, source: str):
        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError):
            return
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for name in node.names:
                    yield (name.name,)
            elif isinstance(node, ast.ImportFrom) and node.module:
                yield ("." * node.level + node.module,)
            elif isinstance(node, ast.ImportFrom):  # the names are modules of the package itself
                for name in node.names:
                    yield ("." * node.level + ("" if name.name == "*" else name.name),)


def symbols(files: DataFrame) -> DataFrame:
    files.createOrReplaceTempView("__files")
    files.sparkSession.udtf.register("python_symbols", PythonSymbols)
    return files.sparkSession.sql("SELECT path, s.* FROM __files, LATERAL python_symbols(text) s")


def imports(files: DataFrame) -> DataFrame:
    files.createOrReplaceTempView("__files")
    files.sparkSession.udtf.register("python_imports", PythonImports)
    return files.sparkSession.sql("SELECT path, s.spec FROM __files, LATERAL python_imports(text) s")


def resolved_imports(specs: DataFrame, known: DataFrame) -> DataFrame:
    """(path, target): imports (path, spec) of any kind resolved to known files (path); a name alone is a module here."""
    return links.file_links(specs, known, bare=True)


def frontmatter(files: DataFrame) -> DataFrame:
    """(path, meta map<string,string>, body): the block between --- lines at the top as keys and values; of a key that
    stands twice the last value counts; a block that isn't closed is body."""
    block = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    key = lambda x: F.trim(F.substring_index(x, ":", 1))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)), r"^[\"']|[\"']$", "")
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: key(later) == key(x)))
    meta = F.map_from_entries(F.transform(last, lambda x: F.struct(key(x), value(x))))
    return files.select("path", F.when(block != "", meta).otherwise(F.map_from_entries(F.expr("cast(array() as array<struct<k:string,v:string>>)"))).alias("meta"), F.regexp_replace("text", r"(?s)\A---\n.*?\n---(?:\n|\z)", "").alias("body"))


def checklist(files: DataFrame) -> DataFrame:
    """(path, at, state, item) of the [ ], [x], [-] and [>] lines of (path, body), with the indented lines that
    follow folded in."""
    lines = files.select("path", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    mark = F.regexp_extract("line", r"^\s*[-*] \[([ xX>-])\]", 1)
    marked = lines.withColumn("mark", mark)
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = marked.withColumn("item", F.sum((F.col("mark") != "").cast("int")).over(w)).where((F.col("item") > 0) & ((F.col("mark") != "") | F.col("line").rlike(r"^\s{2,}\S")))
    state = F.create_map(*(F.lit(x) for x in (" ", "open", "x", "done", "X", "done", "-", "dropped", ">", "moved")))
    text = F.trim(F.regexp_replace("line", r"^\s*[-*] \[[ xX>-]\]", ""))
    return islands.groupBy("path", "item").agg(F.min("at").alias("at"), F.max(state[F.when(F.col("mark") != "", F.col("mark"))]).alias("state"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", text.alias("t")))), lambda s: s["t"]), " ").alias("text")).drop("item")


# How a line begins that defines something, by the file's suffix.
_NAME = r"([A-Za-z_$][\w$]*)"
_JS = {"class": rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}", "function": rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+{_NAME}|^\s*(?:export\s+)?(?:const|let)\s+{_NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", "interface": rf"^\s*(?:export\s+)?interface\s+{_NAME}", "type": rf"^\s*(?:export\s+)?type\s+{_NAME}\s*[=<]", "enum": rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_NAME}"}
_MODIFIED = r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|open|data|partial)\s+)*"
_TYPES = {"class": rf"{_MODIFIED}class\s+{_NAME}", "interface": rf"{_MODIFIED}interface\s+{_NAME}", "enum": rf"{_MODIFIED}enum\s+(?:class\s+)?{_NAME}"}
_METHOD = rf"^\s*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async)\s+)+[\w<>\[\],.? ]+\s+{_NAME}\s*\("
_C = {"struct": rf"^\s*(?:typedef\s+)?struct\s+{_NAME}", "enum": rf"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?{_NAME}", "function": rf"^(?!\s*(?:return|else|if|for|while|switch)\b)[A-Za-z_][\w\s*&:<>,]*?[\s*&]{_NAME}\s*\([^;]*\)\s*\{{?\s*$"}
PATTERNS = {
    "ts": _JS, "tsx": _JS, "js": _JS, "jsx": _JS,
    "go": {"function": rf"^func\s+(?:\([^)]*\)\s*)?{_NAME}", "type": rf"^type\s+{_NAME}"},
    "rs": {"function": rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+{_NAME}", "struct": rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_NAME}", "enum": rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}", "trait": rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_NAME}"},
    "java": _TYPES | {"function": _METHOD}, "cs": _TYPES | {"struct": rf"{_MODIFIED}struct\s+{_NAME}", "function": _METHOD},
    "kt": _TYPES | {"function": rf"{_MODIFIED}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?{_NAME}"},
    "swift": _TYPES | {"struct": rf"{_MODIFIED}struct\s+{_NAME}", "protocol": rf"{_MODIFIED}protocol\s+{_NAME}", "function": rf"{_MODIFIED}func\s+{_NAME}"},
    "rb": {"class": rf"^\s*class\s+{_NAME}", "module": rf"^\s*module\s+{_NAME}", "function": r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)"},
    "php": _TYPES | {"function": rf"{_MODIFIED}function\s+&?{_NAME}", "trait": rf"^\s*trait\s+{_NAME}"},
    "c": _C, "h": _C, "cpp": _C | {"class": rf"^\s*class\s+{_NAME}"}, "hpp": _C | {"class": rf"^\s*class\s+{_NAME}"},
}
#: How lines say what they import, by suffix.
_JS_IMPORT = r"""(?:^\s*(?:import|export)\b[^'"]*?from\s*|^\s*import\s*|\brequire\(\s*|\bimport\(\s*)['"]([^'"]+)['"]"""
SCRIPTS = ("ts", "tsx", "js", "jsx")
COMMENT = r"^\s*(?://+|#+|\*+|/\*+)\s?"


def defined(files: DataFrame) -> DataFrame:
    """(path, symbol, kind, line, doc) of (path, text) in the languages of PATTERNS: lines that define
    something, and the comment lines right above. Other files give none; Python is read by :func:`symbols`."""
    suffix = F.lower(F.substring_index("path", ".", -1))
    lines = files.select("path", suffix.alias("suffix"), F.split("text", "\n").alias("lines")).where(F.col("suffix").isin(*PATTERNS))
    each = lines.select("path", "suffix", "lines", F.posexplode("lines").alias("at", "text"))

    def first(patterns: dict[str, str]):
        options = []
        for kind, pattern in patterns.items():
            groups = pattern.count(_NAME) or 1
            name = F.coalesce(*(F.nullif(F.regexp_extract("text", pattern, g), F.lit("")) for g in range(1, groups + 1)))
            options.append(F.when(name.isNotNull(), F.struct(name.alias("symbol"), F.lit(kind).alias("kind"))))
        return F.coalesce(*options)

    hit = F.coalesce(*(F.when(F.col("suffix") == s, first(p)) for s, p in PATTERNS.items()))
    found = each.withColumn("hit", hit).where("hit is not null")
    # Comment lines that end right above: those after the last line that is no comment.
    above = F.reverse(F.slice("lines", F.greatest(F.col("at") - 19, F.lit(1)), F.least("at", F.lit(20))))
    stop = F.array_position(F.transform(above, lambda x: x.rlike(COMMENT)), False)
    doc = F.reverse(F.when(stop > 0, F.slice(above, F.lit(1), (stop - 1).cast("int"))).otherwise(above))
    clean = F.trim(F.array_join(F.filter(F.transform(doc, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, COMMENT, ""), r"\*/\s*$", ""))), lambda x: x != ""), " "))
    return found.select("path", "hit.symbol", "hit.kind", (F.col("at") + 1).alias("line"), F.when(F.col("at") > 0, F.nullif(clean, F.lit(""))).alias("doc"))


def script_imports(files: DataFrame) -> DataFrame:
    """(path, spec) of what TypeScript and JavaScript files (path, text) import or require."""
    own = files.where(F.lower(F.substring_index("path", ".", -1)).isin(*SCRIPTS))
    return own.select("path", F.explode(F.regexp_extract_all("text", F.lit("(?m)" + _JS_IMPORT), F.lit(1))).alias("spec")).distinct()


def resolved_scripts(specs: DataFrame, known: DataFrame) -> DataFrame:
    """(path, target): relative imports (path, spec) resolved to known files (path): as named, then with a
    suffix, then the folder's index; the first that is there. Packages are left out."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    joined = F.split(F.concat(folder, "spec"), "/")
    start = F.expr("cast(array() as array<string>)")
    walked = F.aggregate(joined, start, lambda acc, x: F.when((x == ".") | (x == ""), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    base = F.array_join(walked, "/")
    stripped = F.regexp_replace(base, r"\.jsx?$", "")
    options = [base, *(F.concat(base, F.lit("." + s)) for s in SCRIPTS), *(F.concat(base, F.lit("/index." + s)) for s in SCRIPTS), *(F.concat(stripped, F.lit("." + s)) for s in SCRIPTS)]
    candidates = specs.where(F.col("spec").startswith(".")).select("path", "spec", F.posexplode(F.array(*options)).alias("at", "target"))
    hits = candidates.join(known.select(F.col("path").alias("target")), "target").where("path <> target")
    return hits.groupBy("path", "spec").agg(F.min_by("target", "at").alias("target")).select("path", "target").distinct()
