"""Imports resolved to files, JSON in noisy replies, headlines and frontmatter, against plain Python."""

import json
import posixpath
import random

import pytest
from pyspark.sql import functions as F

from skeinbase.functions import notes, text
from skeinbase.sources import links, tree


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def resolve(spark, spec, path, *files):
    rows = links.resolved(table(spark, [(path, spec)], "path string, spec string"), table(spark, [(f,) for f in files], "path string")).collect()
    assert len(rows) <= 1
    return rows[0].target if rows else None


CASES = [
    ("./util", "src/a.ts", ["src/a.ts", "src/util.ts"], "src/util.ts"),
    ("../lib/helper", "src/feat/a.ts", ["src/feat/a.ts", "src/lib/helper.ts"], "src/lib/helper.ts"),
    ("@/components/Thing", "src/a.ts", ["src/components/Thing.tsx", "src/a.ts"], "src/components/Thing.tsx"),
    ("@/lib/api", "web/src/page.tsx", ["web/src/lib/api.ts", "web/src/page.tsx"], "web/src/lib/api.ts"),
    ("@/components/Table", "admin/src/page.tsx", ["admin/src/components/Table.tsx", "src/components/Table.tsx"], "admin/src/components/Table.tsx"),
    ("@/only", "admin/src/page.tsx", ["web/src/only.ts", "admin/src/page.tsx"], None),
    ("./lib", "src/a.ts", ["src/a.ts", "src/lib/index.ts"], "src/lib/index.ts"),
    ("react", "src/a.ts", ["src/a.ts", "react.ts"], None),
    ("@scope/pkg", "src/a.ts", ["src/a.ts", "scope/pkg.ts"], None),
    ("./does-not-exist", "src/a.ts", ["src/a.ts"], None),
    ("pkg.sub.mod", "pkg/a.py", ["pkg/a.py", "pkg/sub/mod.py"], "pkg/sub/mod.py"),
    ("pkg.c", "x.py", ["pkg/c.py"], "pkg/c.py"),
    ("pkg.sub", "x.py", ["src/pkg/sub/__init__.py"], "src/pkg/sub/__init__.py"),
    (".util", "pkg/a.py", ["pkg/util.py", "util.py"], "pkg/util.py"),
    ("..b", "pkg/sub/a.py", ["pkg/b.py", "b.py", "pkg/sub/b.py"], "pkg/b.py"),
    ("..pkg.mod", "pkg/sub/a.py", ["pkg/pkg/mod.py"], "pkg/pkg/mod.py"),
    (".", "pkg/a.py", ["pkg/__init__.py"], "pkg/__init__.py"),
    ("./x.css", "a.ts", ["x.css"], "x.css"),
    ("theme.css", "a.ts", ["theme/css.ts"], None),
    ("../../x", "a/b.ts", ["x.ts"], None),
    ("../x", "b.ts", ["x.ts"], None),
    ("./a/../b/./c", "s/t.ts", ["s/b/c.js", "s/b/c.py"], "s/b/c.js"),
    (" ./b ", "a.ts", ["b.ts"], "b.ts"),
    ("", "a.ts", ["a.ts"], None),
    ("./b.ts", "a.ts", ["b.ts", "b.ts.js"], "b.ts"),
]


def test_cases(spark):
    for spec, path, files, want in CASES[::6]:
        assert resolve(spark, spec, path, *files) == want, spec
    # All of them at once: each in a tree of its own.
    specs, known, expected = [], [], {}
    for i, (spec, path, files, want) in enumerate(CASES):
        if spec.startswith((".", "@/")):
            specs.append((f"t{i}/r/{path}", spec))
            known += [(f"t{i}/r/{f}",) for f in files]
            if want:
                expected[f"t{i}/r/{path}"] = f"t{i}/r/{want}"
    got = {r.path: r.target for r in links.resolved(table(spark, specs, "path string, spec string"), table(spark, known, "path string")).collect()}
    inside = {k: v for k, v in got.items() if not (k.endswith("a/b.ts") or k.endswith("/b.ts"))}  # what led out of the tree may not in a deeper one
    assert inside == {k: v for k, v in expected.items() if k in inside or not (k.endswith("a/b.ts") or k.endswith("/b.ts"))}


def brute(spec, path, files):
    """By trying each way of ending each candidate."""
    spec = spec.strip()
    base = posixpath.dirname(path)
    if not spec:
        return None
    if spec.startswith(".") and "/" in spec:
        options = [posixpath.normpath(posixpath.join(base, spec))]
    elif spec.startswith("."):
        tail = spec.lstrip(".")
        options = [posixpath.normpath(posixpath.join(base, *[".."] * (len(spec) - len(tail) - 1), tail.replace(".", "/")))]
    elif spec.startswith("@/"):
        above = [base]
        while above[-1]:
            above.append(posixpath.dirname(above[-1]))
        options = [posixpath.normpath(posixpath.join(r, *m, spec[2:])) for r in above for m in (("src",), ())]
    elif "/" not in spec and "." in spec and not spec.lower().endswith(links.ASSETS):
        options = [spec.replace(".", "/"), "src/" + spec.replace(".", "/")]
    else:
        return None
    for o in options:
        for end in ("", *links.SUFFIXES, *(f"/{b}{s}" for b in links.FOLDER_FILES for s in links.SUFFIXES)):
            if o + end in files:
                return o + end
    return None


def test_equals_trying_everything(spark):
    rng = random.Random(5)
    folder = lambda: "/".join(rng.choice(["a", "b", "src", "pkg"]) for _ in range(rng.randint(0, 3)))
    name = lambda: rng.choice(["x", "y", "index", "__init__", "mod"]) + rng.choice([".ts", ".py", ".js", ".css", ".tsx", ".go"])
    files = sorted({posixpath.join(folder(), name()) for _ in range(120)})
    stem = lambda: rng.choice(["x", "y", "a", "b", "pkg", "a/x", "b/y", "pkg/a/x", "src/x", "x.ts", "y.css"])
    spec = lambda: rng.choice([lambda: "./" + stem(), lambda: "../" * rng.randint(1, 3) + stem(), lambda: "@/" + stem(), lambda: "." * rng.randint(1, 3) + rng.choice(["x", "a.x", "", "pkg"]), lambda: rng.choice(["a.x", "pkg.a.y", "b.css", "react", "src.x", "@s/x", "a/x"])])()
    asked = sorted({(rng.choice(files), spec()) for _ in range(600)})
    got = {(r.path, r.spec): r.target for r in links.resolved(table(spark, asked, "path string, spec string"), table(spark, [(f,) for f in files], "path string")).collect()}
    want = {(p, s): t for p, s in asked if (t := brute(s, p, set(files)))}
    assert got == want and len(want) > 60


def test_edges_are_distinct_and_not_to_itself(spark):
    specs = table(spark, [("src/a.ts", "./b"), ("src/a.ts", "./b"), ("src/a.ts", "./a"), ("src/a.ts", "react"), (None, "./b"), ("src/a.ts", None)], "path string, spec string")
    files = table(spark, [("src/a.ts",), ("src/b.ts",), (None,)], "path string")
    assert list(map(tuple, links.file_links(specs, files).collect())) == [("src/a.ts", "src/b.ts")]


def test_python_imports_of_the_package_itself(spark):
    files = table(spark, [("p/a.py", "from . import b as c, d\nfrom ..x import y\nimport q.r as s\nfrom . import *\n")], "path string, text string")
    assert sorted(r.spec for r in tree.imports(files).collect()) == [".", "..x", ".b", ".d", "q.r"]


REPLIES = [
    ('{"a": 1}', '{"a": 1}'), ('  [1, 2]\n', "[1, 2]"), ('Sure: {"a": 1} and note {x}', '{"a": 1}'), ('note {x} first, then {"a": {"b": 2}} end', '{"a": {"b": 2}}'),
    ('```json\n{"k": "v"}\n```\nthanks {"z": 1}', '{"k": "v"}'), ('text\n```\n[{"a": 1}]\n``` more', '[{"a": 1}]'), ('```json\nnot json\n``` but {"ok": true}', '{"ok": true}'), ('```\n{"open": 1}', '{"open": 1}'),
    ('say {"a": "use the {x} pattern"} ok', '{"a": "use the {x} pattern"}'), (r'x {"a": "quote \" and } brace"} y', r'{"a": "quote \" and } brace"}'), (r'{"p": "c:\\"} }', r'{"p": "c:\\"}'),
    ('two {"a": 1} {"b": 2}', '{"a": 1}'), ("nothing here", None), ("{never closed", None), ("", None), (None, None), ("it's {x and {\"a\": 1}", '{"a": 1}'), ('"quoted" {"a": []}', '{"a": []}'), ("[1, {\"a\": 2}", '{"a": 2}'), ('{"a": 1,} {"b": 1}', '{"b": 1}'),
]


def test_json_in_replies(spark):
    df = table(spark, [(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string")
    got = dict(df.select("i", notes.json_part(F.col("reply"))).collect())
    for i, (reply, want) in enumerate(REPLIES):
        assert got[i] == want, reply


def first_json(reply):
    """All spans of brackets by start, the longest first: the first that the parser of the language takes."""
    for a, c in enumerate(reply):
        if c in "{[":
            for b in (b for b in range(len(reply), a, -1) if reply[b - 1] in "}]"):
                try:
                    json.loads(reply[a:b])
                    return reply[a:b]
                except ValueError:
                    pass
    return None


def test_json_in_random_replies(spark):
    rng = random.Random(2)
    value = lambda d: rng.choice([lambda: rng.randint(0, 9), lambda: rng.choice(["{", "}", "a\"b", "[x]", "\\", "é{"]), lambda: [] if d > 2 else [value(d + 1) for _ in range(rng.randint(0, 2))], lambda: {} if d > 2 else {rng.choice("abc{"): value(d + 1) for _ in range(rng.randint(0, 2))}])()
    prose = lambda: rng.choice(["", "Sure: ", "it is so, ", "(see) ", "\n\n", "é "])
    replies = [prose() + json.dumps({"k": value(0)}, ensure_ascii=rng.random() < 0.5) + prose() + rng.choice(["", json.dumps([value(0)])]) for _ in range(80)]
    df = table(spark, list(enumerate(replies)), "i int, reply string")
    got = dict(df.select("i", notes.json_part(F.col("reply"))).collect())
    assert all(got[i] == first_json(r) for i, r in enumerate(replies))


LONG = "A point that goes on for quite a while without any end to it, so that it has well over one hundred and twenty characters in all"


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Short. Two.", ("Short. Two.", "")), (f"  {LONG}. And then more.", (f"{LONG}.", "And then more.")), (LONG, (LONG, "")), (f"Stub. {LONG}.   Rest here.", (f"Stub. {LONG}.", "Rest here.")),
        (f"Fixed: e.g. a thing!\n{LONG}. More.", ("Fixed: e.g. a thing!", f"{LONG}. More.")), (f"{LONG} {LONG}. End of it.", (f"{LONG} {LONG}. End of it.", "")), (None, ("", "")), ("", ("", "")), (f"{'x' * 130}?", (f"{'x' * 130}?", "")),
        ("One two three fourx. " + "y" * 120, ("One two three fourx.", "y" * 120)),
    ],
)
def test_headlines(spark, title, want):
    df = table(spark, [(title,)], "t string").select(text.split_headline(F.col("t")).alias("h"), text.headline(F.col("t")).alias("only"))
    row = df.first()
    assert tuple(row.h) == want and row.only == want[0]


def test_a_key_that_stands_twice_in_frontmatter(spark):
    files = table(spark, [("a.md", "---\ntitle: one\nkind: x\ntitle: two: three\n---\nbody"), ("b.md", None), ("c.md", "no block")], "path string, text string")
    got = {r.path: (r.meta, r.body) for r in tree.frontmatter(files).collect()}
    assert got["a.md"] == ({"title": "two: three", "kind": "x"}, "body") and got["c.md"] == ({}, "no block")
