"""Rules, history, knowledge files, symbols and notes, on literal cases."""

from pyspark.sql import functions as F

from skeinbase.functions import notes
from skeinbase.operators import freshness, maintenance, serving
from skeinbase.sources import history, knowledge, rules, tree

A, B, C = "a" * 40, "b" * 40, "c" * 40


def test_settings_are_layered_and_the_core_holds(tmp_path):
    user, project = tmp_path / "user.md", tmp_path / "project.md"
    user.write_text("---\nsilence_floor: 4\nstay_silent_on: [docs]\nfacet_weights:\n  ui: 1.2\n  security: 0.1\n---\ntext")
    project.write_text('---\nsilence_floor: 0\nallowed_tags: [feature, "a, b"]\nquery_stopwords: [Foo]\n  odd: 1\ncore:\n  silence_floor_min: 3\n---\n')
    found = rules.load(user, project, tmp_path / "none.md")
    assert found.silence_floor == 3 and found.stay_silent_on == {"chore", "docs"} and found.query_stopwords == {"foo"}
    assert found.facet_weights["ui"] == 1.2 and found.facet_weights["security"] == 2.0
    assert found.allowed_tags == {"feature", "a, b", "security"}
    project.write_text("---\ndedup_threshold: 7\n---\n")
    assert rules.load(project) == rules.load()
    assert rules.settings("---\nnever: closed\n") == {} and rules.value("[1, 'x']") == ["1", "x"] and rules.value("TRUE") is True
    (tmp_path / "b.toml").write_text("[build]\nname = 'x'\n")
    assert rules.build_settings(tmp_path / "b.toml") == {"build": {"name": "x"}} and rules.build_settings(tmp_path / "c.toml") == {}


LOG = "\x00".join([C, "ann", "300", "feat(app): third", "why\n\nNote-anchors: One, two\nNote-tags: Sec\nNote-edge: relates_to -> Thing", "\nsrc/a.py", "src\\b.py", "", B, "bob", "200", "fix: second", "", "\nsrc/a.py", "doc.md", "", A, "ann", "100", "first", "", "\nsrc/a.py", "src/c.py", ""])


def logs(spark):
    return spark.createDataFrame([("r", LOG), ("none", "")], "repo string, log string")


def test_commits_of_a_log(spark):
    found = history.commits(logs(spark))
    rows = {r.sha: r for r in found.collect()}
    assert [(rows[s].at, rows[s].author, rows[s].ts, rows[s].files) for s in (C, B, A)] == [(0, "ann", 300, ["src/a.py", "src/b.py"]), (1, "bob", 200, ["src/a.py", "doc.md"]), (2, "ann", 100, ["src/a.py", "src/c.py"])]
    since = spark.createDataFrame([("r", B)], "repo string, sha string")
    assert [r.sha for r in history.newer_than(found, since).collect()] == [C]
    files = {r.file: r for r in history.file_history(found).collect()}
    assert (files["src/a.py"].created_by, files["src/a.py"].changed_by, files["src/a.py"].commits) == ("ann", "ann", 3)
    assert sorted((r.sha[0], r.file) for r in history.co_changed(found).collect()) == [("a", "src/a.py"), ("a", "src/c.py"), ("b", "src/a.py"), ("c", "src/a.py"), ("c", "src/b.py")]
    nodes = {r.sha: r for r in history.commit_nodes(found).collect()}
    assert nodes[C].kind == "lesson" and nodes[C].anchors == ["one", "two"] and nodes[C].facets == ["security"] and [tuple(e) for e in nodes[C].edges] == [("relates_to", "Thing")]
    assert nodes[B].kind == "commit" and nodes[B].facets == ["bugfix"] and nodes[B].file == "src/a.py"
    shot = history.snapshot(found).first()
    assert (shot.head, shot.commits) == (C, 3)


def test_dirty_files_and_blame(spark):
    lines = spark.createDataFrame([(" M src/a.py",), ("R  old.py -> new.py",), ('?? "odd name"',)], "line string")
    assert sorted(r.file for r in history.dirty_files(lines).collect()) == ["new.py", "odd name", "src/a.py"]
    steps = spark.createDataFrame([("t.md", "Write the **tests**"), ("t.md", "Other")], "path string, text string")
    blame = spark.createDataFrame([("t.md", "- [x] Write the **tests**", "ann", 5), ("t.md", "- [ ] write the tests", "bob", 3)], "path string, line string, author string, ts long")
    assert {r.text: r.author for r in history.blamed(steps, blame).collect()} == {"Write the **tests**": "ann", "Other": None}


PROSE = "Some prose about engines, storage layers and the reasons behind careful migrations of data between them. " * 2


def test_sections_of_knowledge_files(spark):
    text = f"# Title\nintro\n## Full part\n{PROSE}\n### Child part\n{PROSE}\n## [1.1.0]\n### Added\n- engine switches and storage layers that were asked for\n### Fixed\n- careful migrations of data between storage layers\n### Long\n{PROSE}\n## Empty\n### Tiny\nx"
    rows = spark.createDataFrame([("docs/decisions/a.md", text), ("CHANGELOG.md", f"# Only\n{PROSE}"), ("none.md", "")], "path string, text string")
    found = knowledge.sections(rows).orderBy("path", "at").collect()
    assert [(r.path, r.title, r.facets) for r in found] == [
        ("CHANGELOG.md", "Only", []), ("docs/decisions/a.md", "Full part", ["foundation"]), ("docs/decisions/a.md", "Child part", ["foundation"]),
        ("docs/decisions/a.md", "[1.1.0]", ["foundation"]), ("docs/decisions/a.md", "[1.1.0] — Long", ["foundation"]),
    ]
    assert "### Fixed" in found[3].body and "### Long" not in found[3].body


def test_tasks_and_their_steps(spark):
    files = spark.createDataFrame([
        ("a.md", "---\ntitle: Ship it\nstatus: open\nkind: plan\naffects: [src\\a.py, b.py]\ntags: [x]\n---\n- [x] one\n- [-] two\n  goes on\n- [>] three\n"),
        ("b.md", "---\ntitle: ''\nstatus: odd\n---\n# Heading\n- [ ] one\n"), ("c.md", ""),
    ], "path string, text string")
    found = knowledge.tasks(files)
    rows = {r.path: r for r in found.collect()}
    assert set(rows) == {"a.md", "b.md"} and rows["b.md"].title == "Heading" and rows["b.md"].status == "open" and rows["b.md"].kind == "task"
    assert rows["a.md"].affects == ["src/a.py", "b.py"] and rows["a.md"].tags == ["x", "plan"]
    assert [(r.path, r.total, r.done, r.moved, r.dropped) for r in knowledge.steps(found).orderBy("path").collect()] == [("a.md", 3, 1, 1, 1), ("b.md", 1, 0, 0, 0)]
    assert [(r.path, r.steps) for r in knowledge.flip_candidates(found).collect()] == [("a.md", 3)]


def test_symbols_of_many_languages(spark):
    files = {
        "a.ts": "// Does things.\n// Well.\nexport class Thing {}\nexport const run = async (x) => 1\ninterface Odd {}\nfunction plain() {}",
        "b.go": "package x\nfunc (s *S) Name() {}\ntype S struct {}", "c.rs": "pub async fn go() {}\nstruct P;\ntrait T {}", "d.java": "public class Big {\n  public static void main(String[] a) {\n}}",
        "e.rb": "module M\n  def self.ok?\n", "f.php": "class P { \n public function f() {}", "g.c": "int add(int a, int b) {\n  return a;\n}", "h.kt": "data class K(val x: Int)\nfun go() = 1", "i.swift": "struct V {}\nfunc f() {}", "j.cs": "public sealed class D {}", "k.txt": "class No",
    }
    found = {}
    for r in tree.defined(spark.createDataFrame(list(files.items()), "path string, text string")).collect():
        found.setdefault(r.path, []).append((r.line, r.symbol, r.kind, r.doc))
    assert sorted(found["a.ts"]) == [(3, "Thing", "class", "Does things. Well."), (4, "run", "function", None), (5, "Odd", "interface", None), (6, "plain", "function", None)]
    names = {p: sorted(x[1] for x in v) for p, v in found.items()}
    assert names == {"a.ts": ["Odd", "Thing", "plain", "run"], "b.go": ["Name", "S"], "c.rs": ["P", "T", "go"], "d.java": ["Big", "main"], "e.rb": ["M", "ok?"], "f.php": ["P", "f"], "g.c": ["add"], "h.kt": ["K", "go"], "i.swift": ["V", "f"], "j.cs": ["D"]}


def test_script_imports(spark):
    files = spark.createDataFrame([("src/a.ts", "import x from './b'\nimport './c.js'\nexport { y } from \"../lib\"\nconst z = require('pkg')"), ("src/b.ts", ""), ("src/c.ts", ""), ("lib/index.tsx", "")], "path string, text string")
    assert sorted(r.target for r in tree.resolved_scripts(tree.script_imports(files), files).collect()) == ["lib/index.tsx", "src/b.ts", "src/c.ts"]


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first().x


def test_small_functions(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.expr("cast(array() as array<string>)")
    assert one(spark, notes.phrase(arr("a", "b", "c"), arr("b", "c"))) and not one(spark, notes.phrase(arr("a", "b"), arr("b", "a"))) and not one(spark, notes.phrase(arr("a"), arr()))
    assert one(spark, notes.path_mentions(F.lit("see src/a.py and src\\b.ts, not c.exe"))) == ["src/a.py", "src/b.ts"]
    assert one(spark, notes.suggested_check(F.lit("x/a.py"), arr("X = 1", "MAX_SIZE = 3", "  async def handle_it(x):"))) == "contains:handle_it"
    assert one(spark, notes.suggested_check(F.lit("a.md"), arr("def handle():"))) is None
    assert one(spark, notes.commit_facets(F.lit("words"), arr("a/.gitignore", "poetry.lock"))) == ["chore"] and one(spark, notes.commit_facets(F.lit("words"), arr("a.py"))) == []
    assert one(spark, notes.knowledge_facets(F.lit("docs/Decisions/x.md"))) == ["foundation"]
    reply = 'Sure:\n```json\n{"edges": [{"target": "a", "kind": " Implements "}, {"target": "no", "kind": "x"}, {"target": "a", "kind": "guarded_by"}]}\n```'
    assert one(spark, notes.edge_labels(F.lit(reply), arr("a", "b"))) == {"a": "guarded_by"} and one(spark, notes.edge_labels(F.lit("no json"), arr("a"))) == {}
    assert one(spark, notes.context_facet(F.lit("src/Auth.py"), {"ui": "frontend", "auth": "security"})) == "security" and one(spark, notes.context_facet(F.lit("x"), {"ui": "frontend"})) is None
    assert one(spark, notes.is_noise(F.lit("./dist/x.js"))) and not one(spark, notes.is_noise(F.lit("src/dist.js")))


def test_name_status_listing(spark):
    tokens = ["M", "a.py", "R100", "old.py", "new\\x.py", "D", "gone.py", "C75", "from.py", "to.py", "A", "b.py", ""]
    diff = spark.createDataFrame(list(enumerate(tokens)), "at int, token string")
    assert sorted((r.file, r.deleted) for r in maintenance.diff_files(diff).collect()) == [("a.py", False), ("b.py", False), ("gone.py", True), ("new/x.py", False), ("old.py", True), ("to.py", False)]


def test_runs_versions_and_logs(spark):
    meta = spark.createDataFrame([("run:1", '{"status": "undone", "scope": "a"}'), ("run:12", '{"status": "done"}'), ("rules_version", "3")], "key string, value string")
    assert [(r.run, r.status, r.scope, r.newest) for r in maintenance.rank_runs(meta).orderBy("newest").collect()] == [(12, "done", None, 1), (1, "undone", "a", 2)]
    assert maintenance.needs_rebuild(meta, 4).first().rebuild and not maintenance.needs_rebuild(meta, 3).first().rebuild
    log = spark.createDataFrame([(1, "brief", None), (2, "search", 9)], "id int, kind string, chars long")
    more = maintenance.logged(log, spark.createDataFrame([(3, "stamp")], "id int, kind string"))
    assert sorted((r.id, r.chars) for r in maintenance.sized(more, spark.createDataFrame([(1, 50), (2, 60)], "id int, chars long")).collect() if r.chars) == [(1, 50), (2, 9)]


def test_new_nodes_have_the_same_ids_again(spark):
    nodes = spark.createDataFrame([(1, "code-symbol", "known", "a.py", 1, "bootstrap"), (2, "lesson", "note", "b.md", None, "live")], "id long, kind string, title string, file string, line int, origin string")
    edges = spark.createDataFrame([], "src long, dst long, kind string")
    wanted = spark.createDataFrame([(2, "relates_to", "known"), (2, "relates_to", " other "), (2, "relates_to", " ")], "src long, kind string, target string")
    first, made = maintenance.edges_to_targets(nodes, wanted)
    again, _ = maintenance.edges_to_targets(nodes, wanted)
    assert sorted(first.collect()) == sorted(again.collect()) and [r.title for r in made.collect()] == ["other"]
    links, new = maintenance.task_links(nodes, edges, spark.createDataFrame([(9, "a.py"), (9, "b.md"), (9, "c.json")], "task long, file string"))
    assert sorted(r.dst for r in links.collect() if r.dst > 0) == [1, 2] and [r.file for r in new.collect()] == ["c.json"]


def test_ranks_over_many_ranges(spark):
    rows = [(i, (i * 37) % 100) for i in range(500)]
    found = {r.sha: r.rank for r in freshness.commit_rank(spark.createDataFrame(rows, "sha int, ts int").repartition(7)).collect()}
    assert [s for s, _ in sorted(found.items(), key=lambda x: x[1])] == [s for s, _ in sorted(rows, key=lambda r: (-r[1], -r[0]))] and sorted(found.values()) == list(range(500))
    assert freshness.commit_rank(spark.createDataFrame([], "sha int, ts int")).collect() == []


def test_dead_and_untested_files(spark):
    nodes = [(i, "code-symbol", f, 1.0) for i, f in enumerate(["src/a.py", "src\\b.py", "src/c.py", "tests/test_a.py", "src/x/__init__.py", "readme.md", "src/gone.py"])] + [(50, "lesson", None, 1.0)]
    nodes = spark.createDataFrame(nodes, "id long, kind string, file string, importance double")
    known = nodes.where("file is not null and file not like '%gone%'").select(F.translate("file", "\\", "/").alias("file"))
    edges = spark.createDataFrame([(3, 0, "depends_on", True), (50, 1, "guarded_by", True), (0, 2, "co_changed", True)], "src long, dst long, kind string, verified boolean")
    assert [r.file for r in serving.dead(nodes, edges, known).collect()] == ["src/c.py"]
    assert sorted(r.file for r in serving.untested(nodes, edges, known).collect()) == ["src/b.py", "src/c.py"]
