"""Archives and folders as inventories, Markdown references, links, new findings and redaction on small trees."""

import hashlib
import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from treelift.jobs import catalog
from treelift.operators import boundaries as B
from treelift.operators import decisions as D
from treelift.operators import links as L
from treelift.operators import references as R
from treelift.operators.markdown import markdown_rows
from treelift.sources.archives import admitted, folder_inventory, members, pack_documents, refused_sources, untar
from treelift.sources.trees import read_trees, write_trees

SCHEMA = "source_id string, path string, kind string, size long, executable boolean, symlink_target string, sha256 string, content string"


def tree(spark, files=(), links=()):
    rows = [("s", p, "file", len(c or ""), False, None, hashlib.sha256((c or "").encode()).hexdigest(), c) for p, c in dict(files).items()]
    rows += [("s", p, "symlink", len(t), False, t, None, None) for p, t in dict(links).items()]
    return spark.createDataFrame(rows, SCHEMA)


def tar(*entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as archive:
        for name, data, fields in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            for k, v in fields.items():
                setattr(info, k, v)
            archive.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archive_members(spark):
    link = {"type": tarfile.SYMTYPE, "linkname": "a.txt"}
    data = tar(
        ("./a.txt", "é".encode(), {"mode": 0o755}),
        ("bin", b"\xff\xfe", {}),
        ("nul", b"a\0b", {}),
        ("x/.git/config", b"", {}),
        ("l", b"", link),
        ("l/inside", b"x", {}),
        ("/etc/passwd", b"x", {}),
        ("a/../../up", b"x", {}),
        ("A.TXT", b"x", {}),
        ("pipe", b"", {"type": tarfile.FIFOTYPE}),
        ("big", b"x" * 50, {}),
        ("/".join("d" * 9), b"x", {}),
    )
    rows = {r[0]: r for r in members(data, max_file=40, max_depth=8)}
    assert rows["a.txt"][1:] == ("file", 2, True, None, hashlib.sha256("é".encode()).hexdigest(), "é", None)
    assert rows["bin"][6] is None and rows["nul"][6] is None and rows["l"][4] == "a.txt"
    problems = {p: r[7] for p, r in rows.items() if r[7]}
    assert problems == {
        "l/inside": "below_symlink", "/etc/passwd": "unsafe_path", "a/../../up": "unsafe_path", "A.TXT": "path_collision",
        "pipe": "unsupported_member", "big": "too_large", "/".join("d" * 9): "too_deep",
    }
    assert not any(".git" in p for p in rows)
    sources = spark.createDataFrame([("t", data), ("broken", b"no archive"), ("none", None)], "source_id string, archive binary")
    found = untar(sources).groupBy("source_id").count().collect()
    assert {r.source_id: r["count"] for r in found} == {"t": 19, "broken": 1}  # with the folders above the deepest member


LINK = {"type": tarfile.SYMTYPE, "linkname": "a"}


@pytest.mark.parametrize(
    "entries,problems",
    [
        ([("a/b", b"x", {}), ("a", b"", LINK)], {"a": "path_collision"}),
        ([("c/f", b"x", {}), ("c", b"y", {})], {"c": "path_collision"}),
        ([("D/x", b"x", {}), ("d/y", b"y", {})], {"d/y": "path_collision"}),
        ([("f", b"x", {}), ("f/g", b"y", {})], {"f/g": "parent_collision"}),
        ([("a", b"", LINK), ("a/b", b"y", {})], {"a/b": "below_symlink"}),
        ([("e", b"x", {}), ("e", b"y", {})], {"e": "path_collision"}),
        ([("g", b"", {"type": tarfile.DIRTYPE}), ("g/h", b"y", {}), ("g", b"", {"type": tarfile.DIRTYPE})], {}),
    ],
)
def test_archive_parents(entries, problems):
    assert {r[0]: r[7] for r in members(tar(*entries)) if r[7]} == problems


def test_archive_limits():
    many = tar(*((f"f{k}", b"x" * 10, {}) for k in range(9)))
    told = lambda **limits: [(r[0], r[7]) for r in members(many, **limits)][-1]
    assert told() == ("f8", None)
    assert told(max_entries=5) == ("", "too_many_entries") and told(max_total=45) == ("f4", "too_many_bytes") and told(max_archive=9) == ("", "archive_too_large")
    assert [r[7] for r in members(tar(("a/b/c/d", b"", {})), max_entries=3)][-1] == "too_many_entries"
    assert [r[7] for r in members(b"\x1f\x8b broken")] == ["not_an_archive"]


def test_refused_sources(spark):
    archives = [("ok", tar(("a", b"x", {}))), ("link", tar(("a/b", b"x", {}), ("a", b"", LINK))), ("up", tar(("../a", b"x", {}), ("b", b"", {"type": tarfile.FIFOTYPE}))), ("many", tar(*((f"f{k}", b"x", {}) for k in range(4))))]
    inventory = untar(spark.createDataFrame(archives, "source_id string, archive binary"))
    refused = refused_sources(inventory, max_entries=3)
    assert {r.source_id: (r.code, r.path) for r in refused.collect()} == {"link": ("PATH_COLLISION", "a"), "up": ("PATH_TRAVERSAL", "../a"), "many": ("SCAN_LIMIT_EXCEEDED", None)}
    assert [(r.source_id, r.path) for r in admitted(inventory, refused).collect()] == [("ok", "a")]


def test_tree_source(spark, tmp_path):
    root = tmp_path / "trees"
    for name, data in {"s/a/SKILL.md": b"x\n", "s/a/b/c.bin": b"\0", "s/a/bad": b"\xff", "s/.git/config": b"x", "s/a/.svn/x": b"", "s/empty": b"", "s/big": b"y" * 99, "t/é/f": b"z", "t/lib/src/t/k.py": b"1", "t/k.py": b"2"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    os.chmod(root / "s/empty", 0o755)
    os.symlink("../../t", root / "s/a/out")
    os.symlink("gone", root / "s/gone")
    os.link(root / "t/k.py", root / "t/again")
    os.mkfifo(root / "t/pipe")
    os.makedirs(root / "t/" / "/".join("d" * 6))
    os.mkdir(os.fsencode(root) + b"/t/\xff")
    for partitions in (1, 3, 50):
        rows = {(r.source_id, r.path): r for r in read_trees(spark, str(root), max_file=50, max_depth=5, partitions=partitions).collect()}
        s = {p: r for (k, p), r in rows.items() if k == "s"}
        assert set(s) == {"a", "a/b", "a/SKILL.md", "a/b/c.bin", "a/bad", "empty", "big", "a/out", "gone"}
        assert (s["empty"].size, s["empty"].executable, s["empty"].content) == (0, True, "") and not s["a/SKILL.md"].executable
        assert (s["a/out"].kind, s["a/out"].symlink_target, s["a/out"].size, s["a/out"].sha256) == ("symlink", "../../t", 7, None)
        assert s["big"].problem == "too_large" and s["big"].content is None and s["a/bad"].content is s["a/b/c.bin"].content is None
        assert s["a/bad"].sha256 == hashlib.sha256(b"\xff").hexdigest() and s["a"].kind == s["a/b"].kind == "directory"
        problems = {p: r.problem for (k, p), r in rows.items() if k == "t" and r.problem}
        assert problems == {"again": "hard_link", "k.py": "hard_link", "pipe": "unsupported_member", "d/d/d/d/d/d": "too_deep", "?": "unsafe_path"}
        assert rows["t", "lib/src/t/k.py"].content == "1"
    one = read_trees(spark, f"file://{root}/t", source_id="x", max_entries=3, partitions=1)
    assert {(r.source_id, r.path, r.problem) for r in one.collect()} == {("x", ".", "too_many_entries")}


def test_trees_are_written_whole(spark, tmp_path):
    rows = tree(spark, {"a/b": "é", "c": ""}, {"d": "a/b"}).selectExpr("*")
    target = tmp_path / "out"
    write_trees(rows.unionByName(rows.selectExpr("'t' AS source_id", "path", "kind", "size", "true AS executable", "symlink_target", "sha256", "content")), str(target))
    got = {(r.source_id, r.path): (r.kind, r.executable, r.symlink_target, r.content) for r in read_trees(spark, str(target)).where("kind <> 'directory'").collect()}
    assert got == {(k, p): v for k, x in (("s", False), ("t", True)) for p, v in {"a/b": ("file", x, None, "é"), "c": ("file", x, None, ""), "d": ("symlink", False, "a/b", None)}.items()}
    bad = rows.selectExpr("source_id", "concat('../', path) AS path", "kind", "executable", "symlink_target", "content")
    with pytest.raises(Exception, match="not a path in a tree"):
        write_trees(bad, str(tmp_path / "bad"))
    assert sorted(os.listdir(tmp_path)) == ["out"]


def test_folder_whose_path_comes_again(spark, tmp_path):
    root = tmp_path / "src"
    (root / "lib/src").mkdir(parents=True)
    (root / "lib/src/a.py").write_text("1")
    (root / "a.py").write_text("2")
    rows = {r.path: r.content for r in folder_inventory(spark, str(root), "s").where("kind = 'file'").collect()}
    assert rows == {"a.py": "2", "lib/src/a.py": "1"}


def test_folder(spark, tmp_path):
    for name, data in {"a/SKILL.md": b"x\n", "a/b/c.bin": b"\0", "a/bad": b"\xff", ".git/config": b"x", "a/.svn/x": b"", "empty": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path: r for r in folder_inventory(spark, f"file://{tmp_path}", "s").collect()}
    assert set(rows) == {"a", "a/b", "a/SKILL.md", "a/b/c.bin", "a/bad"}  # the reader passes over empty files
    assert rows["a"].kind == "directory" and rows["a/SKILL.md"].content == "x\n"
    assert rows["a/b/c.bin"].content is None and rows["a/bad"].content is None
    assert rows["a/bad"].sha256 == hashlib.sha256(b"\xff").hexdigest()


@pytest.mark.parametrize(
    "text, want",
    [
        ("[a](b.md) ![c](<d e.png> 'title')", [(1, "markdown.link", "b.md"), (1, "markdown.link", "d e.png")]),
        (r"\[a](b.md) `[c](d.md)` ``x ` [e](f.md)``", []),
        ("[a](x(1).md)", [(1, "markdown.link", "x(1).md")]),
        ("```\n[a](b.md)\n```\n~~~ py\n[c](d.md)\n~~~\n[e](f.md)", [(7, "markdown.link", "f.md")]),
        ("[t][L]\n[l]: one.md\n[l]: two.md\n[x]: three.md", [(2, "markdown.reference", "one.md")]),
        ("[s]\n\n[s]: <a b.md>", [(3, "markdown.reference", "a b.md")]),
        ("---\nscript: 'run.sh' # c\nname: n\n---\nfile: x/y", [(2, "markdown.frontmatter", "run.sh")]),
        ("```bash\n$ python tools/a.py --x=b/c https://h/p /abs\n```", [(2, "shell.command", "tools/a.py")]),
        ("Run ../x/y.sh, then go.", [(1, "markdown.action_path", "../x/y.sh")]),
        ("", []),
        ("``` unclosed\n[a](b)", []),
    ],
)
def test_markdown(text, want):
    assert markdown_rows(text) == want


def test_links(spark):
    links = {"a/x": "links/y", "a/links/y": "../f", "out": "../up", "chain": "out", "p": "q", "q": "p", "gone": "no", "dir": "a", "through": "dir/f"}
    rows = {r.path: (r.outcome, r.terminal) for r in L.close_links(tree(spark, {"a/f": "t"}, links)).collect()}
    assert rows["a/x"] == ("resolved", "a/f") and rows["a/links/y"] == ("resolved", "a/f")
    assert rows["out"] == ("escape", None) and rows["chain"] == ("escape", None)
    assert rows["p"][0] == rows["q"][0] == "cycle" and rows["gone"] == ("dangling", "no") and rows["through"] == ("resolved", "a/f")


def test_findings_beside_references(spark):
    files = {
        "plugin.json": '{"name": "p", "mcpServers": {"Files": {}}}',
        "commands/deploy.md": "x",
        "skills/a/SKILL.md": "---\nname: a\ndescription: d\n---\nuse mcp__files__read, mcp__other__read\nthen /deploy or /other",
        "skills/a/skill.md": "",
        "skills/a/sub/plugin.json": '{"runtime": "x"}',
        "skills/a/big": "x" * 30,
        "skills/b/SKILL.md": "---\nname: b\ndescription: d\n---\n",
    }
    inventory = tree(spark, files, {"skills/a/loop": "loop", "skills/a/out": "../../plugin.json", "skills/b/ghost": "none"})
    boundaries = B.detect_boundaries(inventory)
    candidates = B.discover(inventory, boundaries)
    refs = R.references(inventory)
    found = L.link_evidence(L.close_links(inventory), candidates)
    found = found.unionByName(D.collision_evidence(inventory, candidates)).unionByName(D.limit_evidence(inventory, candidates, single=29 + 100, depth=3))
    found = found.unionByName(D.package_evidence(boundaries, candidates)).unionByName(D.symbol_evidence(refs, candidates, R.owned_symbols(inventory, boundaries)))
    codes = {(r.root, r.code, r.value) for r in found.collect()}
    assert {c for _, c, _ in codes if c.startswith("SYMLINK")} == {"SYMLINK_ESCAPE"}
    assert ("skills/a", "DYNAMIC_REFERENCE_UNRESOLVED", "loop (cycle)") in codes
    assert ("skills/a", "SYMLINK_ESCAPE", "../../plugin.json -> plugin.json") in codes
    assert ("skills/b", "MISSING_LOCAL_RESOURCE", "none -> skills/b/none") in codes
    assert {v for _, c, v in codes if c == "PLUGIN_OWNED_MCP_TOOL"} == {"mcp__files__read"}
    assert {v for _, c, v in codes if c == "PLUGIN_COMMAND_REFERENCE"} == {"/deploy"}
    assert {r for r, c, _ in codes if c in ("PLUGIN_RUNTIME_INSIDE_SKILL_ROOT", "DUPLICATE_ENTRYPOINT", "PATH_COLLISION")} == {"skills/a"}
    assert {r for r, c, _ in codes if c == "SCAN_LIMIT_EXCEEDED"} == {"skills/a", "skills/b"}
    limits = D.limit_evidence(inventory, candidates, entries=3, single=20)
    assert {c.code for c in limits.collect()} == {"FILE_TOO_LARGE", "SCAN_LIMIT_EXCEEDED"}
    classes = {r.root: r.classification for r in D.classify(candidates, found).collect()}
    assert set(classes.values()) == {"blocked"}


@pytest.mark.parametrize(
    "head, name",
    [
        ("name: 123\ndescription: d", None),
        ("name: 'On'\ndescription: d", "On"),
        ("name: on\ndescription: d", None),
        ("name: x # note\ndescription: d", "x"),
        ("name: [a]\ndescription: d", None),
        ("name: 2020-01-01\ndescription: d", None),
        ("name: v1.2\ndescription: >\n  folded\n  text\nlicense: x", "v1.2"),
        ("name: x\ndescription: >", None),
        ("name: x\ndescription: ' '", None),
    ],
)
def test_frontmatter(spark, head, name):
    inventory = tree(spark, {"a/SKILL.md": f"---\n{head}\n---\nbody"})
    row = R.frontmatter(inventory, B.discover(inventory, B.detect_boundaries(inventory))).first()
    assert row.name == name and row.valid == (name is not None)
    if "folded" in head:
        assert row.description == "folded text"


def test_redaction(spark):
    texts = {
        "api-key: abc": ("api-key: <REDACTED:TOKEN>", ["TOKEN"]),
        "access-key=abc;": ("access-key=<REDACTED:TOKEN>;", ["TOKEN"]),
        'my.private-key_ = "a b"': ("my.private-key_ = <REDACTED:PRIVATE_KEY>", ["PRIVATE_KEY"]),
        "DB_PASS_WORD: 'x'": ("DB_PASS_WORD: <REDACTED:PASSWORD>", ["PASSWORD"]),
        "Authorization: Bearer a.b": ("Authorization: Bearer <REDACTED:TOKEN>", ["TOKEN"]),
        "UNTRUSTED_REPOSITORY_DATA_BEGIN": ("<REDACTED:PROMPT_DELIMITER>", ["PROMPT_DELIMITER"]),
        "keyboard: x": ("keyboard: x", []),
    }
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.redaction(F.col("t")).alias("r")).collect()
    assert {r.t: (r.r.redacted, r.r.types) for r in rows} == texts
    row = spark.createDataFrame([("a\ntoken=b\nc",)], "t string").select(D.redaction(F.col("t")).alias("r")).first()
    assert row.r.unchanged == [1, 3]


def test_sensitive_paths(spark):
    from pyspark.sql import functions as F

    paths = ["a/.env", "b/.env.local", "MyCredentials/x", "k/id_rsa", "c.PEM", "x/.docker/config.json", "config.json", "environment", "src/key.py"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").where(D.is_sensitive(F.col("p"))).collect()
    assert [r.p for r in rows] == paths[:6]


def test_written_trees_come_back_whole(spark, tmp_path):
    n = 10_300  # more links in one folder than the reader takes from a stranger's
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    docs.coalesce(4).write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.tree_inventory(spark, str(tmp_path))
    found = rows.groupBy().agg(F.count_if(F.col("problem").isNotNull()).alias("bad"), F.count_if(F.startswith("path", F.lit("links/"))).alias("links")).first()
    assert (found.bad, found.links) == (0, n)


def test_archives_come_a_few_at_a_time(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id long, text string")
    rows = untar(pack_documents(docs))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan  # Arrow's batches hold ten thousand archives of any size
    assert {r.source_id for r in rows.collect()} == {"d1", "d2"}
