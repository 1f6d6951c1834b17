import random
from fnmatch import fnmatchcase

from pyspark.sql import functions as F

from treelift.operators.globs import match_globs, segment_regex, variants
from treelift.operators.structured import UNPARSEABLE, json_references
from treelift.sources.scratch import Scratch


def serial_variants(pattern):
    out = [pattern]
    while "/**/" in out[-1]:
        out.append(out[-1].replace("/**/", "/", 1))
    return out


def serial_match(path, pattern):
    def one(variant):
        want, have = variant.split("/"), path.split("/")
        return len(want) <= len(have) and all(fnmatchcase(h, w) for h, w in zip(have[-len(want) :], want, strict=True))

    return any(one(v) for v in serial_variants(pattern))


def test_segments_match_as_in_a_shell(spark):
    rng = random.Random(3)
    segments = ["".join(rng.choice("ab-!]^[*?.\\&é") for _ in range(rng.randint(1, 6))) for _ in range(400)] + ["[]", "[!]", "[z-a]", "[!z-a]x", "[]a]", "[a-c-e]", "[\n]", "****"]
    names = ["".join(rng.choice("abc-!]^[.\\&é\n") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    frame = spark.createDataFrame([(s, n) for s in segments for n in names], "s string, n string").withColumn("r", segment_regex(F.col("s")))
    wrong = [(x.s, x.n, x.r) for x in frame.withColumn("hit", F.expr("n rlike r")).collect() if x.hit != fnmatchcase(x.n, x.s)]
    assert wrong == []


def test_inner_folders_fall_away_from_the_left(spark):
    for pattern in ("a", "a/**/b", "a/**/**/b", "**/a", "a/**", "a/**/b/**/c", "**/**/x"):
        got = spark.range(1).select(variants(F.lit(pattern)).alias("v")).first().v
        assert {"/".join(v) for v in got} == set(serial_variants(pattern)), pattern


def test_globs_equal_all_pairs_of_patterns_and_paths(spark):
    rng = random.Random(7)
    part = lambda: rng.choice(["a", "b", "ab", "c1", "x.ts"])
    paths = {(f"s{rng.randint(0, 1)}", "/".join(part() for _ in range(rng.randint(1, 6)))) for _ in range(400)}
    wild = lambda: rng.choice(["a", "b", "*", "**", "?", "[a-b]", "[!a]*", "*.ts", "x.ts"])
    patterns = {(f"s{rng.randint(0, 2)}", "/".join(wild() for _ in range(rng.randint(1, 5)))) for _ in range(200)}
    rows = [*patterns, *list(patterns)[:20], ("s0", None), (None, "a")]
    got = match_globs(
        spark.createDataFrame(rows, "source_id string, pattern string"),
        spark.createDataFrame([*paths, ("s0", None), (None, "a")], "source_id string, path string"),
        Scratch(spark, "globs"),
    ).collect()
    want = {(s, p, x) for s, p in patterns for t, x in paths if s == t and serial_match(x, p)}
    assert len(got) == len(want) and {(r.source_id, r.pattern, r.path) for r in got} == want


def test_no_patterns_and_no_paths(spark):
    empty = spark.createDataFrame([], "source_id string, pattern string")
    one = spark.createDataFrame([("s", "a/b")], "source_id string, path string")
    assert match_globs(empty, one, Scratch(spark, "globs")).count() == 0
    assert match_globs(one.withColumnRenamed("path", "pattern"), one.limit(0), Scratch(spark, "globs")).count() == 0


def test_patterns_and_paths_are_joined_by_keys(spark):
    paths = spark.createDataFrame([("s", "a/b.ts")], "source_id string, path string")
    plan = match_globs(paths.withColumnRenamed("path", "pattern"), paths, Scratch(spark, "globs"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


JSON = {
    "s/tsconfig.json": '{"extends": "../base.json",\n "include": ["lib/**/*.ts", "none/*", 5],\n "files": "*.md",\n "references": [{"path": "q"}, {"path": 1}, 7, null], "path": {"a": 1}, "script": null}',
    "s/deep/jsconfig.json": '{"include": ["*.md", "../../../*.x", "%252e%252e/*", "/etc/*", "[a"]}',
    "s/package.json": '{"main": ',
    "s/other.json": "{",
    "s/list.json": '["a"]',
    "s/null.json": "null",
    "s/empty.json": "",
    "out.json": '{"path": "x"}',
    "s/lib/a.ts": "", "s/lib/b/c.ts": "", "s/lib/b/c/d.ts": "", "s/SKILL.md": "", "s/lib/e.js": "",
}


def test_fields_lists_and_patterns_of_json_files(spark):
    rows = [("t", path, "file", text) for path, text in JSON.items()] + [("t", "s/none.json", "file", None), ("t", "s/l.ts", "symlink", None)]
    inventory = spark.createDataFrame(rows, "source_id string, path string, kind string, content string")
    candidates = spark.createDataFrame([("t", "s")], "source_id string, root string")
    got = json_references(inventory, candidates, Scratch(spark, "json")).collect()
    assert sorted((r.path, r.line, r.syntax, r.value) for r in got) == sorted([
        ("s/tsconfig.json", 1, "json.extends", "../base.json"),
        ("s/tsconfig.json", 2, "json.glob", "lib/a.ts"),
        ("s/tsconfig.json", 2, "json.glob", "lib/b/c.ts"),
        ("s/tsconfig.json", 3, "json.glob", "SKILL.md"),
        ("s/tsconfig.json", 4, "json.references.path", "q"),
        ("s/deep/jsconfig.json", 1, "json.glob", "SKILL.md"),
        ("s/deep/jsconfig.json", 1, "json.glob", "../../../*.x"),
        ("s/deep/jsconfig.json", 1, "json.glob", "%252e%252e/*"),
        ("s/deep/jsconfig.json", 1, "json.glob", "/etc/*"),
        ("s/package.json", 1, "json.parse_failure", UNPARSEABLE),
    ])
