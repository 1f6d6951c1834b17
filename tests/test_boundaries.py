import json
import random

import pytest
from pyspark.sql import functions as F

from treelift.functions.json_values import parse_whole, walk
from treelift.operators import boundaries as B

DEEP = "[" * 60 + "]" * 60


def nodes(value, depth=0, key=None):
    yield depth, key
    items = value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ()
    for k, v in items:
        yield from nodes(v, depth + 1, k)


def test_walk_equals_a_serial_walk(spark):
    rng = random.Random(2)

    def made(depth):
        kind = rng.choice("dlsnbz" if depth else "sn")
        if kind == "d":
            return {rng.choice(['a"b', "é", "k\\", "", "x", "main"]) + str(n): made(depth - 1) for n in range(rng.randint(0, 4))}
        return [made(depth - 1) for _ in range(rng.randint(0, 4))] if kind == "l" else {"s": '"k": {[', "n": 1.5, "b": True, "z": None}[kind]

    texts = [json.dumps(made(rng.randint(0, 5))) for _ in range(150)] + [DEEP, "{}", "[]", "null", "  5 ", json.dumps(list(range(200)))]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.transform(walk(F.col("t")), lambda n: F.struct(n["depth"], n["key"])).alias("n")).collect()
    for r in got:
        assert sorted(map(repr, map(tuple, r.n))) == sorted(map(repr, nodes(json.loads(texts[r.k])))), texts[r.k]


def test_no_json_and_bounds(spark):
    texts = [None, "", "{", '{"a":1} x', '{"a":1,"a":2}', "{'a':1}", "[" * 2000 + "]" * 2000]
    assert [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(walk(F.col("t"))).collect()] == [None] * len(texts)
    assert spark.createDataFrame([(json.dumps([[[1] * 5] * 5] * 5),)], "t string").select(F.size(walk(F.col("t"), 5))).first()[0] == 6  # the level past the bound is not opened
    assert spark.createDataFrame([(" [1] ",)], "t string").select(F.to_json(parse_whole(F.col("t")))).first()[0] == "[1]"


SKILL = "x/SKILL.md"
CASES = [
    ({"plugin.json": "{}", SKILL: ""}, "skills_only"),
    ({"plugin.json": '{"a": {"b": [{"MCP-Servers": 1}]}}', SKILL: ""}, "mixed"),
    ({"plugin.json": '{"\\u006dain": 1}', SKILL: ""}, "mixed"),
    ({"plugin.json": '{"a": "\\"main\\": 1"}', SKILL: ""}, "skills_only"),
    ({"plugin.json": '{"a": "main"}', SKILL: ""}, "skills_only"),
    ({"plugin.json": '{"a": ["main", null, 1.5, true]}', SKILL: ""}, "skills_only"),
    ({"plugin.json": "[]", SKILL: ""}, "mixed"),
    ({"plugin.json": "{} x", SKILL: ""}, "mixed"),
    ({"plugin.json": None, SKILL: ""}, "mixed"),
    ({"plugin.json": json.dumps({"a": [0] * 4094}), SKILL: ""}, "skills_only"),
    ({"plugin.json": json.dumps({"a": [0] * 4095}), SKILL: ""}, "mixed"),
    ({"plugin.json": "{}", SKILL: "", "y/plugin.json": '{"hooks": 1}'}, "mixed"),
    ({"plugin.json": "{}", SKILL: "", "package.json": '{"name": "a", "packageManager": "b"}'}, "skills_only"),
    ({"plugin.json": "{}", SKILL: "", "package.json": '{"name": "a", "dependencies": {}}'}, "mixed"),
    ({"plugin.json": "{}", SKILL: "", "package.json": "{}"}, "skills_only"),
    ({"plugin.json": "{}", SKILL: "", "package.json": "[]"}, "mixed"),
    ({"plugin.json": "{}", SKILL: "", "y/package.json": '{"name": "a"}'}, "mixed"),
    ({"plugin.json": "{}", SKILL: "", "bin": "dir"}, "mixed"),
    ({"plugin.json": "{}", SKILL: "", "other": "dir"}, "skills_only"),
    ({"plugin.json": "{}", SKILL: "", "x/bin/run.py": ""}, "skills_only"),
    ({"plugin.json": "{}", "SKILL.md": "", "notes.md": ""}, "skills_only"),
    ({"plugin.json": "{}", "SKILL.md": "", "tool.PY": ""}, "mixed"),
    ({"plugin.json": "{}", "SKILL.md": "", "bin/readme": ""}, "mixed"),
    ({"plugin.json": "{}", "SKILL.md": "", "scripts/run.py": "", "scripts": "dir"}, "skills_only"),
    ({"plugin.json": "{}", "SKILL.md": "", "scripts/bin/run.py": ""}, "mixed"),
    ({"plugin.json": "{}", "SKILL.md": "", "scripts/references/run.py": ""}, "skills_only"),
    ({"plugin.json": "{}", "SKILL.md": "", "scripts": ""}, "mixed"),
    ({"plugin.json": "{}", "SKILL.md": "", "notes": "exe"}, "mixed"),
    ({"plugin.json": "{}", "SKILL.md": "", "assets/notes": "exe"}, "skills_only"),
    ({"plugin.json": "{}", "SKILL.md": "", "sub/SKILL.md": "", "sub/bin/x.py": ""}, "skills_only"),
    ({"plugin.json": "{}", "SKILL.md": "", "docs/bin/x.py": ""}, "skills_only"),
]


@pytest.mark.parametrize("base", ["", "deep/er/"])
def test_package_kinds(spark, base):
    rows = [(f"s{k}", base + p, "directory" if t == "dir" else "file", t == "exe", t) for k, (tree, _) in enumerate(CASES) for p, t in tree.items()]
    inventory = spark.createDataFrame(rows, "source_id string, path string, kind string, executable boolean, content string")
    root = base.rstrip("/") or "."
    got = {r.source_id: r.package_kind for r in B.detect_boundaries(inventory).where(F.col("root") == root).collect()}
    for k, (tree, want) in enumerate(CASES):
        assert got[f"s{k}"] == want, tree
