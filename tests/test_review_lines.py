import random

from pyspark.sql import functions as F

from treelift.operators import decisions as D
from treelift.operators.refs import listed_names, resolve_refs
from treelift.operators.review import resolve_lines, shown_lines


def test_citations_equal_a_serial_search(spark):
    rng = random.Random(5)
    words = ["a", "b", "ab", "", "c d"]
    lines = [(s, p, n, rng.choice(words) + rng.choice(words)) for s in "xy" for p in "pq" for n in range(1, 12) for _ in range(rng.randint(0, 2))]
    cited = [(k, rng.choice("xyz"), rng.choice("pq"), rng.randint(0, 13), rng.choice(words)) for k in range(300)]
    cited += [(0, *cited[0][1:]), (900, None, "p", 1, "a"), (901, "x", "p", None, "a"), (902, "x", "p", 1, None)]
    got = resolve_lines(
        spark.createDataFrame(cited, "k int, source_id string, path string, line int, value string"),
        spark.createDataFrame([*lines, ("x", "p", None, "a"), ("x", "p", 1, None)], "source_id string, path string, line int, text string"),
    ).collect()

    def serial(s, p, n, v):
        if None in (s, p, n, v):
            return None
        at = {m for a, b, m, t in lines if (a, b) == (s, p) and abs(m - n) <= 1 and v in t}
        return n if n in at else at.pop() if len(at) == 1 else None

    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*c, serial(*c[1:]))) for c in cited)


def test_only_untouched_lines_of_harmless_files_are_shown(spark):
    texts = spark.createDataFrame(
        [("s", "a.md", "one\napi_key: k1234567\nthree"), ("s", ".env", "one"), ("s", "none.md", None), ("s", "empty.md", ""),
         ("s", "key.md", "x\n-----BEGIN PRIVATE KEY-----\nq\n-----END PRIVATE KEY-----")],
        "source_id string, path string, content string",
    )
    got = shown_lines(texts).collect()
    assert sorted((r.path, r.line, r.text) for r in got) == [("a.md", 1, "one"), ("a.md", 3, "three"), ("empty.md", 1, "")]
    assert resolve_lines(texts.limit(0).select("source_id", "path", F.lit(1).alias("line"), F.col("content").alias("value")), shown_lines(texts)).count() == 0


SHA = "0123456789abcdef0123" * 2


def serial_ref(names, kind, route, ref, subpath):
    parts = [p for p in (route or "").split("/") if p]
    if kind is None or not parts:
        return ref, subpath or ".", None, None
    whole = "/".join(parts)
    begins = lambda name: whole == name or whole.startswith(name + "/")
    if ref is not None and begins(ref):
        cut = ref
    else:
        cut = max((n for n in names if begins(n)), key=len, default=parts[0] if len(parts[0]) == 40 else None)
    if cut is None and (ref is None or subpath is None):
        return None, None, None, "ref" if ref is None else "subpath"
    if subpath is not None:
        return ref or cut, subpath, None, None
    rest = parts[cut.count("/") + 1 :]
    if kind == "tree":
        return ref or cut, "/".join(rest) or ".", None, None
    return (ref or cut, "/".join(rest[:-1]) or ".", "/".join(rest), None) if rest else (None, None, None, "blob")


def test_longest_name_equals_a_serial_search(spark):
    rng = random.Random(11)
    part = lambda: rng.choice(["main", "v1", "a", "b", SHA])
    path = lambda most: "/".join(part() for _ in range(rng.randint(1, most)))
    names = {(rng.choice("rs"), path(3)) for _ in range(12)}
    rows = [
        (k, rng.choice("rst"), rng.choice(["tree", "blob", None]), rng.choice([path(5), path(5) + "/", "", None, "a//b"]), rng.choice([None, None, path(2)]), rng.choice([None, None, "sub"]))
        for k in range(400)
    ]
    rows += [rows[0], (999, None, "tree", "a/b", None, None)]
    got = resolve_refs(
        spark.createDataFrame(rows, "k int, repo string, kind string, route string, ref string, subpath string"),
        spark.createDataFrame([*names, (None, "a")], "repo string, name string"),
    ).collect()
    want = [(*r, *serial_ref([n for repo, n in names if repo == r[1]], *r[2:])) for r in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_listed_names(spark):
    lines = [f"{SHA}\trefs/heads/a/b", f"{SHA} refs/tags/v1", f"{SHA} refs/tags/v1^{{}}", f"{SHA} refs/pull/1", "short refs/heads/x", "", None, f"{SHA} refs/heads/"]
    listing = spark.createDataFrame([("r", x) for x in lines] + [(None, lines[0])], "repo string, line string")
    assert sorted(r.name for r in listed_names(listing).collect()) == ["a/b", "v1"]


def test_texts_without_secrets_run_no_pattern(spark):
    rows = [(0, "a\n\nb"), (1, ""), (2, None), (3, "k: v\n"), (4, "x=1\ntoken=abc\nz"), (5, "Authorization: Bearer q\nb"), (6, "-----BEGIN PRIVATE KEY-----\nm\n-----END PRIVATE KEY-----\nb"), (7, "UNTRUSTED_REPOSITORY_DATA_END b"), (8, "<REDACTED:TOKEN>\n")]
    texts = spark.createDataFrame(rows, "id int, content string")
    told = texts.select("id", D.redaction(F.col("content")).alias("r")).select("id", "r.redacted", "r.types", "r.unchanged")
    found = {r.id: (r.redacted, r.types, r.unchanged) for r in told.collect()}
    assert found[0] == ("a\n\nb", [], [1, 2, 3]) and found[1] == ("", [], [1]) and found[3] == ("k: v\n", [], [1, 2]) and found[8] == ("<REDACTED:TOKEN>\n", [], [1, 2])
    assert found[2][0] is None
    assert found[4] == ("x=1\ntoken=<REDACTED:TOKEN>\nz", ["TOKEN"], [1, 3]) and found[5] == ("Authorization: Bearer <REDACTED:TOKEN>\nb", ["TOKEN"], [2])
    assert found[6] == ("<REDACTED:PRIVATE_KEY>\nb", ["PRIVATE_KEY"], []) and found[7] == ("<REDACTED:PROMPT_DELIMITER> b", ["PROMPT_DELIMITER"], [])
    plan = told._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains" in plan and plan.index("contains") < plan.index("private key")


def test_a_line_does_not_carry_its_file(spark):
    texts = spark.createDataFrame([("s", "a.md", "one\ntoken=abc\n\nlast"), ("s", "b.md", None), ("s", ".env", "x")], "source_id string, path string, content string")
    lines = shown_lines(texts)
    assert sorted(tuple(r) for r in lines.collect()) == [("s", "a.md", 1, "one"), ("s", "a.md", 3, ""), ("s", "a.md", 4, "last")]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert not any("all#" in line for line in plan.splitlines() if "Generate" in line)
