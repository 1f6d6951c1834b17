import random

import pytest

from treelift.operators import boundaries as B
from treelift.operators import inert as I
from treelift.operators import references as R

SCHEMA = "source_id string, path string, kind string, executable boolean, symlink_target string, content string, size long"


def make(spark, tree):
    return spark.createDataFrame([("s", p, "file", False, None, c, len(c)) for p, c in tree.items()], SCHEMA)


def shown(scan, text):
    """The text with inert characters as dots and quoted ones as tildes."""
    out = list(text)
    for kind, a, b in scan(text):
        for k in range(a, b):
            if kind != "literal" and out[k] != "\n":
                out[k] = {"inert": ".", "quoted": "~"}[kind]
    return "".join(out)


@pytest.mark.parametrize(
    "scan,text,want",
    [
        (I.python_spans, "a = 'x' # c\nb", "a = ... ...\nb"),
        (I.python_spans, "a = '''x\ny'''; b = r'\\'", "a = ....\n....; b = ...."),
        (I.python_spans, "f'ab{x}c' + g", "f'..{x}.' + g"),
        (I.python_spans, "f'{{a}}{b}'", "f'.....{b}'"),
        (I.python_spans, "a = 'open\nb = 1", "a = .....\nb = 1"),
        (I.python_spans, "", ""),
        (I.javascript_spans, "a /* b\nc */ d // e\nf", "a ....\n.... d ....\nf"),
        (I.javascript_spans, "x = `a${y}b`; z = a / b / c", "x = `.${y}.`; z = a / b / c"),
        (I.javascript_spans, "x = /a'b/; y = 'q'", "x = .....; y = ..."),
        (I.javascript_spans, "return /x\"/ + \"y\"", "return .... + ..."),
        (I.shell_spans, "#!/bin/sh\na 'b c' \"d $e\" # f\ng#h", "#!/bin/sh\na ..... ~~~~~~ ...\ng#h"),
        (I.shell_spans, "cat <<'E' x\na 'b\nE\nc", "cat <<'E' x\n....\n.\nc"),
        (I.shell_spans, "cat <<E\na $b\nE\nc 'd'", "cat <<E\na $b\n.\nc ..."),
        (I.shell_spans, "cat <<-E <<F\n\ta\n\tE\nb\nF\nc", "cat <<-E <<F\n\ta\n..\nb\n.\nc"),
        (I.shell_spans, "cat <<'E'\nnever", "cat <<'E'\n....."),
        (I.shell_spans, "a <<< 'b' \\'c", "a <<< ... \\'c"),
        (I.markdown_spans, "a\n```\nb\n```\nc", "a\n...\n.\n...\nc"),
        (I.markdown_spans, "~~~py\nx = 'y' # z\n~~~\n'c'", "~~~py\nx = ... ...\n~~~\n'c'"),
        (I.markdown_spans, "```sh\necho 'a'\n```\n```text\nb", "```sh\necho ...\n```\n.......\n."),
    ],
)
def test_spans(scan, text, want):
    assert shown(scan, text) == want


def test_intervals_against_brute_force(spark):
    rnd = random.Random(3)
    points = [("f", rnd.choice("ab"), rnd.randint(0, 3 * I.SPAN), k) for k in range(400)]
    spans = []
    for _ in range(120):
        start = rnd.randint(0, 3 * I.SPAN)
        end = min(start + rnd.choice([0, 1, 7, 300]), (start // I.SPAN + 1) * I.SPAN)
        spans.append(("f", rnd.choice("abc"), start, end))
    got = I.covered(spark.createDataFrame(points, "path string, line string, at int, n int"), spark.createDataFrame(spans, "path string, line string, start int, end int"), ["path", "line"])
    want = {n for p, line, at, n in points if any((p, line) == s[:2] and s[2] <= at < s[3] for s in spans)}
    assert {r.n for r in got.collect()} == want and len(want) > 30


SKILL = "---\nname: n\ndescription: d\n---\n"


def test_symbols_in_inert_text(spark):
    long = "x" * (2 * I.SPAN) + " '" + "y" * I.SPAN + " mcp__a__long' mcp__a__after"
    tree = {
        "a.py": "# mcp__a__one\nx = 'mcp__a__two' + mcp__a__three\n'''\nmcp__a__four\n'''\nf'{mcp__a__five} mcp__a__six'\n" + long,
        "b.js": "// ${PLUGIN_ROOT}\n`${PLUGIN_ROOT}/x ${mcp__b__one}`; y = \"mcp__b__two\"",
        "c.sh": "echo \"${PLUGIN_ROOT} mcp__c__one\" '${PLUGIN_ROOT}' mcp__c__two # mcp__c__three",
        "d.txt": "mcp__d__one ${PLUGIN_ROOT}",
        "e.md": "mcp__e__one\n```\nmcp__e__two\n```\n```python\n# mcp__e__three\nmcp__e__four\n```\nthen /deploy it",
        "f.cfg": "'mcp__f__one' # mcp__f__two",
        "g": "#!/usr/bin/env node\n'mcp__g__one' mcp__g__two",
    }
    rows = make(spark, tree)
    refs = R.references(rows)
    assert all(tree[r.path].split("\n")[r.line - 1].startswith(r.value, r.col) for r in refs.where("col is not null").collect())
    got = sorted(r.value for r in I.active_references(refs, rows).collect())
    assert got == sorted([
        "mcp__a__three", "mcp__a__five", "mcp__a__after", "${PLUGIN_ROOT}", "${PLUGIN_ROOT}", "mcp__b__one", "mcp__c__two", "mcp__e__one", "mcp__e__four", "/deploy", "mcp__f__one", "mcp__f__two", "mcp__g__two",
    ])


def test_residual_literals(spark):
    tree = {
        "s/SKILL.md": SKILL, "up.md": "x", "s/own.md": "y",
        "s/a.py": 'x = "../up.md"\ny = "own.md"  # "../up.md"\nz = "../../gone.md"\nw = "http://h/a.b"\nv = "/abs.md"\nu = "two words.md"\nt = "up.md"',
        "s/b.rb": "load '%2e%2e/up.md'", "s/c.md": "'../up.md'", "out.py": '"../up.md"', "s/run": "#!/bin/sh\ncat '../up.md'",
    }
    rows = make(spark, tree)
    found = B.discover(rows, B.detect_boundaries(rows))
    literals = I.residual_literals(rows, found)
    got = {(r.path, r.line, r.code, r.value) for r in I.residual_evidence(literals, R.resolve(literals, rows, found), found).collect()}
    code = "STATIC_ANALYSIS_INCOMPLETE"
    assert got == {
        ("s/a.py", 1, code, "../up.md -> up.md"), ("s/a.py", 3, code, "../../gone.md -> <outside snapshot>"), ("s/a.py", 7, code, "up.md -> up.md"),
        ("s/b.rb", 1, code, "%2e%2e/up.md -> up.md"), ("s/run", 2, code, "../up.md -> up.md"),
    }


def test_literal_limit(spark, monkeypatch):
    tree = {"s/SKILL.md": SKILL, "s/a.py": "\n".join(f"'v{k}.md'" for k in range(I.LITERALS + 3))}
    rows = make(spark, tree)
    found = B.discover(rows, B.detect_boundaries(rows))
    literals = I.residual_literals(rows, found)
    got = I.residual_evidence(literals, R.resolve(literals, rows, found), found).collect()
    assert [(r.line, r.value) for r in got] == [(I.LITERALS + 1, f"literal limit {I.LITERALS} exceeded")]
