import json
import random

import pytest

from treelift.operators import envelopes as E
from treelift.sources.scratch import Scratch

SCHEMA = "source_id string, root string, path string, priority int, need long, raw long, whole long, least long, cuttable boolean"


def serial(items, budget):
    used, out = 0, []
    for path, need, raw, whole, least, cuttable in items:
        left = budget - used - (1 if out else 0)
        if left < 160:
            break
        if need > left:
            continue
        cut = raw > left or (cuttable and whole > left)
        size = least if cut else whole
        if size > left:
            break
        used += size + (1 if out else 0)
        out.append((len(out) + 1, path, cut, size, used))
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_budgets_equal_a_serial_pass(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng, rows = random.Random(3), []
    for g in range(12):
        for k in range(400 if g == 0 else rng.choice([0, 1, 5, 40])):  # one review holds most rows
            raw = rng.choice([0, 30, 300, 900, 3000, 9000])
            whole = None if raw > 2000 else 120 + raw // rng.choice([1, 2, 6])
            rows.append(("s", f"r{g}", f"p{k:04d}", rng.randint(0, 4), rng.choice([12, 60, 400, 700, 5000] if g < 9 else [12]), raw, whole, rng.choice([100, 110, 130]), rng.random() < 0.8))
    got = E.fill_budgets(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"), 2000).collect()
    for g in range(12):
        mine = sorted((r for r in rows if r[1] == f"r{g}"), key=lambda r: (r[3], r[2]))
        want = serial([(r[2], *r[4:]) for r in mine], 2000)
        assert sorted(tuple(r)[2:] for r in got if r.root == f"r{g}") == want


def test_no_review_is_an_empty_table(spark):
    shown = E.fill_budgets(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"))
    assert shown.count() == 0 and shown.columns == ["source_id", "root", "n", "path", "cut", "chars", "reach"]
    assert E.review_status(spark.createDataFrame([], SCHEMA), shown).count() == 0


def test_records_are_as_long_as_their_json(spark):
    texts = ["", "a", "a\n", "a\n\nb\r\nc\rd\u2028e\u2029f\x85g\x1ch", 'quote " \\ \t \x01 é 語 😀', "\n", "x" * 400, None]
    entries = [("s", "p/a", "p/a/SKILL.md", "p/plugin.json", f"p/a/f{k}.txt", "file", False, None, t, None if t is None else len(t.encode())) for k, t in enumerate(texts)]
    entries += [("s", "p/a", "p/a/SKILL.md", "p/plugin.json", p, k, x, t, c, 3) for p, k, x, t, c in [
        ("p/a/SKILL.md", "file", False, None, "abc"), ("p/plugin.json", "file", True, None, "{}"), ("p/bin/x", "file", True, None, "x"), ("p/z.PY", "file", False, None, "x"),
        ("p/notes", "symlink", False, "a/é", None), ("p/dir", "directory", False, None, None), ("p/.env", "file", False, None, "x"), ("p/password=hunter22", "file", False, None, "x"),
    ]]
    frame = spark.createDataFrame(
        entries, "source_id string, root string, entrypoint string, boundary_manifest string, path string, kind string, executable boolean, symlink_target string, content string, size long"
    )
    got = {r.path: r for r in E.file_records(frame, budget=2000).collect()}
    assert set(got) == {e[4] for e in entries} - {"p/a/f7.txt", "p/.env", "p/password=hunter22"}
    assert [got[p].priority for p in ("p/a/SKILL.md", "p/a/f1.txt", "p/plugin.json", "p/bin/x", "p/z.PY", "p/notes", "p/dir")] == [0, 1, 2, 3, 3, 4, 4]
    for _, _, _, _, path, kind, executable, target, content, size in entries:
        if path not in got:
            continue
        record = {"path": path, "kind": kind, "size": size, "executable": executable, "sha256": "0" * 64 if kind == "file" else None, "lines": [], "symlinkTarget": None}
        length = lambda: len(json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":")))  # noqa: E731, B023
        cut_record = {**record, "symlinkTarget": "<TRUNCATED>" if target else None}
        assert got[path].least == len(json.dumps(cut_record, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
        record["lines"] = [{"line": n, "value": v} for n, v in enumerate((content or "").splitlines(), 1)]
        record["symlinkTarget"] = target
        assert got[path].whole == (length() if 6 * len(content or target or "") <= 2000 else None), path
        assert got[path].raw == 6 * len(content or target or "") and got[path].need == 6 * len(path)


def test_scope_leaves_packages_inside_out(spark):
    paths = ["p/plugin.json", "p/a/SKILL.md", "p/in/plugin.json", "p/in/x.md", "q/SKILL.md", "q/sub/y", "z.md"]
    inventory = spark.createDataFrame([("s", p) for p in paths] + [("t", "p/a/SKILL.md")], "source_id string, path string")
    boundaries = spark.createDataFrame([("s", "p"), ("s", "p/in")], "source_id string, root string")
    reviews = spark.createDataFrame(
        [("s", "p/a", "p/a/SKILL.md", "p", "p/plugin.json"), ("s", "q", "q/SKILL.md", None, None), ("t", "p/a", "p/a/SKILL.md", None, None)],
        "source_id string, root string, entrypoint string, boundary_root string, boundary_manifest string",
    )
    got = sorted((r.source_id, r.root, r.path) for r in E.review_scope(inventory, reviews, boundaries).collect())
    assert got == [("s", "p/a", "p/a/SKILL.md"), ("s", "p/a", "p/plugin.json"), ("s", "q", "q/SKILL.md"), ("s", "q", "q/sub/y"), ("t", "p/a", "p/a/SKILL.md")]
