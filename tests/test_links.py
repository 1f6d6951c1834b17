import random

import pytest

from treelift.operators import links as L

SCHEMA = "source_id string, path string, kind string, symlink_target string"


def make(spark, *trees):
    rows = []
    for k, tree in enumerate(trees):
        for path, link in tree.items():
            rows.append((f"s{k}", path, "symlink" if link is not None else "file", link))
    return spark.createDataFrame(rows, SCHEMA)


def collapse(base, value):
    out = [] if base == "." else base.split("/")
    for part in value.split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out) or "."


def up(path):
    return path.rpartition("/")[0] or "."


def within(path, root):
    return root == "." or path == root or path.startswith(root + "/")


def folders(tree):
    out = {"."}
    for path in tree:
        while path != ".":
            path = up(path)
            out.add(path)
    return out


def walk(tree, path, root="."):
    """One link after the other. Returns (outcome, hops, value or terminal)."""
    seen, hops, last = set(), 0, ""
    while True:
        parts = path.split("/")
        link = next((p for k in range(1, len(parts) + 1) if tree.get(p := "/".join(parts[:k])) is not None), None)
        if link is None:
            there = path in tree or path in folders(tree)
            return ("resolved" if there else "dangling", hops, path, last)
        if hops >= 64:
            return ("limit", hops, None, last)
        if path in seen:
            return ("cycle", hops, None, tree[link])
        seen.add(path)
        hops, last = hops + 1, tree[link]
        if last.startswith("/"):
            return ("escape", hops, None, last)
        to = collapse(up(link), last)
        if to is None or not within(to, root):
            return ("escape", hops, None, f"{last} -> {to or '<outside snapshot>'}")
        path = collapse(to, path[len(link) + 1 :])


def cyclic_links(tree, root):
    """Folders and links as a graph; a link is cyclic if its folder can be reached from its target."""
    inside = {f for f in folders(tree) if within(f, root)} | {root}
    edges = {(up(f), f) for f in inside if f != root}
    ends = {}
    for path, link in tree.items():
        if link is not None and within(path, root) and path != root:
            outcome, _, end, _ = walk(tree, path, root)
            if outcome == "resolved" and end in inside or outcome == "dangling" and end == root:
                ends[path] = end
                edges.add((up(path), end))
    out = set()
    for path, end in ends.items():
        seen, todo = {end}, [end]
        while todo:
            n = todo.pop()
            for a, b in edges:
                if a == n and b not in seen:
                    seen.add(b)
                    todo.append(b)
        if up(path) in seen:
            out.add(path)
    return out, ends


def found(spark, tree):
    return {r.path: (r.outcome, r.hops, r.terminal) for r in L.close_links(make(spark, tree)).collect()}


def test_links_below_links(spark):
    tree = {"dir/x": "y", "dir/y": None, "d": "dir", "a": "d/x", "d2": "dir2", "dir2/z": "../dir3", "dir3/f": None, "e": "d2/z/f"}
    got = found(spark, tree)
    assert got["a"] == ("resolved", 3, "dir/y") and got["e"] == ("resolved", 3, "dir3/f")


def test_ends(spark):
    tree = {"p": "q", "q": "p", "to_p": "p", "self": "self", "grow": "grow/x", "out": "../x", "abs": "/etc", "gone": "no", "up": "a/b", "a/c": None, "a/b": "..", "root": "."}
    got = found(spark, tree)
    assert got["p"] == ("cycle", 2, None) and got["to_p"] == ("cycle", 3, None) and got["self"] == ("cycle", 1, None)
    assert got["grow"][0] == "limit" and got["out"][0] == got["abs"][0] == "escape" and got["gone"] == ("dangling", 1, "no")
    assert got["up"] == ("resolved", 2, ".") and got["root"] == ("resolved", 1, ".")


@pytest.mark.parametrize("n,outcome", [(63, "resolved"), (64, "resolved"), (65, "limit"), (200, "limit")])
def test_chain_limit(spark, n, outcome):
    tree = {f"n{k}": f"n{k + 1}" for k in range(n)} | {f"n{n}": None}
    got = found(spark, tree)
    assert got["n0"][0] == outcome and got[f"n{n - 1}"] == ("resolved", 1, f"n{n}")


@pytest.mark.parametrize("n,outcome", [(63, "cycle"), (64, "limit"), (70, "limit")])
def test_long_cycles(spark, n, outcome):
    assert {o for o, _, _ in found(spark, {f"n{k}": f"n{(k + 1) % n}" for k in range(n)}).values()} == {outcome}


def random_tree(seed):
    rnd = random.Random(seed)
    names = ["a", "b", "c", "s", "t"]
    some = lambda: "/".join(rnd.choice(names) for _ in range(rnd.randint(1, 4)))
    tree = {}
    for _ in range(40):
        path = some()
        if any(path == p or path.startswith(p + "/") or p.startswith(path + "/") for p in tree):
            continue
        target = rnd.choice([some(), "../" + some(), "../../" + rnd.choice(names), ".", "..", "./" + some(), "/x"])
        tree[path] = target if rnd.random() < 0.6 else None
    return tree


def test_random_trees(spark):
    trees = [random_tree(seed) for seed in range(60)]
    got = {(r.source_id, r.path): (r.outcome, r.hops, r.terminal) for r in L.close_links(make(spark, *trees)).collect()}
    want = {(f"s{k}", p): walk(t, p)[:3] for k, t in enumerate(trees) for p, link in t.items() if link is not None}
    assert {o for o, _, _ in want.values()} == {"resolved", "dangling", "escape", "cycle"} | ({"limit"} & {o for o, _, _ in want.values()})
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {} and got.keys() == want.keys()


def test_evidence_of_random_trees(spark):
    trees = [random_tree(seed) for seed in range(100, 150)]
    roots = [(f"s{k}", root) for k, t in enumerate(trees) for root in (".", "a", "b/c", "s") if root in folders(t)]
    closed = L.close_links(make(spark, *trees))
    got = {(r.source_id, r.root, r.path): (r.code, r.value) for r in L.link_evidence(closed, spark.createDataFrame(roots, "source_id string, root string")).collect()}
    want = {}
    for source, root in roots:
        tree = trees[int(source[1:])]
        cycles, ends = cyclic_links(tree, root)
        for path, link in tree.items():
            if link is None or not within(path, root) or path == root:
                continue
            outcome, _, end, value = walk(tree, path, root)
            if path in cycles:
                want[source, root, path] = ("SYMLINK_CYCLE", f"{link} -> {ends[path]}")
            elif outcome == "escape":
                want[source, root, path] = ("SYMLINK_ESCAPE", value)
            elif outcome == "cycle":
                want[source, root, path] = ("DYNAMIC_REFERENCE_UNRESOLVED", f"{value} (cycle)")
            elif outcome == "limit":
                want[source, root, path] = ("DYNAMIC_REFERENCE_UNRESOLVED", "chain exceeds 64 links")
            elif outcome == "dangling" and end != root:
                want[source, root, path] = ("MISSING_LOCAL_RESOURCE", f"{value} -> {end}")
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
    assert len({c for c, _ in want.values()}) == 4


def test_cyclic_edges(spark):
    rnd = random.Random(4)
    edges, want = set(), set()
    for g in range(25):
        n = rnd.randint(2, 12)
        own = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(1, 18))}
        reach = {a: {b for x, b in own if x == a} for a in range(n)}
        for _ in range(n):
            for a in range(n):
                for b in list(reach[a]):
                    reach[a] |= reach[b]
        edges |= {(f"g{g}", f"{a:02}", f"{b:02}") for a, b in own}
        want |= {(f"g{g}", f"{a:02}", f"{b:02}") for a, b in own if a in reach[b] or a == b}
    got = L.cyclic_edges(spark.createDataFrame(sorted(edges), "group string, a string, b string"))
    assert {tuple(r) for r in got.collect()} == want
    assert L.cyclic_edges(spark.createDataFrame([], "group string, a string, b string")).count() == 0


def test_follow(spark):
    trees = [random_tree(seed) for seed in range(20)]
    rnd = random.Random(7)
    paths = [(f"s{k}", "/".join(rnd.choice("abcst") for _ in range(rnd.randint(1, 4)))) for k in range(20) for _ in range(12)]
    closed = L.close_links(make(spark, *trees))
    got = {(r.source_id, r.path): r.terminal for r in L.follow(spark.createDataFrame(paths, "source_id string, path string"), closed).collect()}
    for source, path in set(paths):
        outcome, _, end, _ = walk(trees[int(source[1:])], path)
        assert got[source, path] == (end if outcome in ("resolved", "dangling") else None), (source, path)
