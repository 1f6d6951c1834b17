"""Symbolic links of source trees: where they and paths through them lead, and which of them close a cycle of directories.

A path is resolved link by link: the shortest part of it that is a link is replaced by the link's target, until no part is a link.
All links of all trees are resolved at once by doubling: a path that runs through a link takes over everything that is
already known of that link, so chains of the 64 links that are followed at most take seven rounds.  Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelift.functions.paths import ancestors, bounded, collapse, is_host_reference, is_within, parent
from treelift.sources.scratch import Scratch

MAX_LINKS = 64
ROUNDS = MAX_LINKS.bit_length()


def with_folders(inventory: DataFrame) -> DataFrame:
    """source_id, path, kind of all entries, and of the folders that follow from them."""
    given = inventory.select("source_id", "path", "kind")
    above = inventory.select("source_id", F.explode(ancestors(parent(F.col("path")))).alias("path")).distinct()
    folders = above.join(given, ["source_id", "path"], "left_anti").withColumn("kind", F.lit("directory"))
    return given.unionByName(folders)


def _below(base: Column, suffix: Column) -> Column:
    """A path and what follows it: '' or '/...'."""
    return F.when(suffix == "", base).when(base == ".", F.substr(suffix, F.lit(2))).otherwise(F.concat(base, suffix))


def _through(active: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (source_id, at, ...) whose path runs through a link, with the link, what follows it, and what is known of it.

    known has one row a link; only links that lie below no other link are in it, so a path runs through one of them at most.
    """
    parts = active.withColumn("link", F.explode(ancestors(F.col("at"))))
    return parts.join(known, ["source_id", "link"]).withColumn("suffix", F.substr("at", F.length("link") + 1))


def _walked(trail: Column, suffix: Column) -> Column:
    return F.transform(trail, lambda s: s.withField("state", F.concat(s["state"], suffix)))


def close_links(inventory: DataFrame) -> DataFrame:
    """source_id, path, symlink_target, trail, hops, terminal, kind, outcome of every symbolic link.

    trail: an element for each link that is followed: state (the path so far), link, target (as written) and resolved (the path
    that the target means; null if it leaves the tree or names the machine).  outcome: resolved (kind tells what lies there), dangling, escape,
    cycle (hops: links until a path comes back), or limit (more than 64 links).
    """
    scratch = Scratch(inventory.sparkSession, "links")
    links = inventory.where((F.col("kind") == "symlink") & F.col("path").isNotNull()).select("source_id", "path", F.coalesce("symlink_target", F.lit("")).alias("symlink_target"))
    resolved = F.when(~is_host_reference(F.col("symlink_target")), collapse(parent(F.col("path")), F.col("symlink_target")))
    one = F.struct(F.col("path").alias("state"), F.col("path").alias("link"), F.col("symlink_target").alias("target"), resolved.alias("resolved"))
    step = scratch.keep(links.select("*", F.array(one).alias("trail"), resolved.alias("at")), "links")
    above = step.select("source_id", F.col("path").alias("inner"), F.explode(ancestors(parent(F.col("path")))).alias("path"))
    inner = above.join(step.select("source_id", "path"), ["source_id", "path"]).select("source_id", F.col("inner").alias("path")).distinct()
    tops = scratch.keep(step.select("source_id", "path").join(inner, ["source_id", "path"], "left_anti"), "tops")
    done: list[DataFrame] = []
    active, known = step, step
    for _ in range(ROUNDS):
        lookup = known.join(tops, ["source_id", "path"], "left_semi").select("source_id", F.col("path").alias("link"), F.col("at").alias("end"), F.col("trail").alias("more"))
        moved = _through(active.where("at is not null"), lookup)
        trail = F.slice(F.concat("trail", _walked(F.col("more"), F.col("suffix"))), 1, MAX_LINKS + 1)
        moved = moved.select("source_id", "path", "symlink_target", trail.alias("trail"), _below(F.col("end"), F.col("suffix")).alias("at"))
        moved = scratch.keep(moved, "moved")
        if moved.isEmpty():
            break
        done.append(active.join(moved.select("source_id", "path"), ["source_id", "path"], "left_anti"))
        over = F.size("trail") > MAX_LINKS
        states = F.transform("trail", lambda s: s["state"])
        over |= F.size(F.array_distinct(states)) < F.size("trail")
        done.append(moved.where(over))
        active = moved.where(~over)
        known = scratch.keep(known.join(moved.select("source_id", "path"), ["source_id", "path"], "left_anti").unionByName(moved), "known")
    final = active
    for part in done:
        final = final.unionByName(part)
    return _outcomes(final, with_folders(inventory))


def _outcomes(closed: DataFrame, entries: DataFrame) -> DataFrame:
    states = F.transform("trail", lambda s: s["state"])
    places = F.sequence(F.lit(1), F.least(F.size("trail"), F.lit(MAX_LINKS)))
    first_again = F.array_min(F.filter(places, lambda k: F.array_position(states, F.get(states, k - 1)) < k))
    again = F.when(F.size(F.array_distinct(states)) < F.size(states), first_again)
    at = closed.withColumn("again", again).withColumn("terminal", F.when(F.col("again").isNull() & (F.size("trail") <= MAX_LINKS), F.col("at")))
    outcome = (
        F.when(F.col("again").isNotNull(), "cycle")
        .when(F.size("trail") > MAX_LINKS, "limit")
        .when(F.col("terminal").isNull(), "escape")
        .when(F.col("kind").isNull(), "dangling")
        .otherwise("resolved")
    )
    kinds = entries.select("source_id", F.col("path").alias("terminal"), "kind")
    joined = at.join(kinds, ["source_id", "terminal"], "left")
    hops = F.coalesce(F.col("again") - 1, F.least(F.size("trail"), F.lit(MAX_LINKS)))
    return joined.select("source_id", "path", "symlink_target", "trail", hops.alias("hops"), "terminal", "kind", outcome.alias("outcome"))


def follow(paths: DataFrame, closed: DataFrame) -> DataFrame:
    """source_id, path, terminal: where paths (source_id, path) lead through links; null where a link fails.

    Every round replaces one link and all behind it; a path needs more rounds only for links below linked folders.
    """
    scratch = Scratch(paths.sparkSession, "paths")
    ends = closed.select("source_id", F.col("path").alias("link"), F.when(F.col("outcome").isin("resolved", "dangling"), F.col("terminal")).alias("end"))
    inner = ends.select("source_id", "link", F.explode(ancestors(parent(F.col("link")))).alias("above")).join(ends.select("source_id", F.col("link").alias("above")), ["source_id", "above"])
    known = ends.join(inner.select("source_id", "link").distinct(), ["source_id", "link"], "left_anti")
    active = scratch.keep(paths.select("source_id", "path").distinct().withColumn("at", F.col("path")), "paths")
    done: list[DataFrame] = []
    for _ in range(MAX_LINKS):
        moved = _through(active.where("at is not null"), known).select("source_id", "path", _below(F.col("end"), F.col("suffix")).alias("at"))
        moved = scratch.keep(moved, "moved")
        if moved.isEmpty():
            break
        done.append(active.join(moved.select("source_id", "path"), ["source_id", "path"], "left_anti"))
        active = moved
    else:
        active = active.withColumn("at", F.lit(None).cast("string"))
    for part in done:
        active = active.unionByName(part)
    return active.withColumnRenamed("at", "terminal")


_EDGE = ["group", "a", "b"]


def _both(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes (group, node) of a table."""
    return edges.join(nodes.withColumnRenamed("node", "a"), ["group", "a"], "left_semi").join(nodes.withColumnRenamed("node", "b"), ["group", "b"], "left_semi").select(*_EDGE)


def _trimmed(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Edges that are left once those that nothing leads to, or that lead nowhere, are taken away again and again."""
    n = edges.count()
    while n:
        entered, left = edges.select("group", F.col("b").alias("a")).distinct(), edges.select("group", F.col("a").alias("b")).distinct()
        fewer = scratch.keep(edges.join(entered, ["group", "a"], "left_semi").join(left, ["group", "b"], "left_semi").select(*_EDGE), "edges")
        m = fewer.count()
        edges = fewer
        if m == n:
            break
        n = m
    return edges, n


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """group, a, b: the directed edges whose ends lie in one strongly connected component of their group.

    Forward and backward colouring: every node takes the greatest name that reaches it; the nodes of a colour from which the node of that name can
    be reached back are one component.  Edges between colours go, found components go, and the rest is coloured anew.  Edges on no cycle
    are mostly gone before, by trimming.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    rest = scratch.keep(edges.select(*_EDGE).distinct(), "edges")
    found: list[DataFrame] = []
    while True:
        rest, n = _trimmed(rest, scratch)
        if not n:
            break
        nodes = rest.select("group", F.col("a").alias("node")).unionByName(rest.select("group", F.col("b").alias("node"))).distinct()
        colours = scratch.keep(nodes.withColumn("colour", F.col("node")), "colours")
        changed = colours
        while not changed.isEmpty():  # only what changed in the last round is passed on
            passed = changed.withColumnRenamed("node", "a").join(rest, ["group", "a"]).groupBy("group", F.col("b").alias("node")).agg(F.max("colour").alias("new"))
            joined = scratch.keep(colours.join(passed, ["group", "node"], "left").withColumn("up", F.coalesce(F.col("new") > F.col("colour"), F.lit(False))), "colours")
            colours = joined.select("group", "node", F.greatest("colour", "new").alias("colour"))
            changed = joined.where("up").select("group", "node", F.col("new").alias("colour"))
        ends = [colours.withColumnsRenamed({"node": e, "colour": f"{e}_colour"}) for e in "ab"]
        same = scratch.keep(rest.join(ends[0], ["group", "a"]).join(ends[1], ["group", "b"]).where("a_colour = b_colour").select(*_EDGE), "same")
        reached = scratch.keep(colours.where("node = colour").select("group", "node"), "reached")
        new = reached
        while not new.isEmpty():
            back = same.join(new.withColumnRenamed("node", "b"), ["group", "b"]).select("group", F.col("a").alias("node")).distinct()
            new = scratch.keep(back.join(reached, ["group", "node"], "left_anti"), "new")
            reached = scratch.keep(reached.unionByName(new), "reached")
        found.append(_both(same, reached))
        nodes_left = colours.join(reached, ["group", "node"], "left_anti").select("group", "node")
        rest = scratch.keep(_both(same, nodes_left), "edges")
    out = rest
    for part in found:
        out = out.unionByName(part)
    return out


def candidate_links(closed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links once for each candidate root around them, with how they end if no step may leave the candidate.

    Adds root, failed (the first step that leaves the candidate, if the walk gets that far) and target (the folder it ends in, if it does).
    A walk that ends at the candidate's root ends in a folder even where the tree does not list it.
    """
    rows = closed.withColumn("root", F.explode(ancestors(parent(F.col("path"))))).join(candidates.select("source_id", "root"), ["source_id", "root"])
    out = F.filter(F.slice("trail", 1, F.greatest("hops", F.lit(1))), lambda s: s["resolved"].isNull() | ~is_within(s["resolved"], F.col("root")))
    rows = rows.withColumn("failed", F.get(out, F.lit(0)))
    folder = (F.col("outcome") == "resolved") & (F.col("kind") == "directory") | (F.col("outcome") == "dangling") & (F.col("terminal") == F.col("root"))
    return rows.withColumn("target", F.when(F.col("failed").isNull() & folder, F.col("terminal")))


def folder_cycles(links: DataFrame) -> DataFrame:
    """source_id, root, path: links of :func:`candidate_links` that close a cycle of folders.

    Folders lead to the folders in them, and to where links in them lead.  Only targets of links can be entered otherwise than from above, so they are
    the nodes: each has an edge from the next target above it, and one from the next target around each link that leads to it.
    """
    key = ["source_id", "root"]
    into = links.where("target is not null").select(*key, "path", "target")
    targets = into.select(*key, F.col("target").alias("around")).distinct()

    def nearest(rows: DataFrame, of: Column, name: str) -> DataFrame:
        around = rows.withColumn("around", F.explode(ancestors(of))).join(targets, [*key, "around"])
        return around.groupBy(*key, *[c for c in rows.columns if c not in key]).agg(F.max_by("around", F.when(F.col("around") == ".", 0).otherwise(F.length("around"))).alias(name))

    held = nearest(into, parent(F.col("path")), "a")
    nested = nearest(targets.withColumnRenamed("around", "b").where("b <> '.'"), parent(F.col("b")), "a")
    group = F.struct(*key).alias("group")
    scratch = Scratch(links.sparkSession, "folders")
    held = scratch.keep(held, "held")
    edges = held.select(group, "a", F.col("target").alias("b")).unionByName(nested.select(group, "a", "b"))
    closed = cyclic_edges(edges).select("group.*", "a", F.col("b").alias("target")).distinct()
    return held.join(closed, [*key, "a", "target"], "left_semi").select(*key, "path")


def link_evidence(closed: DataFrame, candidates: DataFrame) -> DataFrame:
    """source_id, root, code, path, line, ord, value: findings on links in candidates.

    A link that closes a cycle of folders is SYMLINK_CYCLE, whatever else; one that leaves the candidate at any step, SYMLINK_ESCAPE; one that comes back to
    itself or is followed more than 64 times, DYNAMIC_REFERENCE_UNRESOLVED; one that ends nowhere, MISSING_LOCAL_RESOURCE.
    """
    scratch = Scratch(closed.sparkSession, "linked")
    links = scratch.keep(candidate_links(closed, candidates), "candidates")
    key = ["source_id", "root", "path"]
    rows = links.join(folder_cycles(links).withColumn("cyclic", F.lit(True)), key, "left")
    arrow = lambda a, b: F.concat(a, F.lit(" -> "), b)
    last = F.element_at("trail", -1)["target"]
    repeated = F.get(F.col("trail"), F.col("hops"))["target"]
    host = is_host_reference(F.col("failed.target"))
    cases = [
        (F.col("cyclic"), "SYMLINK_CYCLE", arrow(F.col("symlink_target"), F.col("target"))),
        (F.col("failed").isNotNull() & host, "SYMLINK_ESCAPE", F.col("failed.target")),
        (F.col("failed").isNotNull(), "SYMLINK_ESCAPE", arrow(F.col("failed.target"), F.coalesce("failed.resolved", F.lit("<outside snapshot>")))),
        (F.col("outcome") == "cycle", "DYNAMIC_REFERENCE_UNRESOLVED", F.concat(repeated, F.lit(" (cycle)"))),
        (F.col("outcome") == "limit", "DYNAMIC_REFERENCE_UNRESOLVED", F.lit(f"chain exceeds {MAX_LINKS} links")),
        ((F.col("outcome") == "dangling") & F.col("target").isNull(), "MISSING_LOCAL_RESOURCE", arrow(last, F.col("terminal"))),
    ]
    code = value = F.lit(None).cast("string")
    for when, name, shown in reversed(cases):
        code, value = F.when(when, name).otherwise(code), F.when(when, shown).otherwise(value)
    told = rows.select(*key, code.alias("code"), bounded(value).alias("value")).where("code is not null")
    return told.select("source_id", "root", "code", "path", F.lit(None).cast("int").alias("line"), F.lit(0).alias("ord"), "value")
