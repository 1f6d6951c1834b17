"""What a reviewer is shown of a package: which files, in which order, and how many of them fit into a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelift.functions.paths import ancestors, depth, file_name, is_within, parent
from treelift.operators.decisions import is_sensitive, redaction
from treelift.sources.scratch import Scratch

#: Folders and ends of files that come before the rest, characters that must be left for another file, and those that one
#: character can take in JSON.
RUNTIME_PARTS = [
    "agent", "agents", "bin", "command", "commands", "config", "configs", "hook", "hooks", "mcp", "provider", "providers", "runtime",
    "script", "scripts", "server", "servers", "src", "workflow", "workflows",
]
CODE_ENDS = [".cjs", ".js", ".json", ".mjs", ".py", ".sh", ".toml", ".ts", ".yaml", ".yml"]
LEAST_LEFT = 160
WIDEST = 6
BUDGET = 128 * 1024
#: Line ends of a shown text.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"
#: Rows of one review that a task looks at together; more than the budget holds records.
BLOCK = 1024
_KEY = ["source_id", "root"]


def priority(path: Column, entrypoint: Column, root: Column, manifest: Column, cited: Column) -> Column:
    """0 the entrypoint, 1 the candidate's own, 2 the package's manifest, 3 cited, runtime and code files, 4 the rest."""
    parts, name = F.split(F.lower(path), "/"), F.lower(file_name(path))
    code = F.arrays_overlap(parts, F.array(*map(F.lit, RUNTIME_PARTS)))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    near = F.when(F.coalesce(is_within(path, root), F.lit(False)), 1).when(F.coalesce(path == manifest, F.lit(False)), 2)
    return F.when(F.coalesce(path == entrypoint, F.lit(False)), 0).otherwise(near.when(F.coalesce(cited, F.lit(False)) | code | suffix.isin(CODE_ENDS), 3).otherwise(4))


def review_scope(inventory: DataFrame, reviews: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The entries that lie in a review's package and in none inside it; without a package those below the candidate.

    reviews: source_id, root, entrypoint, boundary_root, boundary_manifest.  An entry meets the roots above it by equality.
    """
    roots = boundaries.select("source_id", F.col("root").alias("above")).distinct()
    above = inventory.select("source_id", "path", F.explode(ancestors(F.col("path"))).alias("above"))
    inner = above.join(roots, ["source_id", "above"]).groupBy("source_id", "path").agg(F.max_by("above", depth(F.col("above"))).alias("inner"))
    packed = inventory.join(inner, ["source_id", "path"], "left")
    of_package = packed.join(reviews.where("boundary_root is not null").withColumn("inner", F.col("boundary_root")), ["source_id", "inner"])
    free = reviews.where("boundary_root is null").withColumnRenamed("root", "above")
    of_candidate = above.join(free, ["source_id", "above"]).withColumnRenamed("above", "root").join(packed, ["source_id", "path"]).where("inner is null")
    return of_package.unionByName(of_candidate).drop("inner")


def file_records(entries: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The entries that may be shown, with their order and what they need: sensitive, binary and redacted paths are left out.

    priority, need (characters that must be left to try the entry), raw (those to show its text or target), whole and least (characters of
    its record with and without them; whole is null where the budget can't hold the text), cuttable (a text may be left out afterwards).
    """
    shown = entries.where(~is_sensitive(F.col("path")) & ((F.col("kind") != "file") | F.col("content").isNotNull()))
    shown = shown.where(redaction(F.col("path"))["redacted"] == F.col("path"))
    text = F.coalesce("content", "symlink_target")
    rows = shown.withColumns({"need": WIDEST * F.length("path"), "raw": F.coalesce(WIDEST * F.length(text), F.lit(0)), "cuttable": F.col("content").isNotNull()})
    rows = rows.withColumn("redacted", F.when(text.isNotNull() & (F.col("raw") <= budget), redaction(text)["redacted"]))
    ended = F.regexp_replace("redacted", f"(?:{LINE_END})\\z", "")
    lines = F.when(F.col("redacted") != "", F.transform(F.split(ended, LINE_END), lambda value, at: F.struct((at + 1).alias("line"), value.alias("value"))))
    none = F.array().cast("array<struct<line:int,value:string>>")

    def chars(lines: Column, target: Column) -> Column:
        digest = F.when(F.col("kind") == "file", F.lit("0" * 64))  # every digest is as long
        fields = F.struct("executable", "kind", lines.alias("lines"), "path", digest.alias("sha256"), "size", target.alias("symlinkTarget"))
        return F.length(F.to_json(fields, {"ignoreNullFields": "false"})).cast("long")

    target = F.when(~F.col("cuttable"), F.col("redacted"))
    cut_target = F.when(~F.col("cuttable") & F.col("symlink_target").isNotNull(), F.lit("<TRUNCATED>"))
    whole = F.when(F.col("raw") <= budget, chars(F.when(F.col("cuttable"), F.coalesce(lines, none)).otherwise(none), target))
    cited = F.col("cited") if "cited" in entries.columns else F.lit(False)
    order = priority(F.col("path"), F.col("entrypoint"), F.col("root"), F.col("boundary_manifest"), cited)
    return rows.select(*_KEY, "path", order.alias("priority"), "need", "raw", whole.alias("whole"), chars(none, cut_target).alias("least"), "cuttable")


_STATE = "struct<used:bigint,n:int,stop:boolean,taken:array<struct<n:int,path:string,cut:boolean,chars:bigint,reach:bigint>>>"


def _fill(rows: Column, start: Column, budget: int) -> Column:
    """The state after a block: characters used, files taken, whether the end is reached, and the files of this block."""

    def step(s: Column, x: Column) -> Column:
        gap = F.when(s["n"] > 0, 1).otherwise(0)
        left = budget - s["used"] - gap
        cut = (x["raw"] > left) | (x["cuttable"] & (x["whole"] > left))
        size = F.when(cut, x["least"]).otherwise(x["whole"])
        tried = x["need"] <= left
        stop = s["stop"] | (left < LEAST_LEFT) | (tried & (size > left))
        take, reach = ~stop & tried, s["used"] + gap + size
        file = F.struct((s["n"] + 1).alias("n"), x["path"].alias("path"), cut.alias("cut"), size.alias("chars"), reach.alias("reach"))
        return F.when(
            take, F.struct(reach.alias("used"), (s["n"] + 1).alias("n"), stop.alias("stop"), F.array_append(s["taken"], file).alias("taken")).cast(_STATE)
        ).otherwise(F.struct(s["used"], s["n"], stop.alias("stop"), s["taken"]).cast(_STATE))

    return F.aggregate(rows, start, step)


def fill_budgets(records: DataFrame, scratch: Scratch, budget: int = BUDGET) -> DataFrame:
    """source_id, root, n, path, cut, chars, reach: the files of each review in order, until the budget is full.

    A file whose path may not fit is passed over; one whose text doesn't fit is shown without it; where even that doesn't fit, or where less
    than LEAST_LEFT is left, the review ends.  Rows are dealt in order to blocks, and a block's least need tells whether any of its rows can be
    tried with what is left.  A round leaps to each review's next such block and goes through it; each block visited takes a file or ends the review, so no
    review is gathered and rounds are at most as many as files fit.  Equal paths of a review come in any order.
    """
    order = [*_KEY, "priority", "path"]
    placed = records.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = scratch.keep(placed.withColumn("block", F.floor(F.col("place") / BLOCK)), "placed")
    blocks = scratch.keep(placed.groupBy(*_KEY, "block").agg(F.min("need").alias("need")), "blocks")
    empty = F.array().cast("array<struct<n:int,path:string,cut:boolean,chars:bigint,reach:bigint>>")
    open_ = blocks.groupBy(*_KEY).agg(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(-1).cast("long").alias("seen"))
    done = []
    while True:
        left = budget - F.col("used") - F.when(F.col("n") > 0, 1).otherwise(0)
        ahead = blocks.join(open_, _KEY).where((F.col("block") > F.col("seen")) & (F.col("need") <= left) & (left >= LEAST_LEFT))
        chosen = ahead.groupBy(*_KEY, "used", "n").agg(F.min("block").alias("block"))
        fields = F.struct("place", "path", "need", "raw", "whole", "least", "cuttable")
        rows = placed.join(chosen, [*_KEY, "block"]).groupBy(*_KEY, "block", "used", "n").agg(F.array_sort(F.collect_list(fields)).alias("rows"))
        start = F.struct("used", "n", F.lit(False).alias("stop"), empty.alias("taken")).cast(_STATE)
        state = scratch.keep(rows.select(*_KEY, "block", _fill(F.col("rows"), start, budget).alias("s")), "state")
        if state.isEmpty():
            break
        done.append(state)
        open_ = state.where("not s.stop").select(*_KEY, "s.used", "s.n", F.col("block").alias("seen"))
    found = state
    for one in done:
        found = found.unionByName(one)
    return found.select(*_KEY, F.explode("s.taken").alias("f")).select(*_KEY, "f.*")


def review_status(records: DataFrame, shown: DataFrame) -> DataFrame:
    """source_id, root, n_files, n_shown, n_truncated (files that aren't shown whole), n_chars (of all records with the commas between)."""
    of = records.groupBy(*_KEY).agg(F.count("*").alias("n_files"))
    fit = shown.groupBy(*_KEY).agg(F.count("*").alias("n_shown"), F.count_if(~F.col("cut")).alias("whole"), F.max("reach").alias("n_chars"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return of.join(fit, _KEY, "left").select(
        *_KEY, "n_files", zero("n_shown").alias("n_shown"), (F.col("n_files") - zero("whole")).alias("n_truncated"), zero("n_chars").alias("n_chars")
    )
