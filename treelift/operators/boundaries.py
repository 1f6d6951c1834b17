"""Package boundaries and candidate directories of source trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelift.functions.json_values import MOST_NODES, walk
from treelift.functions.paths import ancestors, component_key, depth, file_name, parent, relative_to
from treelift.sources.scratch import Scratch

#: Manifest locations and the kind of each.
METADATA_MANIFESTS = {
    ".plugin/plugin.json": "plugin_metadata",
    ".claude-plugin/plugin.json": "claude_plugin",
    ".codex-plugin/plugin.json": "codex_plugin",
    ".cursor-plugin/plugin.json": "cursor_plugin",
    ".github/plugin/plugin.json": "github_plugin",
}
ROOT_MANIFESTS = {"plugin.json": "plugin", "gemini-extension.json": "gemini_extension", "openclaw.plugin.json": "openclaw_plugin"}
#: Keys of a package.json that mark a plugin, and keys that declare something to run.
PACKAGE_MARKERS = ["openclaw", "claudePlugin", "codexPlugin", "cursorPlugin", "geminiExtension", "plugin"]
RUNTIME_KEYS = [
    "agent", "agents", "bin", "command", "commands", "entrypoint", "executable", "executables", "extension", "extensionpath", "extensions",
    "hook", "hooks", "main", "mcp", "mcpserver", "mcpservers", "provider", "providers", "runtime", "script", "scripts", "server", "servers", "source", "src",
]
#: Keys of a package.json that only describes, folders that hold something to run, those of them and others that a skill at a
#: package's root may have, and ends of programs' names.
METADATA_KEYS = [
    "author", "bugs", "contributors", "description", "engines", "funding", "homepage", "keywords", "license", "name", "packageManager",
    "private", "repository", "version",
]
RUNTIME_FOLDERS = [
    "agent", "agents", "bin", "command", "commands", "entrypoint", "executable", "executables", "extension", "extensions", "hook", "hooks", "mcp",
    "mcpserver", "mcpservers", "provider", "providers", "runtime", "script", "scripts", "server", "servers", "source", "src",
]
PAYLOAD_FOLDERS = ["asset", "assets", "reference", "references", "script", "scripts"]
PROGRAM_ENDS = [
    ".bash", ".bat", ".c", ".cc", ".cjs", ".cmd", ".cpp", ".cs", ".cts", ".cxx", ".fish", ".go", ".h", ".hpp", ".java", ".js", ".jsx", ".kt", ".kts", ".lua",
    ".mjs", ".mts", ".php", ".pl", ".ps1", ".py", ".rb", ".rs", ".sh", ".swift", ".ts", ".tsx", ".zsh",
]
#: Files beside skills that don't make a package mixed.
DOC_NAMES = [".editorconfig", ".gitignore", "architecture.md", "code_of_conduct.md", "contributing.md", "security.md"]
DOC_DIRECTORIES = ["docs", "examples"]
MARKETPLACE_NAMES = ["marketplace.json", "marketplace.yaml", "marketplace.yml"]
METADATA_DIRECTORIES = [".plugin", ".claude-plugin", ".codex-plugin", ".cursor-plugin", ".github"]
ENTRYPOINTS = ["SKILL.md", "skill.md"]


def _manifest(path: Column, content: Column, kind: Column) -> Column:
    """(root, manifest kind) if a path is a manifest, else null."""
    found = F.lit(None).cast("struct<root:string,manifest_kind:string>")
    marked = F.arrays_overlap(F.coalesce(F.json_object_keys(content), F.array()), F.array(*map(F.lit, PACKAGE_MARKERS)))
    for container in ("claude", "codex", "cursor", "gemini"):
        marked = marked | F.get_json_object(content, f"$.{container}.extensions").isNotNull()
    package = (file_name(path) == "package.json") & ((kind != "file") | F.coalesce(marked, F.lit(False)))
    found = F.when(package, F.struct(parent(path).alias("root"), F.lit("package_json").alias("manifest_kind"))).otherwise(found)
    for name, label in ROOT_MANIFESTS.items():
        found = F.when(file_name(path) == name, F.struct(parent(path).alias("root"), F.lit(label).alias("manifest_kind"))).otherwise(found)
    for suffix, label in METADATA_MANIFESTS.items():
        inside = (path == suffix) | path.endswith("/" + suffix)
        cut = F.length(path) - len(suffix) - 1
        root = F.when(path == suffix, F.lit(".")).otherwise(F.substr(path, F.lit(1), F.greatest(cut, F.lit(1))))
        found = F.when(inside, F.struct(root.alias("root"), F.lit(label).alias("manifest_kind"))).otherwise(found)
    return found


def _declares_runtime(content: Column) -> Column:
    """Whether a manifest can't be read as an object, has too many nodes, or any key in it declares something to run."""
    names = F.array(*map(F.lit, RUNTIME_KEYS))
    return F.get(F.transform(F.array(walk(content)), lambda nodes: (
        nodes.isNull() | F.coalesce(~F.startswith(F.schema_of_variant(nodes[0]["value"]), F.lit("OBJECT")), F.lit(True)) | (F.size(nodes) > MOST_NODES)
        | F.exists(nodes, lambda n: F.coalesce(F.array_contains(names, component_key(n["key"])), F.lit(False)))
    )), F.lit(0))


def _only_describes(relative: Column, content: Column) -> Column:
    """Whether an entry is the package.json of the root, with keys that describe and no others."""
    keys = F.transform(F.filter(walk(content), lambda n: n["depth"] == 1), lambda n: n["key"])
    known = F.size(F.array_except(keys, F.array(*map(F.lit, METADATA_KEYS)))) == 0
    return F.coalesce((relative == "package.json") & F.startswith(F.ltrim(content), F.lit("{")) & known, F.lit(False))


def _runs_at_root(kind: Column, executable: Column, relative: Column) -> Column:
    """Whether an entry below a package that is itself a skill lies in a folder to run from, or is a program, outside the folders skills have."""
    parts = F.split(relative, "/")
    folders, payload = F.array(*map(F.lit, RUNTIME_FOLDERS)), F.array(*map(F.lit, PAYLOAD_FOLDERS))
    in_payload = F.array_contains(payload, F.lower(parts[0]))
    below = F.transform(F.slice(parts, 2, F.size(parts)), component_key)
    conventional = in_payload & ((F.size(parts) > 1) | (kind == "directory")) & ~F.arrays_overlap(F.array_except(below, payload), folders)
    runs = F.arrays_overlap(F.transform(parts, component_key), folders) & ~conventional
    suffix = F.lower(F.regexp_extract(parts[F.size(parts) - 1], r"^.+(\.[^.]+)$", 1))
    program = (kind == "file") & ~(in_payload & (F.size(parts) > 1)) & (F.coalesce(executable, F.lit(False)) | suffix.isin(PROGRAM_ENDS))
    return F.coalesce(runs | program, F.lit(False))


def manifests(inventory: DataFrame) -> DataFrame:
    """source_id, root, manifest_path, manifest_kind, runtime: one row per manifest."""
    named = inventory.where(F.endswith("path", F.lit(".json")))  # as all manifests are
    found = named.withColumn("m", _manifest(F.col("path"), F.col("content"), F.col("kind"))).where("m is not null")
    return found.select(
        "source_id",
        "m.root",
        F.col("path").alias("manifest_path"),
        "m.manifest_kind",
        F.coalesce((F.col("kind") != "file") | _declares_runtime(F.col("content")), F.lit(True)).alias("runtime"),
    )


def _is_document(relative: Column) -> Column:
    """Documentation, marketplace and distribution files, by their path below the package root."""
    parts = F.split(relative, "/")
    name, single = F.element_at(parts, -1), F.size(parts) == 1
    return (
        (single & F.upper(name).rlike("^(?:README|CHANGELOG|LICENSE)"))
        | (single & F.lower(name).isin(DOC_NAMES))
        | F.lower(parts[0]).isin(DOC_DIRECTORIES)
        | (F.lower(name).isin(MARKETPLACE_NAMES) & (single | F.lower(parts[0]).isin(METADATA_DIRECTORIES)))
    )


def detect_boundaries(inventory: DataFrame) -> DataFrame:
    """One row per manifest; a package is 'mixed' if a manifest in it declares a runtime, or it holds files outside its skills and documents.

    A package that is a skill itself may hold what skills hold, but neither folders to run from nor programs beside those.  Entries meet their
    packages by an equi-join on the exploded ancestors of their path, and are reduced to one flag per package before anything else is joined.
    """
    found = Scratch(inventory.sparkSession, "boundaries").keep(manifests(inventory), "manifests")  # met five times below
    roots = found.select("source_id", "root").distinct()
    skills = inventory.where((F.col("kind") == "file") & file_name(F.col("path")).isin(ENTRYPOINTS))
    skills = skills.select("source_id", parent(F.col("path")).alias("skill")).distinct()
    marked = roots.join(skills.select("source_id", F.col("skill").alias("root"), F.lit(True).alias("is_skill")), ["source_id", "root"], "left")
    executable = F.col("executable") if "executable" in inventory.columns else F.lit(False)
    package_text = F.when(file_name(F.col("path")) == "package.json", F.col("content"))
    entries = inventory.select("source_id", "path", "kind", executable.alias("executable"), package_text.alias("content"), F.explode(ancestors(F.col("path"))).alias("root"))
    entries = entries.join(marked, ["source_id", "root"])
    entries = entries.join(found.select("source_id", F.col("manifest_path").alias("path")), ["source_id", "path"], "left_anti")
    covered = (
        inventory.select("source_id", "path", F.explode(ancestors(F.col("path"))).alias("skill"))
        .join(skills, ["source_id", "skill"])
        .select("source_id", "path", "skill")
    )
    packages = skills.withColumn("root", F.explode(ancestors(F.col("skill")))).join(roots, ["source_id", "root"])
    owned = covered.join(packages, ["source_id", "skill"]).groupBy("source_id", "root", "path").agg(F.bool_or(F.col("skill") != F.col("root")).alias("nested"))
    relative = relative_to(F.col("path"), F.col("root"))
    in_folder = F.coalesce(F.arrays_overlap(F.transform(F.split(relative, "/"), component_key), F.array(*map(F.lit, RUNTIME_FOLDERS))), F.lit(False))
    at_root = F.coalesce("is_skill", F.lit(False))
    loose = (
        entries.where(~F.coalesce(_is_document(relative), F.lit(False)) & ~_only_describes(relative, F.col("content")))
        .join(owned, ["source_id", "root", "path"], "left")
        .where(~(at_root & F.coalesce("nested", F.lit(False))))
        .where((at_root & _runs_at_root(F.col("kind"), F.col("executable"), relative)) | (F.col("nested").isNull() & ((F.col("kind") != "directory") | in_folder)))
        .groupBy("source_id", "root")
        .agg(F.lit(True).alias("loose"))
    )
    inside = found.select("source_id", "runtime", F.explode(ancestors(F.col("manifest_path"))).alias("root")).join(roots, ["source_id", "root"])
    runs = inside.groupBy("source_id", "root").agg(F.bool_or("runtime").alias("runs"))
    kinds = runs.join(loose, ["source_id", "root"], "left").select(
        "source_id", "root", F.when(F.col("runs") | F.coalesce("loose", F.lit(False)), "mixed").otherwise("skills_only").alias("package_kind")
    )
    return found.join(kinds, ["source_id", "root"]).select("source_id", "root", "manifest_path", "manifest_kind", "package_kind")


def discover(inventory: DataFrame, boundaries: DataFrame, scope: str = ".") -> DataFrame:
    """source_id, root, entrypoint, both (entrypoints exist), boundary_root, boundary_manifest, package_kind (of the innermost boundary or null)."""
    named = inventory.where(F.col("kind").isin("file", "symlink") & file_name(F.col("path")).isin(ENTRYPOINTS))
    if scope != ".":
        named = named.where((F.col("path") == scope) | F.startswith("path", F.lit(scope + "/")))
    found = named.groupBy("source_id", parent(F.col("path")).alias("root")).agg(
        F.min("path").alias("entrypoint"),  # the large letters sort first
        (F.count("*") == 2).alias("both"),
    )
    around = found.select("source_id", F.col("root").alias("candidate"), F.explode(ancestors(F.col("root"))).alias("root")).join(
        boundaries, ["source_id", "root"]
    )
    inner = around.groupBy("source_id", F.col("candidate").alias("root")).agg(
        F.min_by(F.struct("root", "manifest_path", "package_kind"), F.struct(-depth(F.col("root")), "manifest_path")).alias("b")
    )
    return found.join(inner, ["source_id", "root"], "left").select(
        "source_id",
        "root",
        "entrypoint",
        "both",
        F.col("b.root").alias("boundary_root"),
        F.col("b.manifest_path").alias("boundary_manifest"),
        F.col("b.package_kind").alias("package_kind"),
    )
