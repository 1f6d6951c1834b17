"""Registry of the queries over source trees, each with the SQL that gives the same rows.

All of them work on the inventory that is derived from the documents table, or on the tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelift.functions.identity import candidate_id, content_hashes, snapshot_hashes
from treelift.functions.paths import ancestors, file_name
from treelift.operators import boundaries as B
from treelift.operators import decisions as D
from treelift.operators import envelopes as E
from treelift.operators import inert as I
from treelift.operators import links as L
from treelift.operators import references as R
from treelift.operators import responses as P
from treelift.operators import structured as S
from treelift.operators.markdown import markdown_references as markdown_rows
from treelift.operators.refs import resolve_refs
from treelift.operators.review import resolve_lines, shown_lines
from treelift.sources.archives import admitted, pack_documents, refused_sources, untar
from treelift.sources.derived import DUCKDB_CONFIGURED, DUCKDB_INVENTORY, inventory, paths
from treelift.sources.scratch import Scratch
from treelift.sources.tables import table
from treelift.sources.trees import read_trees, write_trees

URL = "https://trees.example/"
DOMAIN = "package-content-v1"
ID_RANGE = 1000


def inventory_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).select("source_id", "path", "kind", "size", "sha256")


def snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_hashes(inventory(spark, sf_dir))


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _Tree(spark, inventory(spark, sf_dir))
    members = tree.paths.select("*", F.explode(ancestors(F.col("path"))).alias("root")).join(tree.candidates.select("source_id", "root"), ["source_id", "root"])
    return content_hashes(members, DOMAIN)


def package_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.detect_boundaries(inventory(spark, sf_dir))


def ancestor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inventory(spark, sf_dir).select("source_id", "size", F.explode(ancestors(F.col("path"))).alias("root"))
    return rows.groupBy("source_id", "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


class _Tree:
    """The inventory, and what several joins need of it as written tables: paths (with the texts of small declaring files,
    not of entrypoints), package boundaries and candidates. Entrypoints' texts are read from the source where they are looked into."""

    def __init__(self, spark: SparkSession, rows: DataFrame) -> None:
        self.scratch = Scratch(spark, "trees")
        self.full = self.scratch.keep(rows, "inventory")
        text = F.when(~file_name(F.col("path")).isin(B.ENTRYPOINTS), F.col("content"))
        self.paths = self.scratch.keep(self.full.withColumn("content", text), "paths")
        self.boundaries = self.scratch.keep(B.detect_boundaries(self.paths), "boundaries")
        self.candidates = self.scratch.keep(B.discover(self.paths, self.boundaries), "candidates")


def innermost_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _Tree(spark, inventory(spark, sf_dir)).candidates
    revision = F.lit("0" * 40)
    return found.select(
        "source_id", "root", "entrypoint", "boundary_root", "boundary_manifest", "package_kind",
        candidate_id(F.concat(F.lit(URL), "source_id"), revision, F.col("root")).alias("candidate_id"),
    )


def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _Tree(spark, inventory(spark, sf_dir))
    return R.frontmatter(tree.full, tree.candidates)


def path_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _Tree(spark, inventory(spark, sf_dir))
    refs = tree.scratch.keep(R.references(tree.full), "references")
    return R.resolve(refs, tree.paths, tree.candidates).select("source_id", "root", "path", "value", "target", "outcome")


def link_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every symbolic link ends, through chains of links and linked folders."""
    return L.close_links(paths(spark, sf_dir)).select("source_id", "path", "terminal", "hops", "outcome")


def _findings(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    tree = _Tree(spark, rows)
    hinted = tree.scratch.keep(R.with_symbols(tree.full), "hinted")  # a small part of the texts, which is all that symbols are looked up in
    every = tree.scratch.keep(R.references(tree.full, hinted), "references")
    refs = tree.scratch.keep(I.active_references(every, hinted), "active")
    fields = tree.scratch.keep(R.frontmatter(tree.full, tree.candidates), "frontmatter")
    callers = R.reverse_references(tree.paths, tree.candidates, tree.boundaries, fields)
    literals = tree.scratch.keep(I.residual_literals(tree.paths, tree.candidates), "literals")
    resolved = R.resolve(refs, tree.paths, tree.candidates)
    found = D.evidence(resolved, refs, tree.candidates, fields, callers)
    found = found.unionByName(I.residual_evidence(literals, R.resolve(literals, tree.paths, tree.candidates), tree.candidates))
    for more in (
        L.link_evidence(L.close_links(tree.paths), tree.candidates),
        D.collision_evidence(tree.paths, tree.candidates),
        D.limit_evidence(tree.paths, tree.candidates),
        D.package_evidence(tree.boundaries, tree.candidates),
        D.symbol_evidence(refs, tree.candidates, R.owned_symbols(tree.paths, tree.boundaries)),
    ):
        found = found.unionByName(more)
    return tree.candidates, tree.scratch.keep(found, "evidence")


def runtime_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _Tree(spark, inventory(spark, sf_dir))
    return R.reverse_references(tree.paths, tree.candidates, tree.boundaries, R.frontmatter(tree.full, tree.candidates))


def inert_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols in comments, literals, samples and foreign blocks, which give no evidence."""
    tree = _Tree(spark, inventory(spark, sf_dir))
    hinted = tree.scratch.keep(R.with_symbols(tree.full), "hinted")
    refs = tree.scratch.keep(R.references(tree.full, hinted).where("col is not null"), "references")
    active = I.active_references(refs, hinted)
    return refs.join(active, ["source_id", "path", "line", "ord", "syntax"], "left_anti").select("source_id", "path", "line", "syntax", "value", "col")


def residual_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals in candidates' programs that lead out of them."""
    tree = _Tree(spark, inventory(spark, sf_dir))
    literals = tree.scratch.keep(I.residual_literals(tree.paths, tree.candidates), "literals")
    return I.residual_evidence(literals, R.resolve(literals, tree.paths, tree.candidates), tree.candidates).drop("ord", "code")


def structured_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What JSON files in candidates refer to: fields, lists, and patterns with the files that they match."""
    tree = _Tree(spark, inventory(spark, sf_dir, configured=True))
    return S.json_references(tree.paths, tree.candidates, tree.scratch).select("source_id", "root", "path", "line", "syntax", "value")


def ref_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs as routes of their host: the ref by the longest name that a third of the pages gives, then scope and target."""
    url = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]+://([^/?#]*)/?([^?#]*)", 2)
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]+://([^/?#]*)", 1).alias("repo"), F.rtrim(url, F.lit("/")).alias("route"))
    head = F.split_part("route", F.lit("/"), F.lit(1))
    name = F.when(F.col("page_id") % 3 == 0, head).when(F.col("page_id") % 3 == 1, F.col("route"))
    names = pages.select("repo", name.alias("name")).where("name <> ''")
    routes = pages.withColumns({
        "kind": F.when(F.col("page_id") % 2 == 0, "tree").otherwise("blob"),
        "ref": F.when(F.col("page_id") % 7 == 1, head).when(F.col("page_id") % 7 == 2, "main"),
        "subpath": F.when(F.col("page_id") % 11 < 2, "docs"),
    })
    return resolve_refs(routes, names).select("page_id", "repo", "route", "kind", "wanted_ref", "scope", "target", "problem")


def _shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, path, content, doc_id: documents as files of a review, some with a secret."""
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("\nx-api-key: k"), F.col("doc_id"))).otherwise(F.lit("")))
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    return docs.select(F.coalesce("lang", F.lit("none")).alias("source_id"), F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("path"), text.alias("content"), "doc_id")


def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of documents' lines, some a line or two off, against the lines that redaction left as they were."""
    texts = _shown_texts(spark, sf_dir)
    lines = F.split("content", "\n")
    at = F.when(F.col("doc_id") % 2 == 0, F.size(lines)).otherwise((F.col("doc_id") % 5 + 1).cast("int"))
    cited = texts.select("source_id", "path", at.alias("at"), F.split_part(F.get(lines, at - 1), F.lit(" "), F.lit(1)).alias("value"))
    cited = cited.where("value is not null").select("source_id", "path", F.explode(F.expr("array(at - 1, at, at + 1, at + 2)")).alias("line"), "value")
    return resolve_lines(cited, shown_lines(texts))


#: An answer about a document, in SQL that Spark and DuckDB share: most are right, and each kind of fault is in some.
_ANSWER = """CASE WHEN doc_id % 37 <> 23 THEN concat('{"analysis_hash":"sha256:', hash, CASE WHEN doc_id % 37 = 4 THEN '0' ELSE '' END,
  '","verdict":"', CASE WHEN doc_id % 37 = 5 THEN 'unknown' ELSE verdict END,
  '","confidence":', CASE doc_id % 37 WHEN 6 THEN 'true' WHEN 7 THEN '1.5' WHEN 8 THEN '"0.9"' WHEN 26 THEN '1' WHEN 27 THEN '0.5' ELSE '0.95' END,
  ',"reason_codes":[', CASE WHEN doc_id % 37 = 9 THEN '' WHEN doc_id % 37 = 10 THEN '"low"' WHEN doc_id % 37 = 11 THEN '"A","A"' WHEN doc_id % 37 = 12 THEN '"OTHER"'
    WHEN verdict = 'portable' THEN '"SELF_CONTAINED_FILES","B"' WHEN verdict = 'plugin_bound' THEN '"PLUGIN_DEPENDENCY"' ELSE '"AUTONOMY_UNPROVEN"' END,
  '],"evidence":[', CASE WHEN doc_id % 37 = 13 THEN '' ELSE concat('{"path":', CASE doc_id % 37 WHEN 15 THEN concat('"../', path, '"') WHEN 16 THEN '5' ELSE concat('"', path, '"') END,
    ',"line":', CASE doc_id % 37 WHEN 17 THEN '0' WHEN 18 THEN '1.5' WHEN 20 THEN '99999' WHEN 28 THEN '2' ELSE '1' END,
    CASE WHEN doc_id % 37 = 14 THEN ',"more":0' ELSE '' END, ',"value":"', CASE WHEN doc_id % 37 = 19 THEN '' ELSE word END, '"}') END,
  ']', CASE doc_id % 37 WHEN 1 THEN ',"verdict":"portable"' WHEN 2 THEN ',"more":null' ELSE '' END,
  CASE doc_id % 37 WHEN 3 THEN '' WHEN 21 THEN ',"rationale":""' WHEN 22 THEN ',"rationale":5' ELSE ',"rationale":"fine"' END,
  '}', CASE WHEN doc_id % 37 = 0 THEN ' x' ELSE '' END) END"""


def strict_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about documents, each read strictly, and the class that follows for an ambiguous candidate; what is redacted isn't portable."""
    texts = _shown_texts(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    verdict = F.when(F.col("toxic") == 1, "plugin_bound").when(F.col("quality") == 1, "portable").otherwise("ambiguous")
    word = F.regexp_extract("content", "^[A-Za-z]+", 0)
    redacted = F.size(D.redaction(F.col("content"))["types"]) > 0
    rows = texts.join(labels, "doc_id", "left").select("doc_id", "source_id", "path", verdict.alias("verdict"), word.alias("word"), F.sha2("content", 256).alias("hash"), redacted.alias("redacted"))
    answers = rows.select("doc_id", "source_id", F.expr(_ANSWER).alias("response"), F.concat(F.lit("sha256:"), "hash").alias("expected_hash"), "redacted")
    judged = P.judge_answers(answers, shown_lines(texts)).withColumn("final", P.final_class(F.col("code"), F.lit(False), F.col("redacted")))
    return judged.select("doc_id", "source_id", "rule", "verdict", "confidence", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), "final.classification", "final.code")


def scan_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.limit_checks(inventory(spark, sf_dir))


def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collisions among the paths of pages' links, a page's host being the source."""
    pages = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("source_id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("path")
    )
    return D.path_collisions(pages)


def source_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs as source specs: kind, host, and whether query, fragment or password make them unsafe to fetch."""
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    kind = F.when(host == "", "local").when(host == "github.com", "github").otherwise("git")
    unsafe = url.rlike(r"[?#]") | url.rlike(r"^[a-z]+://[^/@]*:[^/@]*@") | ~url.rlike(r"^(?:https|ssh|git)://")
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), host.alias("host"), F.when(kind == "local", F.lit(False)).otherwise(unsafe).alias("unsafe"))


def decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _findings(spark, inventory(spark, sf_dir))
    rows = D.reasons(found)
    return rows.select("source_id", "root", "code", "n_attempts", F.to_json("evidence").alias("evidence"))


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.classify(*_findings(spark, inventory(spark, sf_dir)))


def classification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.class_counts(classifications(spark, sf_dir))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate per document: its name is the first word, its content hash that of the text."""
    docs = table(spark, sf_dir, "documents")
    root = F.concat(F.lit("packages/"), F.coalesce("source", F.lit("none")), F.lit("/d"), F.col("doc_id"))
    text = F.coalesce("text", F.lit(""))
    source = F.coalesce("lang", F.lit("none"))
    return docs.select(
        source.alias("source_id"),
        root.alias("root"),
        candidate_id(F.concat(F.lit(URL), source), F.lit("0" * 40), root).alias("candidate_id"),
        F.split_part(text, F.lit(" "), F.lit(1)).alias("name"),
        F.sha2(text, 256).alias("content_hash"),
    )


def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.groups(_members(spark, sf_dir), "duplicate", "content_hash")


def name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.groups(_members(spark, sf_dir), "name-conflict", "name")


def duplicate_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _members(spark, sf_dir)
    sizes = rows.groupBy("source_id", "content_hash").agg(F.count("*").alias("n_copies"))
    return rows.join(sizes, ["source_id", "content_hash"]).select("source_id", "root", "n_copies", (F.col("n_copies") > 1).alias("duplicate"))


def import_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _members(spark, sf_dir)
    one = rows.groupBy("source_id", "content_hash").agg(
        F.min_by("name", F.struct("root", "candidate_id")).alias("name"), F.count("*").alias("n_candidates")
    )
    slug = F.regexp_replace(F.regexp_replace("name", "[^A-Za-z0-9_.-]+", "-"), "^[-._]+|[-._]+$", "")
    records = one.withColumn("slug", F.when(slug == "", "skill").otherwise(F.left(slug, F.lit(80))))
    named = D.destinations(records.select("source_id", "slug", "content_hash"))
    return records.join(named, ["source_id", "slug", "content_hash"]).select("source_id", "content_hash", "destination", "n_candidates")


def partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected and rejected candidates cover every candidate once: rows that don't, beside the counts."""
    rows = classifications(spark, sf_dir)
    split = rows.select("source_id", (F.col("classification") == "portable").alias("selected"))
    return split.groupBy("source_id").agg(
        F.count_if("selected").alias("n_selected"), F.count_if(~F.col("selected")).alias("n_rejected"), F.count_if(F.col("selected").isNull()).alias("n_lost")
    )


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels as an outside reviewer's answers."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    root = F.concat(F.lit("packages/"), F.coalesce("source", F.lit("none")), F.lit("/d"), F.col("doc_id"))
    verdict = F.when(F.col("toxic") == 1, "plugin_bound").when(F.col("quality") == 1, "portable").otherwise("ambiguous")
    confidence = F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(0.95)
    rows = docs.join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id")
    return rows.select(F.coalesce("lang", F.lit("none")).alias("source_id"), root.alias("root"), verdict.alias("verdict"), confidence.alias("confidence"))


def review_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.review_outcome(classifications(spark, sf_dir).drop("base_reason"), _reviews(spark, sf_dir))


def expected_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer comparison of classes with the reviewer's verdicts, in numbers by source."""
    actual = classifications(spark, sf_dir).select("source_id", "root", "classification")
    joined = actual.join(_reviews(spark, sf_dir).select("source_id", "root", "verdict"), ["source_id", "root"], "full_outer")
    same = F.col("classification") == F.col("verdict")
    return joined.groupBy("source_id").agg(
        F.count_if(same).alias("agree"),
        F.count_if(~same).alias("disagree"),
        F.count_if(F.col("verdict").isNull()).alias("not_expected"),
        F.count_if(F.col("classification").isNull()).alias("not_found"),
    )


def review_quota(spark: SparkSession, sf_dir: str, limit: int = 2) -> DataFrame:
    """The first attempts of each conversation that count, in order of turn."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(order).alias("attempt"))
    return rows.where(F.col("attempt") <= limit)


def envelope_budget(spark: SparkSession, sf_dir: str, budget: int = 20_000) -> DataFrame:
    """Documents of a language and source that fit into a review's budget of bytes, in order of id.

    Sums over ranges of ids come first, and only the ranges that the budget reaches are looked at row by row, a range at a time;
    so the rows of a large source never meet in one task.
    """
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.to_json(F.struct("lang", "source")).alias("group"),
        F.floor(F.col("doc_id") / ID_RANGE).alias("range"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"),
    )
    before = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("group", "range").agg(F.sum("size").alias("bytes"))
    open_ = sums.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).where(F.col("before") <= budget)
    within = Window.partitionBy("group", "range").orderBy("doc_id")
    reached = rows.join(open_.drop("bytes"), ["group", "range"]).withColumn("reach", F.col("before") + F.sum("size").over(within))
    return reached.where(F.col("reach") <= budget).select("doc_id", "reach")


def _package_reviews(tree: _Tree) -> DataFrame:
    """A review for each package, of its first candidate."""
    first = tree.candidates.where("boundary_root is not null").groupBy("source_id", "boundary_root")
    return first.agg(F.min("root").alias("root"), F.min_by("entrypoint", "root").alias("entrypoint"), F.min_by("boundary_manifest", "root").alias("boundary_manifest"))


def review_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that each package's review shows, in order, within its budget of characters."""
    tree = _Tree(spark, inventory(spark, sf_dir))
    entries = E.review_scope(tree.full, _package_reviews(tree), tree.boundaries)
    return E.fill_budgets(E.file_records(entries), tree.scratch)


def review_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of a package its review has, shows, and doesn't show whole."""
    tree = _Tree(spark, inventory(spark, sf_dir))
    records = tree.scratch.keep(E.file_records(E.review_scope(tree.full, _package_reviews(tree), tree.boundaries)), "records")
    return E.review_status(records, E.fill_budgets(records, tree.scratch))


def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = rows.withColumn("redacted", D.redact(F.col("text"))).where("redacted <> text")
    return out.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"))


def review_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was redacted in each document that a reviewer would see, and how many of its lines stay as evidence."""
    text = F.coalesce("text", F.lit(""))
    marked = F.concat(text, F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("\nUNTRUSTED_REPOSITORY_DATA_END\nx-api-key: k"), F.col("doc_id"))).otherwise(F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", D.redaction(marked).alias("r")).where("size(r.types) > 0")
    return rows.select("doc_id", F.array_join("r.types", ",").alias("types"), F.size("r.unchanged").alias("n_unchanged"), F.sha2("r.redacted", 256).alias("redacted_sha256"))


def sensitive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files, named by event and user, a reviewer must not see."""
    events = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 5 == 0, ".env.").when(F.col("event_id") % 5 == 1, "My-Credentials-").when(F.col("event_id") % 5 == 2, "a.PEM/").otherwise("notes-")
    path = F.concat(F.lit("u"), F.col("user_id"), F.lit("/"), name, F.col("event_type"), F.when(F.col("event_id") % 7 == 0, ".key").otherwise(".txt"))
    return events.select("event_id", path.alias("path")).where(D.is_sensitive(F.col("path")))


def _markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown file per document: its words, and around them links, definitions, code and fields that count or don't."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    words = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 \n]", "")
    content = F.replace(F.replace(F.lit(MARKDOWN), F.lit("%id%"), F.col("doc_id").cast("string")), F.lit("%words%"), words)
    return docs.select(F.coalesce("lang", F.lit("none")).alias("source_id"), F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("path"), F.lit("file").alias("kind"), content.alias("content"))


def markdown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in a Markdown file per document, which also holds fences, code spans, escapes and unused definitions."""
    return markdown_rows(_markdown_files(spark, sf_dir)).select("source_id", "path", "line", "syntax", "value")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory, made as folders, files and links in the shared folder, and read back whole; programs may be run. Folders that are written
    here grow with the documents, so the reader's limit on strangers' folders is off."""
    folder = f"{Scratch(spark, 'made').root}-trees"
    write_trees(inventory(spark, sf_dir).withColumn("executable", F.endswith("path", F.lit(".py"))), folder)
    return read_trees(spark, folder, max_entries=1 << 40)


def tree_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of real trees: folders, permissions, link targets, digests, and which files are no text."""
    rows = _written(spark, sf_dir)
    return rows.select("source_id", "path", "kind", "size", "executable", "symlink_target", "sha256", F.col("content").isNull().alias("opaque"), "problem")


def tree_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification counts over real trees that no entry keeps from being taken."""
    rows = _written(spark, sf_dir)
    return D.class_counts(D.classify(*_findings(spark, admitted(rows, refused_sources(rows, max_entries=1 << 40, max_total=1 << 50)))))


def archive_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of a tar archive per document, read back from its bytes, with what was rejected and why."""
    archives = pack_documents(table(spark, sf_dir, "documents"))
    return untar(archives).select("source_id", "path", "kind", "size", "executable", "symlink_target", "sha256", F.col("content").isNull().alias("opaque"), "problem")


def link_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages by their first path part: number, and how many lead to the host's own root."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return pages.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.startswith("href", F.lit("/"))).alias("host_links"), F.min(file_name(F.col("href"))).alias("first_name"))


_QUERIES = (
    inventory_hash, snapshot_digest, content_digest, package_boundaries, ancestor_counts, innermost_boundary, frontmatter_fields,
    path_references, link_closure, decision_reasons, classifications, classification_counts, content_duplicates, name_conflicts,
    duplicate_annotation, import_records, runtime_callers, inert_symbols, residual_paths, structured_references, ref_scopes, evidence_lines, scan_limits, path_collisions, source_specs, partition_check, review_join, expected_vs_actual, review_quota, envelope_budget, review_envelopes, review_statuses, strict_reviews,
    secret_redaction, link_extraction, review_redaction, sensitive_paths, markdown_references, archive_inventory, tree_inventory, tree_classes,
)

#: A file of :func:`_markdown_files`; its references by line are in the SQL.
MARKDOWN = """---
name: x
script: tools/%id%.sh
---
%words%
See [guide](guides/%id%.md) and \\[no](skipped.md).
`[code](span.md)` then ![img](<a b.png>)
```
[fence](fence.md)
```
Use [the notes][n] and [this text].
[n]: notes/%id%.md
[n]: other.md
[unused]: never.md
```bash
$ bash scripts/run.sh --out=x/y
```
Run ../shared/%id%.sh now."""

_WITH = f"WITH RECURSIVE {DUCKDB_INVENTORY}"
#: Ancestors of a path, from '.' to itself.
_ANCESTORS = "list_concat(['.'], list_transform(range(1, len(string_split({p}, '/')) + 1), lambda n: array_to_string(string_split({p}, '/')[1:n], '/')))"
#: In the derived inventory each candidate lies directly in its package, whose manifest is plugin.json.
_CANDIDATES = """,
b AS (SELECT source_id, regexp_replace(path, '/plugin.json$', '') AS root, path AS manifest_path, contains(content, '"runtime"') AS runs
      FROM inventory WHERE path LIKE '%/plugin.json'),
loose AS (SELECT DISTINCT source_id, regexp_replace(path, '/shared/common.md$', '') AS root FROM inventory WHERE path LIKE '%/shared/common.md'),
inner_ AS (SELECT b.source_id, b.root, bool_or(i.runs) AS any_runs FROM b JOIN b i ON i.source_id = b.source_id AND (i.root = b.root OR starts_with(i.root, b.root || '/')) GROUP BY 1, 2),
kinds AS (SELECT b.*, CASE WHEN any_runs OR loose.root IS NOT NULL THEN 'mixed' ELSE 'skills_only' END AS package_kind
          FROM b JOIN inner_ USING (source_id, root) LEFT JOIN loose USING (source_id, root)),
c AS (SELECT i.source_id, regexp_replace(i.path, '/SKILL.md$', '') AS root, i.path AS entrypoint, i.content, kinds.root AS boundary_root,
             kinds.manifest_path AS boundary_manifest, kinds.package_kind
      FROM inventory i LEFT JOIN kinds ON kinds.source_id = i.source_id AND kinds.root = regexp_replace(i.path, '/[^/]*/SKILL.md$', '')
      WHERE i.path LIKE '%/SKILL.md')"""
_REFERENCES = """,
r AS (SELECT source_id, root, entrypoint AS path, boundary_root, regexp_extract(content, '\\[guide\\]\\(([^)]*)\\)', 1) AS value, content FROM c),
t AS (SELECT *, CASE WHEN value LIKE '../%' THEN boundary_root || substr(value, 3) ELSE root || '/' || value END AS target,
             CASE WHEN value LIKE '/%' THEN 'host' WHEN value LIKE '#%' OR value LIKE 'https:%' THEN 'remote'
                  WHEN value LIKE '\\%2e%' ESCAPE '\\' THEN 'escape' END AS early FROM r),
rs AS (SELECT t.source_id, t.root, t.path, t.value, t.content,
              coalesce(early, CASE WHEN i.path IS NULL THEN 'missing' WHEN starts_with(i.path, t.root || '/') THEN 'inside' ELSE 'outside' END) AS outcome,
              CASE WHEN early IS NULL THEN t.target END AS target
       FROM t LEFT JOIN inventory i ON i.source_id = t.source_id AND i.path = t.target)"""
#: Names made of letters that YAML doesn't take for a string, and no name at all.
NO_STRING = "^(?i:|true|false|yes|no|on|off|null)$"
#: Quoted literals that climb, outside comments, in candidates' programs; they count where they meet a file outside the candidate.
_LITERALS = r""",
q AS (SELECT i.source_id, c.root, c.boundary_root, i.path, unnest(range(1, len(string_split(i.content, chr(10))) + 1)) AS line, i.content
      FROM inventory i JOIN c ON c.source_id = i.source_id AND starts_with(i.path, c.root || '/') WHERE regexp_matches(i.path, '/tool[.](py|sh)$')),
rl AS (SELECT q.source_id, q.root, q.path, CAST(line AS INT) AS line, v || ' -> ' || i.path AS value
       FROM (SELECT *, unnest(regexp_extract_all(regexp_replace(string_split(content, chr(10))[line], '(^|\s)#.*', ''), '["''](\.\./[^"'']*)["'']', 1)) AS v FROM q) q
       JOIN inventory i ON i.source_id = q.source_id AND i.path = q.boundary_root || substr(v, 3))"""
#: A path with '.' and '..' resolved; null if it leaves the tree.
_COLLAPSE = """coalesce(nullif(substr(nullif(list_reduce(list_prepend('', string_split({p}, '/')), lambda a, x: CASE WHEN a = '!' THEN '!' WHEN x = '' OR x = '.' THEN a
  WHEN x <> '..' THEN a || '/' || x WHEN a = '' THEN '!' ELSE regexp_replace(a, '/[^/]*$', '') END), '!'), 2), ''), CASE WHEN {p} IS NULL THEN NULL END)"""
#: A pattern of segments as a regular expression over a path's last parts.
_PATTERN = r"""'(.*/)?' || regexp_replace(regexp_replace(regexp_replace(regexp_replace({p}, '[.]', '[.]', 'g'), '\[!', '[^', 'g'), '[?]', '[^/]', 'g'), '\*+', '[^/]*', 'g')"""
#: Strings of JSON files below candidates; a pattern has one inner '**' at most, and its head without wildcards is part of each match.
_STRUCTURED = rf""",
jf AS (SELECT i.source_id, c.root, i.path, i.content, regexp_replace(i.path, '/[^/]*$', '') AS folder FROM inventory i
       JOIN c ON c.source_id = i.source_id AND c.root = regexp_extract(i.path, '^packages/[^/]*/[^/]*') WHERE i.path LIKE '%.json'),
jv AS (SELECT jf.*, field, unnest(CASE json_type(content, '$.' || field) WHEN 'VARCHAR' THEN [json_extract_string(content, '$.' || field)]
         WHEN 'ARRAY' THEN list_transform(list_filter(TRY_CAST(json_extract(content, '$.' || field) AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') ELSE [] END) AS value
       FROM jf, (SELECT unnest({S.FIELDS}) AS field) WHERE json_valid(content)
       UNION ALL SELECT jf.*, 'references.path', unnest(json_extract_string(content, '$.references[*].path')) FROM jf WHERE json_valid(content)),
jl AS (SELECT *, len(string_split(left(content, greatest(strpos(content, value) - 1, 0)), chr(10))) AS line, field IN ('files', 'include') AND regexp_matches(value, '[*?\[]') AS globbed,
              url_decode(value) AS once, url_decode(url_decode(url_decode(value))) AS decoded FROM jv),
jb AS (SELECT *, unnest([folder, root]) AS base, unnest([0, 1]) AS probe, starts_with(decoded, '/') OR (decoded <> once AND regexp_matches(decoded, '(^|/)[.][.](/|$)')) AS stays
       FROM jl WHERE globbed),
jp AS (SELECT *, {_COLLAPSE.format(p="(base || '/' || once)")} AS pattern FROM jb),
jm AS (SELECT jp.*, i.path AS hit FROM jp JOIN inventory i ON i.source_id = jp.source_id AND i.kind = 'file' AND contains(i.path, regexp_extract(pattern, '^[^*?\[]*'))
         AND (regexp_full_match(i.path, {_PATTERN.format(p='pattern')}) OR regexp_full_match(i.path, {_PATTERN.format(p="replace(pattern, '/**/', '/')")})) WHERE NOT stays),
jx AS (SELECT source_id, root, path, line, value, CASE WHEN starts_with(hit, base || '/') THEN substr(hit, length(base) + 2) ELSE hit END AS found FROM jm
       QUALIFY probe = min(probe) OVER (PARTITION BY source_id, root, path, value))"""
#: Links one after the other: a path has at most one part that is a link below no other link.
_LINKS = f""",
lk AS (SELECT source_id, path, symlink_target AS raw, CASE WHEN NOT starts_with(symlink_target, '/') THEN {_COLLAPSE.format(p="regexp_replace(path, '[^/]*$', '') || symlink_target")} END AS target
       FROM inventory WHERE kind = 'symlink'),
tops AS (SELECT * FROM lk WHERE NOT EXISTS (SELECT 1 FROM lk u WHERE u.source_id = lk.source_id AND starts_with(lk.path, u.path || '/'))),
fo AS (SELECT DISTINCT source_id, unnest({{ancestors}}) AS path FROM (SELECT source_id, regexp_replace(path, '/[^/]*$', '') AS folder FROM inventory WHERE contains(path, '/'))),
walk AS (SELECT source_id, path AS link, path AS cur, 0 AS hops, CAST([] AS VARCHAR[]) AS seen, CAST([] AS VARCHAR[]) AS tos, CAST([] AS VARCHAR[]) AS raws FROM lk
  UNION ALL SELECT w.source_id, w.link, t.target || substr(w.cur, length(t.path) + 1), w.hops + 1, list_append(w.seen, w.cur), list_append(w.tos, coalesce(t.target, '!')), list_append(w.raws, t.raw)
  FROM walk w JOIN tops t ON t.source_id = w.source_id AND (w.cur = t.path OR starts_with(w.cur, t.path || '/')) WHERE w.hops < 65 AND NOT list_contains(w.seen, w.cur)),
lc AS (SELECT w.*, coalesce(i.kind, CASE WHEN fo.path IS NOT NULL THEN 'directory' END) AS kind, list_contains(seen, cur) AS again
  FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY source_id, link ORDER BY hops DESC) = 1) w
  LEFT JOIN inventory i ON i.source_id = w.source_id AND i.path = w.cur LEFT JOIN fo ON fo.source_id = w.source_id AND fo.path = w.cur),
le0 AS (SELECT *, CASE WHEN again THEN 'cycle' WHEN hops > 64 THEN 'limit' WHEN cur IS NULL THEN 'escape' WHEN kind IS NULL THEN 'dangling' ELSE 'resolved' END AS outcome FROM lc)""".replace(
    "{ancestors}", _ANCESTORS.format(p="folder")
)
#: In a candidate, no step may leave it; a link is cyclic if its folder can be reached from where it leads.
_LINK_CODES = """,
cl0 AS (SELECT l.*, c.root, list_filter(range(1, hops + 1), lambda k: tos[k] = '!' OR NOT (tos[k] = c.root OR starts_with(tos[k], c.root || '/')))[1] AS bad,
               regexp_replace(link, '/[^/]*$', '') AS folder
        FROM le0 l JOIN c ON c.source_id = l.source_id AND starts_with(l.link, c.root || '/')),
cl1 AS (SELECT *, CASE WHEN bad IS NULL AND outcome = 'resolved' AND kind = 'directory' THEN cur END AS target FROM cl0),
ge AS (SELECT DISTINCT source_id, root, folder AS a, target AS b FROM cl1 WHERE target IS NOT NULL
       UNION SELECT DISTINCT fo.source_id, cl1.root, regexp_replace(fo.path, '/[^/]*$', ''), fo.path FROM fo JOIN cl1 ON cl1.source_id = fo.source_id AND starts_with(fo.path, cl1.root || '/')),
reach AS (SELECT source_id, root, link, target AS node FROM cl1 WHERE target IS NOT NULL
          UNION SELECT r.source_id, r.root, r.link, ge.b FROM reach r JOIN ge ON ge.source_id = r.source_id AND ge.root = r.root AND ge.a = r.node),
le AS (SELECT source_id, root, link, CASE WHEN cyclic THEN 'SYMLINK_CYCLE' WHEN bad IS NOT NULL THEN 'SYMLINK_ESCAPE' WHEN outcome IN ('cycle', 'limit') THEN 'DYNAMIC_REFERENCE_UNRESOLVED'
         WHEN outcome = 'dangling' THEN 'MISSING_LOCAL_RESOURCE' END AS code,
       CASE WHEN cyclic THEN raws[1] || ' -> ' || target WHEN bad IS NOT NULL AND starts_with(raws[bad], '/') THEN raws[bad]
         WHEN bad IS NOT NULL THEN raws[bad] || ' -> ' || CASE WHEN tos[bad] = '!' THEN '<outside snapshot>' ELSE tos[bad] END
         WHEN outcome = 'cycle' THEN raws[list_position(seen, cur)] || ' (cycle)' WHEN outcome = 'limit' THEN 'chain exceeds 64 links' WHEN outcome = 'dangling' THEN raws[hops] || ' -> ' || cur END AS value
       FROM (SELECT cl1.*, EXISTS (SELECT 1 FROM reach r WHERE r.source_id = cl1.source_id AND r.root = cl1.root AND r.link = cl1.link AND r.node = cl1.folder) AS cyclic FROM cl1))"""
_CALLS = """,
calls AS (SELECT c.source_id, c.root, i.path, 1 AS line, 0 AS ord, regexp_extract(i.content, '"([^"]*)"', 1) AS value
          FROM inventory i JOIN c ON c.source_id = i.source_id AND c.boundary_root || '/src/main.py' = i.path
            AND c.root = c.boundary_root || '/' || regexp_extract(i.content, '"([^"]*)"', 1))"""
_EVIDENCE = _CALLS + _LITERALS + _LINKS + _LINK_CODES + """,
marks AS (
  SELECT source_id, root, 'PATH_TRAVERSAL' AS code, path, value, content, '[guide]' AS mark FROM rs WHERE outcome = 'escape'
  UNION ALL SELECT source_id, root, 'REFERENCE_OUTSIDE_SKILL_ROOT', path, value || ' -> ' || target, content, '[guide]' FROM rs WHERE outcome = 'outside'
  UNION ALL SELECT source_id, root, 'MISSING_LOCAL_RESOURCE', path, value || ' -> ' || target, content, '[guide]' FROM rs WHERE outcome = 'missing'
  UNION ALL SELECT source_id, root, 'PLUGIN_ROOT_VARIABLE', path, '$' || '{PLUGIN_ROOT}', content, 'run $' FROM rs WHERE contains(content, '{PLUGIN_ROOT}')),
ev AS (
  SELECT source_id, root, code, path, value, len(string_split(split_part(content, mark, 1), chr(10))) AS line FROM marks
  UNION ALL SELECT source_id, root, 'REFERENCED_BY_PLUGIN_RUNTIME', path, value, line FROM calls
  UNION ALL SELECT source_id, root, 'STATIC_ANALYSIS_INCOMPLETE', path, value, line FROM rl
  UNION ALL SELECT i.source_id, c.root, 'PLUGIN_ROOT_VARIABLE', i.path, '$' || '{PLUGIN_ROOT}', 2 FROM inventory i JOIN c ON c.source_id = i.source_id AND i.path = c.root || '/tool.sh'
  UNION ALL SELECT source_id, root, 'INVALID_FRONTMATTER', entrypoint, 'name', 1 FROM c WHERE regexp_matches(split_part(substr(content, 11), chr(10), 1), '""" + NO_STRING + """')
  UNION ALL SELECT source_id, root, code, link, value, NULL FROM le WHERE code IS NOT NULL
  UNION ALL SELECT i.source_id, c.root, 'PATH_COLLISION', i.path, lower(i.path), NULL
    FROM inventory i JOIN (SELECT source_id, lower(path) AS k FROM inventory GROUP BY ALL HAVING count(DISTINCT path) > 1) k ON k.source_id = i.source_id AND k.k = lower(i.path)
    JOIN c ON c.source_id = i.source_id AND c.root = regexp_replace(i.path, '/[^/]*$', '')
  UNION ALL SELECT i.source_id, c.root, 'PLUGIN_RUNTIME_INSIDE_SKILL_ROOT', i.path, 'mixed', NULL
    FROM inventory i JOIN c ON c.source_id = i.source_id AND c.root = regexp_replace(i.path, '/inner/plugin.json$', '')
  UNION ALL SELECT i.source_id, c.root, 'DUPLICATE_ENTRYPOINT', c.entrypoint, 'ignored in favor of ' || c.entrypoint, NULL
    FROM inventory i JOIN c ON c.source_id = i.source_id AND c.root = regexp_replace(i.path, '/skill.md$', '') WHERE i.path LIKE '%/skill.md'
  UNION ALL SELECT c.source_id, c.root, 'PLUGIN_OWNED_MCP_TOOL', entrypoint, 'mcp__' || regexp_extract(c.root, '^packages/([^/]*)', 1) || '__find',
    len(string_split(split_part(c.content, chr(10) || 'ask mcp__', 1), chr(10))) + 1
    FROM c JOIN inventory m ON m.source_id = c.source_id AND m.path = c.boundary_manifest WHERE contains(split_part(c.content, chr(10) || '```text', 1), 'ask mcp__') AND contains(m.content, 'mcpServers')
  UNION ALL SELECT c.source_id, c.root, 'PLUGIN_COMMAND_REFERENCE', entrypoint, '/deploy', len(string_split(split_part(c.content, chr(10) || 'then /deploy', 1), chr(10))) + 1
    FROM c JOIN inventory m ON m.source_id = c.source_id AND m.path = c.boundary_root || '/commands/deploy.md' WHERE contains(split_part(c.content, chr(10) || '```text', 1), 'then /deploy it'))"""
_CLASSES = """,
fl AS (SELECT source_id, root, bool_or(code IN ('PATH_TRAVERSAL', 'SYMLINK_CYCLE', 'SYMLINK_ESCAPE', 'PATH_COLLISION')) AS blocked,
              bool_or(code = 'INVALID_FRONTMATTER') AS invalid,
              bool_or(code NOT IN ('PATH_TRAVERSAL', 'SYMLINK_CYCLE', 'SYMLINK_ESCAPE', 'PATH_COLLISION', 'INVALID_FRONTMATTER', 'DUPLICATE_ENTRYPOINT', 'STATIC_ANALYSIS_INCOMPLETE')) AS bound,
              bool_or(code = 'STATIC_ANALYSIS_INCOMPLETE') AS incomplete
       FROM ev GROUP BY ALL),
cl AS (SELECT c.source_id, c.root, package_kind, CASE WHEN blocked THEN 'blocked' WHEN invalid THEN 'invalid' WHEN bound THEN 'plugin_bound' WHEN incomplete THEN 'ambiguous'
              WHEN package_kind IS NULL OR package_kind = 'skills_only' THEN 'portable' ELSE 'ambiguous' END AS classification
       FROM c LEFT JOIN fl USING (source_id, root))"""
_MEMBERS = f"""WITH m AS (
  SELECT coalesce(lang, 'none') AS source_id, 'packages/' || coalesce(source, 'none') || '/d' || doc_id AS root,
         'sha256:' || sha256('["{URL}' || coalesce(lang, 'none') || '","{"0" * 40}","packages/' || coalesce(source, 'none') || '/d' || doc_id || '"]') AS candidate_id,
         split_part(coalesce(text, ''), ' ', 1) AS name, sha256(coalesce(text, '')) AS content_hash FROM documents)"""
_GROUP = """SELECT source_id, {key} AS key, count(*) AS n, arg_min(root, root) AS representative,
  'sha256:' || sha256('["{kind}",' || CAST(to_json({key}) AS VARCHAR) || ',["' || string_agg(candidate_id, '","' ORDER BY candidate_id) || '"]]') AS group_id
  FROM m WHERE {where} GROUP BY source_id, {key} HAVING count(*) > 1"""
_REVIEWS = """,
rv AS (SELECT coalesce(d.lang, 'none') AS source_id, 'packages/' || coalesce(d.source, 'none') || '/d' || d.doc_id AS root,
              CASE WHEN toxic = 1 THEN 'plugin_bound' WHEN quality = 1 THEN 'portable' ELSE 'ambiguous' END AS verdict,
              CASE WHEN d.doc_id % 3 = 0 THEN 0.5 ELSE 0.95 END AS confidence
       FROM documents d JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))"""


def _u64(value: str) -> str:
    return f"lpad(to_hex(CAST({value} AS BIGINT)), 16, '0')"


def _record(path: str) -> str:
    fields = (f"hex(encode({path}))", "hex(encode(kind))", "'30'", "CASE kind WHEN 'file' THEN upper(sha256) ELSE hex(encode(symlink_target)) END")
    return " || ".join(f"{_u64(f'length({f}) // 2')} || {f}" for f in fields)


def _redacted(text: str) -> str:
    """Nested replacements; RE2 has no look-ahead, which only matters for values that are redacted already."""
    quoted = lambda pattern: pattern.replace("'", "''")
    out = f"regexp_replace({text}, '-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----', '<REDACTED:PRIVATE_KEY>', 'gs')"
    for marker in D.SECRET_KEYS:
        value = r"""(?:"[^\r\n"]*"|'[^\r\n']*'|[^\s,#;}\]'"]+)"""
        out = f"regexp_replace({out}, '{quoted(D.secret_key_pattern(marker) + value)}', '\\1<REDACTED:{marker}>', 'g')"
    bearer = r"(?im)(\b(?:proxy-)?authorization\s*:\s*Bearer\s+)[A-Za-z0-9._~+/=-]+"
    out = f"regexp_replace({out}, '{bearer}', '\\1<REDACTED:TOKEN>', 'g')"
    return f"regexp_replace({out}, '{D.PROMPT_DELIMITER}', '<REDACTED:PROMPT_DELIMITER>', 'g')"


def _envelopes() -> str:
    """Every file of a package in order, one after the other, with what is used so far."""
    folders, ends = "|".join(E.RUNTIME_PARTS), "|".join(end[1:] for end in E.CODE_ENDS)
    ends_of_lines = E.LINE_END.replace(r"\u0085", r"\x{85}").replace(r"\u2028", r"\x{2028}").replace(r"\u2029", r"\x{2029}")
    of_record = lambda lines, target: (
        "length(CAST(to_json({'executable': executable, 'kind': kind, 'lines': " + lines + ", 'path': path, 'sha256': CASE WHEN kind = 'file' THEN repeat('0', 64) END, "
        "'size': size, 'symlinkTarget': " + target + "}) AS VARCHAR))"
    )
    return f"""{_WITH},
      pb AS (SELECT source_id, CASE WHEN path = 'plugin.json' THEN '.' ELSE regexp_replace(path, '/plugin.json$', '') END AS pack, path AS manifest FROM inventory WHERE regexp_matches(path, '(^|/)plugin.json$')),
      px AS (SELECT source_id, path, unnest({_ANCESTORS.format(p="path")}) AS pack FROM inventory),
      pi AS (SELECT source_id, path, arg_max(pack, CASE WHEN pack = '.' THEN 0 ELSE len(string_split(pack, '/')) END) AS pack, arg_max(manifest, CASE WHEN pack = '.' THEN 0 ELSE len(string_split(pack, '/')) END) AS manifest
             FROM px JOIN pb USING (source_id, pack) GROUP BY source_id, path),
      pr AS (SELECT source_id, pack, min(regexp_replace(path, '/[^/]*$', '')) AS root FROM pi WHERE regexp_matches(path, '/(SKILL|skill).md$') GROUP BY source_id, pack),
      ps AS (SELECT i.*, pr.root, pi.manifest, {_redacted("coalesce(i.content, i.symlink_target)")} AS shown FROM inventory i JOIN pi USING (source_id, path) JOIN pr USING (source_id, pack)),
      pl AS (SELECT *, list_transform(CASE WHEN shown = '' OR content IS NULL THEN [] ELSE regexp_split_to_array(regexp_replace(shown, '({ends_of_lines})$', ''), '{ends_of_lines}') END,
               lambda x, i: {{'line': i, 'value': x}}) AS lines FROM ps),
      pn AS (SELECT source_id, root, path, 6 * length(path) AS need, 6 * length(coalesce(content, symlink_target)) AS raw, content IS NOT NULL AS cuttable,
               {of_record("lines", "CASE WHEN content IS NULL THEN shown END")} AS whole, {of_record("[]", "CASE WHEN content IS NULL THEN '<TRUNCATED>' END")} AS least,
               row_number() OVER (PARTITION BY source_id, root ORDER BY CASE WHEN path = root || '/SKILL.md' THEN 0 WHEN starts_with(path, root || '/') THEN 1 WHEN path = manifest THEN 2
                 WHEN regexp_matches(lower(path), '(^|/)({folders})(/|$)') OR regexp_matches(lower(path), '[^/][.]({ends})$') THEN 3 ELSE 4 END, encode(path)) AS k FROM pl),
      pg AS (SELECT source_id, root, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, 0 AS n, false AS stop, false AS take, false AS cut, CAST(0 AS BIGINT) AS chars FROM pr
             UNION ALL SELECT source_id, root, k, CASE WHEN take THEN used + gap + size ELSE used END, CASE WHEN take THEN n + 1 ELSE n END, stop, take, cut, size FROM (
               SELECT *, NOT stop AND need <= left_ AS take FROM (SELECT *, left_ < {E.LEAST_LEFT} OR (need <= left_ AND size > left_) AS stop FROM (
                 SELECT *, CASE WHEN cut THEN least ELSE whole END AS size FROM (SELECT *, raw > left_ OR (cuttable AND whole > left_) AS cut FROM (
                   SELECT pn.*, used, n, CASE WHEN n > 0 THEN 1 ELSE 0 END AS gap, {E.BUDGET} - used - CASE WHEN n > 0 THEN 1 ELSE 0 END AS left_
                   FROM pg JOIN pn ON pn.source_id = pg.source_id AND pn.root = pg.root AND pn.k = pg.k + 1 WHERE NOT stop)))))),
      pf AS (SELECT pg.source_id, pg.root, n, path, cut, chars, used AS reach FROM pg JOIN pn USING (source_id, root, k) WHERE take)"""


def _strict_reviews() -> str:
    """The rules of an answer, one after the other, over DuckDB's own JSON functions."""
    keys = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
    clean = lambda v, name: f"json_type({v}) = 'VARCHAR' AND length({v} ->> '$') BETWEEN 1 AND {P.LONGEST[name]} AND NOT regexp_matches({v} ->> '$', '[\\x00-\\x1F\\x7F]')"
    return f"""WITH t AS (SELECT doc_id, coalesce(lang, 'none') AS source_id, 'd' || doc_id || '.md' AS path, coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN chr(10) || 'x-api-key: k' || doc_id ELSE '' END AS t
          FROM documents WHERE doc_id IS NOT NULL),
      lb AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
      rw AS (SELECT t.*, {_redacted('t')} AS o, CASE WHEN toxic = 1 THEN 'plugin_bound' WHEN quality = 1 THEN 'portable' ELSE 'ambiguous' END AS verdict,
               regexp_extract(t, '^[A-Za-z]+') AS word, sha256(t) AS hash FROM t LEFT JOIN lb USING (doc_id)),
      an AS (SELECT *, {_ANSWER} AS response FROM rw),
      ob AS (SELECT *, CASE WHEN json_valid(response) THEN CAST(response AS JSON) END AS j FROM an),
      fd AS (SELECT *, j -> '$.analysis_hash' AS jh, j -> '$.verdict' AS jv, j -> '$.confidence' AS jc, j -> '$.reason_codes' AS jr, j -> '$.evidence' AS je, j -> '$.rationale' AS jt FROM ob),
      ln AS (SELECT source_id, path, unnest(range(1, len(a) + 1)) AS k, unnest(a) AS text, unnest(b) AS shown FROM (SELECT source_id, path, string_split(t, chr(10)) AS a, string_split(o, chr(10)) AS b FROM rw)
             WHERE len(a) = len(b)),
      ev AS (SELECT doc_id, source_id, unnest(range(1, len(CAST(je AS JSON[])) + 1)) AS k, unnest(CAST(je AS JSON[])) AS e FROM fd WHERE json_type(je) = 'ARRAY'),
      el AS (SELECT doc_id, ev.k, e, CASE WHEN bool_or(ln.k = CAST(e ->> '$.line' AS DOUBLE)) THEN CAST(e ->> '$.line' AS DOUBLE) WHEN min(ln.k) = max(ln.k) THEN min(ln.k) END AS place
             FROM ev LEFT JOIN ln ON ln.source_id = ev.source_id AND ln.path = e ->> '$.path' AND abs(ln.k - CAST(e ->> '$.line' AS DOUBLE)) <= 1 AND ln.text = ln.shown AND contains(ln.text, e ->> '$.value') GROUP BY doc_id, ev.k, e),
      er AS (SELECT doc_id, k, place, CASE WHEN list_sort(json_keys(e)) <> {keys(P.EVIDENCE_KEYS)} THEN 'evidence_keys' WHEN NOT ({clean("(e -> '$.path')", "path")}) THEN 'path'
               WHEN regexp_matches(e ->> '$.path', '^/|/$|//|[\\\\]|(^|/)[.][.]?(/|$)|^[A-Za-z]:') THEN 'path_form' WHEN json_type(e -> '$.line') NOT IN ('UBIGINT', 'BIGINT') OR CAST(e ->> '$.line' AS DOUBLE) < 1 THEN 'line'
               WHEN NOT ({clean("(e -> '$.value')", "value")}) THEN 'value' WHEN place IS NULL THEN 'unseen' END AS broken FROM el),
      ei AS (SELECT doc_id, arg_min(broken, k) FILTER (broken IS NOT NULL) AS item, string_agg(CAST(CAST(place AS INT) AS VARCHAR), ',' ORDER BY k) AS lines FROM er GROUP BY doc_id),
      ru AS (SELECT fd.*, lines, jv ->> '$' AS said, CASE WHEN json_type(jc) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(jc AS DOUBLE) END AS sure,
          CASE WHEN response IS NULL THEN 'none' WHEN j IS NULL OR len(json_keys(j)) <> len(list_distinct(json_keys(j))) THEN 'json' WHEN list_sort(json_keys(j)) <> {keys(P.KEYS)} THEN 'keys'
          WHEN NOT ({clean("jh", "analysis_hash")}) OR jh ->> '$' <> 'sha256:' || hash THEN 'analysis_hash' WHEN (jv ->> '$') NOT IN ('portable', 'plugin_bound', 'ambiguous') THEN 'verdict'
          WHEN json_type(jc) NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR CAST(jc ->> '$' AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'confidence'
          WHEN len(CAST(jr AS VARCHAR[])) NOT BETWEEN 1 AND {P.MOST_CODES} OR len(list_distinct(CAST(jr AS VARCHAR[]))) <> len(CAST(jr AS VARCHAR[]))
            OR len(list_filter(CAST(jr AS VARCHAR[]), lambda x: NOT regexp_full_match(x, '[A-Z][A-Z0-9_]{{0,63}}'))) > 0 THEN 'reason_codes'
          WHEN list_intersect(CAST(jr AS VARCHAR[]), {keys(P.NEEDED_CODE.values())}) <> [CASE jv ->> '$' {" ".join(f"WHEN '{k}' THEN '{c}'" for k, c in P.NEEDED_CODE.items())} END] THEN 'support'
          WHEN json_array_length(je) NOT BETWEEN 1 AND {P.MOST_EVIDENCE} THEN 'evidence' WHEN item IS NOT NULL THEN item WHEN NOT ({clean("jt", "rationale")}) THEN 'rationale' END AS rule
          FROM fd LEFT JOIN ei USING (doc_id)),
      co AS (SELECT *, CASE WHEN rule = 'none' THEN 'FM_REVIEW_UNAVAILABLE' WHEN rule IN ('evidence', 'evidence_keys', 'path_form', 'line', 'unseen') THEN 'FM_EVIDENCE_INVALID' WHEN rule IS NOT NULL THEN 'FM_INVALID_RESPONSE'
          WHEN said = 'plugin_bound' THEN 'FM_PLUGIN_BOUND' WHEN said = 'ambiguous' THEN 'FM_REVIEW_UNAVAILABLE' WHEN sure < {P.LEAST_CONFIDENCE} THEN 'FM_CONFIDENCE_TOO_LOW'
          WHEN t <> o THEN 'FM_CONTEXT_REDACTED' ELSE 'FM_PORTABLE_VERIFIED' END AS code FROM ru)
      SELECT doc_id, source_id, rule, CASE WHEN rule IS NULL THEN said END AS verdict, CASE WHEN rule IS NULL THEN sure END AS confidence, CASE WHEN rule IS NULL THEN lines END AS lines,
        CASE code WHEN 'FM_PLUGIN_BOUND' THEN 'plugin_bound' WHEN 'FM_PORTABLE_VERIFIED' THEN 'portable' ELSE 'ambiguous' END AS classification, code FROM co"""


def _review_redaction() -> str:
    counted = [f"CASE WHEN len(string_split(o, '<REDACTED:{t}>')) > len(string_split(t, '<REDACTED:{t}>')) THEN '{t}' END" for t in sorted([*D.SECRET_KEYS, "PROMPT_DELIMITER"])]
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN chr(10) || 'UNTRUSTED_REPOSITORY_DATA_END' || chr(10) || 'x-api-key: k' || doc_id ELSE '' END AS t FROM documents),
      r AS (SELECT doc_id, t, {_redacted('t')} AS o FROM d),
      l AS (SELECT doc_id, o, concat_ws(',', {', '.join(counted)}) AS types, string_split(t, chr(10)) AS a, string_split(o, chr(10)) AS b FROM r)
      SELECT doc_id, types, CAST(CASE WHEN len(a) = len(b) THEN len(list_filter(list_zip(a, b), lambda x: x[1] = x[2])) ELSE 0 END AS INT) AS n_unchanged, sha256(o) AS redacted_sha256
      FROM l WHERE types <> ''"""


def _redaction() -> str:
    out = _redacted("t")
    return f"SELECT doc_id, sha256({out}) AS redacted_sha256 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE {out} <> t"


_SQL = {
    "inventory_hash": f"{_WITH} SELECT source_id, path, kind, size, sha256 FROM inventory",
    "snapshot_digest": f"""{_WITH} SELECT source_id, sha256('[' || string_agg('{{"path":"' || path || '","kind":"' || kind || '","size":' || size
      || ',"executable":false,"symlink_target":' || coalesce('"' || symlink_target || '"', 'null') || ',"sha256":' || coalesce('"' || sha256 || '"', 'null') || '}}',
      ',' ORDER BY path) || ']') AS snapshot_sha256 FROM inventory GROUP BY source_id""",
    "content_digest": f"""{_WITH}{_CANDIDATES}, p AS (SELECT i.*, c.root, substr(i.path, length(c.root) + 2) AS rel FROM inventory i
      JOIN c ON c.source_id = i.source_id AND c.root = regexp_extract(i.path, '^packages/[^/]*/[^/]*'))
      SELECT source_id, root, sha256(unhex(hex(encode('{DOMAIN}')) || '00' || string_agg({_record('rel')}, '' ORDER BY rel))) AS content_hash FROM p GROUP BY source_id, root""",
    "package_boundaries": f"{_WITH}{_CANDIDATES} SELECT source_id, root, manifest_path, 'plugin' AS manifest_kind, package_kind FROM kinds",
    "ancestor_counts": f"{_WITH} SELECT source_id, root, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT source_id, size, unnest({_ANCESTORS.format(p='path')}) AS root FROM inventory) GROUP BY ALL",
    "innermost_boundary": f"""{_WITH}{_CANDIDATES} SELECT source_id, root, entrypoint, boundary_root, boundary_manifest, package_kind,
      'sha256:' || sha256('["{URL}' || source_id || '","{"0" * 40}","' || root || '"]') AS candidate_id FROM c""",
    "frontmatter_fields": f"""{_WITH}{_CANDIDATES}, f AS (SELECT source_id, root, CASE WHEN NOT regexp_matches(split_part(substr(content, 11), chr(10), 1), '{NO_STRING}') THEN split_part(substr(content, 11), chr(10), 1) END AS name,
      split_part(split_part(content, 'description: ', 2), chr(10), 1) AS description FROM c)
      SELECT source_id, root, name IS NOT NULL AS valid, name, CASE WHEN name IS NOT NULL THEN description END AS description,
      CASE WHEN name IS NULL THEN 'name' END AS problem FROM f""",
    "path_references": f"{_WITH}{_CANDIDATES}{_REFERENCES} SELECT source_id, root, path, value, target, outcome FROM rs",
    "link_closure": f"{_WITH}{_LINKS} SELECT source_id, link AS path, CASE WHEN outcome NOT IN ('cycle', 'limit') THEN cur END AS terminal, least(hops, 64) AS hops, outcome FROM le0",
    "decision_reasons": f"""{_WITH}{_CANDIDATES}{_REFERENCES}{_EVIDENCE} SELECT source_id, root, code, count(*) AS n_attempts,
      '[' || string_agg('{{"path":"' || path || coalesce('","line":' || line || ',"', '","') || 'value":"' || value || '"}}', ',' ORDER BY path, line, value) || ']' AS evidence
      FROM ev GROUP BY source_id, root, code""",
    "classifications": f"""{_WITH}{_CANDIDATES}{_REFERENCES}{_EVIDENCE}{_CLASSES} SELECT source_id, root, classification,
      CASE WHEN classification = 'portable' AND package_kind IS NULL THEN 'STANDALONE_NO_PLUGIN_BOUNDARY' WHEN classification = 'portable' THEN 'SKILLS_ONLY_PACKAGE'
           WHEN classification = 'ambiguous' AND package_kind = 'mixed' THEN 'MIXED_PLUGIN_AUTONOMY_UNPROVEN' END AS base_reason FROM cl""",
    "classification_counts": f"{_WITH}{_CANDIDATES}{_REFERENCES}{_EVIDENCE}{_CLASSES} SELECT source_id, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (classification = '{c}') AS {c}" for c in D.CLASSES)
    + " FROM cl GROUP BY source_id",
    "content_duplicates": f"{_MEMBERS} {_GROUP.format(key='content_hash', kind='duplicate', where='true')}",
    "name_conflicts": f"{_MEMBERS} {_GROUP.format(key='name', kind='name-conflict', where="name <> ''")}",
    "duplicate_annotation": f"{_MEMBERS} SELECT source_id, root, count(*) OVER g AS n_copies, count(*) OVER g > 1 AS duplicate FROM m WINDOW g AS (PARTITION BY source_id, content_hash)",
    "import_records": f"""{_MEMBERS}, o AS (SELECT source_id, content_hash, arg_min(name, root) AS name, count(*) AS n_candidates FROM m GROUP BY source_id, content_hash),
      s AS (SELECT *, left(coalesce(nullif(regexp_replace(regexp_replace(name, '[^A-Za-z0-9_.-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), ''), 'skill'), 80) AS slug FROM o),
      x AS (SELECT source_id, slug, content_hash, n, count(*) OVER (PARTITION BY source_id, n, lower(slug || '--' || left(content_hash, n))) AS c
            FROM (SELECT *, unnest(range(12, 64)) AS n FROM s)),
      k AS (SELECT source_id, slug, content_hash, min(n) AS n FROM x WHERE c = 1 GROUP BY ALL)
      SELECT s.source_id, s.content_hash, s.slug || '--' || left(s.content_hash, CAST(coalesce(k.n, 64) AS BIGINT)) AS destination, n_candidates
      FROM s LEFT JOIN k USING (source_id, slug, content_hash)""",
    "partition_check": f"""{_WITH}{_CANDIDATES}{_REFERENCES}{_EVIDENCE}{_CLASSES} SELECT source_id, count(*) FILTER (classification = 'portable') AS n_selected,
      count(*) FILTER (classification <> 'portable') AS n_rejected, count(*) FILTER (classification IS NULL) AS n_lost FROM cl GROUP BY source_id""",
    "review_join": f"""{_WITH}{_CANDIDATES}{_REFERENCES}{_EVIDENCE}{_CLASSES}{_REVIEWS} SELECT source_id, root, classification,
      CASE WHEN classification = 'ambiguous' AND verdict = 'plugin_bound' THEN verdict WHEN classification = 'ambiguous' AND verdict = 'portable' AND confidence >= 0.9 THEN verdict
           ELSE classification END AS final,
      CASE WHEN classification <> 'ambiguous' THEN NULL WHEN verdict IS NULL THEN 'FM_UNAVAILABLE' WHEN verdict = 'portable' AND confidence >= 0.9 THEN 'FM_PORTABLE_VERIFIED'
           WHEN verdict = 'portable' THEN 'FM_LOW_CONFIDENCE' ELSE 'FM_' || upper(verdict) END AS review_code
      FROM cl LEFT JOIN rv USING (source_id, root)""",
    "expected_vs_actual": f"""{_WITH}{_CANDIDATES}{_REFERENCES}{_EVIDENCE}{_CLASSES}{_REVIEWS} SELECT source_id, count(*) FILTER (classification = verdict) AS agree,
      count(*) FILTER (classification <> verdict) AS disagree, count(*) FILTER (verdict IS NULL) AS not_expected, count(*) FILTER (classification IS NULL) AS not_found
      FROM cl FULL JOIN rv USING (source_id, root) GROUP BY source_id""",
    "runtime_callers": f"{_WITH}{_CANDIDATES}{_CALLS} SELECT * FROM calls",
    "markdown_references": """SELECT source_id, path, CAST(line AS INT) AS line, syntax, value FROM (
      SELECT coalesce(lang, 'none') AS source_id, 'd' || doc_id || '.md' AS path, doc_id,
             len(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 \n]', '', 'g'), chr(10))) AS n FROM documents WHERE doc_id IS NOT NULL),
      LATERAL (VALUES (3, 'markdown.frontmatter', 'tools/' || doc_id || '.sh'), (n + 5, 'markdown.link', 'guides/' || doc_id || '.md'), (n + 6, 'markdown.link', 'a b.png'),
        (n + 11, 'markdown.reference', 'notes/' || doc_id || '.md'), (n + 15, 'shell.command', 'scripts/run.sh'), (n + 17, 'markdown.action_path', '../shared/' || doc_id || '.sh')) v(line, syntax, value)""",
    "sensitive_paths": """SELECT * FROM (SELECT event_id, 'u' || user_id || '/' || CASE event_id % 5 WHEN 0 THEN '.env.' WHEN 1 THEN 'My-Credentials-' WHEN 2 THEN 'a.PEM/' ELSE 'notes-' END
      || event_type || CASE WHEN event_id % 7 = 0 THEN '.key' ELSE '.txt' END AS path, event_id % 5 < 3 OR event_id % 7 = 0 AS hit FROM events) WHERE hit""".replace("SELECT * FROM (", "SELECT event_id, path FROM (", 1),
    "tree_inventory": f"""{_WITH} SELECT source_id, path, kind, size, path LIKE '%.py' AS executable, symlink_target, sha256, kind = 'symlink' AS opaque, CAST(NULL AS VARCHAR) AS problem FROM inventory
      UNION ALL SELECT DISTINCT source_id, unnest({_ANCESTORS.format(p="folder")}[2:]), 'directory', 0, false, NULL, NULL, true, NULL FROM (SELECT source_id, regexp_replace(path, '/[^/]*$', '') AS folder FROM inventory)""",
    "tree_classes": f"{_WITH}{_CANDIDATES}{_REFERENCES}{_EVIDENCE}{_CLASSES} SELECT source_id, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (classification = '{c}') AS {c}" for c in D.CLASSES)
    + " FROM cl GROUP BY source_id",
    "archive_inventory": """WITH d AS (SELECT doc_id, 'd' || doc_id AS source_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL)
      SELECT source_id, path, kind, CAST(size AS BIGINT) AS size, executable, symlink_target, sha256, opaque, problem FROM d, LATERAL (VALUES
        ('skill', 'directory', 0, false, NULL, NULL, true, NULL),
        ('skill/SKILL.md', 'file', strlen(t), false, NULL, sha256(t), contains(t, chr(0)), NULL),
        ('skill/run.sh', 'file', 3, doc_id % 2 = 0, NULL, sha256('run'), false, NULL),
        ('skill/data.bin', 'file', 3, false, NULL, sha256('\x00\x01\x02'::BLOB), true, NULL),
        ('skill/link', 'symlink', 8, false, 'SKILL.md', NULL, true, NULL),
        ('../up' || doc_id, 'file', 1, false, NULL, NULL, true, 'unsafe_path'),
        ('skill/Run.sh', 'file', 1, false, NULL, NULL, true, 'path_collision'),
        ('skill/hard', 'unsupported', 0, false, NULL, NULL, true, 'unsupported_member'),
        ('skill/link/below', 'file', 1, false, NULL, NULL, true, 'below_symlink')) v(path, kind, size, executable, symlink_target, sha256, opaque, problem)""",
    "residual_paths": f"{_WITH}{_CANDIDATES}{_LITERALS} SELECT * FROM rl",
    "structured_references": f"""WITH RECURSIVE {DUCKDB_CONFIGURED}{_CANDIDATES}{_STRUCTURED} SELECT source_id, root, path, CAST(line AS INT) AS line, syntax, value FROM (
      SELECT source_id, root, path, line, 'json.' || field AS syntax, value FROM jl WHERE NOT globbed
      UNION ALL SELECT source_id, root, path, line, 'json.glob', found FROM jx
      UNION ALL SELECT source_id, root, path, min(line), 'json.glob', value FROM jp GROUP BY source_id, root, path, value HAVING bool_or(stays)
        OR (bool_or(pattern IS NULL) AND count(*) FILTER (EXISTS (SELECT 1 FROM jx WHERE jx.source_id = jp.source_id AND jx.path = jp.path AND jx.value = jp.value)) = 0)
      UNION ALL SELECT source_id, root, path, 1, 'json.parse_failure', '{S.UNPARSEABLE}' FROM jf WHERE NOT json_valid(content))""",
    "ref_scopes": """WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]*)', 1) AS repo, rtrim(regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]*)/?([^?#]*)', 2), '/') AS route FROM pages),
      n AS (SELECT DISTINCT repo, CASE page_id % 3 WHEN 0 THEN split_part(route, '/', 1) WHEN 1 THEN route END AS name FROM p),
      r AS (SELECT *, CASE page_id % 2 WHEN 0 THEN 'tree' ELSE 'blob' END AS kind, CASE page_id % 7 WHEN 1 THEN split_part(route, '/', 1) WHEN 2 THEN 'main' END AS ref, page_id % 11 < 2 AS sub FROM p),
      m AS (SELECT r.*, CASE WHEN route = ref OR starts_with(route, ref || '/') THEN ref ELSE coalesce(
              (SELECT arg_max(name, length(name)) FROM n WHERE n.repo = r.repo AND name <> '' AND (r.route = name OR starts_with(r.route, name || '/'))),
              CASE WHEN regexp_full_match(split_part(route, '/', 1), '[0-9a-f]{40}') THEN split_part(route, '/', 1) END) END AS cut FROM r),
      k AS (SELECT *, substr(route, length(cut) + 2) AS rest, CASE WHEN route = '' THEN NULL WHEN cut IS NULL AND ref IS NULL THEN 'ref' WHEN cut IS NULL AND NOT sub THEN 'subpath'
              WHEN kind = 'blob' AND NOT sub AND substr(route, length(cut) + 2) = '' THEN 'blob' END AS problem FROM m)
      SELECT page_id, repo, route, kind, CASE WHEN problem IS NULL THEN coalesce(nullif(ref, ''), cut) END AS wanted_ref,
        CASE WHEN problem IS NOT NULL THEN NULL WHEN sub THEN 'docs' WHEN route = '' THEN '.' WHEN kind = 'blob' THEN coalesce(nullif(regexp_replace(rest, '/?[^/]*$', ''), ''), '.') ELSE coalesce(nullif(rest, ''), '.') END AS scope,
        CASE WHEN problem IS NULL AND NOT sub AND route <> '' AND kind = 'blob' THEN rest END AS target, problem FROM k""",
    "evidence_lines": f"""WITH d AS (SELECT coalesce(lang, 'none') AS source_id, 'd' || doc_id || '.md' AS path, doc_id,
        coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN chr(10) || 'x-api-key: k' || doc_id ELSE '' END AS t FROM documents WHERE doc_id IS NOT NULL),
      l AS (SELECT source_id, path, doc_id, string_split(t, chr(10)) AS a, string_split({_redacted('t')}, chr(10)) AS b FROM d),
      x AS (SELECT source_id, path, unnest(range(1, len(a) + 1)) AS k, unnest(a) AS text, unnest(b) AS shown FROM l WHERE len(a) = len(b)),
      q AS (SELECT source_id, path, CASE WHEN doc_id % 2 = 0 THEN len(a) ELSE doc_id % 5 + 1 END AS k, a FROM l),
      c AS (SELECT source_id, path, unnest([k - 1, k, k + 1, k + 2]) AS line, split_part(a[k], ' ', 1) AS value FROM q WHERE k <= len(a))
      SELECT c.source_id, c.path, CAST(line AS INT) AS line, value, CAST(CASE WHEN bool_or(x.k = c.line) THEN c.line WHEN min(x.k) = max(x.k) THEN min(x.k) END AS INT) AS resolved
      FROM c LEFT JOIN x ON x.source_id = c.source_id AND x.path = c.path AND x.k BETWEEN c.line - 1 AND c.line + 1 AND x.text = x.shown AND contains(x.text, c.value)
      GROUP BY c.source_id, c.path, line, value""",
    "inert_symbols": f"""{_WITH}, l AS (SELECT source_id, path, string_split(content, chr(10)) AS t FROM inventory WHERE kind = 'file'),
      f AS (SELECT source_id, path, unnest(range(1, len(t) + 1)) AS line, unnest(t) AS x, list_position(t, '```text') AS fence FROM l)
      SELECT source_id, path, CAST(line AS INT) AS line, 'mcp.tool' AS syntax, regexp_extract(x, 'mcp__[A-Za-z0-9_.-]+__find') AS value, CAST(strpos(x, 'mcp__') - 1 AS INT) AS col
      FROM f WHERE contains(x, 'mcp__') AND (fence < line OR path LIKE '%/tool.py')
      UNION ALL SELECT source_id, path, line, 'plugin.command', '/deploy', 5 FROM f WHERE x = 'then /deploy it' AND fence < line
      UNION ALL SELECT source_id, path, line, 'plugin.variable', '$' || '{{PLUGIN_ROOT}}', strpos(x, '#') + 1 FROM f WHERE path LIKE '%/tool.sh' AND contains(x, '# $')""",
    "scan_limits": f"""{_WITH}, s AS (SELECT source_id, count(*) AS n_entries, CAST(sum(CASE WHEN kind = 'file' THEN size ELSE 0 END) AS BIGINT) AS n_bytes,
      max(size) AS largest, CAST(max(len(string_split(path, '/'))) AS INT) AS deepest FROM inventory GROUP BY source_id)
      SELECT *, n_entries <= 10000 AND n_bytes <= 262144000 AND largest <= 10485760 AND deepest <= 64 AS within FROM s""",
    "path_collisions": """SELECT source_id, replace(replace(lower(nfc_normalize(path)), 'ß', 'ss'), 'ς', 'σ') AS path_key, count(DISTINCT path) AS n FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS source_id,
      unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS path FROM pages) WHERE path IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT path) > 1""",
    "source_specs": """SELECT page_id, CASE host WHEN '' THEN 'local' WHEN 'github.com' THEN 'github' ELSE 'git' END AS kind, host,
      host <> '' AND (regexp_matches(u, '[?#]') OR regexp_matches(u, '^[a-z]+://[^/@]*:[^/@]*@') OR NOT regexp_matches(u, '^(?:https|ssh|git)://')) AS unsafe
      FROM (SELECT page_id, coalesce(url, '') AS u, lower(regexp_extract(coalesce(url, ''), '^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM pages)""",
    "review_quota": "SELECT * FROM (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS attempt FROM conversations) WHERE attempt <= 2",
    "envelope_budget": """SELECT doc_id, CAST(reach AS BIGINT) AS reach FROM (SELECT doc_id, sum(coalesce(strlen(text), 0)) OVER (PARTITION BY lang, source ORDER BY doc_id) AS reach FROM documents)
      WHERE reach <= 20000""",
    "review_envelopes": f"{_envelopes()} SELECT source_id, root, n, path, cut, chars, reach FROM pf",
    "review_statuses": f"""{_envelopes()} SELECT source_id, root, count(*) AS n_files, count(f.n) AS n_shown, count(*) - count(*) FILTER (NOT f.cut) AS n_truncated, coalesce(max(reach), 0) AS n_chars
      FROM pn LEFT JOIN pf f USING (source_id, root, path) GROUP BY source_id, root""",
    "strict_reviews": _strict_reviews(),
    "secret_redaction": _redaction(),
    "review_redaction": _review_redaction(),
    "link_extraction": """SELECT page_id, count(*) AS links, count(*) FILTER (starts_with(href, '/')) AS host_links, min(regexp_extract(href, '[^/]*$')) AS first_name
      FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
