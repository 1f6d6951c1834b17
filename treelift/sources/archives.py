"""Source trees in tar archives and in folders, as inventory rows.

Rows: source_id, path, kind (file, directory, symlink, unsupported), size, executable, symlink_target, sha256, content (null
unless the bytes are UTF-8 without NUL), and problem: null, or why a member does not belong to the tree.
"""

from __future__ import annotations

import hashlib
import io
import tarfile
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelift.functions.paths import ancestors, parent

#: Folders of version control, left out at any depth, and limits of one source.
VCS = [".git", ".hg", ".svn"]
MAX_FILE = 10 << 20
MAX_DEPTH = 64
MAX_ENTRIES = 10_000
MAX_TOTAL = 250 << 20
MAX_ARCHIVE = 100 << 20
INVENTORY = "source_id string, path string, kind string, size long, executable boolean, symlink_target string, sha256 string, content string, problem string"
_COLUMNS = [f.split()[0] for f in INVENTORY.split(", ")]


def text_or_none(data: bytes) -> str | None:
    """Bytes as text, if they are UTF-8 and hold no NUL."""
    if b"\0" in data:
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def unsafe_path(name: str) -> bool:
    """Paths that leave a tree, or that another system would read otherwise."""
    parts = name.split("/")
    return not name or name.startswith("/") or "\\" in name or "\0" in name or ".." in parts or (len(name) > 1 and name[1] == ":")


class _Tree:
    """Paths that an archive has made so far, with the folders that follow from them."""

    def __init__(self, max_entries: int, max_depth: int) -> None:
        self.kinds: dict[str, str] = {}
        self.keys: dict[str, str] = {}
        self.max_entries, self.max_depth = max_entries, max_depth

    def register(self, path: str, kind: str) -> str | None:
        """Takes a path up; returns why not, or 'known' for a folder that is there already."""
        if path.count("/") >= self.max_depth:
            return "too_deep"
        key = unicodedata.normalize("NFC", path).casefold()
        if self.keys.get(key, path) != path:
            return "path_collision"
        if path in self.kinds:
            return "known" if self.kinds[path] == kind == "directory" else "path_collision"
        if len(self.kinds) >= self.max_entries:
            return "too_many_entries"
        self.keys[key], self.kinds[path] = path, kind
        return None

    def parents(self, path: str) -> tuple[list[str], str | None]:
        """Folders above a path that were not there yet, and why the path can't lie below them."""
        made: list[str] = []
        parts = path.split("/")
        for k in range(1, len(parts)):
            above = "/".join(parts[:k])
            kind = self.kinds.get(above)
            if kind == "symlink":
                return made, "below_symlink"
            if kind not in (None, "directory"):
                return made, "parent_collision"
            if kind is None:
                problem = self.register(above, "directory")
                if problem:
                    return made, problem
                made.append(above)
        return made, None


def members(
    archive: bytes, max_file: int = MAX_FILE, max_depth: int = MAX_DEPTH, max_entries: int = MAX_ENTRIES, max_total: int = MAX_TOTAL, max_archive: int = MAX_ARCHIVE
) -> Iterator[tuple]:
    """Rows (path, kind, size, executable, symlink_target, sha256, content, problem) of an archive's members, in its order.

    Folders that follow from a member's path are rows too.  An archive with too many members or bytes is read no further.
    """
    if len(archive) > max_archive:
        yield ("", "unsupported", len(archive), False, None, None, None, "archive_too_large")
        return
    try:
        tar = tarfile.open(fileobj=io.BytesIO(archive), mode="r:*")
    except (tarfile.TarError, EOFError, OSError):
        yield ("", "unsupported", len(archive), False, None, None, None, "not_an_archive")
        return
    tree, total, seen = _Tree(max_entries, max_depth), 0, 0
    with tar:
        while True:
            try:
                member = tar.next()
            except (tarfile.TarError, EOFError, OSError):
                yield ("", "unsupported", 0, False, None, None, None, "broken_archive")
                return
            if member is None:
                return
            seen += 1
            if seen > max_entries:
                yield ("", "unsupported", 0, False, None, None, None, "too_many_entries")
                return
            name = member.name.rstrip("/")
            path = "/".join(p for p in name.split("/") if p not in ("", ".")) if not name.startswith("/") else name
            if not path or set(path.split("/")) & set(VCS):
                continue
            kind = "file" if member.isreg() else "directory" if member.isdir() else "symlink" if member.issym() else "unsupported"
            problem = "unsafe_path" if unsafe_path(name) else "unsupported_member" if kind == "unsupported" else None
            if problem is None:
                made, problem = tree.parents(path)
                for folder in made:
                    yield (folder, "directory", 0, False, None, None, None, None)
            if problem is None:
                problem = tree.register(path, kind)
            if problem == "known":
                continue
            if problem is None and kind == "symlink" and "\0" in member.linkname:
                problem = "unsafe_target"
            if problem is None and kind == "file":
                total += member.size
                problem = "too_large" if member.size > max_file else "too_many_bytes" if total > max_total else None
            size = member.size if kind == "file" else len(member.linkname.encode()) if kind == "symlink" else 0
            if problem:
                yield (path, kind, size, False, None, None, None, problem)
                if problem in ("too_many_bytes", "too_many_entries"):
                    return
            elif kind == "symlink":
                yield (path, kind, size, False, member.linkname, None, None, None)
            elif kind == "file":
                data = tar.extractfile(member).read()
                if len(data) != size:
                    yield (path, kind, size, False, None, None, None, "broken_archive")
                    return
                yield (path, kind, size, bool(member.mode & 0o111), None, hashlib.sha256(data).hexdigest(), text_or_none(data), None)
            else:
                yield (path, kind, 0, False, None, None, None, None)


def untar(archives: DataFrame, **limits: int) -> DataFrame:
    """Inventory rows of archives (source_id, archive), under the limits of :func:`members`. Members that can't be taken are rows with a
    problem; an archive that can't be read is one row; a null archive has none. Folders of version control are left out."""

    entry = ", ".join(f"{n}: {t}" for n, t in (f.split() for f in INVENTORY.split(", ")[1:]))

    @F.udf(returnType=f"array<struct<{entry}>>", useArrow=False)  # few archives at a time; an Arrow batch of ten thousand is of any size
    def read(archive: bytes | None) -> list[tuple] | None:
        return list(members(bytes(archive), **limits)) if archive is not None else None

    found = archives.select(F.col("source_id").cast("string").alias("source_id"), F.explode(read("archive")).alias("m"))
    return found.select("source_id", "m.*")


def folder_inventory(spark: SparkSession, folder: str, source_id: str) -> DataFrame:
    """Inventory rows of a folder in any store that Spark reads; folders follow from the files in them.

    Such stores tell no permissions and no links, so nothing is executable and links are read as what they lead to. The reader
    passes over files without bytes, which an archive keeps.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(folder).select("path", "content")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    path = F.substr("path", F.lit(len(root) + 2))
    text = F.decode("content", "utf-8")
    clean = F.is_valid_utf8(F.col("content").cast("string")) & ~F.contains(F.col("content"), F.lit(b"\0"))
    files = files.select(
        path.alias("path"),
        F.lit("file").alias("kind"),
        F.length("content").cast("long").alias("size"),
        F.lit(False).alias("executable"),
        F.lit(None).cast("string").alias("symlink_target"),
        F.sha2("content", 256).alias("sha256"),
        F.when(clean, text).alias("content"),
        F.when(F.length("content") > MAX_FILE, "too_large").alias("problem"),
    ).where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, VCS))))
    above = files.select(F.explode(ancestors(parent(F.col("path")))).alias("path")).where("path <> '.'").distinct()
    folders = above.select("path", F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("executable"))
    rows = files.unionByName(folders, allowMissingColumns=True).withColumn("source_id", F.lit(source_id))
    return rows.select(*_COLUMNS)


#: Problems of rows, and the codes that a source is refused with.
REFUSALS = {
    "PATH_TRAVERSAL": ["unsafe_path", "unsafe_target", "below_symlink", "hard_link"],
    "PATH_COLLISION": ["path_collision", "parent_collision"],
    "SCAN_LIMIT_EXCEEDED": ["too_deep", "too_many_entries", "too_many_bytes", "archive_too_large"],
    "FILE_TOO_LARGE": ["too_large"],
    "UNSUPPORTED_ENTRY": ["unsupported_member"],
    "SOURCE_CHANGED": ["changed"],
    "INVALID_ARCHIVE": ["not_an_archive", "broken_archive"],
}


def refused_sources(inventory: DataFrame, max_entries: int = MAX_ENTRIES, max_total: int = MAX_TOTAL) -> DataFrame:
    """source_id, code, path: sources with an entry that can't be taken, or that are too large as a whole; a source is taken whole or not at all.

    The first entry by code and path tells why; path is null if the source is too large.
    """
    code = F.lit(None).cast("string")
    for name, problems in REFUSALS.items():
        code = F.when(F.col("problem").isin(problems), name).otherwise(code)
    bad = inventory.where("problem is not null").select("source_id", code.alias("code"), "path")
    sums = inventory.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == "file", F.col("size")).otherwise(0)).alias("bytes"))
    large = sums.where((F.col("n") > max_entries) | (F.col("bytes") > max_total)).select("source_id", F.lit("SCAN_LIMIT_EXCEEDED").alias("code"), F.lit(None).cast("string").alias("path"))
    first = bad.unionByName(large).groupBy("source_id").agg(F.min(F.struct("code", "path")).alias("r"))
    return first.select("source_id", "r.code", "r.path")


def admitted(inventory: DataFrame, refused: DataFrame) -> DataFrame:
    """Entries of the sources that are not refused."""
    return inventory.join(refused.select("source_id"), "source_id", "left_anti").drop("problem")


def pack_documents(docs: DataFrame) -> DataFrame:
    """A tar archive (source_id, archive) per document, with members to take, to leave out and to reject."""

    pack = F.udf(lambda doc_id, text: _packed(doc_id, bytes(text or b"")), "binary", useArrow=False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null")
    return rows.select(F.concat(F.lit("d"), F.col("doc_id")).alias("source_id"), pack("doc_id", "text").alias("archive"))


def _packed(doc_id: int, text: bytes) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:

        def add(name: str, data: bytes = b"", **fields) -> None:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            for field, value in fields.items():
                setattr(info, field, value)
            tar.addfile(info, io.BytesIO(data))

        add("skill", type=tarfile.DIRTYPE, mode=0o755)
        add("skill/SKILL.md", text)
        add("skill/run.sh", b"run", mode=0o755 if doc_id % 2 == 0 else 0o644)
        add("skill/data.bin", b"\0\1\2")
        add("skill/.git/config", b"x")
        add("skill/link", type=tarfile.SYMTYPE, linkname="SKILL.md")
        add(f"../up{doc_id}", b"x")
        add("skill/Run.sh", b"x")
        add("skill/hard", type=tarfile.LNKTYPE, linkname="skill/run.sh")
        add("skill/link/below", b"x")
    return out.getvalue()
