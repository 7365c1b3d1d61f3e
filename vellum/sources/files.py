"""Directory scans, ignore rules, git revisions and bounded JSON."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Iterable
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config, Limits
from ..plans import storage


class BoundsError(ValueError):
    """JSON is larger, deeper or longer than allowed."""


def glob_regex(pattern: str) -> str:
    """A Java and Python regular expression for a glob with `**`, `*`, `?`, `[...]` and `{a,b}`."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + r"(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-2] for x in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}\\z"


def ignore_globs(lines: Iterable[str]) -> list[str]:
    """Globs of a .gitignore: comments and negations are dropped; a name without a slash counts at any depth."""
    globs = []
    for line in (x.strip() for x in lines):
        if not line or line[0] in "#!":
            continue
        name = line.replace("\\", "/").removeprefix("/")
        base = name.rstrip("/")
        if base:
            whole = f"{base}/**" if name.endswith("/") else base
            globs += [whole] if "/" in base else [whole, f"**/{whole}"]
    return globs


def _read_ignores(spark: SparkSession, root: str) -> list[str]:
    """Globs of the root's .gitignore, read past Spark's listing, which leaves out hidden files."""
    path = f"{root}/.gitignore"
    return ignore_globs(storage.read_text(spark, path).splitlines()) if storage.exists(spark, path) else []


def qualified(spark: SparkSession, root: str) -> str:
    """The root as Spark names it in file paths, without a trailing slash."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().rstrip("/")


def scan_markdown(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """path (relative), text, length and modified of every Markdown file that the configuration takes.

    Globs become predicates on the listing, so files that are left out aren't read. Hidden files
    and folders never count; files over the size limit are left out silently.
    """
    base = qualified(spark, root)
    excluded = [*config.exclude, *(_read_ignores(spark, root) if config.follow_gitignore else [])]
    names = r"(?i)\.mdx?\z" if config.parse_mdx else r"(?i)\.md\z"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[mM][dD]*")
        .load(root)
        .where(F.col("length") <= config.max_file_bytes)
    )
    uri = F.regexp_replace(F.col("path"), r"^([a-z][a-z0-9+.-]*):/+", "$1:/")
    prefix = re.sub(r"^([a-z][a-z0-9+.-]*):/+", r"\1:/", base) + "/"
    decoded = F.url_decode(F.regexp_replace(F.substring(uri, len(prefix) + 1, 1 << 20), r"\+", "%2B")) if "%" in base else F.substring(uri, len(prefix) + 1, 1 << 20)
    files = files.withColumn("relative", decoded).where(F.col("relative").rlike(names) & ~F.col("relative").rlike(r"(?:^|/)\."))
    wanted = F.lit(False)
    for glob in config.include:
        wanted = wanted | F.col("relative").rlike(glob_regex(glob))
    for glob in excluded:
        wanted = wanted & ~F.col("relative").rlike(glob_regex(glob))
    return files.where(wanted).select(F.col("relative").alias("path"), F.col("content").cast("string").alias("text"), "length", F.col("modificationTime").alias("modified"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Relative paths of all files under root, for checks that a file exists; contents aren't read."""
    base = re.sub(r"^([a-z][a-z0-9+.-]*):/+", r"\1:/", qualified(spark, root)) + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"^([a-z][a-z0-9+.-]*):/+", "$1:/").alias("path"))
    return files.select(F.substring("path", len(base) + 1, 1 << 20).alias("path"))


def inside_root(path: str) -> bool:
    """Whether a relative path stays under its root."""
    parts: list[str] = []
    for part in PurePosixPath(path.replace("\\", "/")).parts:
        if part == "..":
            if not parts:
                return False
            parts.pop()
        elif part != ".":
            parts.append(part)
    return not path.startswith("/")


def check_bounds(value: Any, depth: int = Limits.JSON_DEPTH, nodes: int = Limits.JSON_NODES, longest: int | None = Limits.JSON_ARRAY) -> None:
    """Raise BoundsError if a JSON value nests too deep, has too many nodes or too long an array."""
    stack, seen = [(value, 1)], 0
    while stack:
        node, level = stack.pop()
        seen += 1
        if seen > nodes:
            raise BoundsError(f"JSON has more than {nodes} nodes")
        if level > depth:
            raise BoundsError(f"JSON nests deeper than {depth}")
        if isinstance(node, dict):
            stack.extend((v, level + 1) for v in node.values())
        elif isinstance(node, list):
            if longest is not None and len(node) > longest:
                raise BoundsError(f"JSON array is longer than {longest}")
            stack.extend((v, level + 1) for v in node)


def parse_json(text: str, **bounds: Any) -> Any:
    if len(text.encode()) > Limits.JSON_BYTES:
        raise BoundsError(f"JSON is larger than {Limits.JSON_BYTES} bytes")
    value = json.loads(text)
    check_bounds(value, **bounds)
    return value


def read_json(path: str, **bounds: Any) -> Any:
    if Path(path).stat().st_size > Limits.JSON_BYTES:
        raise BoundsError(f"JSON is larger than {Limits.JSON_BYTES} bytes")
    return parse_json(Path(path).read_text("utf-8"), **bounds)


ARTIFACT = T.StructType([T.StructField("files", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("symbols", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType())])))])))])


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """path and symbols of each file of a code artifact."""
    return spark.read.schema(ARTIFACT).json(path, multiLine=True).select(F.explode("files").alias("file")).select("file.path", "file.symbols").where("path is not null")


def ignore_store(root: str, folder: str = ".vellum") -> bool:
    """Have the root's .gitignore leave out the store but not the settings; False if it does already."""
    target = Path(root, ".gitignore")
    text = target.read_text("utf-8") if target.exists() else ""
    rules = {line.strip().removeprefix("/") for line in text.splitlines()}
    if rules & {f"{folder}/", f"{folder}/*", f"{folder}/**", f"**/{folder}/**"}:
        return False
    gap = "" if not text else "\n" if text.endswith("\n") else "\n\n"
    target.write_text(f"{text}{gap}# local graph\n{folder}/*\n!{folder}/config.json\n", "utf-8")
    return True


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True).stdout


def changed_paths(root: str, since: str = "HEAD") -> list[tuple[str, str]]:
    """(status, path) of files that differ from a revision; a rename is a deletion and an addition."""
    out = []
    for line in git(root, "diff", "--name-status", "-M", since, "--").splitlines():
        status, *paths = line.split("\t")
        out += [("D", paths[0]), ("A", paths[1])] if status[0] == "R" else [(status[0], p) for p in paths]
    out += [("A", p) for p in git(root, "ls-files", "--others", "--exclude-standard").splitlines()]
    return out


def renames(root: str, base: str) -> list[tuple[str, str]]:
    lines = git(root, "diff", "--name-status", "-M", base, "--").splitlines()
    return [tuple(line.split("\t")[1:3]) for line in lines if line.startswith("R")]


def export_revision(root: str, revision: str, target: str) -> None:
    """The tracked Markdown files and ignore rules of a revision, under another directory."""
    for name in git(root, "ls-tree", "-r", "--name-only", revision).splitlines():
        if name.lower().endswith((".md", ".mdx")) or name == ".gitignore":
            out = Path(target, name)
            out.parent.mkdir(parents=True, exist_ok=True)
            out.write_bytes(subprocess.run(["git", "-C", root, "show", f"{revision}:{name}"], check=True, capture_output=True).stdout)
