"""Sources other than tables: directory trees, manifests, facts, bundles and logs."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import NAME_LINE, TITLE_LINE, detect_language, first_line

EVENT = "ts long, source string, event_type string, payload string, seq long"
AUDIT = "ts long, proposal_id string, command string, decision string, matched_rule string, actor string"
FACT = "kind string, claim string, semantic boolean, path string, start_line long, end_line long, origin string, props string"
PARSEABLE = ("rust", "typescript", "javascript", "python", "go", "java", "kotlin")
MOST_ENTRIES = 50_000


def tree(spark: SparkSession, root: str, ignored: tuple[str, ...] = (), most: int = MOST_ENTRIES) -> DataFrame:
    """(path, size, language) of all files under a folder, without hidden ones and those that match an ignore pattern
    (a regular expression on the relative path).  Only metadata is read.  More than ``most`` files are an error."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("full"), F.col("length").alias("size"))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    f = f.withColumn("path", F.regexp_replace(F.regexp_replace("full", r"^[a-z]+:/+", "/"), F.lit("^" + _quoted(folder) + "/"), F.lit("")))
    f = f.filter(~F.col("path").rlike(r"(?:^|/)\."))
    for p in ignored:
        f = f.filter(~F.col("path").rlike(p))
    if f.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} entries under {root}")
    return f.select("path", "size", detect_language(F.col("path")).alias("language"))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def supported_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("language").isin(*PARSEABLE))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, text) of the parseable files under a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select(F.col("path"), detect_language(F.col("path")).alias("language"), F.col("content").cast("string").alias("text")).filter(F.col("language").isin(*PARSEABLE))


def facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts from JSON: either {"facts": [...]} or a list."""
    one = spark.read.text(path, wholetext=True)
    as_object = F.from_json("value", f"facts array<struct<{_struct(FACT)}>>")
    as_list = F.from_json("value", f"array<struct<{_struct(FACT)}>>")
    rows = F.when(F.ltrim("value").startswith("["), as_list).otherwise(as_object["facts"])
    return one.select(F.explode(rows).alias("f")).select("f.*")


def _struct(ddl: str) -> str:
    return ", ".join(":".join(c.split(" ", 1)) for c in ddl.split(", "))


def scope_manifests(spark: SparkSession, documents: list[tuple[str, str]]) -> DataFrame:
    """(path, name, kind, value) rows of scope manifests in TOML: files, symbols, must_hold, must_not_contain, tests."""
    rows = []
    for path, text in documents:
        m = tomllib.loads(text)
        for kind in ("files", "symbols", "must_hold", "must_not_contain"):
            rows += [(path, m.get("name"), kind, str(v)) for v in m.get(kind, [])]
        if "tests" in m:
            rows.append((path, m.get("name"), "tests", str(m["tests"])))
    return spark.createDataFrame(rows, "path string, name string, kind string, value string")


def package_candidates(files: DataFrame) -> DataFrame:
    """Container candidates (canonical_key, name, strategy, confidence, file, line) from manifest files (path, text); the line
    is that of the name or title, where the file gives one.

    One DataFrame a strategy, in order: Cargo packages, npm workspaces' packages (folders that a pattern of the root's
    ``workspaces`` names, in either of its forms), single npm packages, Helm charts, component folders, Dockerfiles.
    """
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", r"/?[^/]*$", "")
    last = F.element_at(F.split(folder, "/"), -1)

    def found(which, label, strategy: str, confidence, line=F.lit(None).cast("int")) -> DataFrame:  # noqa: B008
        f = files.filter(which).select(F.concat(F.lit("container/"), label).alias("canonical_key"), label.alias("name"), F.lit(strategy).alias("strategy"), confidence.alias("confidence"), F.col("path").alias("file"), line.alias("line"))
        return f.filter(F.coalesce(F.col("name"), F.lit("")) != "")

    toml_name = F.regexp_extract("text", r'(?ms)^\[package\][^\[]*?^name\s*=\s*"([^"]+)"', 1)
    npm_name = F.get_json_object("text", "$.name")
    chart = F.regexp_extract("text", r'(?m)^name:\s*["\']?([^"\'\s]+)', 1)
    title = F.regexp_extract("text", r'(?im)^\s*LABEL\s+[^\n]*?title\s*=\s*"?([^"\n]+)"?', 1)
    inner = folder != ""
    spaces = F.coalesce(F.from_json(F.get_json_object("text", "$.workspaces"), "array<string>"), F.from_json(F.get_json_object("text", "$.workspaces.packages"), "array<string>"))
    globs = files.filter((name == "package.json") & ~inner).select(F.explode(spaces).alias("glob"))
    # a pattern's * stands for one folder, ** for any; folders up to two below what it names count
    table = globs.agg(F.collect_set(F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.rtrim(F.col("glob"), F.lit("/")), r"[.+()]", r"\\$0"), r"\*\*", "\u0001"), r"\*", "[^/]+"), F.lit("(?:/[^/]+){0,2}$"))).alias("globs"))
    member = F.exists("globs", lambda g: F.regexp_like(folder, F.regexp_replace(g, "\u0001", ".*")))
    files = files.join(F.broadcast(table), F.lit(True))  # one row
    parts = [
        found(name == "Cargo.toml", toml_name, "cargo", F.lit(0.85)),
        found((name == "package.json") & inner & member, npm_name, "npm", F.lit(0.8), first_line(F.col("text"), NAME_LINE)),
        found((name == "package.json") & ~inner, npm_name, "npm-single", F.lit(0.7), first_line(F.col("text"), NAME_LINE)),
        found(name == "Chart.yaml", F.when(chart != "", chart).otherwise(last), "helm", F.when(chart != "", 0.7).otherwise(0.5)),
        found(F.col("path").rlike(r"(?:^|/)components/[^/]+/[^/]+$"), last, "components", F.lit(0.65)),
        found(F.lower(name) == "dockerfile", F.when(title != "", title).otherwise(last), "dockerfile", F.lit(0.6), first_line(F.col("text"), TITLE_LINE)),
    ]
    ordered = [p.withColumn("nth", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, ordered)


def dependencies(files: DataFrame) -> DataFrame:
    """(path, name, kind) of dependencies in Cargo manifests, each once; kinds are dependencies, dev-dependencies and
    build-dependencies, whether a name stands in such a section, in a table of its own ([dependencies.x]), below
    [target.…] or below [workspace].  A manifest that can't be read has none."""
    kinds = ("dependencies", "dev-dependencies", "build-dependencies")

    def of(m: dict) -> Iterator[tuple[str, str]]:
        for kind in kinds:
            yield from ((name, kind) for name in m.get(kind, {}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    m = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    continue
                for part in (m, m.get("workspace", {}), *m.get("target", {}).values()):
                    rows += [(path, name, kind) for name, kind in of(part)]
            yield pd.DataFrame(rows, columns=["path", "name", "kind"])

    manifests = files.filter(F.col("path").rlike(r"(?:^|/)Cargo\.toml$")).select("path", "text")
    return manifests.mapInPandas(run, "path string, name string, kind string").distinct()


def event_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Events as JSON lines, in batch or as a stream."""
    return (spark.readStream if stream else spark.read).schema(EVENT).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends JSON lines; what is there stays."""
    rows.write.mode("append").json(path)


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def bundle_graph(text: str) -> tuple[list[dict], list[dict]]:
    """Nodes (id, label, kind, language, file, line, parentId) and edges (id, source, target, kind) of an exported
    bundle in any of its four shapes: projection, call graph, class diagram, bare lists."""
    b = json.loads(text)
    b = b.get("projection", b)
    nodes = b.get("nodes") or b.get("elements") or b.get("functions") or b.get("classes") or []
    links = b.get("edges") or b.get("relations") or b.get("calls") or []
    ident = lambda n: n.get("id") or n.get("canonical_key")
    out = [{"id": ident(n), "label": n.get("label") or n.get("name") or ident(n), "kind": n.get("kind") or n.get("type"), "language": n.get("language"), "file": n.get("file"), "line": n.get("line"), "parentId": n.get("parentId")} for n in nodes]
    ends = [{"id": ident(e), "source": e.get("source") or e.get("caller"), "target": e.get("target") or e.get("callee"), "kind": e.get("kind") or e.get("predicate")} for e in links]
    return out, ends
