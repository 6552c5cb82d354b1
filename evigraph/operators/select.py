"""Selections over the graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_exportable, status_or_accepted

ELEMENT_COLUMNS = ("id", "kind_id", "category", "canonical_key", "current_name", "current_status", "current_confidence", "current_version_id")


class NotFound(LookupError):
    pass


class Ambiguous(LookupError):
    pass


def query_elements(elements: DataFrame, category: str, scope: str | None = None, kind: str | None = None, exact: bool = False) -> DataFrame:
    """Elements of a category, under a key prefix (or exactly a key), whose kind contains a text."""
    cond = F.col("category") == category
    if scope is not None:
        cond &= (F.col("canonical_key") == scope) if exact else F.col("canonical_key").startswith(scope)
    if kind is not None:
        cond &= F.col("kind_id").contains(kind)
    return elements.filter(cond).select(*ELEMENT_COLUMNS)


def query_edges(edges: DataFrame, elements: DataFrame, source_category: str, target_category: str | None = None, closed_under: DataFrame | None = None) -> DataFrame:
    """Active edges whose ends have the categories; ``closed_under``: only between these elements."""
    ids = elements.select("id", "category")
    src = ids.filter(F.col("category") == source_category).select(F.col("id").alias("source_id"))
    dst = ids.filter(F.col("category") == (target_category or source_category)).select(F.col("id").alias("target_id"))
    out = edges.filter("active").join(src, "source_id", "left_semi").join(dst, "target_id", "left_semi")
    if closed_under is not None:
        out = closed(out, closed_under)
    return out.select("relation_id", "predicate_id", "source_id", "target_id", "order_key", "props")


def closed(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the elements."""
    known = elements.select(F.col("id").alias("known"))
    return edges.join(known, edges.source_id == F.col("known"), "left_semi").join(known, edges.target_id == F.col("known"), "left_semi")


def version_props(versions: DataFrame, ids: DataFrame) -> DataFrame:
    """Versions whose id is among ``ids`` (column id)."""
    return versions.join(ids.select("id").distinct(), "id", "left_semi").select("id", "name", "description", "props")


def list_evidence(evidence: DataFrame, path: str | None = None, limit: int = 100) -> DataFrame:
    """By start line; limited only where no path narrows it."""
    if path is not None:
        return evidence.filter(F.col("path") == path).orderBy("start_line", "id")
    return evidence.orderBy("start_line", "id").limit(limit)


def list_evidence_by_status(evidence: DataFrame, status: str, path: str | None = None, limit: int = 100, compat: bool = False) -> DataFrame:
    """Filters, then limits; ``compat``: limits first, so the result may be short."""
    wanted = status_or_accepted(F.col("props")) == status
    if path is not None:
        return list_evidence(evidence, path).filter(wanted)
    if compat:
        return list_evidence(evidence, None, limit).filter(wanted)
    return list_evidence(evidence.filter(wanted), None, limit)


def exportable_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.filter(is_exportable(F.col("props")))


def existing_keys(elements: DataFrame) -> DataFrame:
    return elements.filter("canonical_key is not null").select("canonical_key").distinct()


def only_new(candidates: DataFrame, elements: DataFrame) -> DataFrame:
    """Candidates whose key no element has."""
    return candidates.join(existing_keys(elements), "canonical_key", "left_anti")


def resolve_selector(elements: DataFrame, *, name: str | None = None, key: str | None = None, file: str | None = None, line: int | None = None) -> str:
    """The one canonical key that a name, a key, or a file and line stands for.  Keys of code are lang:file:name:line."""
    if key is not None:
        cond = F.col("canonical_key") == key
    elif name is not None:
        cond = F.col("current_name") == name
    else:
        part = F.split("canonical_key", ":")
        cond = (F.get(part, F.lit(1)) == file) & (F.element_at(part, -1) == str(line))
    found = elements.filter(cond).select("canonical_key").limit(2).collect()
    if not found:
        raise NotFound(f"nothing matches {name or key or f'{file}:{line}'}")
    if len(found) > 1:
        raise Ambiguous(f"more than one element matches {name or key or f'{file}:{line}'}")
    return found[0][0]


def get_diagram(diagrams: DataFrame, ident: str) -> DataFrame:
    """The one diagram of an id; an error if there is none."""
    found = diagrams.filter(F.col("id") == ident)
    if found.isEmpty():
        raise NotFound(f"diagram not found: {ident}")
    return found


def get_view_members(members: DataFrame, diagram: str) -> DataFrame:
    return members.filter(F.col("diagram_id") == diagram)


def related(edges: DataFrame, elements: DataFrame, source: str, predicate: str, kind: str | None = None) -> DataFrame:
    """Elements at the end of active edges of a predicate from one element: components of a container
    (core.contains, c4.component), scenarios of a use case (usecase.realized_by)."""
    ends = edges.filter((F.col("source_id") == source) & (F.col("predicate_id") == predicate) & F.col("active")).select(F.col("target_id").alias("end"))
    wanted = elements if kind is None else elements.filter(F.col("kind_id") == kind)
    return wanted.join(ends, F.col("id") == F.col("end"), "left_semi")


def ordered_interactions(edges: DataFrame, elements: DataFrame, scenario: str, predicate: str = "behavior.has_interaction") -> DataFrame:
    """Interactions of a scenario by their order key."""
    return related(edges, elements, scenario, predicate).orderBy("current_order_key", "id")


def evidence_of_relation(relation: str, current: DataFrame, supported_by: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence that supports the current version of a relation, the surest first.  ``current``: CURRENT_RELATION_VERSION."""
    version = current.filter(F.col("src") == relation).select(F.col("dst").alias("version"))
    support = supported_by.join(version, F.col("src") == F.col("version"), "left_semi").select(F.col("dst").alias("support"))
    return evidence.join(support, F.col("id") == F.col("support"), "left_semi").orderBy(F.col("confidence").desc_nulls_last(), "id")


def stat(**tables: DataFrame) -> DataFrame:
    """One row: how many rows each table has."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # single rows
    return out


def stat_of_graph(elements: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """stat() of a graph with metatypes and predicates, the kinds that are in use: every table is read once."""
    of = lambda df, kind, rows, kinds: df.groupBy(kind).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(rows), F.count(kind).alias(kinds))
    e, r = of(elements, "kind_id", "elements", "metatypes"), of(edges, "predicate_id", "edges", "predicates")
    one = e.crossJoin(r).crossJoin(evidence.agg(F.count("*").alias("evidence")))  # single rows
    return one.select("elements", "edges", "evidence", "metatypes", "predicates")


def kind_histogram(elements: DataFrame) -> DataFrame:
    return elements.groupBy("category", "kind_id").agg(F.count("*").alias("n"))


def language_histogram(files: DataFrame) -> DataFrame:
    """Files (language, size): count and bytes a language, unknown as other, and in total (language ALL)."""
    f = files.select(F.coalesce("language", F.lit("other")).alias("language"), "size")
    g = f.rollup("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return g.select(F.coalesce("language", F.lit("ALL")).alias("language"), "files", "bytes")


def attach_versions(elements: DataFrame, versions: DataFrame) -> DataFrame:
    """Elements with description and props of their current version, null where it is missing."""
    v = versions.select(F.col("id").alias("v_id"), "description", F.col("props").alias("version_props"))
    return elements.join(v, elements.current_version_id == F.col("v_id"), "left").drop("v_id")


def supporting_evidence(versions: DataFrame, supported_by: DataFrame, evidence: DataFrame) -> DataFrame:
    """(version_id, evidence id) of exportable evidence, by the SUPPORTED_BY edges."""
    e = exportable_evidence(evidence).select(F.col("id").alias("evidence_id"))
    s = supported_by.select(F.col("src").alias("version_id"), F.col("dst").alias("evidence_id"))
    return s.join(versions.select(F.col("id").alias("version_id")), "version_id", "left_semi").join(e, "evidence_id").select("version_id", "evidence_id")


def dangling(references: DataFrame, targets: DataFrame, column: str, key: str = "id") -> DataFrame:
    """References that name no target."""
    return references.join(targets.select(F.col(key).alias(column)).distinct(), column, "left_anti")
