"""Views as text: lines with a place, joined in order.

Every line of a diagram is a row (section, place, text), so what is large stays a table; ``as_text`` joins the lines of
one diagram.  Elements come in the order of their keys, edges in that of their ids.  Kinds are compared by their last
segment, so `mt.container` and `c4.container` are drawn alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dsl_escaped, last_segment, stereotype
from ..operators.ingest import transitions

C4 = ("person", "software_system", "container", "component")
# How relations between classes are drawn.
ARROWS = {"uml.extends": "--|>", "uml.implements": "..|>", "uml.association": "-->", "uml.aggregation": "--o", "uml.composition": "--*", "uml.depends_on": "..>"}
SHAPES = {"c4-context": "c4", "c4-container": "c4", "c4-component": "c4", "class": "class", "state": "state", "usecase": "usecase", "sequence": "sequence"}


def _c(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _rows(df: DataFrame, section: int, place: Column, text: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), place.cast("string").alias("place"), text.alias("text")).filter("text is not null")


def _fixed(df: DataFrame, section: int, *lines: str) -> DataFrame:
    one = df.sparkSession.range(1)
    return reduce(DataFrame.unionAll, [_rows(one, section, F.lit(f"{i:04d}"), F.lit(t)) for i, t in enumerate(lines)])


def _named(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Edges whose ends are both there, with their names."""
    a = elements.select(F.col("id").alias("source_id"), F.col("current_name").alias("src"))
    b = elements.select(F.col("id").alias("target_id"), F.col("current_name").alias("dst"))
    return edges.join(a, "source_id").join(b, "target_id")


def _between(edges: DataFrame, elements: DataFrame, *predicates: str) -> DataFrame:
    e = _named(edges, elements)
    return e.filter(F.col("predicate_id").isin(*predicates)) if predicates else e


def plantuml(elements: DataFrame, edges: DataFrame, view: str) -> DataFrame:
    kind, name, key = last_segment(F.col("kind_id")), F.col("current_name"), F.concat_ws("\x1f", "canonical_key", "id")
    src, dst, shape = F.col("src"), F.col("dst"), SHAPES[view]
    rel = F.col("relation_id")
    if shape == "class":
        e = elements.filter(kind.isin("class", "interface", "trait", "enum", "record"))
        body = _rows(e, 1, key, _c("class ", name, F.coalesce(_c(" ", stereotype(F.col("kind_id"))), F.lit("")), " {\n  --\n}"))
        arrow = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ARROWS.items() for x in p]), F.col("predicate_id")), F.lit("-->"))
        links = _rows(_named(edges, elements), 2, rel, _c(src, " ", arrow, " ", dst))
    elif shape == "state":
        first = F.lower(name).contains("initial") | F.lower(name).contains("start")
        text = F.when(kind.isin("state", "state_machine"), _c("state ", name, " {\n}")).when(kind == "pseudostate", F.when(first, _c("[*] --> ", name)).otherwise(_c(name, " --> [*]")))
        body = _rows(elements, 1, key, text)
        names = elements.select(F.col("id").alias("n_id"), name.alias("n"))
        t = transitions(edges, elements)
        for c in ("transition", "source_state", "target_state"):
            t = t.join(names, F.col(c) == F.col("n_id")).withColumn(f"{c}_name", F.col("n")).drop("n", "n_id")
        t = t.groupBy("transition", "transition_name").agg(F.min(F.struct("source_state_name", "target_state_name")).alias("s"))
        links = _rows(t, 2, F.concat_ws("\x1f", "transition_name", "transition"), _c(F.col("s.source_state_name"), " --> ", F.col("transition_name"), " --> ", F.col("s.target_state_name")))
    elif shape == "usecase":
        body = _rows(elements, 1, key, F.when(kind == "actor", _c("[", name, "]")).when(kind == "use_case", _c("usecase ", name)))
        links = _rows(_between(edges, elements, "usecase.participates_in"), 2, rel, _c(src, " --> ", dst))
    elif shape == "c4":
        body = _rows(elements, 1, key, F.when(kind == "person", _c('actor "', name, '" as ', name)).when(kind.isin(*C4), _c('rectangle "', name, '" as ', name)))
        links = _rows(_between(edges, elements, "core.uses", "core.depends_on"), 2, rel, _c(src, " --> ", dst))
    else:
        body = _rows(elements.filter(kind == "participant"), 1, key, _c("participant ", name))
        label = F.get_json_object("props", "$.label")
        links = _rows(_between(edges, elements, "behavior.invokes"), 2, rel, F.when(F.coalesce(label, F.lit("")) != "", _c(src, " -> ", dst, " : ", label)).otherwise(_c(src, " -> ", dst)))
    return _fixed(elements, 0, "@startuml", "!theme default").unionAll(body).unionAll(links).unionAll(_fixed(elements, 9, "", "@enduml"))


def mermaid(elements: DataFrame, edges: DataFrame, view: str) -> DataFrame:
    kind, name, ident, key = last_segment(F.col("kind_id")), F.col("current_name"), F.col("id"), F.concat_ws("\x1f", "canonical_key", "id")
    shape, rel, tab = SHAPES[view], F.col("relation_id"), "    "
    by_id = _c(tab, F.col("source_id"), " --> ", F.col("target_id"))
    tail = None
    if shape == "class":
        body = _rows(elements.filter(kind.isin("class", "interface")), 1, key, _c(tab, name, '("', name, '")'))
        links = _rows(_named(edges, elements), 2, rel, _c(tab, F.col("src"), " --> ", F.col("dst")))
    elif shape == "state":
        states = elements.filter(kind == "state")
        body = _rows(states, 1, key, _c(tab, ident, "([", name, "]):::state"))
        links = _rows(_between(edges, elements, "behavior.source_state"), 2, rel, by_id)
        style = states.limit(1).select(F.lit(1))
        tail = _rows(style, 3, F.lit(""), F.lit(tab + "classDef state fill:#f9f,stroke:#333,stroke-width:2px"))
    elif shape == "usecase":
        body = _rows(elements, 1, key, F.when(kind == "actor", _c(tab, ident, "(", name, ")")).when(kind == "use_case", _c(tab, ident, "((", name, "))")))
        links = _rows(_between(edges, elements, "usecase.participates_in"), 2, rel, by_id)
    elif shape == "c4":
        body = _rows(elements, 1, key, F.when(kind == "person", _c(tab, ident, "(", name, ")")).when(kind.isin(*C4), _c(tab, ident, "([", name, "])")))
        links = _rows(_between(edges, elements, "core.uses", "core.depends_on"), 2, rel, by_id)
    else:
        body = _rows(elements.filter(kind == "participant"), 1, key, _c(tab, "participant ", name))
        label = F.get_json_object("props", "$.label")
        arrow = _c(tab, F.col("src"), "->>+", F.col("dst"))
        links = _rows(_between(edges, elements, "behavior.invokes"), 2, rel, F.when(F.coalesce(label, F.lit("")) != "", _c(arrow, ": ", label)).otherwise(arrow))
    out = _fixed(elements, 0, "sequenceDiagram" if shape == "sequence" else "flowchart TD").unionAll(body).unionAll(links)
    return out if tail is None else out.unionAll(tail)


def structurizr(elements: DataFrame, edges: DataFrame, view: str) -> DataFrame:
    kind, name, key, tab = last_segment(F.col("kind_id")), dsl_escaped(F.col("current_name")), F.concat_ws("\x1f", "canonical_key", "id"), " " * 8
    quoted = lambda word: _c(f'{tab}{word} "', name, '"')
    if view == "c4-context":
        text = F.when(kind == "person", quoted("person")).when(kind == "software_system", quoted("softwareSystem"))
    elif view in ("c4-container", "c4-component"):
        text = F.when(kind == "container", quoted("container")).when(kind == "component", quoted("component"))
    else:
        text = quoted("softwareSystem")
    line = _c(tab, dsl_escaped(F.col("src")), " -> ", dsl_escaped(F.col("dst")))
    why = F.get_json_object("props", "$.description")
    links = _rows(_named(edges, elements), 2, F.col("relation_id"), F.when(F.coalesce(why, F.lit("")) != "", _c(line, ' "', dsl_escaped(why), '"')).otherwise(line))
    shown = {"c4-container": "container", "c4-component": "component"}.get(view, "systemContext")
    head, foot = ("workspace {", "    model {"), ("    }", "    views {", f"{tab}{shown} * {{", f"{tab}    include *", f"{tab}}}", "    }", "}")
    return _fixed(elements, 0, *head).unionAll(_rows(elements, 1, key, text)).unionAll(links).unionAll(_fixed(elements, 9, *foot))


FORMATS = {"plantuml": plantuml, "mermaid": mermaid, "structurizr": structurizr}


def as_text(lines: DataFrame) -> DataFrame:
    """One row with the whole diagram; a diagram is meant to be read, so it is small."""
    ordered = F.sort_array(F.collect_list(F.struct("section", "place", "text")))
    return lines.agg(F.concat(F.array_join(F.transform(ordered, lambda l: l["text"]), "\n"), F.lit("\n")).alias("text"))


def export_bundle(elements: DataFrame, edges: DataFrame, versions: DataFrame | None = None, evidence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an exported view: nodes carry kind, status as the schema knows it, description, and the ids of
    the evidence behind their version.  evidence: version_id, evidence_id."""
    from ..functions.scalars import valid_status
    from ..operators.select import attach_versions

    n = attach_versions(elements, versions) if versions is not None else elements.withColumn("description", F.lit(None).cast("string"))
    if evidence is not None:
        e = evidence.groupBy("version_id").agg(F.array_join(F.sort_array(F.collect_set("evidence_id")), ",").alias("evidence_ids"))
        n = n.join(e, n.current_version_id == e.version_id, "left")
    else:
        n = n.withColumn("evidence_ids", F.lit(None).cast("string"))
    nodes = n.select("id", last_segment(F.col("kind_id")).alias("type"), F.col("current_name").alias("label"), valid_status(F.col("current_status")).alias("status"), "description", F.coalesce("evidence_ids", F.lit("")).alias("evidence_ids"))
    return nodes, edges.select(F.col("relation_id").alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), last_segment(F.col("predicate_id")).alias("type"))


def envelope(rows: DataFrame) -> str:
    """Rows as one JSON document with `empty` and a `warning` where there are none; for small results."""
    import json

    found = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct(*rows.columns))).collect()]
    return json.dumps({"rows": found, "empty": not found} | ({} if found else {"warning": "no rows"}), ensure_ascii=False)


def write_bundle(nodes: DataFrame, edges: DataFrame, folder: str, styles: dict | None = None) -> None:
    """A view as Parquet tables and a manifest, in a new folder."""
    nodes.write.parquet(f"{folder}/nodes")
    edges.write.parquet(f"{folder}/edges")
    manifest = {"schemaVersion": "1", "nodes": "nodes", "edges": "edges", "styles": styles or {}}
    import json

    nodes.sparkSession.range(1).select(F.lit(json.dumps(manifest, sort_keys=True)).alias("value")).coalesce(1).write.text(f"{folder}/manifest")
