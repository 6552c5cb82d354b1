"""From facts found in sources to elements and edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import field_type, last_segment
from ..schema import content_id
from ..scratch import settle
from .select import only_new


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates (nth, canonical_key, name, strategy, confidence, file) -> one row a key.

    The most confident strategy wins, on ties the first; merged_from lists strategies by first arrival; files are the
    distinct ones, sorted.
    """
    best = F.max_by(F.struct("name", "strategy", "confidence"), F.struct("confidence", (-F.col("nth")).alias("first")))
    ways = candidates.groupBy("canonical_key", "strategy").agg(F.min("nth").alias("nth")).groupBy("canonical_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "strategy"))), lambda s: s["strategy"]), ",").alias("merged_from"))
    files = candidates.filter("file is not null").select("canonical_key", "file").distinct().groupBy("canonical_key").agg(F.array_join(F.sort_array(F.collect_list("file")), ",").alias("files"))
    g = candidates.groupBy("canonical_key").agg(best.alias("b")).join(ways, "canonical_key").join(files, "canonical_key", "left")
    return g.select("canonical_key", "b.name", "b.strategy", "b.confidence", "merged_from", F.coalesce("files", F.lit("")).alias("files"))


def attribute_calls(functions: DataFrame, calls: DataFrame, *more: str) -> DataFrame:
    """Calls (language, file, line, callee) with their caller: the last function of the file that starts at or before
    the call, else `<unknown>:0`.  functions: language, file, line, canonical_key.  ``more``: other columns of calls that stay.

    An as-of join as one window over the union: no pair of a function and a call is ever formed.
    """
    f = functions.select("language", "file", "line", F.lit(0).alias("is_call"), "canonical_key", F.lit(None).cast("string").alias("callee"))
    c = calls.select("language", "file", "line", F.lit(1).alias("is_call"), F.lit(None).cast("string").alias("canonical_key"), "callee", *more)
    upto = Window.partitionBy("language", "file").orderBy("line", "is_call", "canonical_key").rowsBetween(Window.unboundedPreceding, 0)
    caller = F.coalesce(F.last("canonical_key", ignorenulls=True).over(upto), F.lit("<unknown>:0"))
    return f.unionByName(c, allowMissingColumns=True).withColumn("caller", caller).filter("is_call = 1").select("language", "file", "line", "callee", "caller", *more)


#: A name with more than this share of the calls is heavy; there are at most its inverse of them, so they are broadcast.
HEAVY_SHARE = 0.005


def callee_names(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(callee, calls, functions, edges): for every name that is called and known, how many calls and functions have it and
    how many edges these make.  The edges of a name are its calls and its functions side by side; they are counted, and may be
    kept, without being written out."""
    c = calls.groupBy("callee").agg(F.count("*").alias("calls"))
    f = functions.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("functions"))
    return c.join(f, "callee").select("callee", "calls", "functions", (F.col("calls") * F.col("functions")).alias("edges"))


def by_name(calls: DataFrame, known: DataFrame) -> DataFrame:
    """``calls`` (callee, more) with everything of that name in ``known`` (name, callee_key).

    Calls of a heavy name are dealt over as many salts as it has shares, and what has the name goes to each of these.
    """
    counts = settle(calls.filter("callee is not null").groupBy("callee").agg(F.count("*").alias("n")), "callees")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = max(1, int(HEAVY_SHARE * total))
    heavy = F.broadcast(counts.filter(F.col("n") > share).select(F.col("callee").alias("heavy"), F.ceil(F.col("n") / share).cast("int").alias("salts")))
    salt = F.pmod(F.xxhash64(*calls.columns), F.coalesce("salts", F.lit(1))).cast("int")
    c = calls.join(heavy, F.col("callee") == F.col("heavy"), "left").select(*calls.columns, salt.alias("salt"))
    k = known.select(F.col("name").alias("of_name"), "callee_key").join(heavy, F.col("of_name") == F.col("heavy"), "left")
    k = k.select("of_name", "callee_key", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("of_salt"))
    return c.join(k, (F.col("callee") == F.col("of_name")) & (F.col("salt") == F.col("of_salt"))).select(*calls.columns, "callee_key")


def resolve_callees(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller, callee_key, line): a call leads to every function of its name; calls of unknown names drop out."""
    return by_name(calls.select("caller", "callee", "line"), functions.select("name", F.col("canonical_key").alias("callee_key"))).select("caller", "callee_key", "line")


def resolve_types(references: DataFrame, classes: DataFrame) -> DataFrame:
    """References (language, file, name, …) with the class of that name in the same file; the last definition wins."""
    last = classes.groupBy("language", "file", "name").agg(F.max_by("canonical_key", F.struct("line", "canonical_key")).alias("target"))
    return references.join(last, ["language", "file", "name"], "left")


def composes(classes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(source, target, line): fields whose type is a class of the same file, once a pair; pairs in ``existing``
    (source, target) with this predicate are left out.  classes: canonical_key, language, file, name, line, members."""
    fields = classes.select("canonical_key", "language", "file", F.explode("members").alias("m")).filter("m.member_kind = 'field'")
    fields = fields.select(F.col("canonical_key").alias("source"), "language", "file", field_type(F.col("m.signature")).alias("name"), F.col("m.line").alias("at"))
    found = resolve_types(fields.filter("name is not null"), classes).filter("target is not null")
    out = found.groupBy("source", "target").agg(F.min("at").alias("line"))
    return out if existing is None else out.join(existing, ["source", "target"], "left_anti")


def edge_rows(pairs: DataFrame, predicate: str, *more: Column) -> DataFrame:
    """Edges (src, dst) as SEMANTIC_EDGE rows, with more columns; the id holds the predicate, so relations of one pair don't
    collapse."""
    ident = content_id("rel:", F.lit(predicate), F.col("src"), F.col("dst"))
    return pairs.select(ident.alias("relation_id"), F.lit(predicate).alias("predicate_id"), F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit(True).alias("active"), *more)


def transitions(edges: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """(transition, source_state, target_state) from source_state and target_state edges, in either direction.

    With elements (id, kind_id) the end of an edge that is a transition by its kind is the transition; where neither is, or
    both are, source_state edges lead to the transition and target_state edges away from it.
    """
    def ends(predicate: str, name: str, leads: bool) -> DataFrame:
        e = edges.filter(F.col("predicate_id") == predicate)
        a, b = F.col("source_id"), F.col("target_id")
        if elements is None:
            return e.select(a.alias("transition"), b.alias(name)).unionAll(e.select(b.alias("transition"), a.alias(name)))
        is_one = elements.select("id", F.coalesce(last_segment(F.col("kind_id")) == "transition", F.lit(False)).alias("is"))
        for c in ("source", "target"):
            e = e.join(is_one.select(F.col("id").alias(f"{c}_id"), F.col("is").alias(c)), f"{c}_id")
        away = F.when(F.col("source") & ~F.col("target"), True).when(F.col("target") & ~F.col("source"), False).otherwise(not leads)
        return e.select(F.when(away, a).otherwise(b).alias("transition"), F.when(away, b).otherwise(a).alias(name))
    return ends("behavior.source_state", "source_state", True).join(ends("behavior.target_state", "target_state", False), "transition").filter("source_state <> transition and target_state <> transition").distinct()


def _new_elements(rows: DataFrame, existing: DataFrame, prefix: str, kind: Column, category: str, origin: str, props: Column) -> tuple[DataFrame, DataFrame]:
    """Elements and versions of rows (canonical_key, name, confidence, …) whose key no element has."""
    fresh = only_new(rows.dropDuplicates(["canonical_key"]), existing)
    ident, version = F.concat(F.lit(prefix), F.col("canonical_key")), content_id("ver:", F.lit(prefix), F.col("canonical_key"), props)
    fresh = fresh.select("*", ident.alias("id"), version.alias("version"), kind.alias("kind_id"), props.alias("props"))
    elements = fresh.select("id", "kind_id", F.lit(category).alias("category"), "canonical_key", F.col("version").alias("current_version_id"), F.col("name").alias("current_name"), F.lit("active").alias("current_status"), F.lit(origin).alias("current_origin"), F.col("confidence").alias("current_confidence"))
    versions = fresh.select(F.col("version").alias("id"), F.col("id").alias("element_id"), "name", F.lit("drafted").alias("status"), F.lit(origin).alias("origin"), "confidence", "props")
    return elements, versions


def _support(rows: DataFrame, kind: str) -> DataFrame:
    """Evidence of where rows (version, name, file, line, confidence) were found."""
    claim = F.concat(F.lit(f"{kind} "), F.col("name"))
    return rows.select(content_id("ev:", F.lit(kind), F.col("file"), F.col("line"), F.col("name")).alias("id"), F.lit(kind).alias("kind"), claim.alias("claim"), "confidence", F.col("file").alias("path"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit('{"status":"drafted"}').alias("props"))


class Made(Mapping):
    """Tables by name; some are made when they are first asked for, so that what nobody reads costs nothing."""

    def __init__(self, there: dict[str, DataFrame], make: dict[str, Callable[[], DataFrame]]) -> None:
        self.there, self.make = there, make

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.there:
            self.there[name] = self.make[name]()
        return self.there[name]

    def __iter__(self) -> Iterator[str]:
        return iter({**self.there, **self.make})

    def __len__(self) -> int:
        return len({**self.there, **self.make})


def call_graph(functions: DataFrame, calls: DataFrame, existing: DataFrame) -> Mapping[str, DataFrame]:
    """What an extracted call graph adds to a graph: Element, ElementVersion, SEMANTIC_EDGE, Evidence, SUPPORTED_BY and
    SourceArtifact rows.

    Functions whose key an element has are skipped, and so are calls out of them.  A call leads to every function of its
    name, new or there before; calls outside functions and of unknown names give no edge.  Calls of one pair of
    functions are one edge, with the first line and its message kind, and evidence of their own.  ``functions`` are read
    several times, so what extracts them should be settled first.
    """
    kind = F.concat(F.lit("code."), F.col("kind"))
    props = F.to_json(F.struct("kind", "language", "confidence"))
    elements, versions = _new_elements(functions, existing, "cg:", kind, "code", "call-graph", props)
    keys = elements.select(F.col("canonical_key").alias("caller"), F.col("current_version_id").alias("version"))
    known = existing.filter("kind_id in ('code.function', 'code.method', 'code.closure')").select("canonical_key", F.col("current_name").alias("name")).unionByName(elements.select("canonical_key", F.col("current_name").alias("name"))).distinct()
    rows = calls.select("language", "file", "line", "callee", "message_kind").dropna(subset=["language", "file", "line", "callee"])

    @cache
    def placed() -> DataFrame:
        """Calls with their callers, written once: heavy names are counted before they are joined."""
        return settle(attribute_calls(functions, rows, "message_kind").join(keys, "caller").select("caller", "version", "callee", "line", "message_kind", "file"), "placed")

    def edges() -> DataFrame:
        named = by_name(placed().select("caller", "callee", "line", "message_kind", "file"), known.select("name", F.concat(F.lit("cg:"), "canonical_key").alias("callee_key")))
        pairs = named.groupBy(F.concat(F.lit("cg:"), "caller").alias("src"), F.col("callee_key").alias("dst")).agg(F.min(F.struct("line", "message_kind", "file")).alias("first"))
        return edge_rows(pairs, "code.calls", F.to_json(F.struct("first.file", "first.line", "first.message_kind")).alias("props"))

    def found() -> DataFrame:
        of_call = placed().select(F.col("callee").alias("name"), "file", "line", F.lit(0.8).alias("confidence"))
        return _support(functions.join(elements.select("canonical_key"), "canonical_key", "left_semi"), "function").unionByName(_support(of_call, "call")).dropDuplicates(["id"])

    def supported() -> DataFrame:
        of_function = functions.join(elements.select("canonical_key", F.col("current_version_id").alias("src")), "canonical_key").select("src", content_id("ev:", F.lit("function"), F.col("file"), F.col("line"), F.col("name")).alias("dst"))
        of_call = placed().select(F.col("version").alias("src"), content_id("ev:", F.lit("call"), F.col("file"), F.col("line"), F.col("callee")).alias("dst"))
        return of_function.unionByName(of_call).distinct()

    artifacts = functions.select("file", "language").union(calls.select("file", "language")).distinct().select(content_id("src:", F.col("file")).alias("id"), F.lit("source").alias("kind"), F.col("file").alias("relative_path"), "language")
    return Made({"Element": elements, "ElementVersion": versions, "SourceArtifact": artifacts}, {"SEMANTIC_EDGE": edges, "Evidence": found, "SUPPORTED_BY": supported})


UML = {"class": "uml.class", "struct": "uml.class", "union": "uml.class", "interface": "uml.interface", "trait": "uml.trait", "enum": "uml.enum", "record": "uml.record"}


def class_diagram(classes: DataFrame, existing: DataFrame) -> dict[str, DataFrame]:
    """What extracted types add: Element, ElementVersion and SEMANTIC_EDGE rows.  Bases that are no type of the file stand
    as placeholders lang:file:class:Name:0, which are no elements."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in UML.items() for x in pair]), F.col("kind"))
    elements, versions = _new_elements(classes.withColumn("confidence", F.lit(0.85)), existing, "cd:", F.coalesce(kind, F.lit("uml.class")), "uml", "class-diagram", F.to_json(F.struct("kind", "language", "members")))
    parts = []
    for column, predicate in (("bases", "uml.extends"), ("implements", "uml.implements")):
        r = classes.select(F.col("canonical_key").alias("source"), "language", "file", F.explode(column).alias("name"))
        r = resolve_types(r, classes).select("source", F.coalesce("target", F.concat_ws(":", "language", "file", F.lit("class"), "name", F.lit("0"))).alias("target"))
        parts.append((r, predicate))
    parts.append((composes(classes), "uml.composition"))
    tag = lambda c: F.concat(F.lit("cd:"), F.col(c))
    edges = [edge_rows(r.select(tag("source").alias("src"), tag("target").alias("dst")).distinct(), p) for r, p in parts]
    return {"Element": elements, "ElementVersion": versions, "SEMANTIC_EDGE": edges[0].unionByName(edges[1]).unionByName(edges[2])}


def state_graph(states: DataFrame, moves: DataFrame, existing: DataFrame) -> dict[str, DataFrame]:
    """What extracted state machines add: elements of machines, states and transitions, and for each transition an edge to
    its source and to its target state: the first state of that name by line."""
    prefix = lambda *more: F.concat_ws(":", "language", "file", *[m if not isinstance(m, str) else F.lit(m) for m in more])
    text = lambda c: F.col(c).cast("string")
    machine = states.groupBy("language", "file", "machine").agg(F.min("line").alias("line"), F.max("confidence").alias("confidence"))
    rows = [(machine.select(prefix("machine", F.col("machine"), text("line")).alias("canonical_key"), F.col("machine").alias("name"), "confidence", F.lit("{}").alias("more")), "uml.state_machine")]
    rows.append((states.select(prefix("state", F.col("state"), text("line")).alias("canonical_key"), F.col("state").alias("name"), "confidence", F.to_json(F.struct("machine")).alias("more")), "uml.state"))
    key = prefix("transition", F.concat_ws("_", "source", "target"), text("line"))
    t = moves.select("*", key.alias("canonical_key"))
    rows.append((t.select("canonical_key", F.concat_ws("_to_", "source", "target").alias("name"), "confidence", F.to_json(F.struct(F.col("source").alias("source_state"), F.col("target").alias("target_state"), "trigger", "guard")).alias("more")), "uml.transition"))
    made = [_new_elements(r, existing, "sm:", F.lit(k), "uml", "state-machine", F.col("more")) for r, k in rows]
    elements, versions = (made[0][i].unionByName(made[1][i]).unionByName(made[2][i]) for i in (0, 1))
    first = states.groupBy("language", "file", "machine", F.col("state").alias("name")).agg(F.min("line").alias("at"))
    state_key = F.concat(F.lit("sm:"), F.concat_ws(":", "language", "file", F.lit("state"), "name", F.col("at").cast("string")))
    first = first.select("language", "file", "machine", "name", state_key.alias("dst"))
    ends = []
    for column, predicate in (("source", "behavior.source_state"), ("target", "behavior.target_state")):
        found = t.withColumn("name", F.col(column)).join(first, ["language", "file", "machine", "name"]).select(F.concat(F.lit("sm:"), "canonical_key").alias("src"), "dst")
        ends.append(edge_rows(found.distinct(), predicate))
    return {"Element": elements, "ElementVersion": versions, "SEMANTIC_EDGE": ends[0].unionByName(ends[1])}


def containers(candidates: DataFrame, existing: DataFrame) -> dict[str, DataFrame]:
    """What discovered containers (see merge_candidates) add; the strategy names the kind."""
    kind = F.when(F.col("strategy") == "components", "mt.component").otherwise("mt.container")
    elements, versions = _new_elements(candidates, existing, "c4:", kind, "structure", "discovery", F.to_json(F.struct("strategy", "merged_from", "files")))
    return {"Element": elements, "ElementVersion": versions}


def gate_violations(documents: DataFrame, must_hold: dict[str, str], must_not_contain: dict[str, str]) -> DataFrame:
    """(path, rule, problem): texts that lack a pattern which must hold, or hold one that must not."""
    checks = [F.when(~F.coalesce(F.col("text").rlike(p), F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit("missing").alias("problem"))) for n, p in must_hold.items()]
    checks += [F.when(F.coalesce(F.col("text").rlike(p), F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit("forbidden").alias("problem"))) for n, p in must_not_contain.items()]
    return documents.select("path", F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("c")).select("path", "c.rule", "c.problem")


def strip_tests(text: Column) -> Column:
    """A Rust source up to its inline test module."""
    return F.regexp_replace(text, r"(?s)#\[cfg\(test\)\]\s*mod\s+\w+\s*\{.*\z", "")


def scope_violations(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(scope, kind, value, problem) of a scope manifest (path, name, kind, value) against files (path, text).

    files must exist; symbols must be declared visible somewhere; must_hold texts must occur; must_not_contain texts
    must not, outside tests; tests is the least number of test functions.
    """
    m = manifest.select(F.col("name").alias("scope"), "kind", "value")
    missing = m.filter("kind = 'files'").join(files.select(F.col("path").alias("value")), "value", "left_anti").withColumn("problem", F.lit("file is missing"))
    body = files.select("path", "text", strip_tests(F.col("text")).alias("body"))
    rules = m.filter("kind in ('symbols', 'must_hold', 'must_not_contain')")
    # a manifest has few rules: every file looks at all of them in one pass
    table = rules.agg(F.collect_list(F.struct("scope", "kind", "value")).alias("rules"))
    visible = lambda v: F.regexp_like("body", F.concat(F.lit(r"(?m)^\s*(?:pub(?:\([^)]*\))?|export|public)\b[^\n]*\b"), F.regexp_replace(v, r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"\b")))
    hit = lambda r: F.when(r["kind"] == "symbols", visible(r["value"])).otherwise(F.col("body").contains(r["value"]))
    hits = body.join(F.broadcast(table), F.lit(True)).select(F.explode(F.filter("rules", lambda r: F.coalesce(hit(r), F.lit(False)))).alias("r")).select("r.*").distinct()
    absent = rules.filter("kind <> 'must_not_contain'").join(hits, ["scope", "kind", "value"], "left_anti").withColumn("problem", F.when(F.col("kind") == "symbols", "symbol is not visible").otherwise("text is missing"))
    present = hits.filter("kind = 'must_not_contain'").withColumn("problem", F.lit("text is forbidden"))
    tests = files.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"(?m)^\s*#\[test\]|^\s*def test_|^func Test"))), F.lit(0)).alias("have"))
    few = m.filter("kind = 'tests'").join(F.broadcast(tests), F.col("value").cast("long") > F.col("have")).select("scope", "kind", "value", F.lit("too few tests").alias("problem"))
    order = ["scope", "kind", "value", "problem"]
    return missing.select(order).unionAll(absent.select(order)).unionAll(present.select(order)).unionAll(few)
