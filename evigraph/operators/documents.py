"""JSON documents as rows: every value is a row (path, kind, value), found level by level from VARIANT.

Checks are joins of these rows with rules on their shapes, so a document of any size is many rows.  Canonical texts are put
together again from the leaves up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import counted, release, settle


def _kind(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    t = F.schema_of_variant(v)
    return (
        F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").otherwise("number")
    )


def _escaped(name: Column) -> Column:
    """A member's name without the signs that paths are made of."""
    for sign, code in (("~", "~0"), (".", "~1"), ("[", "~2")):
        name = F.replace(name, F.lit(sign), F.lit(code))
    return name


def values(docs: DataFrame, depth: int = 64) -> DataFrame:
    """Of documents (doc, text): a row for every value down to ``depth`` levels below the root, whose path is ''.

    path: members by '.name', items by '[number]' (in names ~ . [ are ~0 ~1 ~2); shape: the same with '[]' for any item;
    parent, outer: the container's path and shape; key, nth: a member's name, an item's number; value: a leaf's text, null
    for containers.  A text that is no JSON, or null, has no rows.  A level is written before the next is read from it,
    so plans stay flat.
    """
    v = docs.select("doc", F.try_parse_json("text").alias("v")).filter("v is not null")
    nothing, empty = F.lit(None).cast("string"), F.lit("")
    level = v.select("doc", F.lit(0).alias("depth"), empty.alias("path"), empty.alias("shape"), nothing.alias("parent"), nothing.alias("outer"), nothing.alias("key"), F.lit(None).cast("int").alias("nth"), _kind(F.col("v")).alias("kind"), "v")
    parts = []
    for d in range(1, depth + 2):
        at, rows = counted(level, "json")
        parts.append(at)
        if not rows:
            break
        inner = at.filter(F.col("kind").isin("object", "array")).select("doc", "path", "shape", F.col("kind").alias("of"), "v")
        step = inner.lateralJoin(at.sparkSession.tvf.variant_explode(F.col("v").outer())).select("doc", "path", "shape", "of", "pos", F.col("key").alias("name"), F.col("value").alias("inner"))
        member, name = F.col("of") == "object", F.concat(F.lit("."), _escaped(F.col("name")))
        level = step.select(
            "doc", F.lit(d).alias("depth"), F.concat("path", F.when(member, name).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))).alias("path"),
            F.concat("shape", F.when(member, name).otherwise(F.lit("[]"))).alias("shape"), F.col("path").alias("parent"), F.col("shape").alias("outer"),
            F.when(member, F.col("name")).alias("key"), F.when(~member, F.col("pos")).alias("nth"), _kind(F.col("inner")).alias("kind"), F.col("inner").alias("v"),
        )
    leaf = F.when(F.col("kind") == "string", F.col("v").cast("string")).when(~F.col("kind").isin("object", "array"), F.to_json("v"))
    out = settle(reduce(DataFrame.unionAll, [p.withColumn("value", leaf).drop("v") for p in parts]), "values")
    release(*parts)
    return out


def _quoted(text: Column) -> Column:
    """A text as JSON writes it."""
    whole = F.to_json(F.struct(text.alias("s")))  # {"s":"…"}
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def canonical(rows: DataFrame) -> DataFrame:
    """Of values(): (doc, text), compact JSON with members in the order of their names and arrays whose items all are
    objects with a text `id` in the order of these (equal ids as they were); all other arrays stay.

    Each round joins the texts of one depth to those of the containers above them.
    """
    text = F.when(F.col("kind") == "string", _quoted(F.col("value"))).otherwise(F.col("value"))
    deepest = rows.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0]
    built, last = None, []
    for d in range(deepest, -1, -1):
        at = rows.filter(F.col("depth") == d)
        if built is None:
            at = at.withColumns({"inside": F.lit(None).cast("string"), "ident": F.lit(None).cast("string")})
        else:
            at = at.join(built, ["doc", "path"], "left")
        full = F.when(F.col("kind") == "object", F.concat(F.lit("{"), F.coalesce("inside", F.lit("")), F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), F.coalesce("inside", F.lit("")), F.lit("]"))).otherwise(text)
        level = settle(at.select("doc", "parent", "key", "nth", "kind", full.alias("text"), F.when(F.col("kind") == "object", F.col("ident")).alias("ident"), "value"), "json-texts")
        last.append(level)
        members = F.transform(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "text")))), lambda m: F.concat(_quoted(m["key"]), F.lit(":"), m["text"]))
        named = F.count("ident") == F.count(F.lit(1))
        items = lambda order: F.transform(F.array_sort(F.collect_list(F.when(F.col("key").isNull(), F.struct(*order, "text")))), lambda m: m["text"])
        inside = F.when(F.count("key") > 0, F.array_join(members, ",")).when(named, F.array_join(items(["ident", "nth"]), ",")).otherwise(F.array_join(items(["nth"]), ","))
        own = F.max(F.when((F.col("key") == "id") & (F.col("kind") == "string"), F.col("value")))
        built = level.filter("parent is not null").groupBy("doc", F.col("parent").alias("path")).agg(inside.alias("inside"), own.alias("ident"))
    if not last:
        return rows.select("doc", F.lit("").alias("text"))
    out = settle(last[-1].select("doc", "text"), "canonical")
    release(*last)
    return out


# What the files of a diagram bundle hold.  A line is a shape, its kind (- for any), and what must hold:
# required, min, max and length give bounds, one-of the values allowed, like a pattern.  Other members are not allowed.
BUNDLE = r"""
manifest.json
  .                              object
  .schemaVersion                 string   required  like ^\d+\.\d+\.\d+$
  .format                        -        required  one-of viewer-bundle
  .viewSelector                  string   required  like ^(context|container|component|dynamic|deployment):.+
  .baseRevision                  string   required  like ^blake3:[0-9a-f]{64}$
  .generatedAt                   string   required
  .elementCount                  integer  required  min 0
  .edgeCount                     integer  required  min 0
  .evidenceCount                 integer  required  min 0
projection.json
  .                              object
  .nodes                         array    required
  .nodes[]                       object
  .nodes[].id                    string   required  length 1
  .nodes[].type                  -        required  one-of context|container|component|dynamic|deployment
  .nodes[].name                  string   required
  .nodes[].description           string
  .nodes[].canonicalKey          string
  .nodes[].status                -        optional  one-of accepted|drafted|superseded
  .nodes[].confidence            number   optional  min 0  max 1
  .nodes[].evidenceRefs          array
  .nodes[].evidenceRefs[]        string
  .edges                         array    required
  .edges[]                       object
  .edges[].id                    string   required  length 1
  .edges[].source                string   required  length 1
  .edges[].target                string   required  length 1
  .edges[].predicate             string   required
  .edges[].label                 string
evidence.json
  .                              object
  .evidence                      array    required
  .evidence[]                    object
  .evidence[].id                 string   required  length 1
  .evidence[].kind               string   required
  .evidence[].claim              string   required
  .evidence[].path               string   required
  .evidence[].startLine          integer  required  min 0
  .evidence[].endLine            integer  required  min 0
  .evidence[].toolName           string   required
  .evidence[].toolVersion        string   required
  .evidence[].ruleId             string   required
  .evidence[].contentHash        string   required
  .evidence[].observedAt         string   required
styles.json
  .                              object
  .theme                         string   required
  .version                       string   required
  .elementColors                 object   required
  .elementColors.context         string
  .elementColors.container       string
  .elementColors.component       string
  .elementColors.dynamic         string
  .elementColors.deployment      string
  .edgeColors                    object   required
  .edgeColors.default            string
"""
ICONS = ("context", "container", "component", "dynamic", "deployment")
RULE = "file string, shape string, of string, name string, kind string, required boolean, least double, most double, length int, one_of array<string>, pattern string"


def load_rules(spark: SparkSession, text: str = BUNDLE) -> DataFrame:
    """A row a shape: file, shape, of (its container's), name (of a member), kind, and what must hold."""
    rows, file = [], None
    for line in filter(str.strip, text.splitlines()):
        if not line.startswith(" "):
            file = line.strip()
            continue
        shape, kind, *more = line.split()
        shape = "" if shape == "." else shape
        known = dict(zip(more[1::2], more[2::2], strict=True))
        of, dot, name = shape.rpartition(".")
        member = bool(dot) and not shape.endswith("[]")
        bound = lambda k, as_: as_(known[k]) if k in known else None  # noqa: B023, E731
        rows.append((file, shape, of if member else None, name if member else None, None if kind == "-" else kind, more[:1] == ["required"], bound("min", float), bound("max", float), bound("length", int), bound("one-of", lambda v: v.split("|")), bound("like", str)))
    return spark.createDataFrame(rows, RULE)


def violations(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(bundle, file, path, problem) of what is wrong with bundles.  files: bundle, file, text (null for images).

    Every file that rules name must be there and be JSON; its values must have the shapes and hold what the rules say.
    Where projection and evidence are sound, evidence that nodes refer to must be there.  Icons of all levels must be there.
    Formats of dates are not checked.
    """
    names = [r[0] for r in rules.select("file").distinct().collect()]  # a handful
    problem = lambda df, path, text: df.select("bundle", "file", path.alias("path"), text.alias("problem"))
    root = F.lit("")
    own = files.filter(F.col("file").isin(names))
    bundles = files.select("bundle").distinct()
    wanted = bundles.select("bundle", F.explode(F.array(*[F.lit(n) for n in names])).alias("file"))
    absent = problem(wanted.join(own.select("bundle", "file"), ["bundle", "file"], "left_anti"), root, F.lit("not found"))
    garbled = problem(own.filter(F.try_parse_json("text").isNull()), root, F.lit("no JSON"))
    deepest = rules.agg(F.max(F.size(F.split("shape", r"\.|\[")))).first()[0]
    v = values(own.select(F.struct("bundle", "file").alias("doc"), "text"), deepest).select("doc.*", "path", "shape", "parent", "outer", "key", "kind", "value")
    r = F.broadcast(rules.withColumnsRenamed({"file": "r_file", "shape": "r_shape", "kind": "r_kind"}))  # a row a shape
    met = v.join(r, (F.col("file") == F.col("r_file")) & (F.col("shape") == F.col("r_shape")), "left")
    n, kind = F.col("value").try_cast("double"), F.col("kind")
    fits = F.when(F.col("r_kind") == "integer", (kind == "number") & (n == F.floor(n))).otherwise(kind == F.col("r_kind"))
    number, string = kind == "number", kind == "string"
    checks = [
        F.when(F.col("r_kind").isNotNull() & ~fits, F.concat(F.lit("not of type "), "r_kind")),
        F.when(F.col("one_of").isNotNull() & ~(string & F.array_contains("one_of", F.coalesce("value", F.lit("")))), F.concat(F.coalesce("value", "kind"), F.lit(" is not allowed"))),
        F.when(string & ~F.regexp_like(F.coalesce("value", F.lit("")), F.coalesce("pattern", F.lit(""))), F.lit("does not match")),
        F.when(number & (n < F.col("least")), F.lit("below the least")), F.when(number & (n > F.col("most")), F.lit("above the most")),
        F.when(string & (F.length("value") < F.col("length")), F.lit("too short")),
    ]
    wrong = problem(met.filter("r_file is not null").withColumn("p", F.explode(F.array_compact(F.array(*checks)))), F.col("path"), F.col("p"))
    closed = F.broadcast(rules.filter("kind = 'object'").select(F.col("file").alias("c_file"), F.col("shape").alias("c_shape")))
    unknown = met.filter("r_file is null and key is not null").join(closed, (F.col("file") == F.col("c_file")) & (F.col("outer") == F.col("c_shape")), "left_semi")
    must = F.broadcast(rules.filter("required").select(F.col("file").alias("m_file"), "of", "name"))
    due = v.filter(kind == "object").join(must, (F.col("file") == F.col("m_file")) & (F.col("shape") == F.col("of"))).select("bundle", "file", F.col("path").alias("parent"), F.col("name").alias("key"))
    missing = due.join(v.select("bundle", "file", "parent", "key"), ["bundle", "file", "parent", "key"], "left_anti")
    unsound = reduce(DataFrame.unionAll, [absent, garbled, wrong, problem(unknown, F.col("path"), F.lit("not allowed here")), problem(missing, F.concat("parent", F.lit("."), "key"), F.lit("required"))])
    unsound = settle(unsound, "violations")
    refs = v.filter("file = 'projection.json' and shape = '.nodes[].evidenceRefs[]'").select("bundle", "file", "path", "value")
    known = v.filter("file = 'evidence.json' and shape = '.evidence[].id'").select("bundle", "value")
    bad = unsound.filter("file in ('projection.json', 'evidence.json')").select("bundle")
    dangling = problem(refs.join(known, ["bundle", "value"], "left_anti").join(bad, "bundle", "left_anti"), F.col("path"), F.concat(F.lit("no evidence "), "value"))
    images = files.filter(F.col("file").startswith("assets/"))
    some = images.select("bundle").distinct()
    icons = some.select("bundle", F.explode(F.array(*[F.lit(f"assets/{i}.png") for i in ICONS])).alias("file")).join(images.select("bundle", "file"), ["bundle", "file"], "left_anti")
    none = bundles.join(some, "bundle", "left_anti").withColumn("file", F.lit("assets/"))
    last = [dangling, problem(icons, root, F.lit("not found")), problem(none, root, F.lit("not found"))]
    return reduce(DataFrame.unionAll, [unsound, *last])
