"""Writes as table algebra: every function takes the current tables and gives the new ones.  A store publishes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import identifier_ok
from ..schema import content_hash, content_id
from .select import NotFound


class StaleRevision(ValueError):
    pass


class Rejected(ValueError):
    pass


def latest(rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """One row a key: the last by ``order``.  Rows of a table have no order of their own: without ``order`` a key that
    repeats stops the job with an error, unless its rows are equal."""
    if order is None:
        rest = [F.col(c) for c in rows.columns if c != key]
        same = F.count_distinct(F.coalesce(F.to_json(F.struct(*rest)), F.lit(""))) if rest else F.lit(1)
        one = rows.groupBy(key).agg(same.alias("__kinds"), *[F.first(c).alias(c) for c in rows.columns if c != key])
        checked = F.when(F.col("__kinds") > 1, F.raise_error(F.concat(F.lit("repeated key needs an order: "), F.col(key).cast("string")))).otherwise(F.col(key))
        return one.select(*[(checked if c == key else F.col(c)).alias(c) for c in rows.columns])
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def merge_nodes(old: DataFrame, new: DataFrame, key: str = "id", keep_old: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """MERGE by key: new rows replace old ones; columns in ``keep_old`` keep an old value; columns that the new rows
    lack keep what the old ones have."""
    new = latest(new, key, order)
    theirs = old.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__old_{c}") for c in old.columns if c != key])
    j = new.join(theirs, new[key] == F.col("__key"), "left")
    def value(c: str) -> Column:
        if c == key:
            return F.col(c)
        if c not in new.columns:
            return F.col(f"__old_{c}")
        return F.coalesce(F.col(f"__old_{c}"), F.col(c)) if c in keep_old else F.col(c)
    merged = j.select(*[value(c).alias(c) for c in old.columns])
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(merged)


def merge_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, key: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """MERGE of edges: end points must exist, an edge that is there stays as it is."""
    known = nodes.select(F.col("id").alias("known"))
    fresh = new.join(known, F.col("src") == F.col("known"), "left_semi").join(known, F.col("dst") == F.col("known"), "left_semi").dropDuplicates(list(key))
    return old.unionByName(fresh.join(old.select(*key), list(key), "left_anti").select(*old.columns))


def create_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """CREATE of edges: end points must exist; edges between the same ends are added beside those that are there."""
    known = nodes.select(F.col("id").alias("known"))
    fresh = new.join(known, F.col("src") == F.col("known"), "left_semi").join(known, F.col("dst") == F.col("known"), "left_semi")
    return old.unionByName(fresh.select(*old.columns))


def link(old: DataFrame, new: DataFrame, sources: DataFrame, targets: DataFrame, required: bool = False) -> DataFrame:
    """MERGE of edges from one node table to another; an edge without both ends is left out.  ``required``: a missing
    target is an error (as for what a view member renders)."""
    ends = targets.select(F.col("id").alias("known"))
    if required:
        missing = new.join(ends, F.col("dst") == F.col("known"), "left_anti").select("dst").limit(1).collect()
        if missing:
            raise NotFound(f"not found: {missing[0][0]}")
    fresh = new.join(sources.select(F.col("id").alias("k")), F.col("src") == F.col("k"), "left_semi").join(ends, F.col("dst") == F.col("known"), "left_semi")
    return old.unionByName(fresh.dropDuplicates(["src", "dst"]).join(old.select("src", "dst"), ["src", "dst"], "left_anti").select(*old.columns))


def set_where(old: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """MATCH … SET: changes rows, not their number."""
    hit = F.coalesce(condition, F.lit(False))
    return old.select(*[(F.when(hit, values[c]).otherwise(F.col(c)) if c in values else F.col(c)).alias(c) for c in old.columns])


def set_where_counted(old: DataFrame, condition: Column, values: dict[str, Column]) -> tuple[DataFrame, int]:
    """MATCH … SET … RETURN: the changed table and how many rows were touched."""
    return set_where(old, condition, values), old.filter(condition).count()


def update_member_label(members: DataFrame, member: str, label: str, now: Column | None = None) -> DataFrame:
    """Sets a view member's label (and updated_at, where the table has it); a member that isn't there is an error."""
    values = {"label": F.lit(label)} | ({"updated_at": F.current_timestamp() if now is None else now} if "updated_at" in members.columns else {})
    after, touched = set_where_counted(members, F.col("id") == member, values)
    if not touched:
        raise NotFound(f"view member not found: {member}")
    return after


#: What a repeated put of evidence leaves as it is.
EVIDENCE_KEPT = ("confidence", "classification")


def put_evidence(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """MERGE of evidence by id: all columns are overwritten but those in EVIDENCE_KEPT; observed_at may be text, and what
    is no timestamp becomes the epoch."""
    when = F.coalesce(F.try_to_timestamp(F.col("observed_at").cast("string")), F.timestamp_seconds(F.lit(0)))
    return merge_nodes(old, new.withColumn("observed_at", when), keep_old=EVIDENCE_KEPT, order=order)


def put_timed(old: DataFrame, new: DataFrame, now: Column | None = None, order: str | None = None) -> DataFrame:
    """MERGE of diagrams, view members and groups: created_at stays what it was, updated_at (and a new created_at) is now."""
    now = F.current_timestamp() if now is None else now
    return merge_nodes(old, new.withColumns({"created_at": now, "updated_at": now}), keep_old=("created_at",), order=order)


def members_of(props: Column) -> Column:
    """A JSON object kept as text as map<string, variant>: values keep their kinds.  Null stands for {}; null if it is none."""
    return F.from_json(F.coalesce(props, F.lit("{}")), "map<string,variant>")


def with_status(props: Column, status: str) -> Column:
    """Sets $.status in a JSON object kept as text; other members stay as they are.  Text that is no object stays, too."""
    rest = F.map_filter(members_of(props), lambda k, v: k != "status")
    return F.coalesce(F.to_json(F.map_concat(rest, F.create_map(F.lit("status"), F.parse_json(F.lit(f'"{status}"'))))), props)


def change_evidence_status(evidence: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies requests (id, action: accept or supersede) -> (evidence, violations).

    accept: drafted becomes accepted, accepted stays, superseded is a violation; supersede: from any status.  A request
    for missing evidence, or for evidence whose props are no JSON object, is a violation.
    """
    r = _judged(evidence, requests)
    good = r.filter("why is null").select(F.col("id").alias("g_id"), "action")
    out = evidence.join(good, evidence.id == F.col("g_id"), "left")
    props = F.when(F.col("action") == "accept", with_status(F.col("props"), "accepted")).when(F.col("action") == "supersede", with_status(F.col("props"), "superseded")).otherwise(F.col("props"))
    return out.withColumn("props", props).select(*evidence.columns), r.filter("why is not null").select("id", "action", "why")


def _judged(evidence: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests, one an id, with the evidence's status ``now`` and ``why`` they can't be met."""
    from ..functions.scalars import status_or_accepted

    r = requests.groupBy("id").agg(F.max("action").alias("action"))  # supersede wins over accept
    now = evidence.select(F.col("id").alias("e_id"), status_or_accepted(F.col("props")).alias("now"), members_of(F.col("props")).isNull().alias("broken"))
    j = r.join(now, F.col("id") == F.col("e_id"), "left")
    why = (
        F.when(F.col("e_id").isNull(), "not found").when(~F.col("action").isin("accept", "supersede"), "unknown action").when(F.col("broken"), "props are no JSON object")
        .when((F.col("action") == "accept") & (F.col("now") == "superseded"), "superseded evidence can't be accepted")
    )
    return j.withColumn("why", why)


def evaluations(evidence: DataFrame, requests: DataFrame, now: Column | None = None, criterion: str = "user_accepted", evaluator: str = "lifecycle_v1") -> tuple[DataFrame, DataFrame]:
    """What acceptance adds to the graph: an Evaluation for each evidence that goes from drafted to accepted, and its
    EVALUATES edge.  Evidence that was accepted before gets none."""
    taken = _judged(evidence, requests).filter("why is null and action = 'accept' and now = 'drafted'").select(F.col("id").alias("target_evidence_id"))
    ident = content_id("eval:", F.col("target_evidence_id"), F.lit(criterion), F.lit(evaluator))
    made = taken.select(ident.alias("id"), "target_evidence_id", F.lit(criterion).alias("criterion"), F.lit(True).alias("passed"), F.lit(evaluator).alias("evaluator"), (F.current_timestamp() if now is None else now).alias("evaluated_at"), F.lit("{}").alias("props"))
    return made, made.select(F.lit("Evaluation").alias("src_label"), F.col("id").alias("src"), F.lit("Evidence").alias("dst_label"), F.col("target_evidence_id").alias("dst"))


def _named_well(rows: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows whose identifiers are sound, and (id, reason) of the others."""
    why = F.coalesce(*[F.when(~F.coalesce(identifier_ok(F.col(c)), F.lit(False)), F.lit(f"{c} is no identifier")) for c in names])
    told = rows.withColumn("reason", why)
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null").select("id", "reason")


def put_sources(old: DataFrame, new: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """MERGE of source artifacts by id -> (all, refused with reason).  id, relative_path, language and kind are identifiers;
    no commit is an empty one."""
    good, bad = _named_well(new, ("id", "relative_path", "language", "kind"))
    if "commit_hash" in good.columns:
        good = good.fillna({"commit_hash": ""})
    return merge_nodes(old, good, order=order), bad


def put_evaluations(old: DataFrame, new: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """MERGE of evaluations by id -> (all, refused with reason).  id, target_evidence_id, criterion and evaluator are
    identifiers; a time (text) that is missing, longer than 64 characters or none at all is the epoch."""
    good, bad = _named_well(new, ("id", "target_evidence_id", "criterion", "evaluator"))
    when = F.when(F.length("evaluated_at") <= 64, F.try_to_timestamp("evaluated_at"))
    return merge_nodes(old, good.withColumn("evaluated_at", F.coalesce(when, F.lit("1970-01-01T00:00:00Z").cast("timestamp"))), order=order), bad


def check_facts(facts: DataFrame, batch_kind: str, known_kinds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Facts (kind, claim, semantic) -> (good, bad with reason): claims are required, at most 255 bytes; kinds must be
    known; a semantic batch needs semantic facts."""
    why = (
        F.when(F.coalesce(F.col("claim"), F.lit("")) == "", "claim required").when(F.octet_length("claim") > 255, "claim over 255 bytes")
        .when(F.coalesce(F.col("kind"), F.lit("")) == "", "kind required").when(~F.col("kind").isin(*known_kinds), "unknown kind")
        .when(F.lit(batch_kind == "semantic") & ~F.coalesce(F.col("semantic"), F.lit(False)), "semantic: true required")
    )
    f = facts.withColumn("reason", why)
    return f.filter("reason is null").drop("reason"), f.filter("reason is not null")


def revision(members: DataFrame, groups: DataFrame | None = None, compat: bool = False) -> str:
    """Hash of a view's whole state, whatever the order of its rows; ``compat``: of ids and labels alone.

    A view holds few members; rows are hashed and sorted before they are joined.
    """
    columns = ["id", "label"] if compat else [c for c in ("id", "diagram_id", "element_id", "label", "x", "y", "collapsed") if c in members.columns]
    rows = members.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))
    if groups is not None and not compat:
        rows = rows.unionAll(groups.select(F.sha2(F.to_json(F.struct("id", "label", "collapsed")), 256)))
    text = rows.agg(F.array_join(F.sort_array(F.collect_list("h")), ",").alias("t"))
    return text.select(content_hash(F.col("t"))).first()[0]


COMMANDS = ("move-member", "set-label", "collapse-group")


def apply_changeset(members: DataFrame, groups: DataFrame, changeset: dict, stored_revision: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """All commands of a changeset or none -> (members, groups, new revision).

    The base revision must be the stored one.  move-member sets x and y and leaves label and collapsed alone.
    """
    now = stored_revision or revision(members, groups)
    if changeset["baseRevision"] != now:
        raise StaleRevision(f"based on {changeset['baseRevision']}, stored is {now}")
    commands = changeset.get("commands", [])
    for c in commands:
        if c.get("type") not in COMMANDS:
            raise Rejected(f"unknown command {c.get('type')}")
        table, ident = (groups, c.get("groupId")) if c["type"] == "collapse-group" else (members, c.get("memberId"))
        if table.filter(F.col("id") == ident).isEmpty():
            raise Rejected(f"{c['type']}: {ident} does not exist")
    for c in commands:
        if c["type"] == "move-member":
            members = set_where(members, F.col("id") == c["memberId"], {"x": F.lit(c["x"]).cast("long"), "y": F.lit(c["y"]).cast("long")})
        elif c["type"] == "set-label":
            members = set_where(members, F.col("id") == c["memberId"], {"label": F.lit(c["label"])})
        else:
            groups = set_where(groups, F.col("id") == c["groupId"], {"collapsed": F.lit(True)})
    return members, groups, revision(members, groups)


def changeset_violations(commands: DataFrame) -> DataFrame:
    """(nth, problem) of commands that lack what their type needs."""
    need = {"move-member": ("memberId", "x", "y"), "set-label": ("memberId", "label"), "collapse-group": ("groupId",)}
    problems = [F.when(~F.col("type").isin(*need) | F.col("type").isNull(), F.lit("unknown type"))]
    for kind, columns in need.items():
        problems += [F.when((F.col("type") == kind) & F.col(c).isNull(), F.lit(f"{kind} needs {c}")) for c in columns]
    return commands.select("nth", F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull())).alias("problem"))
