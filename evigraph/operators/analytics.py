"""Analyses over graphs: packages, drift, hierarchy, visibility, naming, history."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import name_similarity, package_of, strip_suffixes
from ..scratch import settle
from .ranking import ranked


def package_edges(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(src_package, dst_package, weight): calls between files of different packages.  nodes: id, file."""
    p = nodes.select("id", package_of(F.col("file")).alias("package"))
    e = calls.join(p.select(F.col("id").alias("src"), F.col("package").alias("src_package")), "src").join(p.select(F.col("id").alias("dst"), F.col("package").alias("dst_package")), "dst")
    return e.filter("src_package <> dst_package").groupBy("src_package", "dst_package").agg(F.count("*").alias("weight"))


def package_files(nodes: DataFrame) -> DataFrame:
    """(package, files): sorted distinct files of each package; nodes without a file make none."""
    n = nodes.filter("file is not null").select(package_of(F.col("file")).alias("package"), "file").distinct()
    return n.groupBy("package").agg(F.sort_array(F.collect_list("file")).alias("files"))


DRIFT_PROPERTIES = ("label", "kind", "description", "technology")


def drift_elements(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(id, change): added, removed or changed; nulls equal nulls."""
    a = declared.select("id", F.struct(*DRIFT_PROPERTIES).alias("was"))
    b = actual.select("id", F.struct(*DRIFT_PROPERTIES).alias("now"))
    j = a.join(b, "id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return j.select("id", change.alias("change")).filter("change is not null")


def drift_properties(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(id, property, was, now) of each property that differs."""
    a = declared.select("id", *[F.col(p).alias(f"{p}_was") for p in DRIFT_PROPERTIES])
    b = actual.select("id", *[F.col(p).alias(f"{p}_now") for p in DRIFT_PROPERTIES])
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(f"{p}_was").cast("string").alias("was"), F.col(f"{p}_now").cast("string").alias("now")) for p in DRIFT_PROPERTIES]))
    return a.join(b, "id").select("id", pairs.alias("p")).select("id", "p.*").filter(~F.col("was").eqNullSafe(F.col("now")))


def drift_relations(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(src, dst, kind, change) of relations on one side only."""
    key = ["src", "dst", "kind"]
    a, b = declared.select(*key).distinct(), actual.select(*key).distinct()
    added, removed = b.join(a, key, "left_anti"), a.join(b, key, "left_anti")
    return added.withColumn("change", F.lit("added")).unionByName(removed.withColumn("change", F.lit("removed")))


def drift_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("added", "removed", "changed")])


def key_prefixes(key: Column) -> Column:
    """Proper '/'-prefixes of a path key, with their number of segments."""
    parts = F.split(key, "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.struct(k.alias("segments"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("prefix")))


def derive_parents(nodes: DataFrame) -> DataFrame:
    """(id, parent_id): the node whose key is the longest proper prefix of this one's; null if there is none.

    Each key joins by its prefixes, so there is no theta join.
    """
    known = nodes.groupBy("canonical_key").agg(F.min("id").alias("parent_id")).withColumnRenamed("canonical_key", "prefix")
    up = nodes.select("id", F.explode(key_prefixes(F.col("canonical_key"))).alias("p")).select("id", "p.*").join(known, "prefix")
    best = up.groupBy("id").agg(F.max_by("parent_id", "segments").alias("parent_id"))
    return nodes.select("id").join(best, "id", "left")


def visible_nodes(parents: DataFrame, focus: str) -> DataFrame:
    """The focus, its children and its parent."""
    of_focus = parents.filter((F.col("id") == focus) & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id"))
    shown = parents.filter((F.col("id") == focus) | (F.col("parent_id") == focus)).select("id")
    return shown.unionByName(of_focus.join(parents.select("id"), "id", "left_semi")).distinct()


def visible_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    known = shown.select(F.col("id").alias("known"))
    return edges.join(known, F.col("src") == F.col("known"), "left_semi").join(known, F.col("dst") == F.col("known"), "left_semi")


def participants(interactions: DataFrame) -> DataFrame:
    """(scenario, participant, column): columns by first appearance; a sender stands before its receiver."""
    seen = interactions.select("scenario", F.explode(F.array(F.struct((F.col("order_key") * 2).alias("at"), F.col("sender").alias("participant")), F.struct((F.col("order_key") * 2 + 1).alias("at"), F.col("receiver").alias("participant")))).alias("p")).select("scenario", "p.*")
    first = seen.filter("participant is not null").groupBy("scenario", "participant").agg(F.min("at").alias("at"))
    return first.select("scenario", "participant", (F.dense_rank().over(Window.partitionBy("scenario").orderBy("at")) - 1).alias("column"))


def connascence(elements: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(stem, a, b, confidence): in each group of names with one lower-cased stem, the most similar pair.

    Equal stripped names all have similarity 1, so a group is first reduced to one element for each stripped spelling
    (and one pair inside a spelling); only the few spellings of a stem are compared.
    """
    e = elements.select("id", F.col("current_name").alias("name"), strip_suffixes(F.col("current_name")).alias("spelling")).withColumn("stem", F.lower("spelling"))
    e = e.filter("name <> ''")
    spelled = e.groupBy("stem", "spelling").agg(F.min(F.struct("id", "name")).alias("first"), F.count("*").alias("n"))
    second = e.join(spelled.select("stem", "spelling", F.col("first.id").alias("first_id")), ["stem", "spelling"]).filter("id <> first_id").groupBy("stem", "spelling").agg(F.min(F.struct("id", "name")).alias("second"))
    same = spelled.filter("n > 1").join(second, ["stem", "spelling"]).select("stem", F.col("first.id").alias("a"), F.col("second.id").alias("b"), F.lit(1.0).alias("confidence"))
    x, y = spelled.select("stem", F.col("spelling").alias("sx"), F.col("first").alias("x")), spelled.select("stem", F.col("spelling").alias("sy"), F.col("first").alias("y"))
    other = x.join(y, "stem").filter("sx < sy").select("stem", F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), name_similarity(F.col("sx"), F.col("sy")).alias("confidence"))
    pairs = same.unionByName(other).filter(F.col("confidence") >= threshold)
    best = pairs.groupBy("stem").agg(F.max("confidence").alias("top"))
    exact = pairs.join(best.select("stem", "top"), "stem").filter("confidence = top").groupBy("stem").agg(F.min(F.struct("a", "b")).alias("p"), F.first("top").alias("confidence"))
    return exact.select("stem", "p.a", "p.b", "confidence")


def best_finding(pairs: DataFrame) -> DataFrame:
    """Of connascence(): the surest pair, on ties the last stem; no pair, no row."""
    return pairs.orderBy(F.col("confidence").desc(), F.col("stem").desc()).limit(1)


def by_group(rows: DataFrame, group: str, value: str = "id", order: str | None = None) -> DataFrame:
    """(group, n, first): the groups of a view (elements by level, edges by predicate, interactions by participant) with
    their size and the first value, groups in the order of their first appearance by ``order`` (default: value)."""
    at = F.col(order or value)
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.min_by(value, F.struct(at, F.col(value))).alias("first"), F.min(at).alias("at"))
    return g.orderBy("at", group).select(group, "n", "first")


def focus_elements(elements: DataFrame, goal: str) -> DataFrame:
    """Ids of elements whose name or key occurs in the goal, in any case."""
    text = F.lit(goal.lower())
    hit = lambda c: F.coalesce((F.length(c) > 0) & text.contains(F.lower(c)), F.lit(False))
    return elements.filter(hit(F.col("current_name")) | hit(F.col("canonical_key"))).select("id").distinct()


def focus_many(elements: DataFrame, goals: DataFrame, gram: int = 4) -> DataFrame:
    """(goal_id, id) of every element whose name or key occurs in a goal's text, in any case: focus_elements for many
    goals (goal_id, text).

    An inverted index of the texts' grams (four letters; shorter ones for names that have no more): each name is looked up
    by that of its grams which the fewest texts hold, and what is found must contain the name.  A name with a gram that no
    text holds is in none.
    """
    names = elements.select("id", F.explode(F.array_compact(F.array_distinct(F.array(F.lower("current_name"), F.lower("canonical_key"))))).alias("name")).filter("name <> ''")
    texts = goals.select("goal_id", F.lower("text").alias("text")).filter("text is not null")
    of_name = _grams(names.select("name").distinct(), "name", F.least(F.length("name"), F.lit(gram)))
    lengths = sorted(r[0] for r in of_name.select(F.length("gram")).distinct().collect())  # at most ``gram``
    # pieces of 64 letters with the beginning of the next: letters are counted from a piece's start, not a text's
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,64}"), F.lit(0))
    ahead = F.transform(cut, lambda x, i: F.concat(x, F.substring(F.coalesce(F.get(cut, i + 1), F.lit("")), 1, gram - 1)))
    pieces = texts.select("goal_id", F.explode(ahead).alias("piece"))
    of_text = [_grams(pieces, "piece", F.lit(n)).select("goal_id", "gram") for n in lengths]
    held = settle(reduce(DataFrame.unionAll, of_text).distinct(), "grams") if of_text else texts.select("goal_id", F.lit("").alias("gram")).filter(F.lit(False))
    times = held.groupBy("gram").agg(F.count("*").alias("times"))
    rarest = of_name.join(times, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram")).alias("r"))
    keyed = rarest.filter("r.times > 0").select("name", F.col("r.gram").alias("gram"))
    found = held.join(keyed, "gram").join(texts, "goal_id").filter(F.col("text").contains(F.col("name"))).select("goal_id", "name").distinct()
    return found.join(names, "name").select("goal_id", "id").distinct()


def _grams(rows: DataFrame, column: str, n: Column) -> DataFrame:
    """``rows`` with gram: the runs of n letters of a column, each once."""
    long = rows.filter(F.length(column) >= n)
    runs = F.transform(F.sequence(F.lit(1), F.length(column) - n + 1), lambda i: F.substring(F.col(column), i, n))
    return long.withColumn("gram", F.explode(F.array_distinct(runs)))


def roll_up(edges: DataFrame, containment: DataFrame, level: str) -> DataFrame:
    """(src, dst, weight): edges between the containers at a level.  containment: id, level, container."""
    c = containment.filter(F.col("level") == level)
    up = edges.join(c.select(F.col("id").alias("src"), F.col("container").alias("s")), "src").join(c.select(F.col("id").alias("dst"), F.col("container").alias("d")), "dst")
    return up.filter("s <> d").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.count("*").alias("weight"))


def intervals(nodes: DataFrame) -> DataFrame:
    """(canonical_key, pre, post) of every key: places in the order of a walk through the tree, so that all keys below one have
    places after its pre, up to its post.

    Places are a ranking by the keys' segments; what lies below a key is counted by the prefixes of all keys.
    """
    keys = nodes.filter("canonical_key is not null").select("canonical_key").distinct()
    placed = ranked(keys, [F.split("canonical_key", "/")], "pre")
    below = placed.select(F.explode(key_prefixes(F.col("canonical_key"))).alias("p")).groupBy(F.col("p.prefix").alias("above")).agg(F.count("*").alias("below"))
    return placed.join(below, F.col("canonical_key") == F.col("above"), "left").select("canonical_key", "pre", (F.col("pre") + F.coalesce("below", F.lit(0))).alias("post"))


def containers(nodes: DataFrame, levels: Sequence[str], width: int = 100_000) -> DataFrame:
    """(id, level, container) for every level on which something contains a node, or is the node.  nodes: id, level (null or
    another: contains nothing), canonical_key.  The containers of one level don't contain one another.

    All levels in one pass: places are cut into stretches of ``width``; a container stands at its first place in each
    stretch that it reaches into, and a node belongs to the last one that stands before it, if that goes so far.
    """
    at = nodes.select("id", "level", "canonical_key").join(intervals(nodes), "canonical_key")
    at = settle(at.withColumns({"first": F.floor(F.col("pre") / width), "last": F.floor(F.col("post") / width)}), "intervals")
    mark = at.filter(F.col("level").isin(*levels)).select("level", F.explode(F.sequence("first", "last")).alias("stretch"), "pre", "post", F.col("id").alias("container"))
    mark = mark.select("level", "stretch", F.greatest("pre", F.col("stretch") * width).alias("place"), F.lit(0).alias("is_node"), F.struct("container", "post").alias("held"), F.lit(None).cast(nodes.schema["id"].dataType).alias("id"))
    node = at.select(F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"), F.col("first").alias("stretch"), F.col("pre").alias("place"), F.lit(1).alias("is_node"), F.lit(None).cast(mark.schema["held"].dataType).alias("held"), "id")
    upto = Window.partitionBy("level", "stretch").orderBy("place", "is_node").rowsBetween(Window.unboundedPreceding, 0)
    met = mark.unionByName(node).withColumn("in", F.last("held", ignorenulls=True).over(upto))
    return met.filter((F.col("is_node") == 1) & (F.col("in.post") >= F.col("place"))).select("id", "level", F.col("in.container").alias("container"))


def multi_level(edges: DataFrame, nodes: DataFrame, levels: Sequence[str]) -> DataFrame:
    """(level, src, dst, weight): edges (src, dst) between the containers of their ends, at all levels at once.  An end that
    nothing contains at a level is not there; edges inside one container are left out."""
    up = containers(nodes, levels).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("level", "container"))).alias("up"))  # one entry a level
    side = lambda c: up.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up"))
    both = edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")
    at = both.select(F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"), "src_up", "dst_up").select("level", F.col("src_up")[F.col("level")].alias("src"), F.col("dst_up")[F.col("level")].alias("dst"))
    return at.filter("src <> dst").groupBy("level", "src", "dst").agg(F.count("*").alias("weight"))


def collapse_consecutive(interactions: DataFrame) -> DataFrame:
    """Drops an interaction that repeats the one before it in its scenario; order_key is numbered anew from 1."""
    w = Window.partitionBy("scenario").orderBy("order_key")
    same = F.col("sender").eqNullSafe(F.lag("sender").over(w)) & F.col("receiver").eqNullSafe(F.lag("receiver").over(w)) & (F.row_number().over(w) > 1)
    kept = interactions.withColumn("same", same).filter("not same").drop("same")
    return kept.withColumn("order_key", F.row_number().over(w))


def version_at(versions: DataFrame, sequence: int) -> DataFrame:
    """The last version of each element at or before a snapshot: versions have element_id, sequence, name."""
    v = versions.filter(F.col("sequence") <= sequence)
    return v.groupBy("element_id").agg(F.max("sequence").alias("sequence"), F.max_by("name", "sequence").alias("name"))


def snapshot_diff(versions: DataFrame, older: int, newer: int) -> DataFrame:
    """(element_id, change) between two snapshots."""
    a = version_at(versions, older).select("element_id", F.struct("name").alias("was"))
    b = version_at(versions, newer).select("element_id", F.struct("name").alias("now"))
    j = a.join(b, "element_id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return j.select("element_id", change.alias("change")).filter("change is not null")


def invalidated(changed: DataFrame, extracted_from: DataFrame, supported_by: DataFrame, versions: DataFrame) -> DataFrame:
    """(source, evidence, version, element): what rests on changed sources, along its lineage."""
    e = changed.select(F.col("id").alias("source")).join(extracted_from.select(F.col("src").alias("evidence"), F.col("dst").alias("source")), "source")
    v = e.join(supported_by.select(F.col("src").alias("version"), F.col("dst").alias("evidence")), "evidence", "left")
    return v.join(versions.select(F.col("id").alias("version"), F.col("element_id").alias("element")), "version", "left").select("source", "evidence", "version", "element")
