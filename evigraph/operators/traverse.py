"""Breadth-first walks.  Every level reads only the edges that touch its frontier; the frontier is settled as a table after
each level, so plans stay flat and a lost executor costs one level; what a walk wrote on its way is deleted at its end.

Edges are a DataFrame (src, dst), repeats allowed, or an Adjacency, in which they are stored by both ends.  Over a
DataFrame a frontier of at most ``SMALL`` nodes is broadcast (some 100 MB of ids at most), so the edge tables are filtered
where they are read and only the hits are shuffled; a larger one is joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import counted, joined, release, settle
from .adjacency import Adjacency, sized, store
from .chains import contract
from .ranking import ranked, ranked_within

Edges = DataFrame | Adjacency
#: Rows that one window may number; more are ranked over ranges.
FEW = 100_000
WAYS = {"out": (("src", "dst"),), "in": (("dst", "src"),), "both": (("src", "dst"), ("dst", "src"))}


def edges_at(edges: Edges, key: str, frontier: DataFrame, rows: int) -> DataFrame:
    """The edges whose ``key`` is in the frontier (id), which has at most so many rows."""
    if isinstance(edges, Adjacency):
        return edges.at(key, frontier, rows)
    return edges.join(sized(frontier.select(F.col("id").alias("at")), rows), F.col(key) == F.col("at"), "left_semi")


def whole(edges: Edges) -> DataFrame:
    return edges.table if isinstance(edges, Adjacency) else edges


def touching(edges: Edges, frontier: DataFrame, rows: int, direction: str) -> DataFrame:
    """(src, dst) of the edges that leave the frontier (id), which has at most so many rows: out as they are, in reversed,
    both either way.  Repeats stay; every step goes on with an aggregate."""
    found = [edges_at(edges, a, frontier, rows).select(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in WAYS[direction]]
    return reduce(DataFrame.unionAll, found)


def levels(edges: Edges, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(id, depth) of what is reached from ``seeds`` (id) in at most ``depth`` steps; seeds have depth 0."""
    frontier, rows = counted(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "walk")
    parts, seen, known = [frontier], frontier, rows
    for k in range(1, depth + 1):
        step = touching(edges, frontier, rows, direction).select(F.col("dst").alias("id")).distinct()
        frontier, rows = counted(step.join(sized(seen.select("id"), known), "id", "left_anti").withColumn("depth", F.lit(k)), "walk")
        parts.append(frontier)
        if not rows:
            break
        seen, known = seen.unionByName(frontier), known + rows
    return joined(parts, "levels")


def neighbours(edges: Edges, nodes: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """(id, label) within 1 to 4 undirected steps, without the start."""
    seeds = nodes.sparkSession.range(1).select(F.lit(start).alias("id")).join(nodes.filter(F.col("id") == start).select("id"), "id", "left_semi")
    near = levels(edges, seeds, min(4, max(1, depth)), "both").filter(F.col("id") != start)
    return nodes.select("id", "label").join(sized(near.select("id"), near.count()), "id", "left_semi").distinct()


def level_edges(edges: Edges, walk: DataFrame, direction: str = "out") -> DataFrame:
    """Edges between nodes of the walk with one end on the level before: (src, dst, depth)."""
    rows = walk.count()
    a = walk.select(F.col("id").alias("src"), F.col("depth").alias("from_depth"))
    b = walk.select(F.col("id").alias("dst"), F.col("depth").alias("to_depth"))
    e = edges_at(edges, "src", walk, rows).select("src", "dst").join(sized(a, rows), "src").join(sized(b, rows), "dst").distinct()
    least = F.least("from_depth", "to_depth") if direction == "both" else F.col("from_depth" if direction == "out" else "to_depth")
    last = walk.agg(F.max("depth").alias("last"))
    return e.withColumn("depth", least + 1).join(F.broadcast(last), F.col("depth") <= F.col("last")).select("src", "dst", "depth")


def blast_radius(edges: Edges, start: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """One row: how many new nodes all levels add."""
    return levels(edges, start, depth, direction).filter("depth > 0").agg(F.count("*").alias("n"))


def _least_paths(edges: Edges, start: str, depth: int, ways: Sequence[str]) -> DataFrame:
    """(id, way, depth, path), for each way on its own, by the shortest path that comes first in order.  All ways take their
    step in one job."""
    one = edges.sparkSession.range(1).select(F.lit(start).alias("id"))
    frontier = reduce(DataFrame.unionAll, [one.select("id", F.lit(w).alias("way"), F.lit(0).alias("depth"), F.col("id").alias("path")) for w in ways])
    seen, rows, known, parts = frontier, len(ways), len(ways), []
    for k in range(1, depth + 1):
        e = reduce(DataFrame.unionAll, [touching(edges, frontier.filter(F.col("way") == w), rows, w).withColumn("way", F.lit(w)) for w in ways])
        step = _best(e.join(sized(frontier.select(F.col("id").alias("src"), "way", "path"), rows), ["src", "way"]), "way")
        fresh = step.join(sized(seen.select("id", "way"), known), ["id", "way"], "left_anti").select("id", "way", F.lit(k).alias("depth"), "path")
        frontier, rows = counted(fresh, "paths")
        parts.append(frontier)
        if not rows:
            break
        seen, known = seen.unionByName(frontier), known + rows
    return joined(parts, "paths") if parts else seen.filter("depth > 0")


def _best(steps: DataFrame, *keys: str) -> DataFrame:
    """Of steps (path, dst): to each dst the path that comes first."""
    return steps.groupBy(F.col("dst").alias("id"), *keys).agg(F.min(F.concat_ws(">", "path", "dst")).alias("path"))


def impact(edges: Edges, focus: str, depth: int = 5, direction: str = "both") -> DataFrame:
    """(id, direction, depth, path): what is reached up- and downstream, each on its own, by the shortest path that
    comes first in order; path joins ids with '>'."""
    ways = {way: name for name, way in (("upstream", "in"), ("downstream", "out")) if direction in ("both", name)}
    name = F.when(F.col("way") == "in", "upstream").otherwise("downstream")
    return _least_paths(edges, focus, depth, list(ways)).select("id", name.alias("direction"), "depth", "path")


def impact_summary(found: DataFrame) -> DataFrame:
    """Of impact(): (direction, n, max_depth), with a row for both directions together (direction all)."""
    g = found.rollup("direction").agg(F.count("*").alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    return g.select(F.coalesce("direction", F.lit("all")).alias("direction"), "n", "max_depth")


def shortest_path(edges: Edges, start: str, end: str, most: int = 12) -> DataFrame:
    """(depth, path) of the shortest directed path that comes first in order; no row if there is none within ``most``.
    A condition that all edges of the path must meet is a filter on ``edges``.

    The search goes on from both ends, each time from the smaller frontier, level by level.  When the level that one end
    adds meets what the other end has met, no shorter path is left out: all of that length pass through the meeting nodes.
    From there the least path goes on to the end through the levels of the search that came from it.
    """
    spark = edges.sparkSession
    one = lambda ident: spark.range(1).select(F.lit(ident).alias("id"), F.lit(ident).alias("path"))
    if start == end:
        return one(start).select(F.lit(0).alias("depth"), "path")
    ahead, behind = [(one(start), 1)], [(one(end).select("id"), 1)]  # levels and their rows
    met = None
    while met is None and len(ahead) + len(behind) - 2 < most:
        forward = ahead[-1][1] <= behind[-1][1]
        mine, others = (ahead, behind) if forward else (behind, ahead)
        frontier, rows = mine[-1]
        e = touching(edges, frontier, rows, "out" if forward else "in")
        if forward:
            step = _best(e.join(sized(frontier.select(F.col("id").alias("src"), "path"), rows), "src"))
        else:
            step = e.select(F.col("dst").alias("id")).distinct()
        known = reduce(DataFrame.unionAll, [t.select("id") for t, _ in mine])
        level = counted(step.join(sized(known, sum(n for _, n in mine)), "id", "left_anti"), "meeting")
        mine.append(level)
        if not level[1]:
            break
        # the others' last level is the only one that can be met for the first time now
        last, n = others[-1]
        common, found = counted((level[0] if forward else last).join(sized((last if forward else level[0]).select("id"), n if forward else level[1]), "id", "left_semi"), "meeting")
        if found:
            met = common, found
        else:
            release(common)
    depth, path = len(ahead) + len(behind) - 2, met
    for level, n in reversed(behind[:-1]) if met else ():
        at, rows = path
        e = edges_at(edges, "src", at, rows).select("src", "dst").join(sized(level.select(F.col("id").alias("dst")), n), "dst", "left_semi")
        path = counted(_best(e.join(sized(at.select(F.col("id").alias("src"), "path"), rows), "src")), "meeting")
        release(at)
    release(*[t for t, _ in (*ahead[1:], *behind[1:])])
    if not met:
        return one(start).select(F.lit(0).alias("depth"), "path").filter(F.lit(False))
    return path[0].select(F.lit(depth).alias("depth"), "path")


def sequence(edges: Edges, start: str, depth: int = 5, cap: int = 500) -> DataFrame:
    """Interactions in breadth-first order from a participant: (order_key, sender, receiver, depth, revisited), and the
    columns message_kind, file and line where the edges have them.

    Senders expand once, in the order in which they were met; receivers of a sender go by key; an interaction with a
    participant already met is listed but not expanded.  At most ``cap`` rows, the first ones.  Of repeated edges the first
    by file, line and kind is the one listed; a message without a kind is a sync_call.
    """
    extra = [c for c in ("message_kind", "file", "line") if c in edges.columns]
    seen = frontier = edges.sparkSession.range(1).select(F.lit(start).alias("id"), F.lit("").alias("place"))
    rows, known, total, out, fronts = 1, 1, 0, [], []
    for k in range(1, depth + 1):
        e = edges_at(edges, "src", frontier, rows).join(sized(frontier.select(F.col("id").alias("src"), "place"), rows), "src")
        first = F.min(F.struct(*[F.col(c) for c in ("file", "line", "message_kind") if c in extra])) if extra else F.lit(None)
        step = e.groupBy("place", F.col("src").alias("sender"), F.col("dst").alias("receiver")).agg(first.alias("first"))
        met = sized(seen.select(F.col("id").alias("receiver"), F.lit(True).alias("met")), known)
        values = [(F.coalesce(F.col(f"first.{c}"), F.lit("sync_call")) if c == "message_kind" else F.col(f"first.{c}")).alias(c) for c in extra]
        step, found = counted(step.join(met, "receiver", "left").select("place", "sender", "receiver", F.lit(k).alias("depth"), F.col("met").isNotNull().alias("met"), *values), "sequence")
        out.append(step)
        total += found
        if not found:
            break
        # the place of a receiver: that of its first sender, then its key
        new = step.filter("not met").groupBy(F.col("receiver").alias("id")).agg(F.min(F.struct("place", "sender")).alias("by"))
        frontier, rows = counted(new.select("id", F.concat_ws(">", "by.place", "id").alias("place"), F.col("by.sender").alias("sender"), F.lit(k).alias("depth")), "sequence")
        fronts.append(frontier)
        seen, known = seen.unionByName(frontier.select("id", "place")), known + rows
        if not rows:
            break
    if not out:
        kinds = {f.name: f.dataType.simpleString() for f in whole(edges).schema}
        return edges.sparkSession.createDataFrame([], "order_key int, sender string, receiver string, depth int, revisited boolean" + "".join(f", {c} {kinds[c]}" for c in extra))
    steps = reduce(DataFrame.unionByName, out)
    if fronts:
        # an interaction is the first with its receiver if it is the one by which the receiver was met
        firsts = reduce(DataFrame.unionByName, fronts).select(F.col("id").alias("receiver"), "sender", "depth", F.lit(True).alias("fresh"))
        steps = steps.join(sized(firsts, known), ["receiver", "sender", "depth"], "left")
    else:
        steps = steps.withColumn("fresh", F.lit(None).cast("boolean"))
    steps = steps.select("place", "sender", "receiver", "depth", F.col("fresh").isNull().alias("revisited"), *extra)
    order = ["depth", "place", "receiver"]
    if total <= FEW:
        listed = settle(steps.withColumn("nth", F.row_number().over(Window.orderBy(*order)) - 1).filter(F.col("nth") < cap), "interactions")
    else:
        listed = ranked(steps, order, "nth").filter(F.col("nth") < cap)
    release(*out, *fronts)
    return listed.select((F.col("nth") + 1).cast("int").alias("order_key"), "sender", "receiver", "depth", "revisited", *extra)


def sequence_flags(listed: DataFrame, cap: int = 500) -> DataFrame:
    """Of sequence(): one row (n, participants, depth_reached, revisits, truncated: the cap was reached)."""
    people = F.count_distinct("participant")
    who = listed.select(F.explode(F.array("sender", "receiver")).alias("participant")).agg(people.alias("participants"))
    one = listed.agg(F.count("*").alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth_reached"), F.count_if("revisited").alias("revisits"), (F.count("*") >= cap).alias("truncated"))
    return one.crossJoin(who).select("n", "participants", "depth_reached", "revisits", "truncated")  # single rows


def on_cycles(edges: Edges) -> DataFrame:
    """Edges that lie on a cycle (both ends in one strongly connected component), self-loops included.

    Chains are contracted first, and again after nodes without an edge in or out were trimmed.  Then every node that is left
    takes the least id that reaches it as its colour; edges between colours are on no cycle; nodes that reach the node of
    their colour inside it are that node's component.  What is left inside the colours goes round again.  Every step is a join
    and an aggregate over nodes and edges; nothing grows beyond the edges, and a chain costs log4 of its length.
    """
    every = settle(whole(edges).select("src", "dst").distinct().withColumns({"eid": F.monotonically_increasing_id().cast("string"), "w": F.lit(1).cast("long")}), "cycles")
    found, members, spent = [every.filter("src = dst").select("eid")], [], []
    rest, n = counted(every.filter("src <> dst"), "cycles")
    while n:
        short = contract(rest, str(len(members)))
        if short:
            members.append(short.members)
            found += [short.rings, short.edges.filter("src = dst").select("eid")]
            spent += [rest, short.edges, short.inner, short.members]
            rest, n = counted(short.edges.filter("src <> dst"), "cycles")
        before = n
        while n:
            outs, ins = (rest.select(F.col(c).alias("k")).distinct() for c in ("src", "dst"))
            trimmed, left = counted(rest.join(ins, F.col("src") == F.col("k"), "left_semi").join(outs, F.col("dst") == F.col("k"), "left_semi"), "cycles")
            spent.append(rest)
            rest, gone, n = trimmed, n - left, left
            if 10 * gone <= left:  # what comes slowly now is a chain, or a round of colours finds it
                break
        if n and n == before:
            some, rest, n = _coloured(rest)
            found.append(some)
    on = settle(reduce(DataFrame.unionAll, found), "on-cycles")
    for m in reversed(members):
        on = joined([on, settle(m.join(on.select(F.col("eid").alias("into")), "into", "left_semi").select("eid"), "on-cycles")], "on-cycles")
    release(*spent)
    return every.join(on, "eid", "left_semi").select("src", "dst")


def _coloured(rest: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of edges, one round of colours: (eid of edges in components that were found, edges that are left, how many)."""
    colour = settle(rest.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("colour", F.col("id")), "colours")
    while True:
        met = rest.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.min("colour").alias("met"))
        after, moved = counted(colour.join(met, F.col("id") == F.col("dst"), "left").select("id", F.least("colour", F.coalesce("met", "colour")).alias("colour"), (F.col("met") < F.col("colour")).alias("moved")), "colours", F.count_if("moved"))
        release(colour)
        colour = after.select("id", "colour")
        if not moved:
            break
    of_src, of_dst = (colour.select(F.col("id").alias(x), F.col("colour").alias(f"{x}_colour")) for x in ("src", "dst"))
    same = settle(rest.join(of_src, "src").join(of_dst, "dst").filter("src_colour = dst_colour").select("src", "dst", "eid", "w"), "cycles")
    frontier, rows = counted(colour.filter("id = colour").select("id"), "marks")
    marked, known, parts = frontier, rows, [frontier]
    while rows:
        back = same.join(sized(frontier, rows), F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("id")).distinct()
        frontier, rows = counted(back.join(sized(marked, known), "id", "left_anti"), "marks")
        marked, known = marked.unionAll(frontier), known + rows
        parts.append(frontier)
    marked = joined(parts, "marks")
    a, b = (marked.select(F.col("id").alias(x), F.lit(True).alias(f"{x}_in")) for x in ("src", "dst"))
    told = settle(same.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "eid", "w", F.col("src_in").isNotNull().alias("src_in"), F.col("dst_in").isNotNull().alias("dst_in")), "cycles")
    left, n = counted(told.filter("not src_in and not dst_in").select("src", "dst", "eid", "w"), "cycles")
    release(same, marked, colour)
    return told.filter("src_in and dst_in").select("eid"), left, n


class Cyclic(ValueError):
    pass


def layers(nodes: DataFrame, edges: Edges, bound: int | None = None, patience: int = 64) -> DataFrame:
    """(id, layer): the longest path from a source.

    Nodes are peeled off in the order of their last predecessor: each counts the edges into it, and is done in the round
    in which the last of these was met.  A round reads the edges that leave the nodes of the round before, so an edge is
    met once; only counts of nodes that were met are written.  Chains are contracted first, each to an edge of its length.

    Nodes that are never done lie on a cycle or behind one, where there is no longest path: Cyclic, unless the graph has no
    more than ``patience`` nodes.  Then, or with a ``bound``, paths may meet a node again, up to the bound (as many edges as
    there are nodes): the layer is the last round in which it was met.
    """
    every, total = counted(nodes.select("id").distinct(), "layers")
    known = sized(every.select(F.col("id").alias("known")), total)
    e = whole(edges).select("src", "dst").distinct().join(known, F.col("src") == F.col("known"), "left_semi").join(known, F.col("dst") == F.col("known"), "left_semi")
    e, edges_in = counted(e.withColumns({"eid": F.monotonically_increasing_id().cast("string"), "w": F.lit(1).cast("long")}), "layers")
    found = _relaxed(every, e, bound) if bound is not None else _peeled(every, e, total, edges_in)
    if found is None:
        if total > patience:
            raise Cyclic("layers need a graph without cycles, or a bound")
        found = _relaxed(every, e, total)
    release(every, e)
    return found


def _relaxed(nodes: DataFrame, e: DataFrame, bound: int) -> DataFrame:
    frontier, rows = counted(nodes.withColumn("layer", F.lit(0)), "layers")
    parts, k = [frontier], 0
    while rows and k < bound:
        k += 1
        frontier, rows = counted(touching(e, frontier, rows, "out").select(F.col("dst").alias("id")).distinct().withColumn("layer", F.lit(k)), "layers")
        parts.append(frontier)
    return joined(parts, "layers").groupBy("id").agg(F.max("layer").alias("layer"))


def _peeled(nodes: DataFrame, e: DataFrame, total: int, edges_in: int) -> DataFrame | None:
    """Layers, or None if there is a cycle.  ``e``: so many distinct edges; they are stored by their source, as nothing walks
    back."""
    short = contract(e)
    if short and not short.rings.isEmpty():
        return None
    core = nodes if short is None else nodes.join(short.inner.select("id"), "id", "left_anti")
    if short is None:
        graph = store(e.select("src", "dst", "w"), ways=["src"], distinct=edges_in)
    else:
        graph = store(short.edges.groupBy("src", "dst").agg(F.max("w").alias("w")), ways=["src"])
    into = settle(core.join(graph.table.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("into")), "id", "left").fillna(0, ["into"]), "layers")
    frontier, rows = counted(into.filter("into = 0").select("id", F.lit(0).cast("long").alias("layer")), "layers")
    parts, logs, done = [frontier], [], rows
    while rows:
        met = graph.at("src", frontier, rows).join(sized(frontier.select(F.col("id").alias("src"), "layer"), rows), "src")
        fresh, n = counted(met.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("met"), F.max(F.col("layer") + F.col("w")).alias("layer")), "peeled")
        logs.append(fresh)
        so_far = reduce(DataFrame.unionAll, logs).join(sized(fresh.select("id"), n), "id", "left_semi").groupBy("id").agg(F.sum("met").alias("met"), F.max("layer").alias("layer"))
        frontier, rows = counted(so_far.join(into, "id").filter("met = into").select("id", "layer"), "layers")
        parts.append(frontier)
        done += rows
        if len(logs) == 16:  # what was counted of nodes that are not done yet
            finished = reduce(DataFrame.unionAll, [p.select("id") for p in parts])
            merged = settle(reduce(DataFrame.unionAll, logs).groupBy("id").agg(F.sum("met").alias("met"), F.max("layer").alias("layer")).join(finished, "id", "left_anti"), "peeled")
            release(*logs)
            logs = [merged]
    release(*logs, into)
    graph.drop()
    out = joined(parts, "layers")
    if done + (short.found if short else 0) < total:
        return None
    if short:
        heads = short.heads.join(out.select(F.col("id").alias("start"), F.col("layer").alias("first")), "start")
        between = short.inner.join(heads, "tail").select("id", (F.col("first") + F.col("total") - F.col("hops")).alias("layer"))
        out = joined([out, settle(between, "layers")], "layers")
        release(short.edges, short.inner, short.heads)
    return out.select("id", F.col("layer").cast("int").alias("layer"))


def layout(layered: DataFrame, width: int = 220, height: int = 120) -> DataFrame:
    """Coordinates: x by the place inside the layer, y by the layer.  A layer may hold nearly all nodes; places come from a
    ranking over ranges, not from a window."""
    placed = ranked_within(layered.select("id", "layer"), "layer", ["id"], "place")
    return placed.select("id", "layer", (F.col("place") * width).alias("x"), (F.col("layer") * height).alias("y"))


def breadcrumbs(parents: DataFrame, focus: str, most: int = 64) -> DataFrame:
    """(step, id) from the root to the focus along (id, parent_id); a loop ends the trail."""
    known = settle(parents.filter("parent_id is not null").select("id", "parent_id"), "parents")
    trail, at = [focus], focus
    for _ in range(most):  # one point lookup a step
        row = known.filter(F.col("id") == at).select(F.min("parent_id")).first()
        if row[0] is None or row[0] in trail:
            break
        at = row[0]
        trail.append(at)
    release(known)
    return parents.sparkSession.createDataFrame([(i, x) for i, x in enumerate(reversed(trail))], "step int, id string")


def breadcrumbs_by_key(elements: DataFrame, focus: str) -> DataFrame:
    """(step, id) from the root to the focus, by the prefixes of its canonical key: one lookup and one filtered scan."""
    key = elements.filter(F.col("id") == focus).select(F.min("canonical_key")).first()[0]
    parts = (key or "").split("/")
    prefixes = ["/".join(parts[: i + 1]) for i in range(len(parts))]
    found = elements.filter(F.col("canonical_key").isin(prefixes)).groupBy("canonical_key").agg(F.min("id").alias("id"))
    step = F.row_number().over(Window.orderBy(F.length("canonical_key"))) - 1  # over one row a prefix
    return found.select(step.alias("step"), "id")
