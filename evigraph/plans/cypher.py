"""A subset of Cypher, planned as DataFrame operations.

Read queries: MATCH and OPTIONAL MATCH of nodes, edges in either direction and undirected walks of bounded length,
inline properties, WHERE (AND, OR, NOT, comparisons, IN, STARTS WITH, ENDS WITH, CONTAINS, IS NULL), WITH … WHERE,
UNWIND of a list, RETURN with DISTINCT, aliases, count, min, max, sum, avg, collect, implicit grouping, COALESCE,
labels(), timestamp(), ORDER BY, SKIP-less LIMIT, and $parameters.  Writing clauses are found by the parser, not by a
search in the text, and refused; operators.upsert has them as table algebra.

A graph is a set of node tables (with ``id``) and edge tables (``src``, ``dst``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.adjacency import SMALL, Adjacency, sized
from ..operators.traverse import touching, whole
from ..scratch import counted, joined, release

_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+\.\d+|\d+)|(\$?[A-Za-z_]\w*)|(<>|<=|>=|->|<-|\.\.|[-=<>()\[\]{},.:*|+/]))")
WRITES = {"CREATE", "MERGE", "SET", "DELETE", "DETACH", "REMOVE", "DROP", "ALTER", "COPY"}
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list}
CLAUSES = ("MATCH", "OPTIONAL", "WHERE", "WITH", "UNWIND", "RETURN", "ORDER", "LIMIT")


class CypherError(ValueError):
    pass


@dataclass
class Graph:
    """Node and edge tables by name; edges that are stored as an Adjacency are walked there."""

    nodes: dict[str, DataFrame]
    edges: dict[str, DataFrame | Adjacency]

    def node(self, label: str | None) -> DataFrame:
        """A label's table with a label column; without a label, ids of all tables."""
        if label is not None:
            if label not in self.nodes:
                raise CypherError(f"no node table {label}")
            return self.nodes[label].withColumn("__label", F.lit(label))
        return reduce(DataFrame.unionAll, [t.select("id", F.lit(n).alias("__label")) for n, t in self.nodes.items()])

    def edge(self, kinds: list[str]) -> DataFrame:
        if len(kinds) == 1:
            if kinds[0] not in self.edges:
                raise CypherError(f"no edge table {kinds[0]}")
            return whole(self.edges[kinds[0]])
        return reduce(DataFrame.unionAll, [whole(self.edges[k]).select("src", "dst", F.lit(k).alias("__type")) for k in (kinds or self.edges)])

    def adjacent(self, kinds: list[str]) -> DataFrame | Adjacency:
        """The edges to walk, stored ones as they are."""
        kinds = kinds or list(self.edges)
        stored = self.edges.get(kinds[0]) if len(kinds) == 1 else None
        return stored if isinstance(stored, Adjacency) else self.edge(kinds)


@dataclass
class Node:
    name: str
    label: str | None
    props: dict = field(default_factory=dict)


@dataclass
class Edge:
    name: str
    kinds: list[str]
    direction: str
    hops: tuple[int, int] | None


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip().rstrip(";")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            if not text[at:].strip():
                break
            raise CypherError(f"can't read {text[at:at + 20]!r}")
        out.append(m.group().strip())
        at = m.end()
    return out


def is_read_only(text: str) -> bool:
    """Whether no writing clause stands in the query; property names and strings don't count."""
    t = tokens(text)
    return not any(x.upper() in WRITES and (i == 0 or t[i - 1] not in (".", ":", "$")) and (i + 1 == len(t) or t[i + 1] not in (":", ".")) for i, x in enumerate(t))


class _Parser:
    def __init__(self, text: str, params: dict) -> None:
        self.t, self.i, self.params, self.fresh = tokens(text), 0, params, 0
        self.paths: dict[str, tuple[int, int]] = {}

    def peek(self, *words: str) -> bool:
        return self.i + len(words) <= len(self.t) and all(self.t[self.i + k].upper() == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise CypherError(f"expected {word} before {' '.join(self.t[self.i : self.i + 3])!r}")

    def word(self) -> str:
        if self.i >= len(self.t):
            raise CypherError("the query ends too early")
        self.i += 1
        return self.t[self.i - 1]

    def anonymous(self) -> str:
        self.fresh += 1
        return f"__{self.fresh}"

    def node(self) -> Node:
        self.need("(")
        name = self.word() if self.i < len(self.t) and re.match(r"[A-Za-z_]", self.t[self.i]) else self.anonymous()
        label = self.word() if self.take(":") else None
        props = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.word()
                self.need(":")
                props[key] = self.value()
                self.take(",")
        self.need(")")
        return Node(name, label, props)

    def edge(self) -> Edge:
        back = self.take("<-")
        if not back:
            self.need("-")
        name, kinds, hops = self.anonymous(), [], None
        if self.take("["):
            if self.i < len(self.t) and re.match(r"[A-Za-z_]", self.t[self.i]):
                name = self.word()
            while self.take(":") or self.take("|"):
                kinds.append(self.word())
            if self.take("*"):
                shortest = self.take("SHORTEST")
                low = int(self.word()) if self.t[self.i].isdigit() else 1
                high = int(self.word()) if self.take("..") else low
                hops = (low, high)
                if shortest:
                    self.paths[name] = hops
            self.need("]")
        ahead = self.take("->")
        if not ahead:
            self.need("-")
        return Edge(name, kinds, "in" if back else "out" if ahead else "both", hops)

    def pattern(self) -> list[Node | Edge]:
        out: list[Node | Edge] = [self.node()]
        while self.peek("-") or self.peek("<-"):
            out += [self.edge(), self.node()]
        return out

    def value(self):
        w = self.word()
        if w == "[":
            out = []
            while not self.take("]"):
                out.append(self.value())
                self.take(",")
            return out
        if w[0] in "'\"":
            return re.sub(r"\\(.)", r"\1", w[1:-1])
        if w[0] == "$":
            return self.params[w[1:]]
        if w == "-":
            return -self.value()
        if re.match(r"\d", w):
            return float(w) if "." in w else int(w)
        known = {"TRUE": True, "FALSE": False, "NULL": None}
        if w.upper() in known:
            return known[w.upper()]
        raise CypherError(f"not a value: {w}")


def _column(name: str, prop: str) -> str:
    return f"{name}.{prop}"


class _Planner(_Parser):
    def __init__(self, graph: Graph, text: str, params: dict) -> None:
        super().__init__(text, params)
        self.graph, self.df, self.bound = graph, None, set()
        self.by_id: set[str] = set()
        self.kinds_of: dict[str, list[str]] = {}
        self.apart: list[tuple[str, bool]] = []

    # expressions ---------------------------------------------------------------------------------------------
    def expression(self) -> Column:
        left = self.conjunction()
        while self.take("OR"):
            left = left | self.conjunction()
        return left

    def conjunction(self) -> Column:
        left = self.negation()
        while self.take("AND"):
            left = left & self.negation()
        return left

    def negation(self) -> Column:
        return ~self.negation() if self.take("NOT") else self.comparison()

    def comparison(self) -> Column:
        if self.peek("ALL", "(") and self.t[self.i + 4] in self.paths:  # met by the walk already
            depth, self.i = 1, self.i + 2
            while depth:
                depth += {"(": 1, ")": -1}.get(self.word(), 0)
            return F.lit(True)
        a = self.operand()
        if self.take("IS", "NOT", "NULL"):
            return a.isNotNull()
        if self.take("IS", "NULL"):
            return a.isNull()
        if self.take("STARTS", "WITH"):
            return a.startswith(self.operand())
        if self.take("ENDS", "WITH"):
            return a.endswith(self.operand())
        if self.take("CONTAINS"):
            return a.contains(self.operand())
        if self.take("IN"):
            return a.isin(self.value())
        for sign, f in (("=", Column.__eq__), ("<>", Column.__ne__), ("<=", Column.__le__), (">=", Column.__ge__), ("<", Column.__lt__), (">", Column.__gt__)):
            if self.take(sign):
                return f(a, self.operand())
        return a

    def operand(self) -> Column:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        w = self.t[self.i] if self.i < len(self.t) else ""
        if re.match(r"[A-Za-z_]", w) and w.upper() not in ("TRUE", "FALSE", "NULL"):
            self.i += 1
            if self.take("("):
                return self.call(w.lower())
            if self.take("."):
                return F.col(f"`{_column(w, self.word())}`")
            return F.col(f"`{w}`") if self.df is not None and w in self.df.columns else F.col(f"`{_column(w, 'id')}`")
        return F.lit(self.value())

    def call(self, name: str) -> Column:
        if name in AGGREGATES:
            self.aggregated = True
            if name == "count" and self.take("*"):
                self.need(")")
                return F.count(F.lit(1))
            distinct = self.take("DISTINCT")
            e = self.expression()
            self.need(")")
            return F.count_distinct(e) if distinct and name == "count" else F.collect_set(e) if distinct else AGGREGATES[name](e)
        if name == "labels":
            w = self.word()
            self.need(")")
            return F.col(f"`{_column(w, '__label')}`")
        args = []
        while not self.take(")"):
            args.append(self.expression())
            self.take(",")
        known = {"coalesce": F.coalesce, "timestamp": F.to_timestamp, "lower": F.lower, "tolower": F.lower, "upper": F.upper, "toupper": F.upper, "size": F.length}
        if name not in known:
            raise CypherError(f"no function {name}")
        return known[name](*args)

    # clauses -------------------------------------------------------------------------------------------------
    def run(self) -> DataFrame:
        while self.i < len(self.t):
            if self.take("MATCH"):
                self.match("inner")
            elif self.take("OPTIONAL", "MATCH"):
                self.match("left")
            elif self.take("WHERE"):
                self.df = self.df.filter(self.expression())
            elif self.take("UNWIND"):
                values = F.explode(F.lit(self.value()))
                self.need("AS")
                name = self.word()
                self.df = (self.any_frame().range(1).select(values.alias(name))) if self.df is None else self.df.withColumn(name, values)
            elif self.take("WITH"):
                self.project()
            elif self.take("RETURN"):
                self.project()
                if self.take("ORDER", "BY"):
                    self.order()
                if self.take("LIMIT"):
                    self.df = self.df.limit(self.value())
            else:
                raise CypherError(f"can't read {' '.join(self.t[self.i : self.i + 3])!r}")
        return self.df

    def any_frame(self):
        return next(iter([*self.graph.nodes.values(), *self.graph.edges.values()])).sparkSession

    def _prefixed(self, df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").alias(_column(name, c)) for c in df.columns])

    def _with_node(self, n: Node, how: str, key: Column | None, ends: DataFrame | None = None) -> None:
        """Binds a node: a new table joined by ``key``, or a filter if the name is bound.  Of a table of nodes where a walk
        ends at few (``ends``: id) only these are read on."""
        if n.name not in self.bound:
            t = self.graph.node(n.label)
            if ends is not None:
                t = t.join(F.broadcast(ends), "id", "left_semi")
            for k, v in n.props.items():
                t = t.filter(F.col(k).isNull() if v is None else F.col(k) == v)
            t = self._prefixed(t, n.name)
            if "id" in n.props:
                self.by_id.add(n.name)
            if self.df is None:
                self.df = t
            elif key is None:
                self.apart += [(n.name, "id" in n.props), *[(b, b in self.by_id) for b in self.bound]]
                self.df = self.df.crossJoin(t) if how == "inner" else self.df.join(t, F.lit(True), "left")  # unconnected patterns, see query()
            else:
                self.df = self.df.join(t, key == F.col(f"`{_column(n.name, 'id')}`"), how)
            self.bound.add(n.name)
            return
        ident = F.col(f"`{_column(n.name, 'id')}`")
        if key is not None and how == "inner":
            self.df = self.df.filter(key == ident)
        for k, v in n.props.items():
            self.df = self.df.filter(F.col(f"`{_column(n.name, k)}`") == v)

    def match(self, how: str) -> None:
        while True:
            p = self.pattern()
            names = [x.name for x in p if isinstance(x, Node)]
            if how == "left" and self.df is not None and any(n in self.bound for n in names):
                self._optional(p)
            else:
                if names[0] not in self.bound and names[-1] in self.bound:
                    turned = {"in": "out", "out": "in", "both": "both"}
                    p = [Edge(x.name, x.kinds, turned[x.direction], x.hops) if isinstance(x, Edge) else x for x in reversed(p)]
                self._chain(p, "inner")
            if not self.take(","):
                break

    def _optional(self, p: list[Node | Edge]) -> None:
        """The pattern on its own, then a left join by the nodes that are bound already."""
        inner = _Planner(self.graph, "", self.params)
        inner.fresh = self.fresh + 1000
        inner._chain(p, "inner")
        shared = [x.name for x in p if isinstance(x, Node) and x.name in self.bound]
        right = inner.df
        for n in shared:
            right = right.withColumnRenamed(_column(n, "id"), f"__{n}").drop(*[c for c in right.columns if c.startswith(f"{n}.") and c != _column(n, "id")])
        cond = reduce(lambda a, b: a & b, [F.col(f"`{_column(n, 'id')}`") == F.col(f"`__{n}`") for n in shared])
        self.df = self.df.join(right, cond, "left").drop(*[f"__{n}" for n in shared])
        self.bound |= inner.bound

    def _chain(self, p: list[Node | Edge], how: str) -> None:
        self._with_node(p[0], how, None)
        for k in range(1, len(p), 2):
            before, e, after = p[k - 1], p[k], p[k + 1]
            here, ends = F.col(f"`{_column(before.name, 'id')}`"), None
            if e.hops:
                t, found = self._walk(e, before)
                ends = t.select(F.col("dst").alias("id")) if found <= SMALL else None
                t = t.select(F.col("src").alias(_column(e.name, "src")), F.col("dst").alias(_column(e.name, "dst")), *([F.col("path").alias(e.name)] if e.name in self.paths else []))
            else:
                raw = self.graph.edge(e.kinds)
                turned = {"src": F.col("dst"), "dst": F.col("src")}
                if e.direction == "in":
                    raw = raw.withColumns(turned)
                elif e.direction == "both":
                    raw = raw.unionByName(raw.withColumns(turned))
                t = self._prefixed(raw, e.name)
            self.df = self.df.join(t, here == F.col(f"`{_column(e.name, 'src')}`"), how)
            self._with_node(after, how, F.col(f"`{_column(e.name, 'dst')}`"), ends)

    def _all_edges(self, name: str) -> Column | None:
        """WHERE ALL(edge IN path WHERE …) of a shortest path that is being matched: the condition on its edges."""
        for at in range(self.i, len(self.t) - 4):
            if self.t[at].upper() == "ALL" and self.t[at + 1] == "(" and self.t[at + 3].upper() == "IN" and self.t[at + 4] == name:
                inner = _Planner(self.graph, "", self.params)
                edge, depth, end = self.t[at + 2], 1, at + 6
                while depth:
                    depth += {"(": 1, ")": -1}.get(self.t[end], 0)
                    end += 1
                # inside the condition edge.x is the column x of the edges
                words = self.t[at + 6 : end - 1]
                inner.t = [w for k, w in enumerate(words) if not (w == edge and words[k + 1 : k + 2] == ["."]) and not (w == "." and words[k - 1] == edge)]
                inner.df = self.graph.edge(self.kinds_of.get(name, []))
                return inner.expression()
        return None

    def _walk(self, e: Edge, before: Node) -> tuple[DataFrame, int]:
        """(src, dst) of ends of trails with low to high steps: pairs by shortest distance, each once; with SHORTEST also
        path, the ids on the way that comes first in order; and how many there are at most.  Every step reads the edges that
        leave its frontier only."""
        raw, shortest = self.graph.adjacent(e.kinds), e.name in self.paths
        if shortest:
            self.kinds_of[e.name] = e.kinds
            condition = self._all_edges(e.name)
            raw = raw if condition is None else raw.filter(condition)
        start, rows = counted(self.df.select(F.col(f"`{_column(before.name, 'id')}`").alias("src")).distinct(), "starts")
        frontier = start.select("src", F.col("src").alias("dst"), F.lit(0).alias("n"), F.array("src").alias("path"))
        seen, parts, total = frontier, [], rows
        for n in range(1, e.hops[1] + 1):
            ids = frontier.select(F.col("dst").alias("id")).distinct()
            step = touching(raw, ids, rows, e.direction)
            more = sized(frontier.select(F.col("src").alias("s"), F.col("dst").alias("d"), "path"), rows).join(step, F.col("d") == F.col("src"))
            more = more.groupBy(F.col("s").alias("src"), "dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
            frontier, rows = counted(more.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(n).alias("n"), "path"), "walk")
            parts.append(frontier)
            total += rows
            if not rows:
                break
            seen = seen.unionByName(frontier)
        found = joined(parts, "walked") if parts else seen
        release(start)
        return found.filter((F.col("n") >= e.hops[0]) & (F.col("src") != F.col("dst"))).select("src", "dst", *(["path"] if shortest else [])), total

    def project(self) -> None:
        distinct = self.take("DISTINCT")
        keys, values, names = [], [], []
        while True:
            self.aggregated = False
            at = self.i
            e = self.expression()
            text = "".join(self.t[at : self.i])
            name = self.word() if self.take("AS") else text
            (values if self.aggregated else keys).append((e, name, text))
            names.append(name)
            if not self.take(","):
                break
        plain = {t: n for _, n, t in keys}
        whole = [t for _, n, t in keys if n == t and t in self.bound]  # WITH a: the node goes on with all its columns
        carried = [c for t in whole for c in self.df.columns if c.startswith(f"{t}.")]
        keys = [k for k in keys if k[2] not in whole]
        if values:
            group = [e.alias(n) for e, n, _ in keys] + [F.col(f"`{c}`") for c in carried]
            self.df = self.df.groupBy(*group).agg(*[e.alias(n) for e, n, _ in values])
        else:
            self.df = self.df.select(*[e.alias(n) for e, n, _ in keys], *[F.col(f"`{c}`") for c in carried])
        self.bound = set(whole)
        self.renamed = plain
        if not carried:
            self.df = self.df.select(*[F.col(f"`{n}`") for n in names])
        if distinct:
            self.df = self.df.distinct()

    def order(self) -> None:
        by = []
        while True:
            at = self.i
            self.word()
            while self.i < len(self.t) and self.t[self.i].upper() not in (",", "ASC", "DESC", "LIMIT"):
                self.i += 1
            text = "".join(self.t[at : self.i])
            c = F.col(f"`{self.renamed.get(text, text)}`")
            by.append(c.desc() if self.take("DESC") else c.asc())
            self.take("ASC")
            if not self.take(","):
                break
        self.df = self.df.orderBy(*by)


def query(graph: Graph, text: str, **params) -> DataFrame:
    """The result of a read query as a DataFrame; a query that writes is refused, and so is one with patterns that nothing
    connects (every row of one with every row of the other), unless one of them is bound by its id."""
    if not is_read_only(text):
        raise CypherError("the query writes; use operators.upsert")
    planner = _Planner(graph, text, params)
    found = planner.run()
    if planner.apart and not any(known or re.search(rf"\b{re.escape(name)}\.id\s*(?:=|IN\b)", text) for name, known in planner.apart):
        raise CypherError(f"nothing connects the patterns of {', '.join(n for n, _ in planner.apart)}; bind one by its id")
    return found
