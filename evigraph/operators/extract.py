"""Functions, calls, types and state machines from source texts, file by file in tasks.

Python is read with its own parser.  For the other languages comments and strings are blanked out first (places stay), braces
are matched, and declarations, calls and type members are found in what is left, each inside its innermost block.  That
is no full grammar; confidences say so.
"""

from __future__ import annotations

import ast
import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Tasks get these functions by value, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FUNCTIONS = "canonical_key string, kind string, language string, file string, line long, name string, confidence double, parent string"
CALLS = "language string, file string, line long, callee string, kind string, message_kind string"
CLASSES = "canonical_key string, kind string, language string, file string, line long, name string, bases array<string>, implements array<string>, members array<struct<name string, member_kind string, signature string, line long>>"
STATES = "machine string, file string, language string, state string, line long, confidence double"
TRANSITIONS = "machine string, file string, language string, source string, target string, trigger string, guard string, line long, confidence double"

#: How sure a language's extraction is, for functions and for state machines.
SURE = {"python": 0.9, "rust": 0.85, "typescript": 0.8, "javascript": 0.8, "go": 0.8, "java": 0.8, "kotlin": 0.8}
MACHINE_SURE = {"rust": 0.75, "typescript": 0.7, "python": 0.6}

NAME = r"[A-Za-z_$][\w$]*"
LITERALS = {
    "rust": r'//[^\n]*|/\*.*?\*/|b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?\'(?:\\[^\n]{1,9}?|[^\\\'\n])\'',
    "go": r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
    "java": r'//[^\n]*|/\*.*?\*/|""".*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    "typescript": r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
}
LITERALS |= {"kotlin": LITERALS["java"], "javascript": LITERALS["typescript"]}
#: Words that stand before a bracket without being called.
NO_CALLS = frozenset("if for while switch return catch else do try in as case throw new super".split())
KEYWORDS = {
    "rust": "fn match loop unsafe move async await", "go": "func go defer select", "kotlin": "fun when is constructor", "java": "synchronized instanceof assert",
    "typescript": "function typeof await async yield of with constructor", "javascript": "function typeof await async yield of with constructor",
}
KEYWORDS = {k: NO_CALLS | set(v.split()) for k, v in KEYWORDS.items()}
TYPE_HEADS = {
    "rust": r"\b(struct|enum|trait|union|impl)\b\s*(?:<[^{;]*?>\s*)?([^{;(]*)",
    "typescript": rf"\b(class|interface|enum)\s+({NAME}[^{{;]*)",
    "go": rf"\btype\s+({NAME})\s+(struct|interface)\b",
    "java": rf"\b(class|interface|enum|record)\s+({NAME}[^{{;]*)",
    "kotlin": rf"\b(class|interface|object)\s+({NAME}[^{{;\n]*)",
}
TYPE_HEADS["javascript"] = TYPE_HEADS["typescript"]
FUNCTION_HEADS = {
    "rust": rf"\bfn\s+({NAME})", "go": rf"(?m)^func\s*(\([^)]*\)\s*)?({NAME})\s*[\[(]", "kotlin": rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?({NAME})\s*\(",
    "typescript": rf"\bfunction\s*\*?\s*({NAME})\s*[<(]", "javascript": rf"\bfunction\s*\*?\s*({NAME})\s*[<(]",
}
#: A method without a keyword of its own: a name, arguments and a body, right inside a type.
BODIED = re.compile(rf"({NAME})\s*(?:<[^<>(){{}};]*>\s*)?\(")
CLOSURE = {"rust": re.compile(r"(?<![\w)\]|])\s*(?:move\s+)?\|[^|\n]*\|(?!\|)"), "typescript": re.compile(rf"(?:\([^()]*\)(?:\s*:\s*[\w<>\[\]., |]+)?|\b{NAME})\s*=>")}
CLOSURE["javascript"] = CLOSURE["typescript"]
#: Rows that a task hands on at once.
ROWS = 10_000
CALL = re.compile(rf"(\.|::)?\s*({NAME})\s*(?:::\s*<[^<>()]*>\s*)?\(")


class Source:
    """One text: its blanked form, matching brackets, blocks of types, and lines of places."""

    def __init__(self, language: str, path: str, text: str) -> None:
        self.language, self.path, self.text = language, path, text
        self.code = re.sub(LITERALS[language], lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S) if re.search(r"[/\"'`]", text) else text
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    # What follows is made when it is asked for: a text without types needs no index of its brackets.
    @cached_property
    def matched(self) -> dict[int, int]:
        """Opening brackets with the ones that close them."""
        out: dict[int, int] = {}
        open_at: list[int] = []
        for m in re.finditer(r"[(){}\[\]]", self.code):
            if m[0] in "({[":
                open_at.append(m.start())
            elif open_at:
                out[open_at.pop()] = m.start()
        return out

    @cached_property
    def types(self) -> list[tuple]:
        return list(self._types())

    @cached_property
    def close(self) -> dict[int, int]:
        """Brackets as they match; a type's block that is never closed goes to the end."""
        self.matched.update({t[1]: t[2] for t in self.types if t[2] > t[1] and t[1] not in self.matched})
        return self.matched

    @cached_property
    def opens(self) -> list[int]:
        return sorted(self.close)

    @cached_property
    def around(self) -> dict[int, int | None]:
        """Each bracket with the one around it."""
        out, stack = {}, []
        for o in self.opens:
            while stack and self.close[stack[-1]] < o:
                stack.pop()
            out[o] = stack[-1] if stack else None
            stack.append(o)
        return out

    @cached_property
    def blocks(self) -> dict[int, tuple]:
        return {t[1]: t for t in self.types if t[2] > t[1]}

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def body(self, at: int) -> tuple[int, int] | None:
        """The next block from a place on, if no statement ends before it."""
        m = re.compile(r"[{;]").search(self.code, at)
        return (m.start(), self.matched.get(m.start(), len(self.code))) if m and m[0] == "{" else None

    def _types(self) -> Iterator[tuple[int, int, int, str, str, str]]:
        """(head, body start, body end, kind, name, rest of the head) of type blocks; without a body start = end."""
        for m in re.finditer(TYPE_HEADS[self.language], self.code):
            kind, rest = (m[2], m[1]) if self.language == "go" else (m[1], m[2])
            if kind == "impl":  # of a trait for a type, or of the type alone
                whole = re.sub(r"<.*?>|\bwhere\b.*", "", rest, flags=re.S).split(" for ")
                name = re.search(rf"({NAME})\s*$", whole[-1].strip())
                rest = whole[0].strip() if len(whole) > 1 else ""
            else:
                name = re.match(rf"\s*({NAME})", rest)
            if name:
                where = self.body(m.end()) or (m.end(), m.end())
                yield m.start(), *where, kind, name[1], rest

    def inner(self, at: int) -> int | None:
        """The innermost bracket around a place."""
        k = bisect_left(self.opens, at) - 1
        o = self.opens[k] if k >= 0 else None
        while o is not None and self.close[o] <= at:
            o = self.around[o]
        return o

    def owner(self, at: int) -> tuple | None:
        """The innermost type block around a place."""
        o = self.inner(at) if self.blocks else None
        while o is not None and o not in self.blocks:
            o = self.around[o]
        return self.blocks.get(o)

    def right_inside(self, at: int, block: tuple) -> bool:
        """Whether no bracket opens between the block's own and the place."""
        return self.inner(at) == block[1]

    # functions ---------------------------------------------------------------------------------------------------
    def functions(self) -> list[tuple[int, str, str, str | None]]:
        """(place of the name, kind, name, parent); ``signatures`` are places of methods without a body."""
        out, self.signatures = [], set()
        if self.language in FUNCTION_HEADS:
            for m in re.finditer(FUNCTION_HEADS[self.language], self.code):
                name = m.lastindex
                if self.language == "go":
                    receiver = re.search(rf"({NAME})\s*(?:\[[^\]]*\])?\s*\)", m[1] or "")
                    out.append((m.start(name), "method" if m[1] else "function", m[name], receiver[1] if receiver else None))
                else:
                    o = self.owner(m.start())
                    out.append((m.start(name), "method" if o else "function", m[name], o[4] if o else None))
        if self.language in ("typescript", "javascript", "java"):
            for t in self.types:
                for m in BODIED.finditer(self.code, t[1] + 1, t[2]):
                    end = self.close.get(m.end() - 1)
                    before = self.code[max(0, m.start() - 16) : m.start()]
                    if end is None or m[1] in KEYWORDS[self.language] - {"constructor"} or re.search(r"[.=@]\s*$|\b(?:new|function|return)\s+$", before) or not self.right_inside(m.start(), t):
                        continue
                    follow = re.compile(r"\s*(?::[^{};=]*|throws[^{};]*)?([{;}])").match(self.code, end + 1)
                    if follow and follow[1] == "{":
                        out.append((m.start(1), "method", m[1], t[4]))
                    elif follow:
                        self.signatures.add(m.start(1))
        for m in CLOSURE[self.language].finditer(self.code) if self.language in CLOSURE and ("|" if self.language == "rust" else "=>") in self.code else ():
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            name = f"{'closure' if self.language == 'rust' else 'arrow'}@{self.line(at)}"
            out.append((at, "closure", name, None))
        return sorted(out)

    def calls(self, declared: set[int]) -> Iterator[tuple[int, str, str, str]]:
        """(place, name, kind, message kind); ``declared``: places of names that are declared there."""
        for m in CALL.finditer(self.code):
            at, name, dotted = m.start(2), m[2], m[1] == "."
            before = self.code[max(0, at - 80) : at]
            if name in KEYWORDS[self.language] or at in declared or re.search(r"\b(?:fn|fun|func|function|class|interface|enum|struct|new|def)\s+$", before) or (dotted and self.language in ("typescript", "javascript")):
                continue
            end = self.close.get(m.end() - 1, len(self.code))
            later = re.match(r"\s*\.\s*await\b", self.code[end + 1 : end + 60]) if self.language == "rust" else re.search(r"\bawait\s+[\w$.]*$", before)
            yield at, name, "method" if dotted else "direct", "async_call" if later else "sync_call"

    # types -------------------------------------------------------------------------------------------------------
    def members(self, t: tuple) -> list[tuple[str, str, str, int]]:
        """Fields, variants and methods right inside a type's block: (name, kind, signature, line)."""
        _, start, end, kind, *_ = t
        out, code = [], list(self.code[start + 1 : end])
        k = bisect_right(self.opens, start)
        while k < len(self.opens) and self.opens[k] < end:
            o, k = self.opens[k], k + 1
            if self.code[o] == "{":  # inner blocks don't matter
                c = self.close[o]
                for i in range(o - start, min(c, end) - start - 1):
                    if code[i] != "\n":
                        code[i] = " "
                k = bisect_right(self.opens, c)
        flat, base = "".join(code), start + 1
        if kind == "enum":
            for m in re.finditer(rf"(?:^|,)\s*(?:#\[[^\]]*\]\s*)*({NAME})", flat):
                if self.inner(base + m.start(1)) == start:
                    out.append((m[1], "variant", m[1], self.line(base + m.start(1))))
            return out
        sign = r",|$" if self.language == "rust" else r"[;\n]|$"
        shape = rf"(?m)(?:^|[,;{{}}])[ \t]*((?:(?:pub(?:\([^)]*\))?|private|public|protected|readonly|static)\s+)*({NAME})\??\s*:\s*[^,;{{}}=\n]*?)\s*(?=[,;=}}\n]|$)"
        for m in re.finditer(shape, flat) if self.language in ("rust", "typescript", "javascript") and sign else ():
            o = self.inner(base + m.start(2))
            while o is not None and o > start and self.code[o] != "(":
                o = self.around[o]
            if o is None or o <= start:
                out.append((m[2], "field", m[1].strip(), self.line(base + m.start(2))))
        return out


def _python(path: str, text: str) -> tuple[list, list, list]:
    functions, calls, classes = [], [], []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return functions, calls, classes

    def key(kind: str, name: str, line: int) -> str:
        return f"python:{path}:{name}:{line}" if kind == "function" else f"python:{path}:{kind}:{name}:{line}"

    awaited = {id(n.value) for n in ast.walk(tree) if isinstance(n, ast.Await)}
    stack = [(n, None) for n in tree.body]
    while stack:
        node, owner = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            functions.append((key("function", node.name, node.lineno), "method" if owner else "function", "python", path, node.lineno, node.name, SURE["python"], owner))
        if isinstance(node, ast.ClassDef):
            members = [(n.target.id, "field", f"{n.target.id}: {ast.unparse(n.annotation)}", n.lineno) for n in node.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name)]
            members += [(n.name, "method", n.name, n.lineno) for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
            classes.append((key("class", node.name, node.lineno), "class", "python", path, node.lineno, node.name, [ast.unparse(b) for b in node.bases], [], members))
        if isinstance(node, ast.Call):
            f, message = node.func, "async_call" if id(node) in awaited else "sync_call"
            if isinstance(f, ast.Name):
                calls.append(("python", path, node.lineno, f.id, "direct", message))
            elif isinstance(f, ast.Attribute):  # the method's name, not the receiver's
                calls.append(("python", path, node.lineno, f.attr, "method", message))
        inside = node.name if isinstance(node, ast.ClassDef) else None if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else owner
        stack += [(n, inside) for n in ast.iter_child_nodes(node)]
    return functions, calls, classes


def _named(text: str | None) -> list[str]:
    return [x for x in (re.sub(r"<.*", "", p).strip() for p in (text or "").split(",")) if x]


def _functions(language: str, path: str, text: str) -> Iterator[tuple]:
    s = Source(language, path, text)
    for at, kind, name, parent in s.functions():
        line = s.line(at)
        yield f"{language}:{path}:{name}:{line}", kind, language, path, line, name, SURE[language], parent


def _calls(language: str, path: str, text: str) -> Iterator[tuple]:
    s = Source(language, path, text)
    declared = {at for at, *_ in s.functions()} | s.signatures
    for at, name, kind, message in s.calls(declared):
        yield language, path, s.line(at), name, kind, message


def _classes(language: str, path: str, text: str) -> list[tuple]:
    s = Source(language, path, text)
    found = s.functions()
    classes = []
    if language in ("rust", "typescript", "javascript"):
        methods = [(at, name) for at, kind, name, _ in found if kind == "method"]
        traits: dict[str, list[str]] = {}
        for _, _, _, kind, name, rest in s.types:
            if kind == "impl" and rest:
                traits.setdefault(name, []).append(rest.split("::")[-1])
        of_block: dict[tuple, list[tuple]] = {}
        for at, name in methods:
            of_block.setdefault(s.owner(at), []).append((at, name))
        impls: dict[str, list[tuple]] = {}
        for t in s.types:
            if t[3] == "impl":
                impls.setdefault(t[4], []).append(t)
        for t in s.types:
            head, start, end, kind, name, rest = t
            if kind == "impl":
                continue
            bases = _named((re.search(r"\bextends\s+([^{]*?)(?=\bimplements\b|$)", rest) or [None, None])[1])
            kept = _named((re.search(r"\bimplements\s+([^{]*)", rest) or [None, None])[1]) if language != "rust" else sorted(set(traits.get(name, [])))
            members = s.members(t) if end > start else []
            members += [(m, "method", m, s.line(at)) for at, m in sorted(x for block in (t, *impls.get(name, ())) for x in of_block.get(block, ()))]
            classes.append((f"{language}:{path}:{kind}:{name}:{s.line(head)}", kind, language, path, s.line(head), name, bases, kept, members))
    return classes


def _by_blocks(language: str, path: str, text: str) -> tuple[list, list, list]:
    return tuple(list(of(language, path, text)) for of in (_functions, _calls, _classes))


def _table(files: DataFrame, schema: str, of: Callable[[str, str, str], Iterable[tuple]]) -> DataFrame:
    """Rows that ``of`` (language, path, text) finds in each file; null texts and unknown languages give none.  One text at a
    time is held, and its rows go on by ``ROWS``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow, strict=True)], schema=arrow)  # noqa: B905, E731
        for b in batches:
            for k in range(b.num_rows):
                path, language, text = (b.column(i)[k].as_py() for i in range(3))
                for row in of(language, path, text) if text is not None and language in SURE else ():
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield give()
                        rows.clear()
        if rows:
            yield give()

    return files.select("path", "language", "text").mapInArrow(run, schema)


def extract(files: DataFrame, what: str) -> DataFrame:
    """files (path, language, text) -> rows of ``what``: functions, calls or classes.  Null texts give none."""
    place = {"functions": 0, "calls": 1, "classes": 2}[what]
    blocks = (_functions, _calls, _classes)[place]
    return _table(files, (FUNCTIONS, CALLS, CLASSES)[place], lambda language, path, text: _python(path, text)[place] if language == "python" else blocks(language, path, text))


# state machines ------------------------------------------------------------------------------------------------------
def _machines(language: str, path: str, text: str) -> tuple[list, list]:
    """(states, transitions) of the machines of a text."""
    states, moves = [], []
    sure = MACHINE_SURE.get(language)
    if language == "python":
        return _python_machines(path, text)
    if sure is None:
        return states, moves
    s = Source(language, path, text)
    around = [(at, name, s.body(at)) for at, kind, name, _ in s.functions() if kind != "closure"]

    def trigger(at: int) -> str | None:
        inside = [(b[0], name) for _, name, b in around if b and b[0] < at < b[1]]
        return max(inside)[1] if inside else None

    if language == "rust":
        for t in s.types:
            if t[3] != "enum" or not re.search(r"State|Status", t[4]):
                continue
            names = {m[0]: m[3] for m in s.members(t)}
            states += [(t[4], path, language, n, line, sure) for n, line in names.items()]
            path_of = rf"(?:{t[4]}|Self)\s*::\s*({'|'.join(names) or '(?!)'})\b"
            # an arm: what is matched, a guard, and what it leads to
            held = r"(?:\s*(?:\{[^{}]*\}|\([^()]*\)))?(?:\s*,[^(){};=]*\)|\s*\))?\s*(?:\|[^=;{}]*?)?"
            for m in re.finditer(rf"{path_of}{held}(?:if\b([^{{}};]*?))?=>", s.code):
                after = m.end()
                arm = s.body(after) if re.match(r"\s*\{", s.code[after:]) else None
                stop = arm[1] if arm else min((i for i in (s.code.find(",", after), s.code.find("}", after)) if i >= 0), default=len(s.code))
                to = re.search(path_of, s.code[after:stop])
                if to:
                    moves.append((t[4], path, language, m[1], to[1], trigger(m.start()), s.text[m.start(2) : m.end(2)].strip() if m[2] else None, s.line(m.start()), sure))
    else:
        for m in re.finditer(r"\btype\s+(\w*(?:State|Status)\w*)\s*=\s*((?:\s*\|?\s*['\"]\w+['\"])+)", text):
            names = {x[1]: s.line(m.start(2) + x.start(1)) for x in re.finditer(r"['\"](\w+)['\"]", m[2])}
            states += [(m[1], path, language, n, line, sure) for n, line in names.items()]
            cases = list(re.finditer(r"\bcase\s+['\"](\w+)['\"]\s*:", text))
            for c, following in zip(cases, [*cases[1:], None], strict=True):
                stop = min(following.start() if following else len(text), next((e for o, e in sorted(s.close.items(), reverse=True) if o < c.start() < e and s.code[o] == "{"), len(text)))
                for to in re.finditer(r"(?:\breturn|=)\s*['\"](\w+)['\"]", text[c.end() : stop]):
                    if c[1] in names and to[1] in names:
                        guard = re.search(r"\bif\s*\(([^()]*)\)\s*\{?\s*(?:this\.\w+\s*)?$", text[c.end() : c.end() + to.start()])
                        moves.append((m[1], path, language, c[1], to[1], trigger(c.start()), guard[1].strip() if guard else None, s.line(c.end() + to.start()), sure))
    return states, moves


def _python_machines(path: str, text: str) -> tuple[list, list]:
    """Classes with @transition(a, b) methods, or to_x methods (from any other state); without a transition no machine."""
    states, moves, sure = [], [], MACHINE_SURE["python"]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return states, moves
    for c in [n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]:
        seen: dict[str, int] = {}
        found = []
        for f in [n for n in c.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]:
            for d in f.decorator_list:
                if isinstance(d, ast.Call) and getattr(d.func, "id", getattr(d.func, "attr", None)) == "transition" and len(d.args) >= 2:
                    a, b = (x.value if isinstance(x, ast.Constant) else ast.unparse(x).split(".")[-1] for x in d.args[:2])
                    found.append((str(a), str(b), f.name, d.lineno))
            if f.name.startswith("to_") and len(f.name) > 3:
                found.append((None, f.name[3:], f.name, f.lineno))
        for a, b, _, line in found:
            for n in (a, b):
                if n is not None:
                    seen.setdefault(n, line)
        states += [(c.name, path, "python", n, line, sure) for n, line in seen.items()]
        moves += [(c.name, path, "python", x, b, name, None, line, sure) for a, b, name, line in found for x in ([a] if a is not None else [n for n in seen if n != b])]
    return states, moves


def state_machines(files: DataFrame) -> DataFrame:
    """(machine, file, language, state, line, confidence): variants of enums named …State or …Status, union types of that
    name, classes with transitions."""
    return _table(files, STATES, lambda language, path, text: _machines(language, path, text)[0]).distinct()


def state_transitions(files: DataFrame) -> DataFrame:
    """(machine, file, language, source, target, trigger, guard, line, confidence): arms of a match, cases of a switch and
    marked methods that lead from one state to another; the trigger is the function around them."""
    return _table(files, TRANSITIONS, lambda language, path, text: _machines(language, path, text)[1]).distinct()


def pattern_evidence(files: DataFrame, patterns: dict[str, str], languages: tuple[str, ...] = ()) -> DataFrame:
    """Evidence (kind, claim, path, start_line, end_line, rule_id, content) of every match of a rule's pattern in the code of
    the files, comments and strings left out."""
    rules = {k: re.compile(v, re.M) for k, v in patterns.items()}

    def of(language: str, path: str, text: str) -> Iterator[tuple]:
        if languages and language not in languages:
            return
        code = text if language == "python" else Source(language, path, text).code
        for rule, pattern in rules.items():
            for m in pattern.finditer(code):
                first, last = text.count("\n", 0, m.start()) + 1, text.count("\n", 0, max(m.start(), m.end() - 1)) + 1
                yield "pattern", f"{rule} at {path}:{first}", path, first, last, rule, text[m.start() : m.end()]

    return _table(files, "kind string, claim string, path string, start_line long, end_line long, rule_id string, content string", lambda *a: list(of(*a)))
