"""Scalar functions over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name endings that say nothing about what is named, in the order in which they are taken off.
SUFFIXES = ("Service", "Manager", "Impl", "Plugin", "Controller", "Handler", "Adapter", "Factory", "Repository", "Gateway")

# Types that are no classes.
PRIMITIVES = (
    "bool char str String i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 "
    "Vec Option Result Box Rc Arc HashMap HashSet BTreeMap BTreeSet Cell RefCell "
    "number string boolean any unknown void null undefined int float bytes object"
).split()

# Language by file name and by extension.
LANGUAGE_OF_NAME = {"dockerfile": "dockerfile", "makefile": "makefile", "cmakelists.txt": "cmake"}
LANGUAGE_OF_EXTENSION = {
    extension: language
    for language, extensions in {
        "rust": "rs", "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "python": "py pyi", "go": "go", "java": "java", "kotlin": "kt kts", "ruby": "rb", "csharp": "cs", "c": "c h",
        "cpp": "cpp cxx cc hpp hxx hh", "objective-c": "m mm", "swift": "swift", "scala": "scala sc", "clojure": "clj cljs cljc", "elixir": "ex exs", "erlang": "erl hrl", "haskell": "hs",
        "ocaml": "ml mli", "fsharp": "fs fsx", "lua": "lua", "perl": "pl pm", "php": "php", "shell": "sh bash", "sql": "sql", "yaml": "yaml yml", "json": "json", "toml": "toml", "xml": "xml",
        "html": "html htm", "css": "css", "scss": "scss", "sass": "sass", "markdown": "md markdown", "vue": "vue", "svelte": "svelte", "dart": "dart", "zig": "zig", "nim": "nim",
        "crystal": "cr", "r": "r", "julia": "jl", "protobuf": "proto", "graphql": "graphql gql",
    }.items()
    for extension in extensions.split()
}


def lookup(key: Column, table: dict[str, str]) -> Column:
    """A fixed small table as a map literal; null where the key is unknown."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def detect_language(path: Column) -> Column:
    """By file name first, then by extension; null if unknown."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    extension = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    return F.coalesce(lookup(name, LANGUAGE_OF_NAME), lookup(extension, LANGUAGE_OF_EXTENSION))


def last_segment(kind_id: Column) -> Column:
    """`c4.container` -> `container`."""
    return F.element_at(F.split(kind_id, r"\."), -1)


def valid_status(status: Column) -> Column:
    """Statuses as the exported schema knows them."""
    return F.when(status == "active", "drafted").when(status == "deprecated", "superseded").otherwise(status)


def status_or_accepted(props: Column) -> Column:
    """Of evidence: a status that is absent or unknown counts as accepted (listing)."""
    s = F.get_json_object(props, "$.status")
    return F.when(s.isin("drafted", "accepted", "superseded"), s).otherwise("accepted")


def is_exportable(props: Column) -> Column:
    """Of evidence: only a status that says accepted counts (export)."""
    return F.coalesce(F.get_json_object(props, "$.status") == "accepted", F.lit(False))


def default_status(origin: Column) -> Column:
    """The status that evidence begins with, by origin."""
    return F.when(origin == "user_workspace", "accepted").when(origin.isin("user_input", "tool_output"), "drafted")


def identifier_ok(value: Column) -> Column:
    """1 to 256 of letters, digits and . _ : / -; null is not."""
    return F.coalesce(value.rlike(r"\A[A-Za-z0-9._:/-]{1,256}\z"), F.lit(False))


def normal_remote(url: Column) -> Column:
    """A git remote without scheme, user and ending; the first colon becomes a slash."""
    s = F.regexp_replace(url, r"^(?:https://|http://|ssh://|git@)", "")
    s = F.regexp_replace(s, r"^[^@]*@", "")
    s = F.regexp_replace(s, r"^([^:]*):", "$1/")
    return F.regexp_replace(F.regexp_replace(s, r"(?:\.git)+$", ""), r"/+$", "")


def glob_match(pattern: Column, text: Column) -> Column:
    """`*`: all; `*.x`: what ends with x (the dot does not count); else equality."""
    rest = F.substring(pattern, F.lit(3), F.length(pattern))
    return F.when(pattern == "*", True).when(pattern.startswith("*."), text.endswith(rest)).otherwise(pattern == text)


def strip_suffixes(name: Column) -> Column:
    """Takes each ending off once, one after another."""
    return reduce(lambda c, s: F.regexp_replace(c, f"{s}$", ""), SUFFIXES, name)


def name_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of the stripped names, in characters; 0 if one is empty."""
    x, y = strip_suffixes(a), strip_suffixes(b)
    ratio = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(x == y, 1.0).otherwise(F.greatest(F.lit(0.0), ratio))


def field_type(signature: Column) -> Column:
    """`pub value: Foo<T>` -> `Foo`; null for references, arrays and primitives."""
    kind = F.regexp_extract(F.trim(signature), r"(?s)^.*:\s*([A-Za-z_][A-Za-z0-9_]*)", 1)
    return F.when((kind != "") & ~kind.isin(*PRIMITIVES), kind)


def package_of(path: Column) -> Column:
    """The folder of a file without trailing `src` folders; without a slash the path itself; null: (unknown)."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(path.isNull(), "(unknown)").when(~path.contains("/"), path).otherwise(F.regexp_replace(folder, r"(?:/src)+$", ""))


def view_level(kind: Column) -> Column:
    """Depth of a diagram kind: context, dynamic and deployment 1, container 2, component 3, others 0."""
    return F.when(kind.isin("context", "dynamic", "deployment"), 1).when(kind == "container", 2).when(kind == "component", 3).otherwise(0)


def dsl_escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def shortened(text: Column, characters: int = 200) -> Column:
    return F.when(F.length(text) > characters, F.concat(F.substring(text, 1, characters), F.lit("…"))).otherwise(text)


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a character offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def first_line(text: Column, begin: str) -> Column:
    """1-based number of the first line that begins, after blanks, with a pattern; null if none does."""
    at = F.regexp_instr(text, F.lit(rf"(?m)^[ \t]*(?:{begin})"))
    return F.when(at > 0, line_at(text, at - 1))


#: Where a package.json gives its name, and a Dockerfile its title.
NAME_LINE, TITLE_LINE = '"name"', r"(?i)LABEL\s[^\n]*title\s*="


def whole_word(text: Column, word: str) -> Column:
    """Whether ``word`` occurs with no letter, digit or underscore beside it."""
    import re

    return text.rlike(rf"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])")


def member_role(kind: Column) -> Column:
    """fields or methods, for a class compartment."""
    return F.when(kind.isin("field", "property", "attribute", "variant"), "fields").otherwise("methods")


def stereotype(kind_id: Column) -> Column:
    last = last_segment(kind_id)
    return F.when(last.isin("interface", "trait", "enum", "record"), F.concat(F.lit("<<"), last, F.lit(">>")))


def project_id(identity: Column) -> Column:
    """A version-4 shaped UUID from the SHA-256 of a project's identity."""
    h = F.sha2(identity, 256)
    variant = F.substring(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)), 1, 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), F.lower(variant), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
