"""Text, path, patch and identifier functions on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path patterns that exclude a file.
EXCLUDE_PATTERNS = ["*/tests/*", "*/test/*", "*_test.py", "*_tests.py", "test_*.py", "*/docs/*", "*/doc/*", "*/build/*", "*/dist/*", "*/.git/*", "*/migrations/*", "*/__pycache__/*"]
#: Fixed value: largest file, in bytes, inclusive.
MAX_FILE_BYTES = 1_000_000
#: Names that are no identifiers of interest.
NOT_IDENTIFIERS = ["True", "False", "None", "self", "cls", "args", "kwargs", "lambda", "return", "yield", "import", "from", "def", "class"]
#: Identifier shapes, in order of application: dotted, camel case, upper case, snake case.
SHAPES = [
    r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\b",
    r"\b[A-Z][a-zA-Z0-9]+(?:[A-Z][a-zA-Z0-9]+)+\b",
    r"\b[A-Z][A-Z0-9_]*[A-Z0-9]\b",
    r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b",
]
#: Back-quoted text, names after def and class, what is an identifier as a whole.
QUOTED, DEFINED, WHOLE = r"`([^`\n]{1,80})`", r"\b(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)", r"^[A-Za-z_][A-Za-z0-9_.]*$"
#: Fixed value: what the router takes for an identifier.
ROUTER_SHAPE = r"\b[a-zA-Z_][a-zA-Z0-9_]*[._][a-zA-Z_][a-zA-Z0-9_]*\b|\b[a-z]+[A-Z]\w*\b|\b[a-z]+_[a-z_]+\b"


def glob_regex(pattern: str) -> str:
    """The anchored regex of a shell pattern: * crosses separators; one without a leading * also matches below any folder."""
    escaped = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in ".\\+^$()[]{}|" else c for c in pattern)
    return f"(?s)^(?:{'' if pattern.startswith('*') else '.*'}{escaped})$"


def excluded(path: Column, patterns: list[str] | None = None) -> Column:
    """Does a path, relative to its repository, match an exclusion pattern?"""
    every = "|".join(glob_regex(p)[4:] for p in (EXCLUDE_PATTERNS if patterns is None else patterns))
    return F.concat(F.lit("/"), F.regexp_replace(path, "^/+", "")).rlike(f"(?s){every}")


def file_class(path: Column, size: Column) -> Column:
    """kept, empty, too_big or pattern; the first that holds of empty, too big, pattern."""
    return F.when(size <= 0, "empty").when(size > MAX_FILE_BYTES, "too_big").when(excluded(path), "pattern").otherwise("kept")


def repo_folder(slug: Column) -> Column:
    return F.replace(slug, F.lit("/"), F.lit("__"))


def decoded(content: Column) -> Column:
    """Bytes as text: bad UTF-8 becomes U+FFFD, line ends become newlines."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def with_header(path: Column, text: Column) -> Column:
    return F.concat(F.lit("# File: "), path, F.lit("\n\n"), text)


def truncated(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def gold_files(patch: Column) -> Column:
    """Paths that a patch writes, first seen first; for one that only deletes, the paths of its diff lines."""
    first = lambda p: F.array_distinct(F.transform(F.regexp_extract_all(patch, F.lit(p), F.lit(1)), lambda x: F.trim(x)))
    written = first(r"(?m)^\+\+\+ b/(.+)$")
    return F.when(F.size(written) > 0, written).otherwise(first(r"(?m)^diff --git a/.+ b/(.+)$"))


def extract_identifiers(text: Column) -> Column:
    """Distinct identifiers: by shape in order, then from back-quoted text, then after def and class."""
    found = [F.regexp_extract_all(text, F.lit(s), F.lit(0)) for s in SHAPES]
    quoted = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), lambda x: F.split(x, r"[\s()\[\],:=]+")))
    every = F.array_distinct(F.concat(*found, quoted, F.regexp_extract_all(text, F.lit(DEFINED), F.lit(1))))
    return F.array_except(F.filter(every, lambda x: x.rlike(WHOLE)), F.array(*(F.lit(w) for w in NOT_IDENTIFIERS)))


def generated_identifiers(text: Column, max_n: int = 15) -> Column:
    """Identifiers of a generated list, one a line: marks, digits and quotes go from both ends, the first word counts."""

    def stripped(x: Column, chars: str) -> Column:
        return F.trim(x, F.lit(chars))

    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: stripped(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), "-*•0123456789. \t`'\""))
    words = F.transform(F.filter(lines, lambda x: x != ""), lambda x: stripped(F.get(F.split(x, r"(?U)\s+"), F.lit(0)), "`'\".,()[]:"))
    return F.slice(F.array_distinct(F.filter(words, lambda x: x.rlike(WHOLE))), 1, max_n)


def routed_level(text: Column, n_tokens: Column) -> Column:
    """Granularity for a query: short with an identifier g3, long without g0, else g2."""
    has = text.rlike(ROUTER_SHAPE)
    return F.when((n_tokens < 30) & has, "g3").when((n_tokens > 100) & ~has, "g0").otherwise("g2")


def module_tail(module: Column) -> Column:
    return F.substring_index(module, ".", -1)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def is_constant_name(name: Column) -> Column:
    return name.rlike("^[A-Z][A-Z0-9_]*$")


def gold_rank(ranked: Column, gold: Column) -> Column:
    """1-based rank of gold as text, >20 if absent."""
    return F.coalesce(F.nullif(F.array_position(ranked, gold), F.lit(0)).cast("string"), F.lit(">20"))


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    """Bytes start to end of binary content, decoded."""
    return decoded(F.substr(content, start + 1, end - start))


def embedding_cost(n_tokens: Column, chunk: int = 1500, overhead: int = 30, dollars_per_million: float = 0.18) -> tuple[Column, Column, Column]:
    """Chunks, billed tokens and dollars of embedding a text."""
    chunks = F.greatest(F.lit(1), F.ceil(n_tokens / chunk)).cast("long")
    billed = n_tokens + overhead * chunks
    return chunks, billed, billed * dollars_per_million / 1e6
