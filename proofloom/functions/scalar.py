"""Scalar functions: paths, identifiers, text, risk. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path categories in order of precedence (components, basenames, suffixes).
PATH_CLASSES = [
    ("vendor", ["third_party", "vendor", "vendored"], [], []),
    ("generated", ["generated", "target"], [], [".generated.rs"]),
    ("test", ["benches", "tests", "benchmarks"], ["test.rs", "tests.rs"], ["_test.rs", "_tests.rs"]),
    ("example", ["example", "examples"], [], []),
    ("docs", ["doc", "docs"], [], []),
]


def path_class(path: Column) -> Column:
    """First category that matches a component, the basename or its suffix; production for other .rs files."""
    parts = F.split(path, "/")
    base = F.element_at(parts, -1)
    out = None
    for name, components, names, suffixes in PATH_CLASSES:
        hit = F.arrays_overlap(parts, F.array(*[F.lit(c) for c in components]))
        for b in names:
            hit = hit | (base == b)
        for s in suffixes:
            hit = hit | base.endswith(s)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(base.endswith(".rs"), "production").otherwise("other")


def production_path(path: Column) -> Column:
    return path.rlike(r"^(crates|rust)/[^/]+/src/.*\.rs$")


def test_path(path: Column) -> Column:
    """In a test directory, or a file that is called or ends like a test."""
    return path.rlike(r"(^|/)(tests|benches|benchmarks)/|(^|/)tests?\.rs$|_tests?\.rs$")


def label_suffix(label: Column, suffix: Column) -> Column:
    """The last components of a label, parted by '::', are those of suffix."""
    return (label == suffix) | label.endswith(F.concat(F.lit("::"), suffix))


def attribute(attributes: Column, name: str) -> Column:
    """The value of an attribute of a string map; null if it is not there."""
    return F.get(F.array(attributes), 0)[name]


def token_shape(text: Column) -> Column:
    """Source text with strings, numbers and identifiers that are no keyword erased; white space runs are one blank. An approximation without a tokenizer."""
    t = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "S")
    t = F.regexp_replace(t, r"\b[0-9][0-9A-Za-z_.]*\b", "N")
    keywords = "as|async|await|break|const|continue|else|enum|fn|for|if|impl|in|let|loop|match|mod|mut|pub|return|self|struct|trait|use|where|while|S|N"
    return normal_space(F.regexp_replace(t, rf"\b(?!(?:{keywords})\b)[A-Za-z_][A-Za-z0-9_]*\b", "I"))


def language(path: Column) -> Column:
    return F.when(path.endswith(".rs"), "rust").when(path.endswith(".kt"), "kotlin").when(path.endswith(".ts") | path.endswith(".tsx"), "typescript").otherwise("other")


def safe_path(path: Column) -> Column:
    """Relative, without empty, '.' or '..' components, backslashes or NUL."""
    bad = F.exists(F.split(path, "/"), lambda c: c.isin("", ".", ".."))
    return (~bad) & ~path.contains("\\") & ~path.contains("\0")


def valid_stable_id(x: Column) -> Column:
    return x.rlike(r"^[a-z][a-z0-9._-]*:[!-~]+$")


def identifier_words(name: Column) -> Column:
    """Distinct sorted lower-case words of a snake or camel case name; acronyms end before their last capital."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda w: w != "")))


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def risk(weight: Column) -> Column:
    return F.when(weight <= 0.25, "info").when(weight <= 0.5, "low").when(weight <= 1, "medium").when(weight <= 2, "high").otherwise("critical")


def risk_rank(weight: Column) -> Column:
    return F.when(weight <= 0.25, 0).when(weight <= 0.5, 1).when(weight <= 1, 2).when(weight <= 2, 3).otherwise(4)


def nesting_depth(text: Column) -> Column:
    """Deepest nesting of brackets."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(a: Column, c: Column) -> Column:
        d = a["d"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        return F.struct(d.alias("d"), F.greatest(a["m"], d).alias("m"))

    return F.aggregate(F.split(text, ""), start, step)["m"]


def touches(ranges: Column, deletions: Column, start: Column, end: Column) -> Column:
    """A changed range meets start..end, or a deletion point n has start <= n < end."""
    return F.exists(ranges, lambda r: (r["start"] <= end) & (start <= r["end"])) | F.exists(deletions, lambda n: (start <= n) & (n < end))
