"""Column functions over paths, names and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a test file, an entry file, and names that frameworks call by themselves.
TEST_FILE = r"(?i)(?:^|/)(?:test_[^/]+\.py|[^/]+_test\.py|[^/]+\.test\.[tj]sx?|[^/]+\.spec\.[tj]sx?)$|(?:^|/)(?:tests?|__tests__)/"
ENTRY_FILE = r"(?i)(?:^|/)(?:setup\.py|conftest\.py|cli\.py|__main__\.py|manage\.py|wsgi\.py|asgi\.py)$|(?:^|/)bin/"
PUBLIC_FILE = r"(?i)(?:^|/)(?:api|exceptions?|errors?|models|types|public|client)\.py$"
DUNDER = "^__[a-z][a-z0-9_]*__$"
ENTRY_NAMES = ["main", "cli", "app", "handler", "lambda_handler", "wsgi", "asgi", "application"]
HOOK_NAMES = [
    "setUp", "tearDown", "setUpClass", "tearDownClass", "setup_method", "teardown_method", "setup_class", "teardown_class",
    "setup_function", "teardown_function", "setup_module", "teardown_module", "dispatch", "get_queryset", "form_valid",
    "form_invalid", "clean", "ready", "handle", "lifespan",
]
HOOK_PREFIXES = ["pytest_", "before_", "after_", "on_", "test_"]


def module_key(file: Column) -> Column:
    """The first two folders of a path at most; root for a file at the top."""
    parts = F.filter(F.split(file, "/"), lambda p: p != "")
    n = F.size(parts)
    return F.when(n <= 1, "root").otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.lit(1), F.least(F.lit(2), n - 1))), "/"))


def is_test(file: Column) -> Column:
    return F.coalesce(file, F.lit("")).rlike(TEST_FILE)


def bare_name(name: Column) -> Column:
    """Behind the last :: and then the last dot."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*::", ""), r"^.*\.", "")


def is_method(kind: Column, name: Column) -> Column:
    return (kind != "file") & (name.contains(".") | name.contains("::"))


def is_hook(bare: Column) -> Column:
    """A framework's hook: a known name, or something behind a known prefix."""
    found = bare.isin(HOOK_NAMES)
    for p in HOOK_PREFIXES:
        found = found | (bare.startswith(p) & (F.length(bare) > len(p)))
    return found


def is_entry(file: Column, bare: Column) -> Column:
    return file.rlike(ENTRY_FILE) | bare.isin(ENTRY_NAMES)


def is_public(kind: Column, file: Column, name: Column) -> Column:
    bare = bare_name(name)
    open_name = (kind != "file") & ~bare.rlike(DUNDER) & ~bare.startswith("_")
    return open_name & (file.rlike(r"(?:^|/)__init__\.py$") | file.rlike(PUBLIC_FILE) & ~is_method(kind, name))


def test_seconds(loc: Column) -> Column:
    """Estimated run time: 1.5 without a line count, else a second and a hundredth for each line, from 0.5 to 10."""
    return F.when(F.coalesce(loc, F.lit(0)) == 0, 1.5).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(0.5), 1 + loc * F.lit(0.01))))


def priority(distance: Column) -> Column:
    return F.when(distance <= 2, "high").when(distance <= 4, "medium").otherwise("low")


def risk_level(fan_in: Column, churn: Column) -> Column:
    return F.when((fan_in >= 5) | (churn >= 3), "high").when((fan_in >= 2) | (churn >= 1), "medium").otherwise("low")


def band(share: Column) -> Column:
    """Thirds of the largest score."""
    return F.when(share >= 0.66, "high").when(share >= 0.33, "medium").otherwise("low")


def change_kind(prompt: Column) -> Column:
    """What a described change does, by the first of its key words: rename, delete, signature, else behavior."""
    p = F.lower(prompt)
    has = lambda *words: p.rlike("|".join(words))
    return F.when(has("rename"), "rename").when(has("delete", "remove"), "delete").when(has("signature", "parameter", "argument"), "signature").otherwise("behavior")


def snake(name: Column) -> Column:
    """A name in lower-case words between single underscores."""
    parted = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_")
    return F.regexp_replace(F.lower(parted), "^_+|_+$", "")


def suggested_test(file: Column) -> Column:
    """Where a test of a file would stand: beside a script, under tests for Python and all else."""
    inner = F.regexp_replace(F.regexp_replace(file, "^src/", ""), r"\.py$", "")
    parts = F.split(inner, "/")
    python = F.array_join(F.concat(F.array(F.lit("tests")), F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat(F.lit("test_"), F.element_at(parts, -1), F.lit(".py")))), "/")
    return F.when(file.endswith(".py"), python).when(file.rlike(r"\.[tj]sx?$"), F.regexp_replace(file, r"\.([tj]sx?)$", ".test.$1")).otherwise(F.concat(F.lit("tests/"), file, F.lit(".test")))


def status(value: Column, good: tuple[float, float], warn: tuple[float, float]) -> Column:
    """good, warn or bad by the ranges a value lies in, ends included."""
    return F.when(value.between(*good), "good").when(value.between(*warn), "warn").otherwise("bad")


def health_bands(diameter: Column, avg_path: Column, density: Column, components: Column, health: Column) -> list[Column]:
    """Bands of a graph's figures, and how many of five dots its health fills."""
    dots = F.when(health >= 80, 5).when(health >= 65, 4).when(health >= 50, 3).when(health >= 35, 2).otherwise(1)
    return [
        status(diameter, (-1, 7), (-1, 10)).alias("diameter_band"), status(avg_path, (-1, 4), (-1, 6)).alias("path_band"),
        status(density, (0.08, 0.35), (0.05, 0.50)).alias("density_band"), status(components, (1, 1), (-1, 2)).alias("component_band"), dots.alias("dots"),
    ]


def name_tokens(name: Column) -> Column:
    """Lower-case parts of a name, of two characters or more; it parts at a capital behind a small letter or digit, and at _, - and dots alone."""
    parted = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(parted), r"[_\-.]"), lambda t: F.length(t) >= 2)
