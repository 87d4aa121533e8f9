"""From what files declare and use to a graph: import resolution and the call cascade, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..plans.lineage import cut
from ..sources.extract import extract
from . import resolve
from .ingest import ending

SEQ_STEP = 1 << 32  # places of a file's rows behind its own seq
JS_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def line_count(content: Column) -> Column:
    """Lines of a text, the last one counted even if it is empty."""
    return F.size(F.split(content, "\n", -1))


def declared(found: DataFrame, files: DataFrame) -> DataFrame:
    """(id, type, file, name, seq): functions and classes, the first of each id; seq orders by file and place."""
    named = found.where("kind in ('function', 'class')").join(files.select("path", F.col("seq").alias("file_seq")), "path")
    seq = F.col("file_seq") * F.lit(SEQ_STEP) + F.col("at") + 1
    rows = named.select(F.concat_ws("::", "path", "name").alias("id"), F.col("kind").alias("type"), F.col("path").alias("file"), "name", seq.alias("seq"))
    first = F.min(F.struct("seq", "type", "file", "name")).alias("f")
    return rows.groupBy("id").agg(first).select("id", "f.type", "f.file", "f.name", "f.seq")


def bare(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def name_index(symbols: DataFrame) -> DataFrame:
    """(name, id) of functions by qualified and by bare name over all files.

    The last function with a qualified name counts, and goes before any with this bare
    name, of which the first counts. Classes aren't in it.
    """
    functions = symbols.where("type = 'function'")
    keys = F.array_distinct(F.array(F.struct(F.col("name").alias("key"), F.lit(True).alias("whole")), F.struct(bare(F.col("name")).alias("key"), (bare(F.col("name")) == F.col("name")).alias("whole"))))
    keyed = functions.select("id", "seq", F.explode(keys).alias("k")).select("id", "seq", "k.*")
    last = F.max_by(F.when(F.col("whole"), F.col("id")), F.when(F.col("whole"), F.struct("seq", "id")))
    first = F.min_by(F.when(~F.col("whole"), F.col("id")), F.when(~F.col("whole"), F.struct("seq", "id")))
    return keyed.groupBy("key").agg(F.coalesce(last, first).alias("id")).select(F.col("key").alias("name"), "id")


def file_names(symbols: DataFrame) -> DataFrame:
    """(file, name, id): what a file's names stand for: qualified and bare names of its functions, and its classes; the last counts."""
    keys = F.array_distinct(F.when(F.col("type") == "class", F.array("name")).otherwise(F.array("name", bare(F.col("name")))))
    rank = F.when(F.col("type") == "class", 1).otherwise(0)
    keyed = symbols.select("file", "id", "seq", rank.alias("rank"), F.explode(keys).alias("name"))
    return keyed.groupBy("file", "name").agg(F.max_by("id", F.struct("rank", "seq", "id")).alias("id"))


def by_base_name(files: DataFrame, end: str) -> DataFrame:
    """(name, target): the first file of each base name among those with an ending."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.where(ending(F.col("path")) == end).groupBy(base.alias("name")).agg(F.min_by("path", F.struct("seq", "path")).alias("target"))


def import_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target, type): imports and includes between files, each language by its own rule, distinct, none of itself."""
    imports = found.where("kind = 'import'").select(F.col("path").alias("source"), F.col("name").alias("path"), ending(F.col("path")).alias("end"))
    of = lambda *ends: imports.where(F.col("end").isin(*ends)).select("source", "path")
    parts = [
        resolve.resolve_modules(of(".py", ".ipynb"), files),
        resolve.resolve_scripts(of(*JS_ENDINGS), files),
        resolve.resolve_classes(of(".java"), by_base_name(files, ".java")),
        resolve.resolve_classes(of(".cs"), by_base_name(files, ".cs")),
        resolve.resolve_packages(of(".go"), resolve.package_folders(files)),
        resolve.resolve_crates(of(".rs"), by_base_name(files, ".rs")),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    edges = edges.withColumn("type", F.lit("imports"))
    included = resolve.resolve_includes(of(".c", ".cpp", ".cc"), files).withColumn("type", F.lit("include"))
    return edges.unionByName(included).where("source <> target").distinct()


def call_edges(found: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, target, type): calls to the name index; in scripts by import, own file, then the index for names not imported."""
    calls = found.where("kind = 'call'").select(
        F.concat_ws("::", "path", "other").alias("source"), F.col("path").alias("file"), F.col("name").alias("callee"), ending(F.col("path")).isin(*JS_ENDINGS).alias("script")
    ).distinct()
    index = name_index(symbols).select(F.col("name").alias("callee"), F.col("id").alias("anywhere"))
    plain = calls.where("not script").join(index, "callee").select("source", F.col("anywhere").alias("target"))
    bound = found.where("kind = 'binding'").select(F.col("path").alias("source"), F.col("other").alias("path"), F.col("name").alias("callee"), "at")
    modules = resolve.resolve_scripts(bound.select("source", "path").distinct(), files, keep_path=True)
    bindings = bound.join(modules, ["source", "path"]).groupBy(F.col("source").alias("file"), "callee").agg(F.max_by("target", "at").alias("module"))
    own = file_names(symbols)
    there = own.select(F.col("file").alias("module"), F.col("name").alias("callee"), F.col("id").alias("imported"))
    here = own.select("file", F.col("name").alias("callee"), F.col("id").alias("local"))
    scripts = (
        calls.where("script").join(bindings, ["file", "callee"], "left").join(there, ["module", "callee"], "left")
        .join(here, ["file", "callee"], "left").join(index, "callee", "left")
        .select("source", F.coalesce("imported", "module", "local", "anywhere").alias("target"))
    )
    return plain.unionByName(scripts).where("target is not null and source <> target").distinct().withColumn("type", F.lit("calls"))


def build_graph(files: DataFrame) -> CodeGraph:
    """The graph of source files (path, content, seq): files with their lines, functions and classes, imports and calls.

    seq orders the files. Paths are distinct; a file without content is a node alone.
    """
    found = cut(extract(files))
    symbols = cut(declared(found, files))
    nodes = files.select(F.col("path").alias("id"), F.lit("file").alias("type"), F.col("path").alias("file"), F.col("path").alias("name"), line_count(F.col("content")).alias("loc"), (F.col("seq") * F.lit(SEQ_STEP)).alias("seq"))
    every = nodes.unionByName(symbols.withColumn("loc", F.lit(None).cast("int")))
    return CodeGraph(every, import_edges(found, files).unionByName(call_edges(found, files, symbols)))
