"""A graph of source files that follows their changes: only what a change can touch is resolved again.

Each file is stored as what it declares and uses, with the keys it asks for: names it
calls, files and folders its imports may mean. An inverted index leads from a key to the
files that ask for it. A batch of changed files is extracted; the keys whose answer
differs from before lead to the files that depend on them, whose stored rows are
resolved again together with the changed files'. Contents of other files aren't read,
and a batch becomes one version of all tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import CodeGraph
from ..operators import build, resolve
from ..operators.ingest import ending
from ..plans.lineage import cut
from ..sources.extract import extract
from ..sources.versioned import PART, Change, VersionedTables

SCHEMAS = {
    "files": "path string, seq long, loc int",
    "found": "path string, at int, kind string, name string, other string",
    "symbols": "id string, type string, file string, name string, seq long",
    "keys": "key string, file string",
    "edges": "source string, target string, type string, file string",
    "batches": "note string, changed long, extracted long, changed_keys long, dependents long, resolved long",
}
BY_BASE_NAME = (".java", ".cs", ".rs")


def asked_keys(found: DataFrame) -> DataFrame:
    """(key, file): what the rows of files ask for: n: a name, p: a path, b: a base name, g: a Go folder, c: the end of a file's name."""
    end, name = ending(F.col("path")), F.col("name")
    keyed = lambda sign, values: F.transform(values, lambda v: F.concat(F.lit(sign), v))
    parts = F.split(name, "/")
    spec = F.coalesce("other", name)  # a binding's module
    scripts = F.flatten(F.transform(resolve.script_bases(F.col("path"), spec), resolve.import_candidates))
    wanted = (
        F.when(F.col("kind") == "call", F.array(F.concat(F.lit("n:"), name)))
        .when(F.col("kind").isin("import", "binding") & end.isin(*build.JS_ENDINGS), keyed("p:", scripts))
        .when(F.col("kind") != "import", F.array())
        .when(end.isin(".py", ".ipynb"), F.array(F.concat(F.lit("p:"), F.replace(name, F.lit("."), F.lit("/")), F.lit(".py"))))
        .when(end.isin(".java", ".cs"), keyed("b:", F.transform(F.split(name, r"\."), lambda v: F.concat(end, F.lit(":"), v))))
        .when(end == ".rs", keyed("b:", F.transform(F.split(name, "::"), lambda v: F.concat(end, F.lit(":"), v))))
        .when(end == ".go", keyed("g:", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))))
        .when(end.isin(".c", ".cpp", ".cc"), F.array(F.concat(F.lit("c:"), F.element_at(parts, -1))))
        .otherwise(F.array())
    )
    return found.select(F.explode(wanted).alias("key"), F.col("path").alias("file")).distinct()


def offered_keys(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, value): what files and their symbols answer; equal rows answer alike."""
    path, end = F.col("path"), ending(F.col("path"))
    name = F.element_at(F.split("path", "/"), -1)
    place = F.concat_ws("|", "path", "seq")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    row = lambda sign, key, value: F.struct(F.concat(F.lit(sign), key).alias("key"), value.alias("value"))
    endings = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: row("c:", F.substring(name, i, F.length(name)), place))
    more = (
        F.when(end.isin(*BY_BASE_NAME), F.array(row("b:", F.concat(end, F.lit(":"), F.regexp_replace(name, r"\.[^.]*$", "")), place)))
        .when((end == ".go") & (folder != ""), F.array(row("g:", folder, place), row("g:", F.element_at(F.split(folder, "/"), -1), place)))
        .otherwise(F.array())
    )
    own = symbols.groupBy(F.col("file").alias("path")).agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("id", "type", "name", "seq")))).cast("string").alias("names"))
    # A script's names decide what a call of an imported name means; of other files only that they are there.
    shown = files.join(own, "path", "left").select("path", "seq", F.when(end.isin(*build.JS_ENDINGS), F.coalesce("names", F.lit(""))).otherwise(F.lit("")).alias("names"))
    by_file = shown.select(F.explode(F.concat(F.array(row("p:", path, F.col("names"))), endings, more)).alias("k")).select("k.*")
    names = F.array_distinct(F.array("name", build.bare(F.col("name"))))
    by_name = symbols.where("type = 'function'").select(F.explode(F.transform(names, lambda n: F.concat(F.lit("n:"), n))).alias("key"), F.concat_ws("|", "id", "name", "seq").alias("value"))
    return by_file.unionByName(by_name)


class IncrementalGraph:
    """The tables of a graph under a root folder that all executors share, cut into so many parts by path or key."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 16):
        self.spark, self.tables, self.parts = spark, VersionedTables(spark, root), parts

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("string")

    def _parts_of(self, rows: DataFrame, key: str) -> list[str]:
        """The parts that some keys lie in: no more than there are parts."""
        return [r[0] for r in rows.select(self._part(F.col(key))).distinct().collect()]

    def read(self, name: str, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        if name not in self.tables.manifest(version)["tables"]:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.tables.read(name, version, parts).drop(PART)

    def graph(self, version: int | None = None) -> CodeGraph:
        """The graph as of a version (the last one), with the rows that build_graph gives for all files."""
        files, symbols = self.read("files", version), self.read("symbols", version)
        path = F.col("path")
        nodes = files.select(path.alias("id"), F.lit("file").alias("type"), path.alias("file"), path.alias("name"), "loc", (F.col("seq") * F.lit(build.SEQ_STEP)).alias("seq"))
        return CodeGraph(nodes.unionByName(symbols.withColumn("loc", F.lit(None).cast("int"))), self.read("edges", version).drop("file"))

    def apply(self, changes: DataFrame, note: str = "") -> int:
        """Takes in changed files (path, content, seq) as a new version; a null content deletes its file.

        seq orders files, as in build_graph. Of several rows of a path the one with the
        greatest seq counts, then the greatest content. How many files were changed,
        extracted and found dependent is a row of the table batches.
        """
        base = self.tables.version()
        changed = cut(changes.groupBy("path").agg(F.max(F.struct("seq", "content")).alias("c")).select("path", "c.content", F.col("c.seq").cast("long").alias("seq")))
        present = changed.where("content is not null")
        extracted = cut(extract(present))
        files = present.select("path", "seq", build.line_count(F.col("content")).cast("int").alias("loc"))
        symbols = cut(build.declared(extracted, files))
        paths, own_parts = changed.select("path"), self._parts_of(changed, "path")
        old = lambda name, key: self.read(name, base, own_parts).join(paths.withColumnRenamed("path", key), key, "left_semi")
        old_found = cut(old("found", "path"))

        side = lambda rows, is_new: rows.withColumn("new", F.lit(is_new))
        both = side(offered_keys(old("files", "path"), old("symbols", "file")), 0).unionByName(side(offered_keys(files, symbols), 1))
        differing = cut(both.groupBy("key", "value").agg(F.count_distinct("new").alias("sides")).where("sides = 1").select("key").distinct())
        n_differing = differing.count()
        asking = self.read("keys", base, self._parts_of(differing, "key")).join(differing, "key", "left_semi").select(F.col("file").alias("path")).distinct()
        dependents = cut(asking.join(paths, "path", "left_anti"))
        found = cut(extracted.unionByName(self.read("found", base, self._parts_of(dependents, "path")).join(dependents, "path", "left_semi")))

        every_file = self.read("files", base).join(paths, "path", "left_anti").unionByName(files)
        every_symbol = self.read("symbols", base).join(paths.withColumnRenamed("path", "file"), "file", "left_anti").unionByName(symbols)
        callees = cut(found.where("kind = 'call'").select(F.col("name").alias("callee")).distinct())
        named = every_symbol.withColumn("callee", F.explode(F.array_distinct(F.array("name", build.bare(F.col("name"))))))
        asked_symbols = cut(named.join(callees, "callee", "left_semi").drop("callee").distinct())
        resolved = build.import_edges(found, every_file).unionByName(build.call_edges(found, every_file, asked_symbols))
        edges = cut(resolved.withColumn("file", F.substring_index("source", "::", 1)))

        gone = cut(paths.unionByName(dependents))
        key_rows = asked_keys(extracted)
        key_parts = self._parts_of(asked_keys(old_found).unionByName(key_rows), "key")

        def change(name: str, new: DataFrame, key: str, file: str, out: DataFrame, parts: list[str]) -> Change:
            kept = self.read(name, base, parts).join(out.withColumnRenamed("path", file), file, "left_anti")
            return Change(kept.unionByName(new).withColumn(PART, self._part(F.col(key))), parts)

        summary = paths.agg(F.count("*").alias("changed")).select(
            F.lit(note).alias("note"), "changed", F.lit(present.count()).cast("long").alias("extracted"), F.lit(n_differing).cast("long").alias("changed_keys"),
            F.lit(dependents.count()).cast("long").alias("dependents"), F.lit(edges.count()).cast("long").alias("resolved"),
        )
        return self.tables.commit(
            {
                "files": change("files", files, "path", "path", paths, own_parts),
                "found": change("found", extracted, "path", "path", paths, own_parts),
                "symbols": change("symbols", symbols, "file", "file", paths, own_parts),
                "keys": change("keys", key_rows, "key", "file", paths, key_parts),
                "edges": change("edges", edges, "file", "file", gone, self._parts_of(gone, "path")),
                "batches": Change(summary.withColumn(PART, F.lit(str(base + 1)))),
            },
            base=base,
            note=note,
        )

    def follow(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Applies a stream of changed files, a version for each batch; a batch that comes again after a failure isn't applied twice."""

        def apply(batch: DataFrame, number: int) -> None:
            note = f"{checkpoint} batch {number}"
            if self.tables.manifest()["note"] != note:
                self.apply(batch, note)

        return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
