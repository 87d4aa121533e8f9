"""Registered queries over source files, prompts and snippets, each derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import paths
from .graph import CodeGraph
from .operators import build, ingest, intervals, merge, prompts, resolve
from .plans.lineage import cut, partitions
from .sources import archives, derived, rendered, store
from .sources.substrings import SubstringIndex
from .sources.versioned import Change, Refused, RepositoryStore, VersionedTables
from .streaming.churn import rolling_churn
from .streaming.incremental import IncrementalGraph


def _extracted(language: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Nodes (type, id, name) and edges (type, source, target) of the parts written in a language."""
        return _listed(build.build_graph(cut(rendered.source_files(spark, sf_dir, language))))

    return query


def _listed(g: CodeGraph) -> DataFrame:
    nodes = g.nodes.select("type", F.col("id").alias("first"), F.coalesce(F.concat(F.lit("loc "), F.col("loc").cast("string")), F.col("name")).alias("second"))
    return nodes.unionByName(g.edges.select("type", F.col("source").alias("first"), F.col("target").alias("second")))


def j12_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments fall into the innermost of their customer's orders, each open for a hundred days by its key's last digit."""
    orders = derived.read(spark, sf_dir, "orders")
    start = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date"))
    spans = orders.select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").cast("string").alias("caller"), start.alias("start"), (start + 20 + F.col("o_orderkey") % 10 * 20).cast("int").alias("end"))
    owner = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("file"))
    shipped = derived.read(spark, sf_dir, "lineitem").join(owner, "l_orderkey")
    calls = shipped.select("file", F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).alias("at"), F.col("l_partkey").cast("string").alias("name")).distinct()
    return intervals.enclosing(calls, spans)


def r2_prompt_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = derived.read(spark, sf_dir, "conversations").where("text is not null")
    asked = F.concat(F.lit("Please rename "), F.replace("role", F.lit("s"), F.lit("_S")), F.lit(" and `fix me` in pkg.mod( now: "), F.col("text"))
    asked_rows = talk.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), asked.alias("text")).dropDuplicates(["id"])
    return resolve.prompt_hints(asked_rows)


def r4_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = derived.part_symbols(spark, sf_dir).select("id", "name", F.concat_ws(".", F.regexp_replace("file", "/", "."), "name").alias("qualified_name"), F.lit("function").alias("kind"))
    return resolve.best_match(resolve.score_symbols(symbols, [("red_widget_1", True), ("blue bolt", False), ("promo", False)]))


def r4_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations ask for parts by name, by its words, by a part of it, by a call, or not at all."""
    symbols = derived.part_symbols(spark, sf_dir)
    whole = F.concat_ws(".", F.replace("file", F.lit("/"), F.lit(".")), "name")
    talk = derived.read(spark, sf_dir, "conversations").where("text is not null").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), ((F.col("conv_id") * 31 + F.col("turn") * 7) % 200).alias("pk"), "text").dropDuplicates(["id"])
    key, name = F.col("pk") % 5, F.col("name")
    asked = (
        F.when(key == 0, F.concat(F.lit("rename "), name)).when(key == 1, F.concat(F.lit("`"), F.replace(name, F.lit("_"), F.lit(" ")), F.lit("`")))
        .when(key == 2, F.concat(F.lit("change "), F.regexp_replace(name, "_[0-9]+$", ""))).when(key == 3, F.concat(F.lit("What does "), whole, F.lit("( do"))).otherwise("hello")
    )
    wanted = talk.join(symbols, "pk").select(talk["id"], F.concat(asked, F.lit(", as said: "), "text").alias("text"))
    known = symbols.select("id", "name", whole.alias("qualified_name"), F.lit("function").alias("kind"))
    return prompts.resolve_prompts(wanted, known, f"{cut_folder(spark)}/prompts")


def x11_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions are qualified by their part's words and its key's last digit, over all files: nodes left, and edges among them."""
    g = derived.part_graph(spark, sf_dir)
    whole = F.when(F.col("type") == "function", F.regexp_replace("name", "_[0-9]*([0-9])$", ".$1"))
    left = merge.merge_nodes(CodeGraph(cut(g.nodes), cut(g.edges)), whole)
    return left.nodes.select("type", F.col("id").alias("first"), F.col("name").alias("second")).unionByName(left.edges.select("type", F.col("source").alias("first"), F.col("target").alias("second")))


def r8_owner_and_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' hosts as owners, in each way of writing an address by the page's key, and the pages' own addresses."""
    n = F.col("page_id").cast("string")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    forms = [
        F.concat(F.lit(" https://GitHub.com/"), host, F.lit("/p"), n, F.lit(".git ")), F.concat(F.lit("http://github.com/"), host, F.lit("/p"), n, F.lit("/tree/main")),
        F.concat(F.lit("git@github.com:"), host, F.lit("/p"), n, F.lit(".git")), F.concat(host, F.lit("/p"), n), F.col("url"), F.concat(host, F.lit("/p/"), n),
    ]
    address = F.element_at(F.array(*forms), (F.col("page_id") % len(forms) + 1).cast("int"))
    return derived.read(spark, sf_dir, "pages").select("page_id", resolve.owner_and_name(address).alias("r")).select("page_id", "r.owner", "r.name")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def a13_rolling_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits to their parts' types, streamed in two goes: those before 1996, then the rest."""
    types = derived.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("file"))
    touched = derived.read(spark, sf_dir, "lineitem").join(types, "l_partkey").groupBy("l_orderkey").agg(F.collect_set("file").alias("files"))  # a few lines an order
    commits = derived.read(spark, sf_dir, "orders").join(touched, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderdate").cast("timestamp").alias("ts"), "files")
    folder, provider = cut_folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)
    try:
        for part in ("ts < '1996-01-01'", "ts >= '1996-01-01'"):
            commits.where(part).write.mode("append").parquet(f"{folder}/commits")
            with partitions(spark, 8):  # a state each, with few keys
                churn = rolling_churn(spark.readStream.schema(commits.schema).parquet(f"{folder}/commits"))
                written = churn.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/churn").option("checkpointLocation", f"{folder}/state")
                written.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(churn.schema).parquet(f"{folder}/churn")


def r6_snippet_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are snippets of part names: each third part has a name of its own, the others share theirs."""
    parts = derived.part_symbols(spark, sf_dir).join(derived.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), "p_name"), "pk")
    named = parts.select("pk", "id", "file", F.when(F.col("pk") % 3 == 0, F.col("name")).otherwise(F.col("p_name")).alias("name"))
    lines = derived.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snippet"), F.col("l_partkey").alias("pk"), (F.col("l_linenumber") % 2 == 1).alias("member"))
    hits = lines.join(named.select("pk", "name"), "pk").groupBy("snippet", "name").agg(F.bool_or("member").alias("has_member"))
    return resolve.snippet_symbols(hits, named.select("id", "name", "file"))


def r7_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for a file, a name, or a part of one, by their key."""
    g = derived.part_graph(spark, sf_dir)
    fan_in = g.edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in"))
    kind = F.when(F.col("type") == "file", "module").otherwise("function")
    symbols = g.nodes.join(fan_in, "id", "left").select("id", "name", F.concat_ws("::", "file", "name").alias("qualified_name"), kind.alias("kind"), "file", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))
    key, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    text = F.when(key % 3 == 0, F.concat(F.lit("what of Test_Brand_"), (key % 9).cast("string"), F.lit(".py"))).when(key % 3 == 1, F.concat(F.lit("widget_"), n)).otherwise(F.concat(F.lit("DGET_"), n))
    symbols = cut(symbols)
    index = SubstringIndex.build(resolve.target_texts(symbols), f"{cut_folder(spark)}/index")
    return resolve.resolve_targets(derived.read(spark, sf_dir, "customer").select(key.alias("id"), text.alias("text")), symbols, index)


def f9_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers look for a part of a part's name, of two to eight characters: the first fifty of what each finds."""
    nodes = cut(derived.part_graph(spark, sf_dir).nodes)
    index = SubstringIndex.build(nodes.select(F.explode(F.array("name", "file")).alias("text"), F.col("seq").alias("best")), f"{cut_folder(spark)}/index")
    key = F.col("s_suppkey")
    names = derived.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    asked = derived.read(spark, sf_dir, "supplier").select(key, (key % 97 + 1).alias("key")).join(names, "key")
    text = F.upper(F.substring(F.concat("name", F.lit("_"), F.col("key").cast("string")), (key % 5 + 1).cast("int"), (key % 7 + 2).cast("int")))
    return resolve.search_many(nodes, asked.select(text.alias("text")), index, 50)


def s1_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of archives of a hundred, packed by Spark, stored and read back: names of all kinds, some beyond a hundred bytes; the first forty kept of each."""
    n = F.col("page_id")
    folder = F.element_at(F.array(*map(F.lit, ["src/app", "tests", "node_modules/x", ".hidden", "lib"])), (n % 5 + 1).cast("int"))
    end = F.element_at(F.array(*map(F.lit, [".py", ".ts", ".html", ".d.ts", ".go", ".test.js", ".java"])), (n % 7 + 1).cast("int"))
    name = F.concat(F.lit("top/"), folder, F.lit("/"), F.when(n % 11 == 0, F.repeat(F.lit("long_name/"), 12)).otherwise(""), F.lit("page"), n.cast("string"), end)
    pages = derived.read(spark, sf_dir, "pages").select(F.floor(n / 100).alias("archive"), n.alias("page_id"), name.alias("name"), F.coalesce("html", F.lit("")).alias("html"))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("page_id")
        files = ((name, html.encode()) for name, html in zip(rows.column("name").to_pylist(), rows.column("html").to_pylist(), strict=True))
        return pa.table({"archive": [key[0].as_py()], "content": pa.array([archives.packed(files)], pa.binary())})

    path = f"{cut_folder(spark)}/archives"
    pages.groupBy("archive").applyInArrow(pack, "archive long, content binary").write.parquet(path)
    walked = archives.walk(spark.read.parquet(path), archives.KEPT_ENDINGS)
    mapped = archives.files_to_map(walked, 40).select(F.lit("map").alias("kept_for"), "archive", "path", F.md5("content").alias("content_md5"))
    return mapped.unionByName(archives.files_to_index(walked, 20_000).select(F.lit("index").alias("kept_for"), "archive", "path", F.md5("content").alias("content_md5")))


def s6_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notebooks: what assistants say is code, a turn each, with a magic line before it; every other one as a list of lines."""
    talk = derived.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = F.when(F.col("role") == "assistant", "code").otherwise("markdown")
    source = F.concat(F.lit("%time\n"), F.col("text"))
    lines = F.split(source, "\n")
    listed = F.transform(lines, lambda x, i: F.when(i < F.size(lines) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    cell = F.when(F.col("turn") % 4 < 2, F.to_json(F.struct(kind.alias("cell_type"), source.alias("source")))).otherwise(F.to_json(F.struct(kind.alias("cell_type"), listed.alias("source"))))
    books = talk.select("conv_id", "turn", "text", cell.alias("cell")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "cell"))).alias("cells"))
    content = F.concat(F.lit('{"cells":['), F.array_join(F.transform("cells", lambda c: c["cell"]), ","), F.lit("]}"))
    return books.select("conv_id", F.md5(ingest.notebook_source(content)).alias("source_md5"))


def s10_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation, then those of even nations written again with new names: odd nations stay as they were."""
    rows = derived.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("repo_id"), F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("name"))
    path = f"{cut_folder(spark)}/replaced"
    store.replace_repositories(rows, path)
    store.replace_repositories(rows.where("repo_id % 2 = 0").withColumn("name", F.upper("name")), path)
    return spark.read.parquet(path).select("id", "name", F.col("repo_id").cast("int").alias("repo_id"))


def s12_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table without the nations of one region."""
    path = f"{cut_folder(spark)}/kept"
    rows = derived.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("repo_id"), F.col("c_custkey").alias("id"))
    store.replace_repositories(rows, path)
    gone = derived.read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("repo_id"))
    store.delete_repositories(spark, path, gone, path + "-after")
    return spark.read.parquet(path + "-after").select("id", F.col("repo_id").cast("int").alias("repo_id"))


def s10_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' Python files, then a batch that deletes every seventh and one that brings half of these back: nodes and edges as x1 has them."""
    files = cut(rendered.source_files(spark, sf_dir, "python"))
    graph = IncrementalGraph(spark, f"{cut_folder(spark)}/graph")
    gone = files.where("seq % 7 = 3")
    graph.apply(files, "all")
    graph.apply(gone.withColumn("content", F.lit(None).cast("string")), "deleted")
    graph.apply(gone.where("seq % 2 = 0"), "back")
    return _listed(graph.graph())


def s10_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batches of a graph read: one file in ten changes its text alone, then one part's name."""
    files = cut(rendered.source_files(spark, sf_dir, "python"))
    graph = IncrementalGraph(spark, f"{cut_folder(spark)}/graph")
    graph.apply(files, "all")
    graph.apply(files.where("seq % 10 = 1").withColumn("content", F.concat("content", F.lit("\n# seen"))), "a remark")
    graph.apply(files.where("seq = 0").withColumn("content", F.replace("content", F.lit("f2("), F.lit("g2("))), "renamed")
    return graph.read("batches").select("note", "changed", "extracted", "dependents")


def f11_guarded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of nations, which regions own: a region writes and deletes its own nations'; another's writes are refused."""
    nations = derived.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("owner_id"), F.lit("private").alias("visibility"), F.col("n_nationkey").alias("updated_at"))
    rows = derived.read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("repo_id"), F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("name"))
    kept = RepositoryStore(VersionedTables(spark, f"{cut_folder(spark)}/store"), ("symbols",))
    kept.register(nations)
    of = lambda region: rows.join(F.broadcast(nations.where(F.col("owner_id") == region).select(F.col("id").alias("repo_id"))), "repo_id", "left_semi")
    for region in range(5):
        kept.replace(region, {"symbols": of(region)})
    kept.replace(1, {"symbols": of(1).withColumn("name", F.upper("name"))})
    try:
        kept.replace(2, {"symbols": rows.withColumn("name", F.lit("taken"))})
    except Refused:
        pass
    kept.delete(0, nations.where("owner_id = 0 and id % 2 = 0").select(F.col("id").alias("repo_id")))
    kept.set_visibility(3, nations.where("owner_id = 3").select(F.col("id").alias("repo_id")), "public")
    return kept.visible("symbols", 1)


def s12_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as repositories of their nations: what nation 7 lists, the last updated first, with its place in the list."""
    rows = derived.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("owner_id"), F.lit("private").alias("visibility"), F.round("s_acctbal").cast("long").alias("updated_at"))
    kept = RepositoryStore(VersionedTables(spark, f"{cut_folder(spark)}/store"))
    kept.tables.commit({"repos": Change(rows.withColumn("_part", F.col("id") % 16))})
    listed = kept.listed(7)
    return listed.select("id", "updated_at", F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")).cast("long").alias("place"))  # one owner's list


def s11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each risk, of the suppliers by region, read back."""
    path = f"{cut_folder(spark)}/runs"
    found = derived.read(spark, sf_dir, "supplier").join(derived.read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = found.select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("depth"), F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("risk"))
    for region in range(5):
        store.append_run(rows.where(F.col("depth") == region), {"prompt": f"region {region}", "change_kind": "behavior"}, path)
    return spark.read.parquet(path).select("prompt", "change_kind", F.size("affected").cast("long").alias("n"), "summary.high", "summary.medium", "summary.low", "summary.total")


def f10_allowed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the customers that nation 3 may see."""
    customers = derived.read(spark, sf_dir, "customer")
    repos = customers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner_id"), F.when(F.col("c_mktsegment") == "BUILDING", "public").otherwise("private").alias("visibility"))
    orders = derived.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo_id"), "o_orderkey")
    return store.allowed(orders, repos, 3)


def u7_broken_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the order tables as of symbols and edges: lines are edges from orders to parts."""
    part = derived.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit(1).alias("repo_id"), F.col("p_name").alias("qualified_name"))
    lines = derived.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_partkey").cast("string").alias("target_id"), F.col("l_returnflag").alias("kind"))
    return store.broken_rules(part, lines)


def p_suggested_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where tests of the parts' files and of files of other kinds would stand, and names in snake case."""
    files = derived.part_symbols(spark, sf_dir)
    path = F.concat(F.regexp_replace("file", r"\.py$", ""), F.element_at(F.array(*map(F.lit, [".py", ".ts", ".go"])), (F.col("pk") % 3 + 1).cast("int")))
    return files.select("id", paths.suggested_test(path).alias("suggested"), paths.snake(F.concat(F.lit("get"), F.initcap(F.replace("name", F.lit("_"), F.lit(" "))))).alias("snake"))


def cut_folder(spark: SparkSession) -> str:
    """A new folder for a table, beside the checkpoints."""
    import uuid

    from .plans.lineage import shared_folder

    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


QUERIES = {
    **{f"x{k}_{language}": _extracted(language) for k, language in enumerate(("python", "c", "java", "go", "rust", "csharp", "javascript"), 1)},
    **{
        f.__name__: f
        for f in (
            s1_archives, j12_enclosing, r2_prompt_hints, r4_best_match, r4_prompts, a13_rolling_churn, x11_merged, r8_owner_and_name, r6_snippet_symbols, r7_targets, f9_search_many, s6_notebooks, s10_replaced, s10_incremental, s10_batches,
            s11_runs, s12_deleted, s12_listed, f10_allowed_rows, f11_guarded_writes, u7_broken_keys, p_suggested_tests,
        )
    },
}
