"""Finding symbols from words, and imports from paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import name_tokens
from ..plans.lineage import cut, stored
from ..sources.substrings import SubstringIndex


def first_by_name(symbols: DataFrame) -> DataFrame:
    """(name, id): the first symbol of each name in ingest order."""
    return symbols.groupBy("name").agg(F.min_by("id", F.struct("seq", "id")).alias("id"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, target): named calls (source, callee) to the first symbol of that name; distinct, no call of itself."""
    named = first_by_name(symbols).withColumnsRenamed({"name": "callee", "id": "target"})
    return calls.join(named, "callee").where("source <> target").select("source", "target").distinct()


def match_strength(n: Column, qn: Column, tokens: Column, hint: Column, tail: Column, parts: Column) -> Column:
    """How well a hint (in lower case, its last dotted part, its tokens) fits a symbol (name and qualified name in lower case, tokens).

    From the qualified name (30) over the name (26), the hint's last part (22, 18) to a part
    of a name (8) or of the qualified one (4); weak fits gain by shared tokens.
    """
    ends = lambda t: qn.endswith(F.concat(F.lit("."), t)) | qn.endswith(F.concat(F.lit("::"), t))
    ladder = (
        F.when((qn == hint) | ends(hint), 30).when(n == hint, 26).when(n == tail, 22).when(ends(tail), 18)
        .when(n.contains(hint) | hint.contains(n), 8).when(qn.contains(hint), 4).otherwise(0)
    )
    shared = F.size(F.filter(parts, lambda t: F.array_contains(tokens, t)))
    return ladder + F.when((ladder <= 8) & (shared > 0), 6 * shared + F.floor(4 * shared / F.size(parts) + 0.5)).otherwise(0)


def kind_bonus(kind: Column) -> Column:
    """What a function, method or class is ahead of other symbols."""
    return F.when(kind.isin("function", "method"), 0.5).when(kind == "class", 0.25).otherwise(0.0)


def hint_weight(strong: Column) -> Column:
    return F.when(strong, 1.0).otherwise(0.35)


def last_dotted(hint: Column) -> Column:
    return F.regexp_extract(hint, r"([^.]*)$", 1)


def score_symbols(symbols: DataFrame, hints: list[tuple[str, bool]]) -> DataFrame:
    """(id, score): how well symbols (id, name, qualified_name, kind) match the words of a prompt.

    A hint is a word and whether it stood out; others weigh 0.35. Functions, methods and
    classes are slightly ahead. hints are few, so they travel as a literal.
    """
    literal = F.array(*(F.struct(F.lit(h).alias("raw"), F.lit(strong).alias("strong")) for h, strong in hints))
    prepared = F.transform(literal, lambda h: F.struct(h["strong"].alias("strong"), name_tokens(h["raw"]).alias("parts"), F.lower(h["raw"]).alias("hint"), last_dotted(F.lower(h["raw"])).alias("tail")))
    named = symbols.select("id", "kind", F.lower("name").alias("n"), F.lower("qualified_name").alias("qn"), name_tokens(F.col("name")).alias("tokens"), prepared.alias("hints"))
    scored = lambda h: match_strength(F.col("n"), F.col("qn"), F.col("tokens"), h["hint"], h["tail"], h["parts"]) * hint_weight(h["strong"])
    total = F.aggregate("hints", F.lit(0.0), lambda done, h: done + scored(h))
    return named.select("id", F.round(total + kind_bonus(F.col("kind")), 6).alias("score"))


def best_match(scored: DataFrame, floor: int = 4, sure: int = 12, gap: int = 1) -> DataFrame:
    """(id, score): the best symbol if it has the floor and is sure or clearly ahead of the next."""
    top = scored.orderBy(F.desc("score"), "id").limit(2)
    ahead = top.withColumn("next", F.lead("score").over(Window.orderBy(F.desc("score"), "id"))).orderBy(F.desc("score"), "id").limit(1)  # two rows
    return ahead.where((F.col("score") >= floor) & ((F.col("score") >= sure) | (F.col("score") - F.coalesce("next", F.lit(0)) >= gap))).select("id", "score")


# Words of a prompt that name no symbol, and what in a prompt surely names one.
PROMPT_STOP = """rename renamed change changed delete deleted remove removed modify modified update updated refactor
refactored add added fix fixed the this that from into make function method class module file and for with all any new old
use using behavior logic code""".split()
PROMPT_PATTERNS = [
    r"\b(\w+\.\w+(?:\.\w+)*)\s*\(",
    r"`([^`\n]+)`",
    r"(?i)(?:rename|change|delete|modify|update|refactor|remove|fix|add)\s+([A-Za-z_][\w.]*)",
    r"(?i)([A-Za-z_][\w.]*)\s+(?:function|method|class)",
    r"\b([A-Za-z_][\w.]*)\s*\(\s*\)?",
]


def prompt_hints(prompts: DataFrame) -> DataFrame:
    """(id, hint, strong): words of prompts (id, text) that may name a symbol, as first written, each once whatever its case.

    What a pattern points out is strong; so is a plain word of compound form, or any if
    the prompt has at most three that are no stop-words. Texts without words give no rows.
    """
    text = F.col("text")
    words = F.filter(F.split(text, r"\W+"), lambda w: (F.length(w) >= 3) & w.rlike("^[A-Za-z_]") & ~F.lower(w).isin(PROMPT_STOP))
    few = F.size(words) <= 3
    named = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda w: F.struct(w.alias("hint"), F.lit(True).alias("strong"))) for p in PROMPT_PATTERNS]
    plain = F.transform(words, lambda w: F.struct(w.alias("hint"), (few | w.rlike("_|[a-z][A-Z]")).alias("strong")))
    every = prompts.where("text is not null").select("id", F.posexplode(F.concat(*named, plain)).alias("at", "h")).select("id", "at", F.trim("h.hint").alias("hint"), "h.strong")
    kept = every.where((F.length("hint") >= 2) & ~F.lower("hint").isin(PROMPT_STOP))
    return kept.groupBy("id", F.lower("hint").alias("_key")).agg(F.min_by("hint", "at").alias("hint"), F.bool_or("strong").alias("strong")).drop("_key")


# Endings that make a word of a query a file name.
QUERY_FILE = r"(?i)\.(py|c|h|cpp|cc|cxx|hpp|hh|hxx)$"


def query_candidates(queries: DataFrame) -> DataFrame:
    """(query, stage, at, candidate): what a query (id, text) may mean: file names (0), then itself and its words (1)."""
    text = F.trim("text")
    base = F.array_distinct(F.filter(F.transform(F.concat(F.array(text), F.regexp_extract_all(text, F.lit(r"[A-Za-z_][\w./-]*"), F.lit(0))), lambda w: F.trim(w)), lambda w: F.length(w) > 1))
    files = F.array_distinct(F.filter(F.transform(base, lambda w: F.regexp_replace(w, r"^.*[\\/]", "")), lambda w: w.rlike(QUERY_FILE)))
    names = F.array_distinct(F.filter(F.concat(base, F.transform(files, lambda w: F.regexp_replace(w, QUERY_FILE, ""))), lambda w: F.length(w) > 1))
    rows = queries.where("text is not null").select(F.col("id").alias("query"), files.alias("files"), names.alias("names"))
    by_file = rows.select("query", F.lit(0).alias("stage"), F.posexplode("files").alias("at", "candidate"))
    return by_file.unionByName(rows.select("query", F.lit(1).alias("stage"), F.posexplode("names").alias("at", "candidate")))


def target_texts(symbols: DataFrame) -> DataFrame:
    """(text, best): what a target may be found in, each symbol's names and file; best ranks its symbol by most callers, then by id."""
    best = F.struct((-F.col("fan_in")).alias("order"), "id")
    return symbols.select(F.explode(F.array("name", "qualified_name", "file")).alias("text"), best.alias("best"))


def resolve_targets(queries: DataFrame, symbols: DataFrame, index: SubstringIndex) -> DataFrame:
    """(query, id): the symbol each query (id, text) means, of symbols (id, name, qualified_name, kind, file, fan_in).

    First a module whose file has a name of the query, then a symbol of exactly that name, then one whose
    name or file holds it, whatever the case; within a stage by the query's words, then by most callers, then
    by id. The last asks an index of target_texts(symbols), and only for queries that the others leave open.
    """
    asked = cut(query_candidates(queries))
    names = asked.where("stage = 1").drop("stage")
    files = asked.where("stage = 0").drop("stage")
    last = F.element_at(F.split(F.lower("file"), "/"), -1)
    modules = symbols.where("kind = 'module' and file like '%/%'").groupBy(last.alias("low")).agg(F.min(F.struct((-F.col("fan_in")).alias("order"), "id")).alias("best"))
    by_file = files.withColumn("low", F.lower("candidate")).join(modules, "low").select("query", F.lit(0).alias("stage"), "at", "best")
    keyed = symbols.select(F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("candidate"), F.struct((-F.col("fan_in")).alias("order"), "id").alias("best"))
    exact = names.join(keyed.groupBy("candidate").agg(F.min("best").alias("best")), "candidate").select("query", F.lit(1).alias("stage"), "at", "best")
    settled = cut(by_file.unionByName(exact).groupBy("query").agg(F.min(F.struct("stage", "at", "best")).alias("first")).select("query", F.col("first.best.id").alias("id")))
    open_names = cut(names.join(settled.select("query"), "query", "left_anti").withColumn("candidate", F.lower("candidate")))
    fuzzy = open_names.join(index.best(open_names.select("candidate")), "candidate").groupBy("query").agg(F.min(F.struct("at", "best")).alias("first"))
    return settled.unionByName(fuzzy.select("query", F.col("first.best.id").alias("id")))


# Names too common to stand for a symbol unless they are reached as a member.
COMMON_NAMES = """update render init setup run start stop close open load save create delete remove add find check handle
process build format parse validate read write apply reset clear next prev done value name type key data item items list
result results entry""".split()


FEW = 3  # so many symbols of a name are tried without an anchor


def snippet_symbols(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """(snippet, id): the symbols (id, name, file) that a snippet's identifiers (snippet, name, has_member) stand for.

    A name with one symbol is taken and anchors its file; an ambiguous one takes its
    symbols in anchored files, or without any all of at most three if it is reached as a
    member and the snippet has fewer than four identifiers. Common names need a member access.

    Names of few symbols bring these along and are settled within their snippet. Other names
    meet the anchored files only, by name and file, so rows are made for answers alone.
    """
    counted = symbols.groupBy("name").agg(F.count("*").alias("n"))
    rare = symbols.join(counted.where(F.col("n") <= FEW).select("name"), "name", "left_semi").groupBy("name").agg(F.collect_list(F.struct("id", "file")).alias("few"))
    named = counted.join(rare, "name", "left")
    once = hits.where("snippet is not null").groupBy("snippet", "name").agg(F.bool_or("has_member").alias("has_member"))
    sized = once.withColumn("size", F.count("name").over(Window.partitionBy("snippet")))  # the identifiers of one snippet
    met = sized.where(~F.col("name").isin(COMMON_NAMES) | F.col("has_member")).join(named, "name")
    alone = (F.col("size") < 4) & F.col("has_member")
    listed = met.groupBy("snippet").agg(
        F.collect_list(F.when(F.col("n") <= FEW, F.struct("few", alone.alias("alone")))).alias("rare"), F.collect_list(F.when(F.col("n") > FEW, F.col("name"))).alias("names")
    )
    anchors = F.array_distinct(F.array_compact(F.transform(F.filter("rare", lambda r: F.size(r["few"]) == 1), lambda r: r["few"][0]["file"])))
    placed = listed.select("snippet", "rare", "names", anchors.alias("anchors"))

    def own(r: Column) -> Column:
        here = F.filter(r["few"], lambda s: F.array_contains("anchors", s["file"]))
        return F.when(F.size(r["few"]) == 1, r["few"]).when(F.size(here) > 0, here).when(r["alone"], r["few"]).otherwise(F.slice(r["few"], 1, 0))["id"]

    settled = stored(placed.select("snippet", F.array_distinct(F.flatten(F.transform("rare", own))).alias("ids"), "names", "anchors"))
    asked = settled.select("snippet", "anchors", F.explode("names").alias("name")).select("snippet", "name", F.explode("anchors").alias("file"))
    many = symbols.groupBy("name", "file").agg(F.collect_set("id").alias("ids"))
    found = settled.select("snippet", F.explode("ids").alias("id")).unionByName(asked.join(many, ["name", "file"]).select("snippet", F.explode("ids").alias("id")))
    # An id has one name and one file, so each row is new; a table that repeats ids needs the rows together.
    return found if symbols.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty() else found.distinct()


def search(nodes: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Nodes whose name or file holds a text, whatever the case; with a limit the first by seq."""
    q = text.lower()
    found = nodes.where(F.lower("name").contains(q) | F.lower("file").contains(q))
    return found if limit is None else found.orderBy("seq", "id").limit(limit)


def search_many(nodes: DataFrame, texts: DataFrame, index: SubstringIndex, limit: int | None = None) -> DataFrame:
    """(text, id): for each of many texts the nodes whose name or file holds it, as search finds them; index is one of names and files.

    Texts of less than two characters find nothing here. With a limit the first by seq.
    """
    asked = texts.select("text", F.lower("text").alias("candidate")).distinct()
    found = index.matches(asked.select("candidate")).withColumnRenamed("text", "held")
    named = nodes.select("id", "seq", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("file")))).alias("held"))
    rows = named.join(found, "held").select("candidate", "id", "seq").distinct().join(asked, "candidate").select("text", "id", "seq")
    if limit is not None:
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("text").orderBy("seq", "id"))).where(F.col("_place") <= limit)
    return rows.select("text", "id")


def import_candidates(path: Column) -> Column:
    """Files a module path without an ending can mean, in order: itself, with each ending, then its index files."""
    ends = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
    return F.array(*(F.concat(path, F.lit(e)) for e in ends), *(F.concat(path, F.lit(f"/index{e}")) for e in ends[1:]))


def script_bases(source: Column, spec: Column) -> Column:
    """Paths a script's import may start from: its own folder for a relative one, src and then the root behind @/ or ~/."""
    folder = F.slice(F.split(source, "/"), 1, F.size(F.split(source, "/")) - 1)
    step = lambda done, s: (
        F.when(s.isin("", "."), done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    )
    walked = F.aggregate(F.concat(folder, F.split(spec, "/")), F.array().cast("array<string>"), step, lambda done: F.array_join(done, "/"))
    rest = F.substring(spec, F.lit(3), F.length(spec))
    aliased = F.array(F.concat(F.lit("src/"), rest), rest)
    return F.when(spec.startswith("@/") | spec.startswith("~/"), aliased).when(spec.startswith("."), F.array(walked)).otherwise(F.array().cast("array<string>"))


def resolve_scripts(imports: DataFrame, files: DataFrame, keep_path: bool = False) -> DataFrame:
    """(source, target): a script's imports (source, path) to the first file that its base paths and their candidates name.

    With keep_path the import's path stays too. Packages (neither relative nor aliased) resolve to nothing.
    """
    bases = script_bases(F.col("source"), F.col("path"))
    asked = imports.select("source", "path", F.posexplode(F.flatten(F.transform(bases, import_candidates))).alias("rank", "candidate"))
    found = asked.join(files.select(F.col("path").alias("candidate")), "candidate", "left_semi")
    best = found.groupBy("source", "path").agg(F.min_by("candidate", "rank").alias("target"))
    return best if keep_path else best.select("source", "target").where("source <> target").distinct()


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target): Python imports (source, path) to the file of that dotted path below the root."""
    asked = imports.select("source", F.concat(F.replace("path", F.lit("."), F.lit("/")), F.lit(".py")).alias("target"))
    return asked.join(files.select(F.col("path").alias("target")), "target", "left_semi").select("source", "target").distinct()


def resolve_crates(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target): Rust uses (source, path) to the file (name, target) of the last part that has one."""
    asked = imports.select("source", "path", F.posexplode(F.split("path", "::")).alias("at", "name")).where("name <> ''")
    return asked.join(files, "name").groupBy("source", "path").agg(F.max_by("target", "at").alias("target")).where("source <> target").select("source", "target").distinct()


def package_folders(files: DataFrame) -> DataFrame:
    """(folder, target): the first Go file of each folder, by its whole path and by its last part."""
    go = files.where(F.lower("path").endswith(".go")).select("path", "seq", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("whole")).where("whole <> ''")
    names = F.array_distinct(F.array("whole", F.element_at(F.split("whole", "/"), -1)))
    return go.select("path", "seq", F.explode(names).alias("folder")).groupBy("folder").agg(F.min_by("path", F.struct("seq", "path")).alias("target"))


def repository(url: Column) -> tuple[Column, Column]:
    """Host and first folder of an address."""
    return F.regexp_extract(url, r"^(?:[a-z]+://)?([^/]+)", 1), F.regexp_extract(url, r"^(?:[a-z]+://)?[^/]+/([^/?#]+)", 1)


# The ways in which a repository's address is written, in order; a trailing .git is no part of a name.
ADDRESSES = [r"(?i)^https?://github\.com/([^/]+)/([^/]+)", r"(?i)^git@github\.com:([^/]+)/([^/]+)", r"^([^/\s]+)/([^/\s]+)$"]


def owner_and_name(address: Column) -> Column:
    """The owner and name (a struct) that an address stands for: a web address, one for git, or owner/name; null for any other."""
    written = F.regexp_replace(F.trim(address), r"\.git$", "")
    shaped = lambda p: F.when(written.rlike(p), F.struct(F.regexp_extract(written, p, 1).alias("owner"), F.regexp_extract(written, p, 2).alias("name")))
    return F.coalesce(*map(shaped, ADDRESSES))


def visible(repos: DataFrame, owner: Column) -> DataFrame:
    """Repositories an owner may read: their own and public ones."""
    return repos.where((F.col("owner_id") == owner) | (F.col("visibility") == "public"))


def commit_churn(commits: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """(file, churn, last_commit): commits (ts, files) of each file within so many days, and the day of its last one."""
    touched = commits.select("ts", F.explode("files").alias("file"))
    recent = F.count_if(F.col("ts") >= as_of - F.expr(f"interval {days} days"))
    return touched.groupBy("file").agg(recent.alias("churn"), F.to_date(F.max("ts")).alias("last_commit"))


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target): C includes (source, path) to the first file (path, seq) that ends in the path, or has its name.

    A path may end in the include within a folder's or file's name (my_x.h for x.h), so
    files are listed under every ending of their own name, with the folders before it:
    one equi-join on the include's last part, then the check of the whole.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    asked = includes.select("source", F.regexp_replace("path", r"^\./", "").alias("wanted")).withColumn("base", last(F.col("wanted"))).distinct()
    name = last(F.col("path"))
    endings = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.substring(name, i, F.length(name)))
    have = files.select(F.col("path").alias("target"), "seq", name.alias("own"), F.explode(endings).alias("base"))
    met = asked.join(have, "base").where((F.col("own") == F.col("base")) | F.col("target").endswith(F.col("wanted")))
    return met.groupBy("source", "wanted").agg(F.min_by("target", "seq").alias("target")).where("source <> target").select("source", "target").distinct()


def resolve_packages(imports: DataFrame, folders: DataFrame) -> DataFrame:
    """(source, target): Go imports (source, path) to the folder (folder, target) that is their longest suffix."""
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    asked = imports.select("source", "path", F.posexplode(suffixes).alias("at", "folder"))
    return asked.join(folders, "folder").groupBy("source", "path").agg(F.min_by("target", F.struct("at", "target")).alias("target")).select("source", "target").distinct()


def resolve_classes(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target): dotted imports (source, path) to the file (name, target) of the last capitalised part that has one."""
    asked = imports.select("source", "path", F.posexplode(F.split("path", r"\.")).alias("at", "name")).where(F.col("name").rlike("^[A-Z]"))
    return asked.join(files, "name").groupBy("source", "path").agg(F.max_by("target", F.struct("at", "target")).alias("target")).where("source <> target").select("source", "target").distinct()
