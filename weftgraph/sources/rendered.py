"""Source files written from the part tables, so that extraction runs over whole tables: parts are functions that call parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .derived import part_calls, read

PARTS_PER_FILE = 40
FOLDERS = 7


@dataclass(frozen=True)
class Style:
    """How a language writes a file: imports, a head, odd parts, a middle, even parts, an end. @-words are filled in."""

    ending: str
    imports: str
    head: str
    odd: str
    middle: str
    even: str
    end: str
    odd_owned: bool = False  # whether a function is named after the file's class
    even_owned: bool = False
    has_class: bool = False


STYLES = {
    "python": Style(".py", "import src.@FOLDER.@MODULE", "class @MODULE:", "    def @NAME(self, a=1):\n        return @BODY", "", "def @NAME(a=1):\n    return @BODY", "", odd_owned=True, has_class=True),
    "javascript": Style(".ts", 'import { @NAMES } from "../@FOLDER/@MODULE";', "export class @MODULE {", "  async @NAME(a) { /* f1(1) */ return @BODY; }", "}", "export const @NAME = async (a) => { const s = 'f1(2)'; return @BODY; };", "", odd_owned=True, has_class=True),
    "java": Style(".java", "import app.@FOLDER.@MODULE;", "public class @MODULE {", "  public static int @NAME(int a) { return @BODY; } // f1(1)", "", '  private int @NAME(int a) throws Late { a = bar("f1(2)"); return @BODY; }', "}", True, True, True),
    "csharp": Style(".cs", "using App.@FOLDER.@MODULE;", "namespace App { internal sealed class @MODULE {", "  public async Task<int> @NAME(int a) { return @BODY; } // f1(1)", "", '  private int @NAME(int a) { var s = "f1(2)"; return @BODY; }', "} }", True, True, True),
    "go": Style(".go", 'import "app/src/@FOLDER"', "package p", "func (r *@MODULE) @NAME(a int) int { return @BODY } // f1(1)", "", "func @NAME(a int) int { s := `f1(2)`; return @BODY }", "", odd_owned=True),
    "rust": Style(".rs", "use crate::@FOLDER::@MODULE;", "// f1(1)", "pub fn @NAME<'a>(a: &'a str) -> i32 { @BODY }", "", 'async fn @NAME(a: i32) -> i32 { let s = "f1(2)"; @BODY }', ""),
    "c": Style(".c", '#include "../@FOLDER/@MODULE.c"', "/* f1(1) { */", "static int @NAME(int a) { return @BODY; }", "", 'int @NAME(int a) { bar("f1(2) {"); return @BODY; }', ""),
}


def filled(template: str, **values: Column) -> Column:
    """A template's text with its @-words replaced."""
    out = F.lit(template)
    for word, value in values.items():
        out = F.replace(out, F.lit("@" + word), value)
    return out


def source_files(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(path, content, seq): a file for each PARTS_PER_FILE parts, its functions calling as the parts do."""
    style = STYLES[language]
    number = lambda key: F.floor(F.col(key) / PARTS_PER_FILE)
    module = lambda n: F.concat(F.lit("Mod"), n.cast("string"))
    folder = lambda n: F.concat(F.lit("pkg"), (n % FOLDERS).cast("string"))
    name = lambda key: F.concat(F.lit("f"), F.col(key).cast("string"))
    calls = part_calls(spark, sf_dir)
    bodies = calls.groupBy(F.col("s").alias("pk")).agg(F.array_sort(F.collect_list("t")).alias("callees"))
    body = F.coalesce(F.array_join(F.transform("callees", lambda t: F.concat(F.lit("f"), t.cast("string"), F.lit("(a)"))), " + "), F.lit("0"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk")).join(bodies, "pk", "left")
    text = F.when(F.col("pk") % 2 == 1, filled(style.odd, NAME=name("pk"), BODY=body, MODULE=module(number("pk")))).otherwise(filled(style.even, NAME=name("pk"), BODY=body))
    functions = parts.select(number("pk").alias("n"), (F.col("pk") % 2 == 0).alias("even"), "pk", text.alias("text"))
    lines = lambda even: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("even") == even, F.struct("pk", "text")))), lambda x: x["text"]), "\n")
    written = functions.groupBy("n").agg(lines(False).alias("odd"), lines(True).alias("evens"))
    asked = calls.select(number("s").alias("n"), number("t").alias("m"), name("t").alias("callee")).where("n <> m")
    line = filled(style.imports, FOLDER=folder(F.col("m")), MODULE=module(F.col("m")), NAMES=F.array_join(F.array_sort(F.collect_set("callee")), ", "))
    imports = asked.groupBy("n", "m").agg(line.alias("line")).groupBy("n").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("imports"))
    fixed = lambda t: filled(t, MODULE=module(F.col("n")))
    content = F.concat_ws("\n", F.coalesce("imports", F.lit("")), fixed(style.head), "odd", F.lit(style.middle), "evens", F.lit(style.end))
    path = F.concat(F.lit("src/"), folder(F.col("n")), F.lit("/"), module(F.col("n")), F.lit(style.ending))
    return written.join(imports, "n", "left").select(path.alias("path"), content.alias("content"), F.col("n").alias("seq"))
