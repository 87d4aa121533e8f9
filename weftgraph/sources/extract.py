"""Declarations, imports and calls of source files, by language.

A file's text is read by a small Python helper inside Spark tasks, a file at a time;
everything that needs more than one file is joins (operators/build.py).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import ending, notebook_source
from .languages import BY_ENDING, COMMENT, PYTHON_STOP, Braced, Found

# What a line of Python declares, imports and calls.
PYTHON_DECLARED = re.compile(r"^(?P<indent>[ \t]*)(?:(?:async[ \t]+)?def[ \t]+(?P<name>[A-Za-z_]\w*)\s*\(|class[ \t]+(?P<type>[A-Za-z_]\w*))", re.ASCII)
PYTHON_FROM = re.compile(r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b", re.ASCII)
PYTHON_IMPORT = re.compile(r"^[ \t]*import[ \t]+([\w.]+(?:[ \t]*,[ \t]*[\w.]+)*)", re.ASCII)
PYTHON_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(", re.ASCII)
NAME = re.compile(r"[A-Za-z_$][\w$]*", re.ASCII)
ROWS_PER_BATCH = 5000


def blanked(text: str, strings: str | None) -> str:
    """The text with comments, and strings if given, as spaces; line ends and offsets stay, code inside a template too."""

    def blank(m: re.Match) -> str:
        if strings is None and not m["comment"]:
            return m[0]
        out = re.sub(r"[^\n]", " ", m[0])
        start, end = m.span("code") if "code" in m.re.groupindex else (-1, -1)
        return out if start < 0 else out[: start - m.start()] + text[start:end] + out[end - m.start() :]

    # Strings are found even if they stay, so that no comment begins inside one.
    return re.sub(rf"(?P<comment>{COMMENT})|{strings or KEPT_STRINGS}", blank, text)


KEPT_STRINGS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'


def brace_ends(text: str) -> dict[int, int]:
    """The place of the closing brace of each opening one; without one, the end of the text."""
    ends, open_ones = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            open_ones.append(m.start())
        elif open_ones:
            ends[open_ones.pop()] = m.start()
    return ends | dict.fromkeys(open_ones, len(text))


def innermost(bodies: list[tuple[int, int, str]], places: list[int]) -> list[list[str]]:
    """For each place in order the names of the innermost body (start, end, name) around it; several may begin together."""
    bodies = sorted(bodies, key=lambda b: (b[0], -b[1]))
    starts = [b[0] for b in bodies]
    out, stack, taken = [], [], 0
    for at in places:
        until = bisect_right(starts, at - 1)
        for b in bodies[taken:until]:
            while stack and stack[-1][1] <= b[0]:
                stack.pop()
            stack.append(b)
        taken = until
        while stack and stack[-1][1] <= at:
            stack.pop()
        out.append([b[2] for b in stack if b[0] == stack[-1][0]])
    return out


NO_TYPE = re.compile(r"[^\w$<>,.\s\[\]?]", re.ASCII)


def typed(code: str, name_at: int, since: int) -> bool:
    """Whether a type stands before a method's name: words and brackets behind the last ;, { or } or on lines of their own."""
    low = name_at
    while low > since and not NO_TYPE.match(code, low - 1):
        low -= 1
    before = code[low:name_at]
    if low > since and code[low - 1] not in ";{}":
        before = before.partition("\n")[2]
    return before[-1:].isspace() and before.lstrip()[:1].strip("<").isidentifier() or before.lstrip().startswith("<") and before[-1:].isspace()


def read_braced(text: str, language: Braced) -> Found:
    """A file of a language with braces. Imports are looked for with comments blanked, all else without strings too."""
    found, code, commented = Found(), blanked(text, language.strings), blanked(text, None)
    ends = brace_ends(code)
    for pattern in language.imports:
        for m in pattern.finditer(commented):
            found.add("import", m["name"])
    if language.import_blocks:
        block, one = language.import_blocks
        for m in block.finditer(commented):
            for i in one.finditer(m["inner"]):
                found.add("import", i["name"])
    if language.bindings:
        for m in language.bindings.finditer(commented):
            found.add("import", m["name"])
            for local in bound_names(m["clause"]):
                found.add("binding", local, m["name"])
    bodies: list[tuple[int, int, str]] = []
    for pattern in language.functions:
        for m in pattern.finditer(code):
            open_at = m.end() - 1
            if (language.stop_declared and m["name"] in language.stop) or (language.closed_only and ends[open_at] == len(code)):
                continue
            owner = m["owner"] if "owner" in pattern.groupindex else None
            bodies.append((open_at, ends[open_at], f"{owner}.{m['name']}" if owner else m["name"]))
    for t in language.types.finditer(code) if language.types else ():
        found.add("class", t["name"])
        inside = t.end() - 1
        for m in (language.heads or language.methods).finditer(code, inside, ends[inside]):
            if m["name"] not in language.stop and (language.constructors or m["name"] != t["name"]) and (not language.heads or typed(code, m.start(), inside)):
                bodies.append((m.end() - 1, ends[m.end() - 1], f"{t['name']}.{m['name']}"))
    for _, _, name in sorted(bodies, key=lambda b: b[0]):
        found.add("function", name)
    calls = [(m.start(), m["name"]) for m in language.call.finditer(code) if m["name"] not in language.stop]
    for (_, callee), callers in zip(calls, innermost(bodies, [at for at, _ in calls]), strict=True):
        for caller in callers:
            found.add("call", callee, caller)
    if language.components:
        known = set(found.rows)
        shown = [(m.start(), m["name"]) for m in language.components.finditer(code) if m["name"] not in language.stop]
        for (_, name), callers in zip(shown, innermost(bodies, [at for at, _ in shown]), strict=True):
            for caller in callers:
                if ("call", name, caller) not in known:
                    known.add(("call", name, caller))
                    found.add("call", name, caller)
    return found


def bound_names(clause: str) -> list[str]:
    """Local names of an import clause: a default one, a namespace, and those in braces, renamed or not."""
    names = []
    first = NAME.match(clause.strip())
    if first:
        names.append(first[0])
    names += re.findall(r"\*\s+as\s+([A-Za-z_$][\w$]*)", clause)
    listed = re.search(r"\{([^}]*)\}", clause)
    for part in listed[1].split(",") if listed else ():
        words = part.split()
        words = words[1:] if len(words) > 1 and words[0] == "type" else words
        if len(words) == 3 and words[1] == "as" or len(words) == 1:
            names += [w for w in words[-1:] if NAME.fullmatch(w)]
    return names


def read_python(text: str) -> Found:
    """A Python file: functions are named after the classes around them, calls belong to the innermost function."""
    found, lines = Found(), re.split(r"\r?\n", text)
    around: list[tuple[int, str, bool]] = []  # (indent, name, whether a class) of what is open
    for line in lines:
        for pattern, parts in ((PYTHON_FROM, None), (PYTHON_IMPORT, ",")):
            m = pattern.match(line)
            if m:
                for name in m[1].split(parts) if parts else [m[1]]:
                    found.add("import", name.strip())
        indent = len(line) - len(line.lstrip())
        if line.strip():
            while around and around[-1][0] >= indent:
                around.pop()
        m = PYTHON_DECLARED.match(line)
        if m and m["type"]:
            found.add("class", m["type"])
            around.append((indent, m["type"], True))
        elif m:
            name = ".".join([n for _, n, is_type in around if is_type] + [m["name"]])
            found.add("function", name)
            around.append((indent, name, False))
        else:
            caller = next((n for _, n, is_type in reversed(around) if not is_type), None)
            for callee in PYTHON_CALL.findall(line) if caller else ():
                if callee not in PYTHON_STOP:
                    found.add("call", callee, caller)
    return found


def read_file(end: str, text: str) -> Found:
    if end in (".py", ".ipynb"):
        return read_python(text)
    return read_braced(text, BY_ENDING[end]) if end in BY_ENDING else Found()


def extract(files: DataFrame) -> DataFrame:
    """(path, at, kind, name, other) of files (path, content): their functions, classes, imports, bindings and calls.

    at numbers a file's rows from 0. A function's name has its classes before it; other is
    the caller of a call, and the module of a binding. Null contents, files of other
    endings and notebooks without code give no rows. A file is read by one task.
    """
    end = ending(F.col("path"))
    code = files.select("path", end.alias("end"), F.when(end == ".ipynb", notebook_source(F.col("content"))).otherwise(F.col("content")).alias("code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for i in range(batch.num_rows):  # a file at a time, so that a batch isn't held twice
                path, ends_in, text = (c[i].as_py() for c in batch.columns)
                for at, row in enumerate(read_file(ends_in, text).rows):
                    yield (path, at, *row)

        schema = pa.schema([("path", pa.string()), ("at", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("other", pa.string())])
        for batch in batches:
            for _, part in groupby(enumerate(rows(batch)), lambda x: x[0] // ROWS_PER_BATCH):
                columns = zip(*(r for _, r in part), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return code.where("code is not null").mapInArrow(run, "path string, at int, kind string, name string, other string")
