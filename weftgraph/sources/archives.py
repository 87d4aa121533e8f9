"""Source files out of gzipped tar archives, many at a time, wherever Spark can read them.

Archives are rows with their bytes: Spark's own binaryFile source lists and reads them
from any store, and leaves out too large ones by their length before it reads them. A
small helper walks an archive's headers inside a task; which files are kept, and how
many, is decided by columns.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ingest import KEPT_ENDINGS, ending, secret, skipped

BLOCK = 512
# Limits of an archive (packed and unpacked bytes, files) and of a file, and the endings that indexing takes.
MAX_PACKED, MAX_UNPACKED, MAX_FILES, MAX_FILE_BYTES = 25 << 20, 35 << 20, 600, 1_000_000
INDEXED_ENDINGS = [".py", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


class Unreadable(ValueError):
    """An archive that can't be walked to its end."""


def unpacked(data: bytes, limit: int) -> bytes:
    """The bytes inside a gzip, which may have several members, as long as they are no more than limit."""
    out, size = [], 0
    while data:
        stream = zlib.decompressobj(wbits=31)
        while data and not stream.eof:
            try:
                part = stream.decompress(data, 1 << 20)
            except zlib.error as error:
                raise Unreadable(f"no gzip: {error}") from None
            size += len(part)
            if size > limit:
                raise Unreadable(f"more than {limit} bytes unpacked")
            out.append(part)
            data = stream.unconsumed_tail
        if not stream.eof:
            raise Unreadable("the gzip ends too early")
        data = stream.unused_data
    return b"".join(out)


def _text(field: bytes) -> str:
    return field.split(b"\0", 1)[0].decode("utf-8", "replace")


def _number(field: bytes) -> int:
    """Octal digits up to a space or zero byte; with the first bit set, a binary number."""
    if field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    digits = field.lstrip(b" ").replace(b" ", b"\0").split(b"\0", 1)[0]
    try:
        return int(digits or b"0", 8)
    except ValueError:
        raise Unreadable("a size that is no number") from None


def entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the regular files of a tar, in order: names with their prefix, long ones by the L or x entry before."""
    at, long_name = 0, None
    while at + BLOCK <= len(data):
        header = data[at : at + BLOCK]
        if not any(header):
            return
        size, kind = _number(header[124:136]), header[156:157]
        at += BLOCK
        if at + size > len(data):
            raise Unreadable("the archive ends within a file")
        body, at = data[at : at + size], at + -(-size // BLOCK) * BLOCK
        if kind == b"L":
            long_name = _text(body)
        elif kind == b"x":
            long_name = _named_in(body) or long_name
        else:
            prefix, name = _text(header[345:500]) if header[257:263] == b"ustar\0" else "", _text(header[:100])
            name, long_name = long_name if long_name is not None else f"{prefix}/{name}" if prefix else name, None
            if kind in (b"0", b"\0", b""):
                yield name, body


def _named_in(body: bytes) -> str | None:
    """The path that an x entry's records (length, a space, key=value, a line end) give the next file."""
    at, found = 0, None
    while at < len(body):
        length = body[at : body.find(b" ", at)]
        if not length.isdigit() or not int(length):
            break
        key, _, value = body[at + len(length) + 1 : at + int(length) - 1].partition(b"=")
        found = value.decode("utf-8", "replace") if key == b"path" else found
        at += int(length)
    return found


def packed(files: Iterable[tuple[str, bytes]]) -> bytes:
    """A gzipped tar of (name, bytes); names of more than a hundred bytes have an L entry. Equal files give equal bytes."""

    def entry(name: bytes, body: bytes, kind: bytes) -> bytes:
        header = bytearray(BLOCK)
        header[: len(name[:100])] = name[:100]
        header[100:108], header[108:116], header[116:124] = b"0000644\0", b"0000000\0", b"0000000\0"
        header[124:136], header[136:148], header[148:156] = b"%011o\0" % len(body), b"%011o\0" % 0, b" " * 8
        header[156:157], header[257:265] = kind, b"ustar\x0000"
        header[148:156] = b"%06o\0 " % sum(header)
        return bytes(header) + body + bytes(-len(body) % BLOCK)

    out = []
    for name, body in files:
        raw = name.encode()
        if len(raw) > 100:
            out.append(entry(b"././@LongLink", raw + b"\0", b"L"))
        out.append(entry(raw, body, b"0"))
    return gzip.compress(b"".join(out) + bytes(2 * BLOCK), mtime=0)


def archives_in(spark: SparkSession, path: str, max_packed: int = MAX_PACKED) -> DataFrame:
    """(archive, content) of the files of a path or glob; of larger ones the content is null, and isn't read."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= max_packed).select(F.col("path").alias("archive"), "content")
    return small.unionByName(files.where(F.col("length") > max_packed).select(F.col("path").alias("archive"), F.lit(None).cast("binary").alias("content")))


def walk(archives: DataFrame, endings: list[str], max_unpacked: int = MAX_UNPACKED, max_packed: int = MAX_PACKED) -> DataFrame:
    """(archive, seq, name, size, content, problem): the files of archives (archive, content) in order, their text where an ending is wanted.

    An archive that is null, too large packed or unpacked, no gzip or cut off has one row
    with the problem and no files. Bytes that are no UTF-8 are replaced. A task holds one
    archive, packed and unpacked.
    """
    kept = tuple(endings)
    kind = archives.schema["archive"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                rows: list[tuple] = []
                try:
                    if data is None or len(data) > max_packed:
                        raise Unreadable(f"more than {max_packed} bytes packed" if data else "no content")
                    for seq, (name, body) in enumerate(entries(unpacked(data, max_unpacked))):
                        rows.append((seq, name, len(body), body.decode("utf-8", "replace") if name.lower().endswith(kept) else None, None))
                except Unreadable as error:
                    rows = [(None, None, None, None, str(error))]
                for k in range(0, len(rows), 500):
                    part = rows[k : k + 500]
                    seq, name, size, content, problem = zip(*part, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([i] * len(part))), pa.array(seq, pa.int64()), pa.array(name, pa.string()), pa.array(size, pa.int64()),
                            pa.array(content, pa.string()), pa.array(problem, pa.string()),
                        ],
                        names=["archive", "seq", "name", "size", "content", "problem"],
                    )

    return archives.select("archive", "content").mapInArrow(run, f"archive {kind}, seq long, name string, size long, content string, problem string")


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The first n files of each archive by seq; an archive's files are bounded by its size."""
    return files.withColumn("_place", F.row_number().over(Window.partitionBy("archive").orderBy("seq"))).where(F.col("_place") <= n).drop("_place")


def below_top(name: Column) -> Column:
    """A name without its first folder; empty for what lies beside it."""
    return F.regexp_extract(name, r"^[^/]*/(.*)$", 1)


def files_to_map(walked: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """(archive, seq, path, content): files to draw a graph of, below the archive's folder, the first max_files that are kept."""
    path = below_top(F.col("name"))
    rows = walked.where("problem is null").select("archive", "seq", path.alias("path"), "content").where((path != "") & ~F.col("path").endswith("/"))
    return first_files(rows.where(~skipped(F.col("path")) & ending(F.col("path")).isin(KEPT_ENDINGS)), max_files)


def files_to_index(walked: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(archive, seq, path, content): files to index symbols of, by their whole name: no tests, hidden or secret ones, none above max_bytes."""
    path = F.col("name")
    test = path.contains("/tests/") | path.contains("/test_") | path.contains("/__tests__/") | path.rlike(r"(?i)\.(test|spec)\.(ts|tsx|js|jsx)$")
    rows = walked.where((F.col("problem").isNull()) & (F.col("size") <= max_bytes)).where(~secret(path) & ~test & ~path.contains("/.") & ~path.endswith(".d.ts"))
    # Python's ending alone is told apart by case.
    wanted = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1)).isin(INDEXED_ENDINGS[1:]) | path.endswith(".py")
    return rows.where(wanted).select("archive", "seq", path.alias("path"), "content")


def problems(walked: DataFrame) -> DataFrame:
    """(archive, problem) of archives that weren't read."""
    return walked.where("problem is not null").select("archive", "problem")
