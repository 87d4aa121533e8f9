"""Archives: walking against the standard library's reader, limits, filters, files in a folder."""

import gzip
import io
import tarfile

import pytest

from weftgraph.sources import archives

NAMES = ["top/a.py", "top/" + "d" * 120 + "/b.ts", "top/" + "é" * 80 + "/" + "x" * 90 + ".py", "top/" + "p" * 90 + "/" + "q" * 40 + ".py", "top/empty.py", "top/sub/one.txt"]


def written(form, files, link=False):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=form) as t:
        folder = tarfile.TarInfo("top")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for name, body in files:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        if link:
            info = tarfile.TarInfo("top/link.py")
            info.type, info.linkname = tarfile.SYMTYPE, "a.py"
            t.addfile(info)
    return gzip.compress(out.getvalue())


FILES = [(n, b"" if "empty" in n else (n * 30).encode()) for n in NAMES]


@pytest.mark.parametrize("form", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT, tarfile.USTAR_FORMAT])
def test_walking_equals_the_standard_reader(form):
    files = [f for f in FILES if form != tarfile.USTAR_FORMAT or len(f[0].encode()) < 200]
    assert list(archives.entries(archives.unpacked(written(form, files, True), 1 << 20))) == files


def test_packing_is_read_by_the_standard_reader():
    with tarfile.open(fileobj=io.BytesIO(archives.packed(FILES)), mode="r:gz") as t:
        assert [(m.name, t.extractfile(m).read()) for m in t.getmembers()] == FILES
    assert list(archives.entries(archives.unpacked(archives.packed(FILES), 1 << 20))) == FILES
    assert list(archives.entries(archives.unpacked(archives.packed([]), 1 << 20))) == []


def test_several_members_and_binary_sizes():
    data = archives.packed(FILES)
    assert archives.unpacked(data + data, 1 << 30) == archives.unpacked(data, 1 << 30) * 2
    assert archives._number(b"\x80" + (77).to_bytes(11, "big")) == 77 and archives._number(b"0000017 \0   ") == 15 and archives._number(b"\0" * 12) == 0


def test_limits_and_broken_archives(spark):
    good, plain = archives.packed(FILES), gzip.compress(b"x" * 700)
    rows = [
        ("good", good), ("null", None), ("no gzip", b"abc"), ("cut gzip", good[: len(good) // 2]), ("large", archives.packed([("t/a.py", b"y" * 90000)])), ("empty", b""),
        ("cut tar", gzip.compress(archives.unpacked(good, 1 << 20)[:600])), ("packed", bytes(5000)), ("no size", gzip.compress(b"a" * 124 + b"zzzzzzzzzzz\0" + b"0" * 400)), ("short", plain),
    ]
    found = archives.walk(spark.createDataFrame(rows, "archive string, content binary"), [".py"], max_unpacked=60_000, max_packed=4000)
    told = {r["archive"]: r["problem"] for r in archives.problems(found).collect()}
    assert set(told) == {"null", "no gzip", "cut gzip", "cut tar", "packed", "no size", "short", "large"}  # nothing at all is an archive without files
    assert [r["name"] for r in found.where("archive = 'good'").orderBy("seq").collect()] == NAMES
    assert found.where("archive = 'good' and name like '%.txt'").first()["content"] is None


def test_what_is_kept(spark):
    names = [
        "r/a.py", "r/src/b.ts", "r/src/b.test.ts", "r/node_modules/x.js", "r/.hid/x.py", "r/vite.config.ts", "r/x.d.ts", "r/tests/t.py", "r/test_z.py", "r/src/.env.py", "r/k.pem",
        "r/A.PY", "r/big.py", "r/x.java", "r/style.css", "beside.py", "r/secrets/y.py", "r/credentials.js",
    ]
    data = archives.packed([(n, b"z" * (2000 if "big" in n else 5)) for n in names])
    walked = archives.walk(spark.createDataFrame([("one", data), ("two", data)], "archive string, content binary"), archives.KEPT_ENDINGS)
    kept = archives.files_to_map(walked, 5).where("archive = 'two'").orderBy("seq").collect()
    assert [r["path"] for r in kept] == ["a.py", "src/b.ts", "tests/t.py", "test_z.py", "src/.env.py"]
    assert archives.files_to_map(walked).where("archive = 'one'").count() == 10
    index = archives.files_to_index(walked, 1000).where("archive = 'one'").orderBy("seq").collect()
    assert [r["path"] for r in index] == ["r/a.py", "r/src/b.ts", "r/vite.config.ts", "beside.py", "r/secrets/y.py"]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.tar.gz").write_bytes(archives.packed(FILES))
    (tmp_path / "b.tar.gz").write_bytes(archives.packed(FILES) + bytes(5000))
    found = archives.archives_in(spark, f"{tmp_path}/*.tar.gz", max_packed=4000)
    walked = archives.walk(found, [".py"])
    assert archives.files_to_map(walked).count() == 5 and archives.problems(walked).count() == 1
