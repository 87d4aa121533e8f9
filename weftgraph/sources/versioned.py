"""Tables of repositories whose versions are manifests of immutable folders.

A table is cut into parts by a column, and a part's rows lie in a folder that nothing
changes once it is written. A manifest names the folders of all tables of a store. A
commit writes new folders for the parts it changes and then one new manifest, so that
readers see all of it or nothing, and tables that belong together change together. Two
commits that start from one version can't both succeed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "_part"


class Conflict(RuntimeError):
    """Another commit has come first."""


class Refused(RuntimeError):
    """Rows that don't belong to the one who writes them."""


@dataclass
class Change:
    """What a commit does to a table: rows replace all rows of the parts they lie in, and of the further parts named."""

    rows: DataFrame | None = None
    parts: list[str] = field(default_factory=list)


class VersionedTables:
    """The tables of one root folder, which all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("versions"))

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def version(self) -> int:
        """The last version; 0 if nothing has been committed."""
        return max((int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "note", "tables": {name: {"schema", "parts": {part: folder}}}}; its size is the number of parts."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "note": "", "tables": {}}
        stream = self._fs.open(self._path(f"versions/{version:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """A table as of a version (the last one), or only some of its parts; each row with its part in _part."""
        table = self.manifest(version)["tables"][name]
        schema = StructType.fromJson(table["schema"])
        folders = [f"{self.root}/{f}" for p, f in table["parts"].items() if parts is None or p in parts]
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn(PART, F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*folders)
        return rows.withColumn(PART, F.regexp_extract(F.col("_metadata.file_path"), rf"/{PART}=([^/]*)/", 1))

    def commit(self, changes: dict[str, Change], *, base: int | None = None, note: str = "", keep: tuple[str, ...] | None = None) -> int:
        """Makes a version out of version base (the last one) and changes, whose rows have their part in _part.

        Raises Conflict if another version has come after base, and whatever a plan of
        the rows raises; in both cases nothing has changed for readers. keep names the
        tables that stay; others are left out of the new version. Where the store's
        rename refuses an existing name (as HDFS does) one of two writers wins.
        """
        base = self.version() if base is None else base
        manifest = self.manifest(base)
        tables = {n: {"schema": t["schema"], "parts": dict(t["parts"])} for n, t in manifest["tables"].items() if keep is None or n in keep}
        for name, change in changes.items():
            table = tables.setdefault(name, {"schema": None, "parts": {}})
            for part in change.parts:
                table["parts"].pop(part, None)
            if change.rows is not None:
                folder = f"data/{name}-{uuid.uuid4().hex}"
                rows = change.rows.withColumn(PART, F.col(PART).cast("string"))
                table["schema"] = json.loads(rows.drop(PART).schema.json())
                rows.write.partitionBy(PART).parquet(f"{self.root}/{folder}")
                for written in self._names(folder):
                    if written.startswith(f"{PART}="):
                        table["parts"][written[len(PART) + 1 :]] = f"{folder}/{written}"
        tables = {n: t for n, t in tables.items() if t["schema"]}
        target, draft = self._path(f"versions/{base + 1:012d}.json"), self._path(f"versions/draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": base + 1, "note": note, "tables": tables}).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {base + 1} is there already")
        return base + 1

    def last_with(self, note: str) -> int | None:
        """The last version with a note, None without one; versions are read from the last backwards."""
        for version in range(self.version(), 0, -1):
            if self.manifest(version)["note"] == note:
                return version
        return None


def owned(rows: DataFrame, repos: DataFrame, owner: Column | str | int) -> DataFrame:
    """The same rows (repo_id), whose plan fails when one is of a repository (id, owner_id) that isn't the owner's, or of none."""
    owner = owner if isinstance(owner, Column) else F.lit(owner)
    own = repos.select(F.col("id").alias("_repo"), F.col("owner_id").alias("_owner"))
    checked = rows.join(own, F.col("repo_id") == F.col("_repo"), "left")
    ours = F.col("_owner").eqNullSafe(owner) & owner.isNotNull()
    told = F.concat(F.lit("not the owner's repository: "), F.coalesce(F.col("repo_id").cast("string"), F.lit("null")))
    # The key itself passes through the check, so no optimisation can leave it out.
    return checked.withColumn("repo_id", F.when(ours, F.col("repo_id")).otherwise(F.raise_error(told).cast(rows.schema["repo_id"].dataType))).select(*rows.columns)


@dataclass
class RepositoryStore:
    """Repositories with what hangs on them: repos (id, owner_id, visibility, updated_at, ...), other tables by repo_id."""

    tables: VersionedTables
    dependents: tuple[str, ...] = ("symbols", "edges")

    def _refusing(self, action) -> int:
        try:
            return action()
        except Conflict:
            raise
        except Exception as error:
            if "not the owner's repository" in str(error):
                raise Refused(str(error).split("not the owner's repository", 1)[1].split("\n")[0].strip(": ")) from None
            raise

    def register(self, repos: DataFrame, **more) -> int:
        """Adds repositories, or writes theirs again: a part each."""
        return self.tables.commit({"repos": Change(repos.withColumn(PART, F.col("id").cast("string")))}, **more)

    def replace(self, owner: str | int, rows: dict[str, DataFrame], **more) -> int:
        """Writes the rows of repositories anew in each table given; refused as a whole if one isn't the owner's."""
        repos = self.tables.read("repos").drop(PART)
        changes = {n: Change(owned(r, repos, owner).withColumn(PART, F.col("repo_id").cast("string"))) for n, r in rows.items()}
        return self._refusing(lambda: self.tables.commit(changes, note=f"replace by {owner}", **more))

    def _named(self, owner: str | int, gone: DataFrame) -> list[str]:
        """The parts of some repositories of an owner (one column, repo_id): a request's own list, as many as it states."""
        repos = self.tables.read("repos").drop(PART)
        return [str(r["repo_id"]) for r in owned(gone.select("repo_id").distinct(), repos, owner).collect()]

    def delete(self, owner: str | int, gone: DataFrame, **more) -> int:
        """Deletes an owner's repositories and the rows that hang on them, in one version."""

        def act() -> int:
            parts = self._named(owner, gone)
            return self.tables.commit({n: Change(None, parts) for n in ("repos", *self.dependents)}, note=f"delete by {owner}", **more)

        return self._refusing(act)

    def set_visibility(self, owner: str | int, repo_ids: DataFrame, visibility: str, **more) -> int:
        """Makes an owner's repositories private or public; only their own parts are written."""
        if visibility not in ("private", "public"):
            raise ValueError("visibility is private or public")

        def act() -> int:
            parts = self._named(owner, repo_ids)
            rows = self.tables.read("repos", parts=parts).withColumn("visibility", F.lit(visibility))
            return self.tables.commit({"repos": Change(rows)}, note=f"visibility by {owner}", **more)

        return self._refusing(act)

    def listed(self, owner: str | int) -> DataFrame:
        """An owner's repositories, the last updated first, ties by id."""
        return self.tables.read("repos").drop(PART).where(F.col("owner_id") == owner).orderBy(F.desc("updated_at"), "id")

    def visible(self, name: str, owner: str | int) -> DataFrame:
        """Rows of a table that an owner may read: those of their own and of public repositories."""
        repos = self.tables.read("repos")
        seen = repos.where((F.col("owner_id") == owner) | (F.col("visibility") == "public")).select(F.col("id").alias("repo_id"))
        return self.tables.read(name).drop(PART).join(seen, "repo_id", "left_semi")
