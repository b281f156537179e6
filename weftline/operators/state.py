"""Versioned state tables: a write adds Parquet snapshots of one site's rows and then a numbered manifest that names them."""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge import ITEM

SCHEMA_VERSION = 2
TABLES = {
    "items": ITEM,
    "validators": "site_id string, url string, etag string, last_modified string, hints_hash string, fetched_at timestamp, status int",
    "site_state": "site_id string, last_run_at timestamp, last_success_at timestamp, last_change_at timestamp, last_error string",
    "feed_stamps": "path string, etag string, modified_at timestamp",
}
_MANIFEST = re.compile(r"manifest-(\d+)\.json")


class ConcurrentWrite(RuntimeError):
    """Another writer has added a manifest since this one was read."""


class Store:
    """Tables under one folder of any file system that Spark reads. Readers keep the snapshot they opened.

    Manifests are numbered and never changed: the newest one that is whole says what the
    tables are. A write that stops anywhere leaves the one before it in force.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = self._manifest()["schema_version"]
        if found > SCHEMA_VERSION:
            raise ValueError(f"state was written by a newer schema ({found})")
        if found < SCHEMA_VERSION:
            self._migrate()

    def _names(self) -> list[str]:
        at = self._path(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _json(self, name: str) -> dict | None:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def _manifest(self) -> dict:
        """The newest whole manifest: number, schema_version, tables {name: {site: folder}}."""
        names = self._names()
        for n in sorted((int(m[1]) for x in names if (m := _MANIFEST.fullmatch(x))), reverse=True):
            if got := self._json(f"manifest-{n:08}.json"):
                return {"number": n, **got}
        if "manifest.json" in names and (old := self._json("manifest.json")):  # schema 1: one snapshot a table, the manifest replaced in place
            return {"number": 0, "schema_version": old["schema_version"], "tables": {k: {"": f"{k}/v{v}"} for k, v in old["tables"].items()}}
        return {"number": 0, "schema_version": SCHEMA_VERSION, "tables": {}}

    def _migrate(self) -> None:
        """From schema 1: each table's rows are written by site."""
        old = self._manifest()
        tables: dict[str, dict[str, str]] = {}
        for name, folders in old["tables"].items():
            rows = self._open(name, list(folders.values()))
            if name == "feed_stamps":
                tables[name] = folders
                continue
            for r in rows.select("site_id").distinct().collect():  # one row a configured site
                folder = tables.setdefault(name, {})[r["site_id"]] = self._folder(name, r["site_id"])
                rows.where(F.col("site_id") == r["site_id"]).write.parquet(f"{self.path}/{folder}")
        self._commit({"number": old["number"], "tables": tables})

    def _folder(self, name: str, site: str) -> str:
        return f"{name}/{quote(site, safe='') or 'all'}/{uuid.uuid4().hex}"

    def _open(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.path}/{f}" for f in folders])

    def _commit(self, manifest: dict) -> None:
        """Make the next manifest: written whole under another name, then renamed to a number that must be free."""
        n = manifest["number"] + 1
        new, name = self._path(f"{self.path}/.manifest-{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest-{n:08}.json")
        stream = self._fs.create(new, False)
        stream.write(json.dumps({"schema_version": SCHEMA_VERSION, "tables": manifest["tables"]}).encode())
        stream.close()
        if self._fs.exists(name) or not self._fs.rename(new, name):
            self._fs.delete(new, False)
            raise ConcurrentWrite(f"manifest {n} is there already")

    def version(self) -> int:
        return self._manifest()["number"]

    def read(self, name: str, site: str | None = None) -> DataFrame:
        """A table, or one site's rows of it, of which alone files are opened."""
        folders = self._manifest()["tables"].get(name, {})
        chosen = list(folders.values()) if site is None else [f for s, f in folders.items() if s == site]
        return self._open(name, chosen) if chosen else self.spark.createDataFrame([], TABLES[name])

    def write(self, site: str = "", **tables: DataFrame) -> None:
        """One site's rows of the tables become visible together, with the next manifest; other sites' files stay."""
        manifest = self._manifest()
        for name, df in tables.items():
            folder = self._folder(name, site)
            df.select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.parquet(f"{self.path}/{folder}")
            manifest["tables"].setdefault(name, {})[site] = folder
        self._commit(manifest)

    def vacuum(self, keep: int = 2) -> None:
        """Drop what none of the last ``keep`` manifests names, and the manifests before them."""
        numbers = sorted(int(m[1]) for x in self._names() if (m := _MANIFEST.fullmatch(x)))
        kept = {f for n in numbers[-keep:] for t in ((self._json(f"manifest-{n:08}.json") or {}).get("tables") or {}).values() for f in t.values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifest-{n:08}.json"), False)
        for name in TABLES:
            at = self._path(f"{self.path}/{name}")
            for site in self._fs.listStatus(at) if self._fs.exists(at) else []:
                for one in self._fs.listStatus(site.getPath()):
                    if f"{name}/{site.getPath().getName()}/{one.getPath().getName()}" not in kept:
                        self._fs.delete(one.getPath(), True)
