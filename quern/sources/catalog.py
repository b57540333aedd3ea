"""A catalog of databases: a small JSON registry on the driver, re-read at each access and written atomically."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid

from pyspark.sql import SparkSession

from quern.sources.store import ChunkStore, import_archive

DEFAULTS = {"embeddingModel": "bge-m3", "dimension": 1024}


def valid_name(name: str) -> str:
    name = (name or "").strip()
    if not name or len(name) > 100 or any(ord(c) < 32 or ord(c) == 127 for c in name):
        raise ValueError("invalid database name")
    return name


class Catalog:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.file = spark, os.path.abspath(base), os.path.join(os.path.abspath(base), "registry.json")
        os.makedirs(base, exist_ok=True)
        if not os.path.exists(self.file):
            self._save({"activeDatabase": "default", "databases": [self._entry("default", "Default")]})

    def _entry(self, db_id: str, name: str, **more: object) -> dict:
        now = time.strftime("%Y-%m-%d %H:%M:%S")
        return {"id": db_id, "name": name, "folderName": db_id, "createdAt": now, "updatedAt": now} | DEFAULTS | more

    def _load(self) -> dict:
        with open(self.file, encoding="utf-8") as f:
            state = json.load(f)
        for d in state["databases"]:  # older registries hold a path of any system
            if "folderName" not in d:
                d["folderName"] = re.split(r"[\\/]", d.pop("path", d["id"]).rstrip("\\/"))[-1]
        return state

    def _save(self, state: dict) -> None:
        with open(f"{self.file}.tmp", "w", encoding="utf-8") as f:
            json.dump(state, f, indent=1)
        os.replace(f"{self.file}.tmp", self.file)

    def list(self) -> list[dict]:
        return self._load()["databases"]

    def active(self) -> str:
        return self._load()["activeDatabase"]

    def info(self, db_id: str) -> dict:
        return next((d for d in self.list() if d["id"] == db_id), None) or self._missing(db_id)

    def _missing(self, db_id: str) -> dict:
        raise KeyError(db_id)

    def _path(self, entry: dict) -> str:
        path = os.path.abspath(os.path.join(self.base, entry["folderName"]))
        if os.path.dirname(path) != self.base:
            raise ValueError("database folder outside the catalog")
        return path

    def store(self, db_id: str | None = None) -> ChunkStore:
        entry = self.info(db_id or self.active())
        return ChunkStore(self.spark, self._path(entry), entry["dimension"])

    def create(self, name: str, model: str | None = None, dimension: int | None = None) -> dict:
        state, entry = self._load(), self._entry(f"db_{uuid.uuid4().hex[:8]}", valid_name(name))
        entry |= {k: v for k, v in (("embeddingModel", model), ("dimension", dimension)) if v}
        self._save(state | {"databases": [*state["databases"], entry]})
        return entry

    def _change(self, db_id: str, **values: object) -> dict:
        self.info(db_id)
        state = self._load()
        for d in state["databases"]:
            if d["id"] == db_id:
                d |= values | {"updatedAt": time.strftime("%Y-%m-%d %H:%M:%S")}
        self._save(state)
        return self.info(db_id)

    def rename(self, db_id: str, name: str) -> dict:
        return self._change(db_id, name=valid_name(name))

    def activate(self, db_id: str) -> None:
        self.info(db_id)
        self._save(self._load() | {"activeDatabase": db_id})

    def delete(self, db_id: str) -> None:
        entry = self.info(db_id)
        if db_id == self.active():
            raise ValueError("the active database can't be deleted")
        path = self._path(entry)
        state = self._load()
        self._save(state | {"databases": [d for d in state["databases"] if d["id"] != db_id]})
        shutil.rmtree(path, ignore_errors=True)

    def export(self, db_id: str, path: str) -> None:
        self.store(db_id).export(path, self.info(db_id)["embeddingModel"])

    def import_(self, path: str, name: str) -> dict:
        entry = self._entry(f"db_{uuid.uuid4().hex[:8]}", valid_name(name))
        meta = import_archive(self.spark, path, self._path(entry))
        entry |= {"embeddingModel": meta.get("embeddingModel", "unknown"), "dimension": meta["dimension"]}
        state = self._load()
        self._save(state | {"databases": [*state["databases"], entry]})
        return entry
