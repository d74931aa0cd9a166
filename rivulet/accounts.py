"""Users of a session's catalog, and files that they have uploaded."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from rivulet.errors import QueryError
from rivulet.storage import delete

ROOT = "root"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds")


@dataclass
class User:
    """Passwords are kept as salted hashes only."""

    id: int
    name: str
    created: str = field(default_factory=_now)
    modified: str | None = None
    salt: bytes = b""
    digest: bytes = b""

    def set(self, password: str) -> None:
        self.salt = os.urandom(16)
        self.digest = hashlib.scrypt(password.encode(), salt=self.salt, n=1 << 12, r=8, p=1)

    def matches(self, password: str) -> bool:
        return bool(self.digest) and hashlib.scrypt(password.encode(), salt=self.salt, n=1 << 12, r=8, p=1) == self.digest

    def describe(self) -> dict:
        return {"id": self.id, "name": self.name, "createTime": self.created, **({"lastModifyTime": self.modified} if self.modified else {})}


class Users:
    """The accounts of a catalog. ``owner`` is who runs the statements; only root creates, lists and drops users."""

    def __init__(self, owner: str = ROOT):
        self.all: dict[str, User] = {ROOT: User(0, ROOT)}
        if owner != ROOT:
            self.all[owner] = User(1, owner)
        self.owner, self.next = owner, 2

    def _root(self) -> None:
        if self.owner != ROOT:
            raise QueryError("permission denied")

    def _known(self, name: str) -> User:
        if name not in self.all:
            raise QueryError(f"no user {name}")
        return self.all[name]

    def create(self, name: str, password: str) -> None:
        self._root()
        if name in self.all:
            raise QueryError(f"user {name} exists already")
        own = User(self.next, name)
        own.set(password)
        self.all[name], self.next = own, self.next + 1

    def alter(self, name: str, password: str) -> None:
        """Root changes any password, others their own."""
        if name != self.owner:
            self._root()
        own = self._known(name)
        own.set(password)
        own.modified = _now()

    def drop(self, name: str, busy: bool) -> None:
        """``busy``: the user has topologies or tuples, and can't go."""
        self._root()
        if name == ROOT:
            raise QueryError("permission denied")
        self._known(name)
        if busy:
            raise QueryError(f"{name} has topologies or tuples")
        del self.all[name]

    def describe(self) -> str:
        return json.dumps(self.all[self.owner].describe())

    def show(self) -> str:
        self._root()
        return json.dumps([u.describe() for u in self.all.values()])


class Files:
    """Uploaded files by name, kept in a folder that any store of Spark may hold."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark, self.folder = spark, folder
        self.all: dict[str, dict] = {}

    def upload(self, path: str) -> None:
        if self.folder is None:
            raise QueryError("UPLOAD needs a session with a warehouse folder")
        if not os.path.isfile(path):
            raise QueryError(f"no file {path}")
        name = os.path.basename(path)
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        to = make(f"{self.folder}/{name}")
        to.getFileSystem(self.spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, make(f"file://{os.path.abspath(path)}"), to)
        with open(path, "rb") as f:
            content = f.read()
        self.all[name] = {"name": name, "size": len(content), "checksum": hashlib.md5(content).hexdigest(), "createTime": _now()}  # noqa: S324 (a checksum)

    def known(self, name: str) -> dict:
        if name not in self.all:
            raise QueryError(f"no file {name}")
        return self.all[name]

    def drop(self, name: str) -> None:
        self.known(name)
        delete(self.spark, f"{self.folder}/{name}")
        del self.all[name]

    def text(self, name: str) -> str | None:
        """The content of an uploaded file; None where there is none of that name."""
        return self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0] if name in self.all else None
