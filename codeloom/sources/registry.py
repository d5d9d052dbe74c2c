"""Configuration, workspaces and repository lists: small files on the driver."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tempfile
import time
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.ignore import EXTENSIONS, FOLDERS

DEFAULTS: dict[str, Any] = {
    "version": 1,
    "llm": {"provider": "openai", "model": "", "api_base": ""},
    "embeddings": {"engine": "hashed", "size": 384},
    "indexing": {"ignore_folders": FOLDERS, "max_file_size_kb": 512, "exclude_extensions": EXTENSIONS},
    "workspaces": [],
}
WORKSPACE = "id string, name string, path string, source string, git_url string, created double, last_sync double, last_index_state string"
GIT_URL = re.compile(r"^(https?://|git@)\S+$")


class Registry:
    """Settings and workspaces in one JSON file, replaced as a whole."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def load(self) -> dict[str, Any]:
        """What is stored over the defaults, one level deep; an unreadable file counts as empty."""
        try:
            stored = json.loads(self.path.read_text())
        except (OSError, ValueError):
            stored = {}
        stored = stored if isinstance(stored, dict) else {}
        merged = {k: {**v, **stored.get(k, {})} if isinstance(v, dict) and isinstance(stored.get(k, {}), dict) else stored.get(k, v) for k, v in DEFAULTS.items()}
        return {**stored, **merged}

    def save(self, config: dict[str, Any]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=self.path.parent, delete=False) as f:
            json.dump(config, f, indent=1)
        os.replace(f.name, self.path)

    def update(self, section: str, patch: dict[str, Any]) -> dict[str, Any]:
        config = self.load()
        config[section] = {**config.get(section, {}), **patch} if isinstance(config.get(section, {}), dict) else patch
        kb = config["indexing"]["max_file_size_kb"]
        if not 1 <= kb <= 10240:
            raise ValueError("max_file_size_kb must lie between 1 and 10240")
        self.save(config)
        return config

    def workspaces(self) -> list[dict[str, Any]]:
        return self.load()["workspaces"]

    def workspace(self, key: str) -> dict[str, Any]:
        for w in self.workspaces():
            if w["id"] == key:
                return w
        raise KeyError(f"no workspace {key}")

    def by_path(self, path: str) -> dict[str, Any] | None:
        return next((w for w in self.workspaces() if w["path"] == path), None)

    def _replace(self, rows: list[dict[str, Any]]) -> None:
        self.save({**self.load(), "workspaces": rows})

    def add(self, name: str, path: str, source: str = "local", git_url: str = "") -> dict[str, Any]:
        rows = self.workspaces()
        if path in {w["path"] for w in rows}:
            raise ValueError(f"{path} is a workspace already")
        fresh = dict.fromkeys(f.split(" ")[0] for f in WORKSPACE.split(", "))
        fresh |= {"id": uuid.uuid4().hex[:12], "name": name, "path": path, "source": source, "git_url": git_url, "created": time.time(), "last_index_state": "pending"}
        self._replace([*rows, fresh])
        return fresh

    def change(self, key: str, **fields: Any) -> dict[str, Any]:
        changed = self.workspace(key) | fields
        self._replace([changed if w["id"] == key else w for w in self.workspaces()])
        return changed

    def remove(self, key: str) -> bool:
        rows = {w["id"]: w for w in self.workspaces()}
        gone = rows.pop(key, None) is not None
        if gone:
            self._replace(list(rows.values()))
        return gone

    def latest(self) -> str | None:
        """The workspace synced last, else the one created last."""
        rows = self.workspaces()
        return max(rows, key=lambda w: (w.get("last_sync") or 0, w.get("created") or 0))["id"] if rows else None

    def frame(self, spark: SparkSession) -> DataFrame:
        names = [f.split(" ")[0] for f in WORKSPACE.split(", ")]
        return spark.createDataFrame([tuple(w.get(n) for n in names) for w in self.workspaces()], WORKSPACE)


def clone(url: str, into: str | Path, name: str = "") -> Path:
    """A shallow clone of one branch."""
    if not GIT_URL.match(url):
        raise ValueError("not a git address")
    slug = re.sub(r"[^\w.-]+", "-", name or url.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git")).strip("-.") or "repo"
    to = Path(into) / slug
    subprocess.run(["git", "clone", "--depth", "1", "--single-branch", "--", url, str(to)], check=True, capture_output=True, timeout=600)
    return to


def read_repo_list(text: str) -> list[dict[str, Any]]:
    """Repositories of a YAML list of flat entries: id, name, description, languages (6 at most), loc.

    Entries without an id are left out."""
    out: list[dict[str, Any]] = []
    row: dict[str, Any] | None = None
    key = ""
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        pair = re.match(r"(?:- )?([A-Za-z_]\w*):\s*(.*)$", body)
        if body.startswith("- ") and pair:
            row = {}
            out.append(row)
        if row is None:
            continue
        if pair:
            key, value = pair[1], pair[2].strip()
            row[key] = [v.strip().strip("'\"") for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") else value.strip("'\"") if value else []
        elif body.startswith("- ") and indent and isinstance(row.get(key), list):
            row[key].append(body[2:].strip().strip("'\""))
    clean = []
    for r in out:
        if r.get("id"):
            loc = str(r.get("loc") or 0)
            clean.append({"id": str(r["id"]), "name": str(r.get("name") or r["id"]), "description": str(r.get("description") or ""), "languages": list(r.get("languages") or [])[:6], "loc": int(loc) if loc.isdigit() else 0})
    return clean


def sanitise_keys(given: Any) -> dict[str, str]:
    """Only an API key and base, trimmed, of 1 to 4096 characters."""
    if not isinstance(given, dict):
        return {}
    return {k: given[k].strip() for k in ("api_key", "api_base") if isinstance(given.get(k), str) and 0 < len(given[k].strip()) <= 4096}
