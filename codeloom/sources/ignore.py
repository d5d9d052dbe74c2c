"""Ignore rules in the manner of ``.gitignore``, as regular expressions on path columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ignore files that are read at the root, and what is left out unless configured.
IGNORE_FILES = (".gitignore", ".loomignore")
ANYWHERE = ("__pycache__", ".git")  # folders that are passed over at any depth
FOLDERS = ["node_modules", ".venv", "venv", "dist", "build", "target", "__pycache__", ".git"]
EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".tar", ".gz", ".so", ".dll", ".exe", ".bin", ".woff", ".woff2", ".ttf", ".mp4", ".mp3", ".lock"]


def compile_rule(line: str) -> tuple[bool, str] | None:
    """Whether the rule ignores (else it takes back), and its pattern for whole paths."""
    if not line.strip() or line.startswith("#"):
        return None
    line = re.sub(r"(?<!\\)\s+$", "", line)
    ignores = not line.startswith("!")
    line = line if ignores else line[1:]
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    parts = line.lstrip("/").split("/")
    out = "" if anchored else "(?:.*/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
            continue
        out += _glob(part) + ("" if last else "/")
    return ignores, f"^{out}" + ("/.*$" if folder else "(?:/.*)?$")


def _glob(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := part.find("]", i + 2)) > 0:
            body = part[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(c)
        i += 1
    return out


@dataclass
class IgnoreRules:
    """Several rule files, each with the last match deciding; a path that any of them ignores, or
    that lies in one of ``folders`` (from the root), is ignored."""

    files: list[list[str]] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)

    def ignored(self, path: Column) -> Column:
        out = F.lit(False)
        for lines in self.files:
            rule = F.lit(False)
            for compiled in filter(None, map(compile_rule, lines)):
                rule = F.when(path.rlike(compiled[1]), F.lit(compiled[0])).otherwise(rule)
            out = out | rule
        names = [f.strip("/") for f in self.folders if f.strip("/")]
        if names:
            out = out | path.rlike("^(?:" + "|".join(map(re.escape, names)) + ")(?:/|$)")
        return out

    def ignores(self, path: str) -> bool:
        return self.matcher()(path, False)

    def matcher(self) -> Callable[[str, bool], bool]:
        """Whether a path below the root is passed over, for walks that do not enter a folder of which
        this holds.  The second argument says that the path is a folder's: rules that end in a slash
        only hold for those, and ``ANYWHERE`` does."""
        files = []
        for lines in self.files:
            compiled = filter(None, map(compile_rule, lines))
            files.append([(ignores, re.compile(pattern), pattern.endswith("/.*$")) for ignores, pattern in compiled][::-1])
        roots = {f.strip("/") for f in self.folders if f.strip("/")}

        def passed_over(path: str, folder: bool) -> bool:
            if folder and path.rsplit("/", 1)[-1] in ANYWHERE or path in roots or any(path.startswith(f + "/") for f in roots):
                return True
            for rules in files:
                for ignores, pattern, folders_only in rules:
                    if pattern.match(path + "/" if folder and folders_only else path):
                        if ignores:
                            return True
                        break
            return False

        return passed_over
