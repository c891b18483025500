"""Which files of a folder count: rules of .gitignore files, hidden files, folders of generated files."""

from __future__ import annotations

import os
import re
from pathlib import Path

GENERATED = {"node_modules", "target", "dist", "build"}
SUFFIXES = (".md", ".mdx", ".txt")


def _pattern(glob: str) -> str:
    """Regular expression of a glob in which * and ? do not match ``/`` and ** does."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
            continue
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


class Rules:
    """The rules of one ignore file; a later rule beats an earlier one."""

    def __init__(self, text: str, base: Path):
        self.base, self.rules = base, []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keeps = line.startswith("!")
            line = line[1:] if keeps else line.removeprefix("\\") if line[:2] in ("\\!", "\\#") else line
            folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            line = line.lstrip("/")
            if line:
                self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + _pattern(line) + r"\Z", re.S), folder, keeps))

    def verdict(self, path: Path, folder: bool) -> bool | None:
        """True: ignored; False: kept by a ``!`` rule; None: no rule says anything."""
        try:
            name = path.relative_to(self.base).as_posix()
        except ValueError:
            return None
        for rule, only_folders, keeps in reversed(self.rules):
            if (folder or not only_folders) and rule.match(name):
                return not keeps
        return None


def _rules(folder: Path) -> list[Rules]:
    file = folder / ".gitignore"
    return [Rules(file.read_text(errors="replace"), folder)] if file.is_file() else []


def visible_files(root: str | Path) -> list[str]:
    """Relative paths, in order, of the text files under ``root`` that no rule hides.

    Rules of parent folders up to the enclosing work tree, and its exclude file, count too. The root itself may be hidden.
    """
    root = Path(root).resolve()
    start: list[Rules] = []
    for folder in [root, *root.parents]:
        if (folder / ".git").exists():
            exclude = folder / ".git" / "info" / "exclude"
            if exclude.is_file():
                start.append(Rules(exclude.read_text(errors="replace"), folder))
            break
    for folder in reversed(root.parents):
        start += _rules(folder)
    out: list[str] = []
    stack = [(root, start)]
    while stack:
        folder, rules = stack.pop()
        rules = rules + _rules(folder)
        with os.scandir(folder) as entries:
            for entry in entries:
                path, is_folder = Path(entry.path), entry.is_dir(follow_symlinks=False)
                if entry.name.startswith(".") or (is_folder and entry.name in GENERATED):
                    continue
                said = next((v for r in reversed(rules) if (v := r.verdict(path, is_folder)) is not None), False)
                if said:
                    continue
                if is_folder:
                    stack.append((path, rules))
                elif entry.is_file() and entry.name.endswith(SUFFIXES):
                    out.append(path.relative_to(root).as_posix())
    return sorted(out)
