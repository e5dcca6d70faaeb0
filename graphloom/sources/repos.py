"""Repository discovery on the driver: roots, workspaces, worktrees, module names."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Target:
    label: str
    root: str


def git_dir(path: Path) -> Path | None:
    """The git folder of a work tree: ``.git`` itself, or where a ``.git`` file points."""
    dot = path / ".git"
    if dot.is_file():
        first = dot.read_text(errors="replace").strip()
        if not first.startswith("gitdir:"):
            return None
        found = (path / first.removeprefix("gitdir:").strip()).resolve()
    elif dot.is_dir():
        found = dot
    else:
        return None
    return found if (found / "HEAD").exists() else None


def toplevel(start: str | Path) -> Path | None:
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if git_dir(p)), None)


def root_of(start: str | Path) -> Path:
    """The nearest ancestor that is a work tree, else the path itself, resolved."""
    return toplevel(start) or Path(start).resolve()


def common_dir(root: str | Path) -> str | None:
    """The git folder that worktrees of one repository share."""
    own = git_dir(Path(root))
    if own is None:
        return None
    link = own / "commondir"
    return str((own / link.read_text().strip()).resolve()) if link.exists() else str(own.resolve())


def automatic_targets(start: str | Path) -> list[Target]:
    """One repository, or the two or more work trees right below, or nothing."""
    top = toplevel(start)
    if top:
        return [Target(top.name, str(top))]
    here = Path(start).resolve()
    children = sorted(p for p in here.iterdir() if p.is_dir() and git_dir(p)) if here.is_dir() else []
    return [Target(p.name, str(p.resolve())) for p in children] if len(children) >= 2 else []


def targets(start: str | Path) -> list[Target]:
    found = automatic_targets(start)
    here = Path(start).resolve()
    return found or [Target(here.name, str(here))]


def target_scope(found: list[Target], scope: str | None) -> tuple[list[Target], str | None]:
    """Route ``repo/path`` of a workspace to its repository; an empty scope is none."""
    scope = (scope or "").strip("/")
    if not scope:
        return found, None
    if len(found) == 1:
        return found, scope
    head, _, rest = scope.partition("/")
    chosen = [t for t in found if t.label == head]
    if not chosen:
        raise ValueError(f"no repository {head!r} in this workspace")
    return chosen, rest or None


def go_module(root: str | Path) -> str | None:
    """The module line of ``go.mod`` at the root."""
    path = Path(root) / "go.mod"
    if not path.is_file():
        return None
    for line in path.read_text(errors="replace").splitlines():
        name = line.strip().removeprefix("module ").strip() if line.strip().startswith("module ") else ""
        if name:
            return name
    return None


def missing_roots(roots: list[str]) -> list[str]:
    """Stored roots that are gone."""
    return [r for r in roots if not os.path.isdir(r)]
