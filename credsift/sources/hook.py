"""The pre-commit hook: installing, removing, looking. Plain files; no Spark."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

SIGNATURE = "# credsift pre-commit hook"
CHAINED = "pre-commit.before-credsift"


class HookError(RuntimeError):
    pass


def hooks_folder(root: str | Path) -> Path:
    def git(*words: str) -> str:
        run = subprocess.run(["git", *words], cwd=root, capture_output=True, text=True)
        if run.returncode and words[0] == "rev-parse":
            raise HookError("not a git repository")
        return run.stdout.strip()

    folder = git("rev-parse", "--git-dir")
    if git("config", "--get", "core.hooksPath"):
        raise HookError("core.hooksPath is set; add the scan to the hooks there")
    return Path(root, folder, "hooks")


def script(command: str) -> str:
    return f'#!/bin/sh\n{SIGNATURE}\nhere=$(dirname "$0")\nif [ -x "$here/{CHAINED}" ]; then "$here/{CHAINED}" "$@" || exit $?; fi\nexec {command} scan --staged --quiet\n'


def status(root: str | Path) -> str:
    """installed, foreign or absent."""
    path = hooks_folder(root) / "pre-commit"
    if not path.exists():
        return "absent"
    return "installed" if SIGNATURE in path.read_text(errors="replace") else "foreign"


def install(root: str | Path, command: str = "python -m credsift") -> str:
    """Installs the hook; one that is there already is kept and runs first. Doing it twice changes nothing."""
    folder, now = hooks_folder(root), status(root)
    path = folder / "pre-commit"
    folder.mkdir(parents=True, exist_ok=True)
    if now == "foreign":
        os.replace(path, folder / CHAINED)
    path.write_text(script(command))
    path.chmod(0o755)
    return "updated" if now == "installed" else "chained" if now == "foreign" else "installed"


def uninstall(root: str | Path) -> str:
    """Removes the hook and puts back the one that it chained; someone else's is refused."""
    folder, now = hooks_folder(root), status(root)
    if now == "foreign":
        raise HookError("the pre-commit hook is not ours")
    if now == "absent":
        return "absent"
    path = folder / "pre-commit"
    path.unlink()
    if (folder / CHAINED).exists():
        os.replace(folder / CHAINED, path)
        return "restored"
    return "removed"
