"""A scan as a step of a workflow: a child process does it, and what it leaves is checked before it counts as a scan.

A child that ends by a signal or with a status that no scan ends with, and one that leaves no report or half of one, is an error of the step,
never a clean scan. Otherwise the step says what the report says and ends as the child did.
"""

from __future__ import annotations

import json
import subprocess
import sys
from collections.abc import Iterator
from pathlib import Path
from typing import TextIO

from .report import say_summary

CLEAN, FOUND, INCOMPLETE = 0, 1, 2
LEVELS = {"critical": "error", "high": "error", "low": "notice"}
CHUNK = 1 << 16


class BrokenReport(ValueError):
    pass


def items(path: Path) -> Iterator[tuple[str, object]]:
    """(key, value) of a report, and of its lists each item by itself, read as far as needed at a time."""
    decoder, text, at = json.JSONDecoder(), "", 0
    with open(path, encoding="utf-8") as f:

        def more() -> bool:
            nonlocal text, at
            got = f.read(max(CHUNK, len(text) - at))
            text, at = text[at:] + got, 0
            return bool(got)

        def sign() -> str:
            nonlocal at
            while True:
                while at < len(text) and text[at] in " \t\r\n":
                    at += 1
                if at < len(text):
                    at += 1
                    return text[at - 1]
                if not more():
                    raise BrokenReport("it ends too early")

        def value() -> object:
            nonlocal at
            while True:
                while at < len(text) and text[at] in " \t\r\n":
                    at += 1
                try:
                    found, end = decoder.raw_decode(text, at)
                    if end < len(text):  # a number could go on
                        at = end
                        return found
                except ValueError as e:
                    problem = str(e)
                else:
                    problem = "it ends too early"
                if not more():
                    raise BrokenReport(problem)

        def expect(due: str) -> str:
            got = sign()
            if got not in due:
                raise BrokenReport(f"{got!r} where one of {due!r} was due")
            return got

        expect("{")
        while True:
            key = value()
            if not isinstance(key, str):
                raise BrokenReport("a key that is no text")
            expect(":")
            if sign() != "[":
                at -= 1
                yield key, value()
            else:
                yield key, None
                if sign() != "]":
                    at -= 1
                    yield key, value()
                    while expect(",]") == ",":
                        yield key, value()
            if expect(",}") == "}":
                return


def escaped(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def step(child: list[str], report: str | Path, out: TextIO | None = None, annotate: bool = True, outputs: str | Path | None = None, cwd: str | Path | None = None) -> int:
    """Runs a scan that writes a JSON report, and says what came of it; the step's exit code."""
    out, path = out or sys.stdout, Path(cwd or ".", report)
    path.unlink(missing_ok=True)  # an earlier run's report must not pass for this one's

    def failed(why: str, status: int) -> int:
        out.write(f"::error::{escaped(why)}\n")
        return status

    try:
        status = subprocess.run(child, cwd=cwd).returncode
    except OSError as e:
        return failed(f"credsift failed to run: {e}", 127)
    if status not in (CLEAN, FOUND, INCOMPLETE):
        ended = f"signal {-status}" if status < 0 else f"status {status}"
        return failed(f"credsift failed to run: it ended with {ended}", 128 - status if status < 0 else status)
    if not path.exists():
        return failed(f"credsift did not write its report to {path}", INCOMPLETE)
    seen, summary = {"findings": 0, "skipped": 0}, None
    try:
        # once over the whole report, so that nothing is said of a broken one
        for key, x in items(path):
            summary = x if key == "summary" else summary
            if key in seen and x is not None:
                seen[key] += 1
        if summary is None or (seen["findings"], seen["skipped"]) != (summary["findings"], summary["filesSkipped"]):
            raise BrokenReport("its parts don't agree with its summary")
        for key, x in items(path) if annotate else ():
            if key == "findings" and x is not None:
                level, said = LEVELS.get(x["severity"], "warning"), f"[{x['provider']}] {x['patternName']} — {x['masked']}"
                out.write(f"::{level} file={x['file']},line={x['line']},col={x['column']}::{escaped(said)}\n")
        for key, x in items(path) if annotate else ():
            if key == "skipped" and x is not None:
                out.write(f"::warning::{escaped(f'Could not scan {x["path"]}: {x["reason"]}')}\n")
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return failed(f"the report in {path} can't be read: {e}", INCOMPLETE)
    if status == CLEAN and summary["filesSkipped"]:
        return failed(f"the scan ended as clean, but {summary['filesSkipped']} files were skipped", INCOMPLETE)
    say_summary(summary, out, outputs)
    return status
