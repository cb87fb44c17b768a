"""Reports of a scan: JSON, terminal, workflow commands, exit code. Only masked values are ever written.

Tasks write the text, in pieces of bounded size; what the driver does is to put the pieces one after another.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import summary
from ..operators.verify import FINDING
from .scan import ScanResult

SCHEMA_VERSION = 1
Reporter = Callable[[ScanResult], None]


def summary_row(result: ScanResult) -> dict:
    """The counts of the JSON report."""
    counted, t = result.counted(), summary.totals(result.findings).first()
    return {
        "filesScanned": counted["files_scanned"], "filesSkipped": counted["files_skipped"], "durationMs": counted["duration_ms"],
        "findings": t["findings"], "uniqueSecrets": t["unique_secrets"], "bySeverity": {s: t[s] for s in fn.SEVERITIES},
    }


def finding_json(findings: DataFrame) -> DataFrame:
    """Findings as one JSON text each, by an explicit list of fields, in the report's order."""
    return summary.ordered(findings).select(F.to_json(F.struct(*FINDING)).alias("json"))


#: Characters of a piece of text that a task sends, about.
PIECE = 1 << 20


def pieces(rows: DataFrame, render: Callable[[dict], str]) -> Iterator[str]:
    """What render says of the rows, in their order, joined by tasks."""

    def said(batches):
        held, size = [], 0
        for b in batches:
            for row in b.to_pylist():
                held.append(render(row))
                size += len(held[-1])
                if size >= PIECE:
                    yield pa.RecordBatch.from_pydict({"text": ["".join(held)]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"text": ["".join(held)]})

    for row in rows.mapInArrow(said, "text string").toLocalIterator(prefetchPartitions=True):
        yield row["text"]


def json_report(result: ScanResult, out: TextIO | str | Path | None = None, pretty: bool | None = None) -> None:
    """Two-space JSON to a stream, compact JSON to a file. Findings and skipped files pass the writer in pieces, never held together."""
    to_file = isinstance(out, (str, Path))
    pretty = not to_file if pretty is None else pretty
    stream = open(out, "w", encoding="utf-8") if to_file else out or sys.stdout  # noqa: SIM115
    head = {"schemaVersion": SCHEMA_VERSION, "tool": {"name": "credsift", "version": result.version}}
    at = result.findings.sparkSession.range(1).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at")).first()["at"]
    head |= {"scannedAt": at, "rootDir": result.root_dir, "summary": summary_row(result)}
    lists = {"skipped": result.skipped.select(F.to_json(F.struct("path", "reason")).alias("json")), "findings": finding_json(result.findings)}
    try:
        style = {"indent": 2} if pretty else {"separators": (",", ":")}
        stream.write(json.dumps(head, ensure_ascii=False, **style).removesuffix("}").rstrip("\n"))

        def body(row: dict) -> str:
            text = json.dumps(json.loads(row["json"]), ensure_ascii=False, **style)
            return ",\n    " + text.replace("\n", "\n    ") if pretty else "," + text

        for name, rows in lists.items():
            stream.write(f',\n  "{name}": [' if pretty else f',"{name}":[')
            any_yet = False
            for text in pieces(rows, body):
                stream.write(text if any_yet else text[1:])
                any_yet = True
            stream.write("\n  ]" if pretty and any_yet else "]")
        stream.write("\n}\n" if pretty else "}\n")
    finally:
        if to_file:
            stream.close()


class Ansi:
    """Colours, or nothing: an explicit choice beats NO_COLOR, that beats FORCE_COLOR=1, that beats whether it is a terminal."""

    def __init__(self, color: bool | None, stream: TextIO):
        if color is None:
            color = False if os.environ.get("NO_COLOR") else True if os.environ.get("FORCE_COLOR") == "1" else bool(getattr(stream, "isatty", lambda: False)())
        on = bool(color)  # the stream itself must not go to tasks
        code = lambda n: lambda s: f"\x1b[{n}m{s}\x1b[0m" if on else s
        self.bold, self.dim, self.red, self.yellow, self.blue, self.gray = (code(n) for n in (1, 2, 31, 33, 34, 90))

    def severity(self, s: str) -> Callable[[str], str]:
        return {"critical": self.red, "high": self.red, "medium": self.yellow}.get(s, self.blue)


def plural(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's'}"


def finding_text(c: Ansi, width: int, verbose: bool) -> Callable[[dict], str]:
    """Writes a row of summary.listed(), with its file's name above if it is the file's first."""

    def say(f: dict) -> str:
        provider = f["provider"] if len(f["provider"]) <= width else f["provider"][: width - 1] + "…"
        text = f"\n  {c.bold(f['file'])}\n" if f["head"] else ""
        text += f"    {c.gray(f'{f["line"]:>4}:{f["column"]:>3}')}  {c.severity(f['severity'])(f['severity'].ljust(8))}  {c.dim(provider.ljust(width))}  {f['masked']}\n"
        if f["others"]:
            text += f"        {c.gray('⤷ the same in: ' + ', '.join(f['others']))}\n"
        return text + "".join(f"        {c.gray(line)}\n" for line in (f["context"] or []) if verbose)

    return say


def _top(findings: DataFrame, most: int) -> Iterator[dict]:
    """The first rows of summary.listed(), without listing the others."""
    shown = [r.asDict() for r in summary.top(findings, most).collect()]
    few = findings.join(F.broadcast(findings.sparkSession.createDataFrame([(p,) for p in {f["fingerprint"] for f in shown}], "fingerprint string")), "fingerprint", "left_semi")  # at most `most` rows
    names, file, told = {r["fingerprint"]: r["files"] for r in summary.secret_files(few).where("n > 1").toLocalIterator()}, None, set()
    for f in shown:
        others = [x for x in names.get(f["fingerprint"], ()) if x != f["file"]] if f["fingerprint"] not in told else None
        yield f | {"head": f["file"] != file, "others": others}
        file = f["file"]
        told.add(f["fingerprint"])


def terminal_report(result: ScanResult, stream: TextIO | None = None, max_findings: int = 50, color: bool | None = None, verbose: bool = False) -> None:
    """Findings by file, A to Z, up to a limit (0 is none); at most that many rows come to the driver."""
    out = stream or sys.stdout
    c, counted, t = Ansi(color, out), result.counted(), summary.totals(result.findings).first()
    n, files, ms = t["findings"], counted["files_scanned"], counted["duration_ms"]

    def warn() -> None:
        if counted["files_skipped"]:
            out.write(f"  {c.yellow('⚠ ' + plural(counted['files_skipped'], 'file') + ' skipped')} {c.gray('— not all files were looked at')}\n")

    if n == 0:
        out.write(f"\n  {c.bold('✔ Nothing found')} {c.gray(f'· {files} files · {ms}ms')}\n\n")
        warn()
        return
    out.write(f"\n  {c.bold('✖ ' + plural(n, 'secret') + ' found')} {c.gray('in ' + plural(t['files_with_findings'], 'file'))}\n")
    width = summary.provider_width(result.findings).first()["width"]
    say = finding_text(c, width, verbose)
    if max_findings:
        for k, f in enumerate(_top(result.findings, max_findings + 1)):
            if k < max_findings:
                out.write(say(f))
                continue
            above = f"\n  {c.bold(f['file'])}\n" if f["head"] else ""
            out.write(f"{above}\n  {c.gray(f'… {plural(n - max_findings, 'more finding')} (--max-findings=0 shows all)')}\n")
    else:
        for text in pieces(summary.listed(result.findings), say):
            out.write(text)
    out.write(f"\n  {c.gray('─' * 52)}\n")
    out.write(f"  {c.gray(f'{plural(n, 'finding')} · {t["unique_secrets"]} unique · {files} files · {ms}ms')}\n\n")
    warn()


def exit_code(result: ScanResult, fail_on: str = "medium") -> int:
    """1 if a finding is at the threshold or worse, else 2 if a file was skipped, else 0."""
    if not summary.failing(result.findings, fail_on).isEmpty():
        return 1
    return 0 if result.skipped.isEmpty() else 2


def workflow_report(result: ScanResult, stream: TextIO | None = None, outputs: str | Path | None = None, annotate: bool = True) -> None:
    """Workflow commands for findings and skipped files, step outputs, and one line of summary."""
    out, row = stream or sys.stdout, summary_row(result)
    if annotate:
        for rows in (summary.annotations(summary.ordered(result.findings)), summary.skip_annotations(result.skipped)):
            for text in pieces(rows.select("command"), lambda r: r["command"] + "\n"):
                out.write(text)
    say_summary(row, out, outputs)


def say_summary(row: dict, out: TextIO, outputs: str | Path | None = None) -> None:
    """Step outputs, to the file that is named or that the workflow names, and one line."""
    target = outputs or os.environ.get("GITHUB_OUTPUT")
    if target:
        with open(target, "a", encoding="utf-8") as f:
            f.write("".join(f"{k}={v}\n" for k, v in step_outputs(row).items()))
    out.write(f"credsift: {row['findings']} findings ({row['uniqueSecrets']} unique) across {row['filesScanned']} files in {row['durationMs']}ms\n")


def step_outputs(row: dict) -> dict[str, int]:
    return {"findings": row["findings"], "unique-secrets": row["uniqueSecrets"], "files-scanned": row["filesScanned"], "files-skipped": row["filesSkipped"]}
