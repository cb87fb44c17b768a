"""Command line: scan, ci, install, uninstall."""

from __future__ import annotations

import argparse
import re
import sys
from importlib import metadata
from pathlib import Path

from .operators.registry import BUILTIN, conflict_notes, load_patterns, merge_patterns
from .sources import files, hook
from .sources.config import load_config


def version() -> str:
    try:
        return metadata.version("credsift")
    except metadata.PackageNotFoundError:
        return "0.0.0"


def count(flag: str, text: str, least: int, what: str) -> int:
    """Leading digits of the text, as command lines have always read them."""
    m = re.match(r"\s*([+-]?\d+)", text)
    if not m or int(m[1]) < least:
        raise ValueError(f'{flag} takes a {what} number, not "{text}"')
    return int(m[1])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("credsift", description="Scan a codebase for hard-coded secrets")
    top.add_argument("-v", "--version", action="version", version=version())
    commands = top.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan")
    scan.add_argument("-p", "--path", default=".")
    scan.add_argument("--concurrency", default="1")
    scan.add_argument("-f", "--format", default="terminal")
    scan.add_argument("-o", "--output")
    scan.add_argument("--fail-on")
    scan.add_argument("--max-findings", default="50")
    scan.add_argument("--verbose", action="store_true")
    scan.add_argument("--no-color", action="store_true")
    scan.add_argument("--staged", action="store_true")
    scan.add_argument("--quiet", action="store_true")
    ci = commands.add_parser("ci", help="scan as a step of a workflow, in a child process that is supervised")
    ci.add_argument("-p", "--path", default=".")
    ci.add_argument("-o", "--output", default="credsift-results.json")
    ci.add_argument("--fail-on", default="medium")
    ci.add_argument("--no-annotations", action="store_true")
    for name in ("install", "uninstall"):
        commands.add_parser(name).add_argument("-p", "--path", default=".")
    return top


def run_scan(o: argparse.Namespace, spark=None) -> int:
    from .plans import report
    from .plans.scan import scan

    if o.format not in ("terminal", "json", "workflow"):
        raise ValueError(f'--format takes terminal, json or workflow, not "{o.format}"')
    if o.output and o.format != "json":
        raise ValueError("--output goes with --format=json only")
    limit, workers = count("--max-findings", o.max_findings, 0, "non-negative"), count("--concurrency", o.concurrency, 1, "positive")
    config = load_config(o.path)
    fail_on = o.fail_on or config.failOn
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master(f"local[{workers}]").appName("credsift").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    custom = load_patterns(Path(o.path, config.customPatterns)) if config.customPatterns else []
    patterns, conflicts = merge_patterns(BUILTIN, custom)
    if not o.quiet:
        print(*conflict_notes(conflicts), sep="\n", end="\n" if conflicts else "", file=sys.stderr)
    source = files.staged(spark, o.path, config.ignore, config.include) if o.staged else None
    result = scan(spark, o.path, patterns, source, config.ignore, config.include, version=version())
    try:
        code = report.exit_code(result, fail_on)
        if o.quiet and result.findings.isEmpty() and result.skipped.isEmpty():
            return 0
        if o.format == "json":
            report.json_report(result, o.output)
        elif o.format == "workflow":
            report.workflow_report(result)
        else:
            report.terminal_report(result, max_findings=limit, color=False if o.no_color else None, verbose=o.verbose)
        if o.output:
            print(f"credsift: {result.findings.count()} finding(s) → {o.output}", file=sys.stderr)
        return code
    finally:
        result.discard()


def main(argv: list[str] | None = None, spark=None) -> int:
    o = parser().parse_args(argv)
    try:
        if o.command == "scan":
            return run_scan(o, spark)
        if o.command == "ci":
            from .plans.ci import step

            return step([sys.executable, "-m", "credsift", "scan", "-p", o.path, "--fail-on", o.fail_on, "-f", "json", "-o", o.output], o.output, annotate=not o.no_annotations)
        print(f"credsift: hook {hook.install(o.path) if o.command == 'install' else hook.uninstall(o.path)}")
        return 0
    except (ValueError, hook.HookError, RuntimeError) as e:
        print(f"credsift: {e}", file=sys.stderr)
        return 2


