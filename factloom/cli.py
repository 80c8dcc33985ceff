"""Command line: parse, query-style, query-text, check, stats, validate, inspect, compare, read-text, read-pdf, spec-check."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.api import Api
from factloom.operators import checks as check_ops
from factloom.operators import compare as compare_ops
from factloom.operators.stats import ParagraphFilter
from factloom.plans import profiles
from factloom.sources import facts
from factloom.sources.sinks import put_json, put_text, write_json


#: So many rows of a result are put into one JSON document; a larger result must go to a folder (--output-dir).
MOST_ROWS = 100_000


def _rows(df: DataFrame) -> list[dict]:
    """The small result of a command as plain data; an error, not a cut, where it is large."""
    found = df.toJSON().take(MOST_ROWS + 1)
    if len(found) > MOST_ROWS:
        raise SystemExit(f"the result has more than {MOST_ROWS} rows: give --output-dir")
    return [json.loads(x) for x in found]


def _put(results: dict[str, DataFrame], a: argparse.Namespace) -> bool:
    """Results as JSON lines below --output-dir, a folder each, of any size; False without the option."""
    if not a.output_dir:
        return False
    for name, df in results.items():
        write_json(df, f"{a.output_dir.rstrip('/')}/{name}")
    return True


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factloom")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *inputs: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        for i in inputs:
            c.add_argument(i.strip("?"), nargs="?" if i.endswith("?") else None)
        c.add_argument("--output")
        c.add_argument("--output-dir", help="write a large result there, as files that Spark writes")
        return c

    add("parse", "input")
    add("query-style", "input").add_argument("--style", required=True)
    add("query-text", "input").add_argument("--keyword", required=True)
    add("check", "input?", "checks?").add_argument("--schema", action="store_true")
    c = add("stats", "input")
    for flag in ("--style-hint", "--exclude-text", "--heading-prefix", "--heading-keyword", "--instruction-hint"):
        c.add_argument(flag, action="append", default=[])
    c.add_argument("--min-length", type=int, default=0)
    c.add_argument("--require-body-shape", action="store_true")
    c.add_argument("--sample-limit", type=int, default=8)
    c = add("validate", "input")
    c.add_argument("--auto-repair", action="store_true")
    c.add_argument("--schemas", help="a folder of XSD files")
    c.add_argument("--original", help="the package before the change: its own schema errors do not count")
    c.add_argument("--repaired", help="a folder for the repaired packages")
    c.add_argument("--verbose", action="store_true", help="tell every violation, not the first of each rule")
    c = add("inspect", "input")
    c.add_argument("--merge-runs", action="store_true")
    c.add_argument("--show")
    c.add_argument("--list", action="store_true")
    add("compare", "reference", "target").add_argument("--report", action="store_true")
    add("read-text", "input")
    c = add("read-pdf", "input")
    c.add_argument("--pages")
    c.add_argument("--tables", action="store_true")
    c.add_argument("--all", action="store_true")
    c = add("spec-check", "input?")
    c.add_argument("--mode", required=True, choices=("conflicts", "structure", "body-consistency", "common-sense"))
    c.add_argument("--evidence", help="the output of stats, or a Word document to take it from")
    c.add_argument("--checks")
    c.add_argument("--body-keyword", action="append", default=[])
    c.add_argument("--profile", help="settings to lay over the default profile")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; 1 for no match, violations, a failed specification or a missing file, else 0."""
    a = parser().parse_args(argv)
    named = [p for p in (getattr(a, "input", None), getattr(a, "reference", None), getattr(a, "target", None)) if p]
    for p in named:
        if "://" not in p and not any(x in p for x in "*?[") and not os.path.exists(p):
            put_json({"status": "error", "error": f"not found: {p}"}, a.output)
            return 1
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    api = Api(spark)
    if a.command == "parse":
        with api.word.parse(a.input) as d:
            found = {n: getattr(d, n) for n in ("metadata", "layouts", "paragraphs", "styles", "headers_footers", "tables")}
            if not _put(found, a):
                put_json({n: _rows(x) for n, x in found.items()}, a.output)
    elif a.command in ("query-style", "query-text"):
        with api.word.parse(a.input) as d:
            found = api.word.query_style(d, a.style) if a.command == "query-style" else api.word.query_text(d, a.keyword).select("doc_id", "id", "index", "text", "style_name", "properties")
            if _put({a.command: found}, a):
                return 0
            rows = _rows(found)
        put_json(rows, a.output)
        return int(a.command == "query-style" and not rows)
    elif a.command == "check":
        if a.schema:
            put_json(_rows(check_ops.catalog(spark)), a.output)
            return 0
        checks = facts.load_checks(a.checks)
        if errors := check_ops.validate(checks):
            put_json({"summary": None, "errors": errors}, a.output)
            return 0
        with api.word.parse(a.input) as d:
            results, issues = api.analysis.check(d, checks)
            found = {"summary": check_ops.summary(results), "results": results, "issues": issues}
            if not _put(found, a):
                put_json({n: _rows(x) for n, x in found.items()}, a.output)
    elif a.command == "stats":
        wanted = ParagraphFilter(tuple(a.style_hint), tuple(a.exclude_text), tuple(a.heading_prefix), tuple(a.heading_keyword), tuple(a.instruction_hint), a.min_length, a.require_body_shape)
        with api.word.parse(a.input) as d:
            found = api.analysis.summary(d, wanted, a.sample_limit)
            if not _put({"summary": found}, a):
                put_json({"filters": dataclasses.asdict(wanted), "summary": _rows(found)}, a.output)
    elif a.command == "validate":
        found = api.word.validate(a.input, a.auto_repair, a.repaired, a.schemas, a.original)
        if _put({"violations": found}, a):
            return 0
        shown = found if a.verbose else found.groupBy("doc_id", "rule").agg(F.count("*").alias("violations"), F.min_by(F.struct("part", "pos", "detail"), F.struct("part", "pos", "detail")).alias("first"))
        rows = _rows(shown)
        put_json({"valid": not rows, "violations": rows}, a.output)
        return int(bool(rows))
    elif a.command == "inspect":
        put_json(_rows(api.word.inspect(a.input, None if a.list else a.show, a.output_dir, a.merge_runs)), a.output)
    elif a.command == "compare":
        found = api.word.compare(a.reference, a.target)
        if a.report:
            put_text("\n".join(r["markdown"] for r in compare_ops.report(found).collect()) or "# No differences\n", a.output)  # one pair, one row
        else:
            put_json(_rows(found), a.output)
    elif a.command == "read-text":
        found = api.text.read(a.input)
        if not _put({"texts": found}, a):
            put_json(_rows(found), a.output)
    elif a.command == "read-pdf":
        found = api.pdf.extract(a.input, a.pages, a.tables, a.all)
        if not _put({"pages": found}, a):
            put_json(_rows(found), a.output)
    else:
        if a.mode == "body-consistency":
            if a.evidence.endswith(".json"):
                evidence, docs = facts.load_evidence(spark, a.evidence), None
            else:
                d = api.word.parse(a.evidence)
                evidence, docs = api.analysis.stats(d), d.ids
            found, bad = api.spec.check_body_consistency(evidence, facts.load_checks(a.checks), tuple(a.body_keyword), docs), "verdict = 'mismatch'"
        elif a.mode == "structure":
            rules = profiles.section_rules(profiles.load(a.profile)) if a.profile else None
            found, bad = api.spec.check_structure(a.input, rules), "status = 'missing'"
        else:
            found, bad = api.spec.check_conflicts(a.input) if a.mode == "conflicts" else api.spec.check_common_sense(a.input), "true"
        needs = not found.where(bad).isEmpty()
        if not _put({a.mode: found}, a):
            put_json({"status": "needs_revision" if needs else "pass", "rows": _rows(found)}, a.output)
        return int(needs)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
