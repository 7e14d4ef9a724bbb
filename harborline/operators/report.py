"""A self-contained HTML page of a validation report."""

from __future__ import annotations

from html import escape

from harborline.operators.rules import ValidationReport


def _table(head: list[str], rows: list[list[object]]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{escape(str(x))}</{tag}>" for x in row)
    return f"<table><tr>{cells('th', head)}</tr>{''.join(f'<tr>{cells("td", r)}</tr>' for r in rows)}</table>"


def html_report(report: ValidationReport, provenance: list[list[object]] = (), profiles: list[list[object]] = (), benford: dict[str, object] | None = None) -> str:
    state = "passed" if report.passed else "failed"
    tiles = "".join(f"<div class=tile><b>{v}</b> {escape(k)}</div>" for k, v in report.summary().items())
    results = _table(["table", "rule", "severity", "checked", "failed", "rate"], [[r.table, r.rule, r.severity, r.n_checked, r.n_failed, f"{r.fail_rate:.2%}"] for r in report.results])
    parts = [f"<h1 class={state}>Data quality: {state}</h1>{tiles}<h2>Rules</h2>{results}"]
    if provenance:
        parts.append("<h2>Provenance</h2>" + _table(["source", "status", "rows", "url"], list(provenance)))
    if profiles:
        parts.append("<h2>Profiles</h2>" + _table(["column", "rows", "missing", "distinct"], list(profiles)))
    if benford:
        parts.append("<h2>First digits</h2>" + _table(["table", "result"], [[k, v] for k, v in benford.items()]))
    if report.skipped:
        parts.append("<h2>Skipped</h2>" + _table(["table", "rule"], [list(x) for x in report.skipped]))
    style = "body{font:15px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:3px 8px}.failed{color:#b00}.passed{color:#070}.tile{display:inline-block;margin-right:2em}"
    return f"<!doctype html><meta charset=utf-8><title>Data quality</title><style>{style}</style>{''.join(parts)}"
