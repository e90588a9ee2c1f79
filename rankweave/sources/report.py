"""Markdown reports of evaluation summaries, made on the driver from a few aggregated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

LIMIT = 2000


def number(value: float | None, digits: int = 3, signed: bool = False) -> str:
    if value is None:
        return "—"
    return f"{value:+.{digits}f}" if signed else f"{value:.{digits}f}"


def p_text(p: float | None) -> str:
    return "—" if p is None else "<0.0001" if p < 0.0001 else f"{p:.4f}"


def section(title: str, rows: DataFrame, digits: int = 3) -> str:
    """One table. More than LIMIT rows are an error: a report holds summaries, not records."""
    got = rows.limit(LIMIT + 1).collect()
    if len(got) > LIMIT:
        raise ValueError(f"{title}: more than {LIMIT} rows")
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    cell = lambda c, v: p_text(v) if c.startswith("p_") or c.endswith("_p") else number(v, digits) if isinstance(v, float) or v is None else str(v)
    body = "\n".join("| " + " | ".join(cell(c, r[c]) for c in rows.columns) + " |" for r in got)
    return f"### {title}\n\n{head}\n{body}\n"


def report(mode: str, **sections: DataFrame) -> str:
    """The report of one mode: summary, span, trade-off, significance or whatever is given, in order."""
    return f"## {mode}\n\n" + "\n".join(section(k.replace("_", " ").capitalize(), v) for k, v in sections.items())


def run_name(split: str, tier: str, modes: list[str], judge: str | None = None, subset: int | None = None) -> str:
    """The name of a run's files."""
    parts = [split, tier, *( [m.lower() for m in modes] if len(modes) < 3 else [] )]
    return ".".join([*parts, *([f"judge-{judge}"] if judge else []), *([f"first{subset}"] if subset else [])])
