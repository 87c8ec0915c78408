"""Text summaries from small tables: markdown and terminal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame, n: int = 10) -> list[str]:
    rows = df.limit(n).collect()
    head = [f"| {' | '.join(df.columns)} |", f"|{'|'.join(' --- ' for _ in df.columns)}|"]
    return head + ["| " + " | ".join("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]


def markdown(title: str, sections: dict[str, DataFrame], n: int = 10) -> str:
    """A report of the first rows of each table, which the caller has ordered."""
    out = [f"# {title}"]
    for name, df in sections.items():
        out += ["", f"## {name}", "", *table(df, n)]
    return "\n".join(out) + "\n"


def html(title: str, sections: dict[str, DataFrame], n: int = 50) -> str:
    from html import escape

    parts = []
    for name, df in sections.items():
        body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(n).collect())
        parts.append(f"<h2>{escape(name)}</h2><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in df.columns)}</tr>{body}</table>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{''.join(parts)}</body></html>"


def write_reports(path: str, title: str, sections: dict[str, DataFrame], kinds: str = "markdown") -> list[str]:
    """One file for each of the comma-separated kinds (repeats count once) in a directory of the driver."""
    import os

    os.makedirs(path, exist_ok=True)
    made = []
    for kind in dict.fromkeys(k.strip() for k in kinds.split(",")):
        text, name = (markdown(title, sections), "report.md") if kind == "markdown" else (html(title, sections), "report.html")
        with open(os.path.join(path, name), "w", encoding="utf-8") as f:
            f.write(text)
        made.append(os.path.join(path, name))
    return made
