"""Text reports.  The input is an aggregate of a few rows (over ``MOST`` is an error); formatting is plain Python."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from tagloom.plans.staging import few

MOST = 1000


def markdown_table(df: DataFrame, digits: int = 4) -> list[str]:
    rows = few(df, MOST, "text report")
    show = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)]


def ascii_table(df: DataFrame, digits: int = 4) -> list[str]:
    rows = few(df, MOST, "text report")
    show = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    cells = [list(df.columns), *[[show(v) for v in r] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return ["  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in cells]


def as_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


def bars_svg(df: DataFrame, group: str, bar: str, value: str, height: int = 240) -> str:
    """A figure of grouped bars as SVG text: one group of bars for each value of ``group``, in the order of the rows."""
    rows = few(df.select(group, bar, value), MOST, "figure")
    groups, bars = (list(dict.fromkeys(r[k] for r in rows)) for k in (0, 1))
    top = max((r[2] or 0 for r in rows), default=0) or 1
    width, left = 18 * len(bars) + 24, 40
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{left + width * len(groups)}" height="{height + 40}" font-size="10">']
    for r in rows:
        x, h = left + width * groups.index(r[0]) + 18 * bars.index(r[1]), height * (r[2] or 0) / top
        shade = 40 + 160 * bars.index(r[1]) // max(len(bars) - 1, 1)
        out.append(f'<rect x="{x}" y="{height - h:.1f}" width="16" height="{h:.1f}" fill="rgb({shade},{shade},{shade})"><title>{escape(f"{r[0]} {r[1]}: {r[2]}")}</title></rect>')
    out += [f'<text x="{left + width * i}" y="{height + 14}">{escape(str(g))}</text>' for i, g in enumerate(groups)]
    out += [f'<text x="0" y="10">{top}</text>', *(f'<text x="{left + 90 * i}" y="{height + 30}">{i + 1}. {escape(str(b))}</text>' for i, b in enumerate(bars)), "</svg>"]
    return "\n".join(out)
