"""Chart-ready tables, and a plain drawing of them as SVG.

A chart's data is a small DataFrame: the bars, groups or points that it shows. Drawing collects it, up to
``MOST_MARKS`` rows.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curves import error_band, first_per_step

MOST_MARKS = 5_000
WIDTH, HEIGHT, EDGE = 640, 360, 56


def accuracy_bars(summary: DataFrame, conditions: tuple[str, ...] = ("before", "after", "teacher")) -> DataFrame:
    """``place, label, value, text`` of the accuracy of each condition, in the order given; missing ones are left out."""
    place = F.array_position(F.array(*map(F.lit, conditions)), F.col("condition"))
    rows = summary.where(F.col("condition").isin(*conditions) & F.col("exact_match_accuracy").isNotNull())
    return rows.select(place.alias("place"), F.col("condition").alias("label"), F.col("exact_match_accuracy").alias("value"), F.format_string("%.1f%%", F.col("exact_match_accuracy") * 100).alias("text")).orderBy("place")


def grouped_bars(df: DataFrame, group: str, metrics: tuple[str, ...]) -> DataFrame:
    """``label, series, place, value``: the named metrics of every group, a bar each."""
    bars = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("series"), F.col(m).cast("double").alias("value")) for i, m in enumerate(metrics)]))
    return df.select(F.col(group).alias("label"), bars.alias("b")).select("label", "b.series", "b.place", "b.value").orderBy("label", "place")


def horizontal_bars(counts: DataFrame, label: str = "label", value: str = "n") -> DataFrame:
    """``label, value, share`` of classes with any rows, the largest first."""
    total = counts.agg(F.sum(value).alias("__total"))
    rows = counts.where(F.col(value) > 0).crossJoin(F.broadcast(total))
    return rows.select(F.col(label).alias("label"), F.col(value).cast("double").alias("value"), (F.col(value) / F.col("__total")).alias("share")).orderBy(F.desc("value"), "label")


def curve_panels(points: DataFrame, panels: dict[str, str], shares: tuple[str, ...] = (), n: int | None = None) -> DataFrame:
    """``panel, series, step, value, low, high``: the first value of every step of the named metrics, each in its panel.
    Metrics in ``shares`` are shares of ``n`` and get a band of one standard error."""
    names = F.create_map(*[F.lit(x) for kv in panels.items() for x in kv])
    rows = first_per_step(points).where(F.col("metric").isin(*panels))
    band: Column = F.when(F.col("metric").isin(*shares), error_band(F.col("value"), F.lit(n))) if shares and n else F.lit(None).cast("double")
    out = rows.select(names[F.col("metric")].alias("panel"), F.concat_ws("/", "run", "metric").alias("series"), "step", "value", (F.col("value") - band).alias("low"), (F.col("value") + band).alias("high"))
    return out.orderBy("panel", "series", "step")


def _rows(df: DataFrame) -> list:
    rows = df.limit(MOST_MARKS + 1).collect()
    if len(rows) > MOST_MARKS:
        raise ValueError(f"a chart of over {MOST_MARKS} marks")
    return rows


def _page(title: str, marks: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="12">'
    return "\n".join([head, f'<text x="{WIDTH / 2}" y="20" text-anchor="middle" font-size="15">{escape(title)}</text>', *marks, "</svg>", ""])


def draw_bars(bars: DataFrame, title: str, most: float | None = None) -> str:
    """Upright bars of ``label, value`` with optional ``text``, as an SVG document."""
    rows = _rows(bars)
    top = most or max((r.value for r in rows if r.value is not None), default=1.0) or 1.0
    step, room, marks = (WIDTH - 2 * EDGE) / max(1, len(rows)), HEIGHT - 2 * EDGE, []
    for i, r in enumerate(rows):
        high = room * (r.value or 0.0) / top
        x, y = EDGE + i * step, HEIGHT - EDGE - high
        said = r.text if "text" in r else f"{r.value:.4g}"
        marks.append(f'<rect x="{x + step * 0.15:.1f}" y="{y:.1f}" width="{step * 0.7:.1f}" height="{high:.1f}" fill="#4269a5"/>')
        marks.append(f'<text x="{x + step / 2:.1f}" y="{y - 5:.1f}" text-anchor="middle">{escape(said)}</text>')
        marks.append(f'<text x="{x + step / 2:.1f}" y="{HEIGHT - EDGE + 16}" text-anchor="middle">{escape(str(r.label))}</text>')
    return _page(title, marks)


def draw_horizontal(bars: DataFrame, title: str) -> str:
    """Lying bars of ``label, value, share``, as an SVG document."""
    rows = _rows(bars)
    top, step, marks = max((r.value for r in rows), default=1.0) or 1.0, (HEIGHT - 2 * EDGE) / max(1, len(rows)), []
    for i, r in enumerate(rows):
        y, wide = EDGE + i * step, (WIDTH - 300) * r.value / top
        marks.append(f'<text x="232" y="{y + step / 2 + 4:.1f}" text-anchor="end">{escape(str(r.label))}</text>')
        marks.append(f'<rect x="240" y="{y + step * 0.15:.1f}" width="{wide:.1f}" height="{step * 0.7:.1f}" fill="#4269a5"/>')
        marks.append(f'<text x="{244 + wide:.1f}" y="{y + step / 2 + 4:.1f}">{r.value:.0f} ({r.share:.1%})</text>')
    return _page(title, marks)


def draw_curves(points: DataFrame, title: str) -> str:
    """The panels of :func:`curve_panels` in a row, a line a series, with bands where there are any; an SVG document."""
    rows, marks, colors = _rows(points), [], ("#4269a5", "#c4622d", "#3f8f5b", "#8b5fa8", "#8a6d3b")
    panels = sorted({r.panel for r in rows})
    wide = (WIDTH - EDGE) / max(1, len(panels))
    for k, panel in enumerate(panels):
        own = [r for r in rows if r.panel == panel and r.value is not None]
        if not own:
            continue
        first, last = min(r.step for r in own), max(r.step for r in own)
        low, high = min(r.low if r.low is not None else r.value for r in own), max(r.high if r.high is not None else r.value for r in own)

        def at(step, value, k=k, first=first, last=last, low=low, high=high):
            x = EDGE / 2 + k * wide + 10 + (wide - 30) * (step - first) / max(1, last - first)
            return f"{x:.1f},{HEIGHT - EDGE - (HEIGHT - 2 * EDGE) * (value - low) / ((high - low) or 1.0):.1f}"

        marks.append(f'<text x="{EDGE / 2 + k * wide + wide / 2:.1f}" y="{HEIGHT - EDGE + 20}" text-anchor="middle">{escape(panel)}: {low:.4g} to {high:.4g}</text>')
        for i, series in enumerate(sorted({r.series for r in own})):
            line, color = [r for r in own if r.series == series], colors[i % len(colors)]
            banded = [r for r in line if r.low is not None]
            if banded:
                ring = [at(r.step, r.high) for r in banded] + [at(r.step, r.low) for r in reversed(banded)]
                marks.append(f'<polygon points="{" ".join(ring)}" fill="{color}" fill-opacity="0.15"/>')
            marks.append(f'<polyline points="{" ".join(at(r.step, r.value) for r in line)}" fill="none" stroke="{color}"><title>{escape(series)}</title></polyline>')
    return _page(title, marks)
