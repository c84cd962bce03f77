"""SVG charts, drawn on the driver from small aggregates."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INK, PALE = "#1f2937", "#e5e7eb"
COLOURS = ("#2563eb", "#d97706", "#059669", "#7c3aed", "#db2777", "#4b5563", "#0891b2")


def text(x: float, y: float, s: object, size: int = 12, anchor: str = "start") -> str:
    return f'<text x="{x:g}" y="{y:g}" font-family="sans-serif" font-size="{size}" fill="{INK}" text-anchor="{anchor}">{escape(str(s))}</text>'


def document(width: int, height: int, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">' + "".join(parts) + "</svg>"


def bars(values: list[tuple[str, float]], x: float, y: float, width: float, step: float = 18) -> list[str]:
    top, out = max([v for _, v in values], default=0) or 1, []
    for i, (name, v) in enumerate(values):
        out += [
            text(x, y + i * step + 11, name, 11),
            f'<rect x="{x + 120:g}" y="{y + i * step:g}" width="{(width - 170) * v / top:g}" height="13" fill="{COLOURS[i % len(COLOURS)]}"/>',
            text(x + 125 + (width - 170) * v / top, y + i * step + 11, f"{v:g}", 11),
        ]
    return out


def split_dashboard(summaries: list[dict], histograms: dict[str, list[float]]) -> str:
    """A panel for each split: coding status, ages and the commonest coders and pairs."""
    parts, height = [], 330
    for i, s in enumerate(summaries):
        y = 20 + i * height
        parts += [f'<rect x="10" y="{y - 12}" width="960" height="{height - 16}" fill="none" stroke="{PALE}"/>', text(20, y + 8, f"{s['split']}: {s['n_rows']} rows, {s['n_transcripts']} transcripts", 15)]
        at, whole = 20.0, max(1, s["n_rows"])
        for j, k in enumerate(("both_coders", "one_coder", "neither")):
            w = BAR * s[k] / whole
            parts.append(f'<rect x="{at:g}" y="{y + 22}" width="{w:g}" height="16" fill="{COLOURS[j]}"><title>{k}: {s[k]}</title></rect>')
            at += w
        hist = histograms.get(s["split"], [])
        parts += [text(20, y + 62, "age in months")]
        parts += [f'<rect x="{20 + 70 * j}" y="{y + 200 - 120 * h / (max(hist) or 1):g}" width="60" height="{120 * h / (max(hist) or 1):g}" fill="{COLOURS[0]}"/>' for j, h in enumerate(hist)]
        ranked = lambda m, n: sorted(m.items(), key=lambda kv: (-kv[1], kv[0]))[:n]
        parts += bars(ranked(s["coder_counts"], 7), 500, y + 22, 440)
        parts.append(text(20, y + 240, "; ".join(f"{k} ({v})" for k, v in ranked(s["overlap_counts"], 4)), 11))
    return document(980, 20 + height * len(summaries), parts)


def jitter(name: Column, width: float) -> Column:
    """A fixed offset for a name, within about a third of the width on either side."""
    points = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), _code_point)
    return (F.aggregate(points, F.lit(0), lambda a, x: a + x) % 1000 / 999 - 0.5) * width * 0.68


def _code_point(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")


#: The scatter's column width, and the y of agreement 0 and of a full agreement above it.
# The chart's column width, base line and height; a dot's jitter (999, 0.68) and radius (2.2, 5.8) too.
COLUMN, FLOOR, RISE = 180, 320.0, 280.0


def scatter_points(points: DataFrame, unit: str = "transcript_id") -> DataFrame:
    """(split, x, y, r, n) of the dots of (split, unit, n_overlap, exact_agreement): larger for more overlap.

    x is from the middle of the split's column. Dots that fall on one pixel are one dot of
    the largest one's size, so their number is bounded by the picture's; n counts them.
    """
    top = F.broadcast(points.agg(F.max("n_overlap").alias("__top")))  # one row
    radius = 2.2 + 5.8 * F.sqrt(F.col("n_overlap") / F.col("__top"))
    dots = points.crossJoin(top).select("split", F.round(jitter(F.col(unit), COLUMN)).alias("x"), F.round(FLOOR - RISE * F.col("exact_agreement")).alias("y"), F.round(radius, 2).alias("r"))
    return dots.groupBy("split", "x", "y").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n"))


def agreement_scatter(points: DataFrame, unit: str = "transcript_id") -> str:
    """A column of dots for each split."""
    dots = [tuple(r) for r in scatter_points(points, unit).orderBy("split", "x", "y").collect()]  # bounded by pixels
    splits = sorted({d[0] for d in dots})
    parts = [text(20, 20, "agreement by transcript", 15)]
    for i, s in enumerate(splits):
        middle = 80 + i * COLUMN + COLUMN / 2
        parts.append(text(middle, 350, s, 12, "middle"))
        parts += [f'<circle cx="{middle + x:g}" cy="{y:g}" r="{r:.2f}" fill="{COLOURS[i % len(COLOURS)]}" fill-opacity="0.5"/>' for q, x, y, r, _ in dots if q == s]
    return document(100 + COLUMN * len(splits), 370, parts)


#: Width of the dashboard's bar of coding status.
BAR = 440


def status_bars(summary: DataFrame) -> DataFrame:
    """(split, status, x, width) of the stacked bar of each split's coding status."""
    names, whole = ("both_coders", "one_coder", "neither"), F.greatest(F.col("n_rows"), F.lit(1))
    bars_of = [F.struct(F.lit(k).alias("status"), (sum((F.col(b) for b in names[:i]), F.lit(0)) * F.lit(BAR) / whole).alias("x"), (F.col(k) * F.lit(BAR) / whole).alias("width")) for i, k in enumerate(names)]
    return summary.select("split", F.explode(F.array(*bars_of)).alias("b")).select("split", "b.*")
