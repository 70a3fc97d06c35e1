"""Sinks: partitioned CSV or Parquet, and pictures of small long-form results."""

from __future__ import annotations

from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_bin(df: DataFrame, path: str, by: str, fmt: str = "csv") -> None:
    """One folder for each bin; rows of a bin come from as many tasks as they have."""
    df.write.mode("overwrite").partitionBy(by).option("header", True).format(fmt).save(path)


def write_wide(df: DataFrame, path: str, tick: str) -> None:
    """A merged wide table in order of its tick, as CSV."""
    df.orderBy(tick).write.mode("overwrite").option("header", True).csv(path)


#: Size of a panel, and of the margin around its line, in picture units.
WIDTH, HEIGHT, MARGIN = 480, 120, 24


def picture(df: DataFrame, x: str, y: str, panel: list[str], title: str = "", save_to: str | None = None) -> str:
    """Panels of y over x of a small long-form result (lags, spectra, models, profiles), as SVG; rows without y are left out."""
    lines: dict[tuple, list[tuple[float, float]]] = {}
    for r in df.select(*panel, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null").orderBy(*panel, "_x").collect():
        lines.setdefault(tuple(r[: len(panel)]), []).append((r["_x"], r["_y"]))
    out = [f'<text x="{MARGIN}" y="16">{escape(title)}</text>']
    for i, (name, points) in enumerate(lines.items()):
        (x0, x1), (y0, y1) = ((min(c), max(c)) for c in zip(*points, strict=True))
        top = MARGIN + i * (HEIGHT + MARGIN)
        at = [(MARGIN + (a - x0) / ((x1 - x0) or 1) * WIDTH, top + HEIGHT - (b - y0) / ((y1 - y0) or 1) * HEIGHT) for a, b in points]
        out.append(f'<rect x="{MARGIN}" y="{top}" width="{WIDTH}" height="{HEIGHT}" fill="none" stroke="#ccc"/>')
        out.append('<polyline fill="none" stroke="#15c" points="' + " ".join(f"{a:.1f},{b:.1f}" for a, b in at) + '"/>')
        out.append(f'<text x="{MARGIN + 4}" y="{top + 14}">{escape(" ".join(map(str, name)))}: {x0:g} to {x1:g}, {y0:.4g} to {y1:.4g}</text>')
    size = f'width="{WIDTH + 2 * MARGIN}" height="{MARGIN + len(lines) * (HEIGHT + MARGIN)}"'
    svg = f'<svg xmlns="http://www.w3.org/2000/svg" {size} font-family="sans-serif" font-size="11">' + "".join(out) + "</svg>"
    if save_to:
        Path(save_to).write_text(svg, encoding="utf-8")
    return svg


def correlation_picture(cc: DataFrame, title: str = "Cross-correlation", save_to: str | None = None):
    return picture(cc, "lag", "value", ["i", "j"], title, save_to)


def spectrum_picture(spectrum: DataFrame, title: str = "Cross-spectrum", save_to: str | None = None):
    return picture(spectrum, "freq_idx", "magnitude", ["i", "j"], title, save_to)


def model_picture(model: DataFrame, title: str = "Model", save_to: str | None = None):
    panel = ["kind", "i", "j"] if "i" in model.columns else ["kind", "dim"]
    return picture(model.where("kind <> 'noise'"), "lag", "value", panel, title, save_to)


def profile_picture(profile: DataFrame, values: list[str], title: str = "Profile", save_to: str | None = None):
    long = profile.select("bucket", F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).alias("value")) for v in values])).alias("s")).select("bucket", "s.*")
    return picture(long, "bucket", "value", ["name"], title, save_to)
