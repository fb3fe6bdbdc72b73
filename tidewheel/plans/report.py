"""Reports on a catalog: rows as JSON or CSV, and one page of HTML."""

from __future__ import annotations

import csv
import html
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.plans.catalog import Catalog, Files

#: Rows that a table on a page shows.
SHOWN = 200


def as_text(rows: DataFrame, form: str = "json", most: int = 1000) -> str:
    """The first ``most`` rows as JSON lines, CSV or a plain table; for whole results write a table instead."""
    found = rows.limit(most).collect()
    names = rows.columns
    if form == "json":
        return "\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in found)
    if form == "csv":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(names)
        writer.writerows([json.dumps(v, default=str) if isinstance(v, (list, dict)) else v for v in r] for r in found)
        return out.getvalue()
    if form != "table":
        raise ValueError("the form must be json, csv or table")
    cells = [names, *([str(v) for v in r] for r in found)]
    widths = [max(len(row[k]) for row in cells) for k in range(len(names))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells)


def _table(title: str, rows: DataFrame) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:.3f}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in rows.limit(SHOWN).collect())
    return f"<h2>{html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def catalog_page(catalog: Catalog, path: str, model: str | None = None) -> None:
    """Write a page: counts by task and label, the best episodes, near-duplicate pairs, flags.

    Each table shows ``SHOWN`` rows at most; the counts are of all.
    """
    episodes = catalog.studio()
    pairs = catalog.table("dedup_edges").select("episode_a", "episode_b", "similarity", "model_id")
    if model:
        pairs = pairs.where(F.col("model_id") == model)
    flags = catalog.latest_quality().select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("episodes")).orderBy(F.desc("episodes"), "flag")
    parts = [
        _table("Tasks", catalog.stats().orderBy(F.desc("episodes"), "task")),
        _table("Labels", catalog.label_counts().orderBy("label")),
        _table("Flags", flags),
        _table("Episodes", episodes.select("episode_id", "task", "language_instruction", "num_frames", "overall_score", F.concat_ws(", ", "flags").alias("flags"), "label")),
        _table("Near-duplicate pairs", pairs.orderBy(F.desc("similarity"), "episode_a", "episode_b")),
    ]
    total = catalog.table("episodes").agg(F.count("*"), F.sum("num_frames")).first()
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}"
    page = f"<!doctype html><meta charset=utf-8><title>Catalog</title><style>{style}</style><h1>{total[0]} episodes, {total[1] or 0} frames</h1>{''.join(parts)}"
    folder, _, name = path.rpartition("/")
    Files(catalog.spark, folder).write(name, page)
