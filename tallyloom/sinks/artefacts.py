"""Artefacts of a run: JSON, JSON lines, guarded CSV, and a manifest that tells whether the run is complete.

A run's folder is written once. Tables are written by Spark's own commit, so a lost executor leaves no half of one; small
documents are written beside and then renamed.
"""

from __future__ import annotations

import html
import json
import platform as machine
from typing import Any

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as tx


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = _path(spark, name)
    return fs.exists(path)


def text(spark: SparkSession, name: str) -> str:
    path, fs = _path(spark, name)
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, name: str, content: str) -> None:
    """Write a small document whole: to a name beside it, then renamed over the old one."""
    path, fs = _path(spark, name)
    beside, _ = _path(spark, f"{name}.tmp")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(content.encode("utf-8")))
    finally:
        stream.close()
    fs.delete(path, False)
    if not fs.rename(beside, path):
        raise OSError(f"could not rename to {name}")


def put_json(spark: SparkSession, name: str, value: Any) -> None:
    put_text(spark, name, json.dumps(value, ensure_ascii=False, indent=2))


def put_lines(df: DataFrame, folder: str) -> None:
    """JSON lines, in as many files as df has partitions; an existing folder is refused."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(folder)


def put_table(df: DataFrame, folder: str) -> None:
    df.write.mode("errorifexists").parquet(folder)


def flat(df: DataFrame) -> DataFrame:
    """Columns as a spreadsheet may read them: nested values as JSON, strings guarded, null empty, numbers as they are."""

    def one(name: str, kind: str) -> Column:
        if kind.startswith(("array", "struct", "map", "variant")):
            return tx.csv_guard(F.coalesce(F.to_json(F.col(f"`{name}`")), F.lit("")))
        if kind == "string":
            return tx.csv_guard(F.coalesce(F.col(f"`{name}`"), F.lit("")))
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    return df.select(*(one(n, t).alias(n) for n, t in df.dtypes))


def merged_rows(*parts: DataFrame) -> DataFrame:
    """The rows of all parts, with every column of any of them in the order of their first sight."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def put_csv(df: DataFrame, folder: str) -> None:
    """Guarded CSV files, each with a header; the header begins with the byte order mark that spreadsheets look for."""
    names = df.columns
    rows = flat(df)
    rows = rows.withColumnsRenamed({names[0]: "﻿" + names[0]}) if names else rows
    rows.write.mode("errorifexists").option("header", True).option("escape", '"').option("quoteAll", True).option("encoding", "UTF-8").csv(folder)


def run_status(files: DataFrame, records: DataFrame, invalid_rows: int, full: bool, topics: str) -> DataFrame:
    """One row `run_status`: COMPLETE for a full run without broken files or rows, with every valid record analysed and
    topics in order; else PARTIAL. An empty run is not complete."""
    good = records.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("status").isin("SUCCESS", "PARTIAL") | ~F.col("valid")), F.lit(True)).alias("done"))
    broken = files.agg(F.count_if(F.col("status") == "ERROR").alias("errors"))
    whole = F.lit(full and invalid_rows == 0 and topics in ("SUCCESS", "INSUFFICIENT_DATA", "DISABLED")) & (F.col("n") > 0) & F.coalesce("done", F.lit(False)) & (F.col("errors") == 0)
    return good.crossJoin(F.broadcast(broken)).select(F.when(whole, "COMPLETE").otherwise("PARTIAL").alias("run_status"))


def run_coverage(files: DataFrame) -> DataFrame:
    """One row over included files (status, window_complete, comparable, total_reported): whether all windows are complete
    and comparable, and the reported total."""
    some = files.where("status = 'INCLUDED'")
    all_ = F.coalesce(F.bool_and(F.coalesce("window_complete", F.lit(False)) & F.coalesce("comparable", F.lit(False))), F.lit(False))
    return some.agg(all_.alias("comparable_complete_windows"), F.coalesce(F.sum("total_reported"), F.lit(0)).alias("total_reported"))


def compared_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(figure, old, new) of the records (text, valid, status) of two runs."""

    def figures(df: DataFrame, name: str) -> DataFrame:
        counts = {"records": F.count("*"), "valid": F.count_if("valid"), "success": F.count_if(F.col("status") == "SUCCESS"), "partial": F.count_if(F.col("status") == "PARTIAL"), "failed": F.count_if(F.col("status") == "FAILED"), "short": F.count_if(F.length("text") < 5), "repeated": F.count("text") - F.count_distinct("text")}
        return df.agg(*(c.alias(n) for n, c in counts.items())).select(F.inline(F.array(*(F.struct(F.lit(n).alias("figure"), F.col(n).alias(name)) for n in counts))))

    return figures(old, "old").join(figures(new, "new"), "figure")


def put_run(spark: SparkSession, folder: str, tables: dict[str, DataFrame], sheets: dict[str, DataFrame], manifest: dict[str, Any]) -> None:
    """All artefacts of a run: a table for each name, guarded CSV of some, and the manifest last, which marks it finished."""
    if exists(spark, f"{folder}/manifest.json"):
        raise FileExistsError(f"{folder} holds a finished run; choose a new folder")
    for name, df in tables.items():
        put_table(df, f"{folder}/{name}")
    for name, df in sheets.items():
        put_csv(df, f"{folder}/{name}.csv")
    put_json(spark, f"{folder}/manifest.json", {**manifest, "environment": {"python": machine.python_version(), "spark": pyspark.__version__}, "tables": sorted(tables), "promotion_state": "RESEARCH_ONLY"})


def reopen(spark: SparkSession, folder: str, schema_version: str) -> dict[str, DataFrame]:
    """The tables of a finished run, to be worked on without judging anything anew; of this schema version only."""
    manifest = json.loads(text(spark, f"{folder}/manifest.json"))
    if manifest.get("schema_version") != schema_version:
        raise ValueError(f"the run has schema {manifest.get('schema_version')}, not {schema_version}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["tables"]}


def guard_manifest(spark: SparkSession, name: str, manifest: dict[str, Any]) -> None:
    """Write a run's manifest once; the same one may go on, a changed one is refused."""
    if exists(spark, name):
        if json.loads(text(spark, name)) != manifest:
            raise ValueError("input or settings changed: choose a new run folder")
        return
    put_json(spark, name, manifest)


def guard_annotations(spark: SparkSession, folder: str) -> None:
    """Refuse to replace annotations (JSON lines) of which any is done."""
    if exists(spark, folder) and not spark.read.json(folder).where("annotation_status in ('COMPLETE', 'COMPLETED')").isEmpty():
        raise FileExistsError("completed annotations are never overwritten; choose a new folder")


def progress(spark: SparkSession, done: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted rows that no finished stage table has yet: what a run that was broken off still has to do."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


# What may be published of each artefact; anything not named stays.
PUBLIC = {
    "entities": ["entity_id", "name", "category", "code", "layer", "mentions", "explicit_count", "context_count", "recommendation_count", "self_position_count", "self_buy_count", "hold_count", "watch_count", "avoid_count", "sell_count", "unique_texts", "unique_groups", "video_count", "video_total", "bullish_index", "bull_ratio", "disagreement", "engagement_ratio", "engagement_comments", "balanced_score", "sample_status"],
    "methods": ["method", "n", "percentage", "support", "oppose", "unknown", "net_support", "sample_status"],
    "risks": ["rule", "attitude", "n"],
    "rationales": ["entity_id", "reason_code", "stance", "mentions"],
    "daily": ["day", "n"],
}


def public(kind: str, df: DataFrame) -> DataFrame:
    """The columns of df that may be published, in the order of the list."""
    return df.select(*(c for c in PUBLIC[kind] if c in df.columns))


def renumbered(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """df with a column's values replaced by prefix and a number, in their order: names of sources do not leave."""
    from pyspark.sql import Window

    names = df.select(column).distinct().withColumn("_no", F.row_number().over(Window.orderBy(column)))
    return df.join(names, column, "left").withColumn(column, F.concat(F.lit(f"{prefix}_"), F.col("_no").cast("string"))).drop("_no")


def link(url: str | None, label: str) -> str:
    """A link where the address is of the web, else the label alone."""
    safe = url and url.lower().startswith(("http://", "https://"))
    return f'<a href="{html.escape(url, quote=True)}">{html.escape(label)}</a>' if safe else html.escape(label)


def _percent(x: float | None) -> str:
    return "–" if x is None else f"{100 * x:.1f}%"


def board_table(title: str, rows: list[dict[str, Any]]) -> str:
    """A board's rows as an HTML table; samples under ten directional comments are marked."""
    marks = {"INSUFFICIENT": " (insufficient sample)"}
    cells = "".join(
        f"<tr><td>{html.escape(str(r['entity_id']))}</td><td>{r['mentions']}</td><td>{r['recommendation_count']}</td><td>{_percent(r['bull_ratio'])}{marks.get(r['sample_status'], '')}</td></tr>" for r in rows
    )
    return f"<h2>{html.escape(title)}</h2><table><tr><th>entity</th><th>mentions</th><th>recommended</th><th>bullish</th></tr>{cells}</table>"


def report(boards: dict[str, DataFrame], comments: DataFrame, title: str, most: int = 500) -> str:
    """One page: a table for each board, and the comments behind them, with anchors. Shows at most `most` of each."""
    tables = "".join(board_table(name, [r.asDict() for r in df.limit(most).collect()]) for name, df in boards.items())
    notes = "".join(f'<article id="{html.escape(r.comment_key, quote=True)}"><p>{html.escape(r.text or "")}</p>{link(r.video_url, "source")}</article>' for r in comments.select("comment_key", "text", "video_url").limit(most).collect())
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{tables}{notes}'


def spliced(page: str, section: str, mark: str = "conclusions") -> str:
    """page with the section between its marks put in or replaced, so that doing it twice changes nothing."""
    begin, end = f"<!-- {mark} -->", f"<!-- /{mark} -->"
    block = f"{begin}{section}{end}"
    if begin in page and end in page:
        return page[: page.index(begin)] + block + page[page.index(end) + len(end) :]
    return page.replace("</h1>", f"</h1>{block}", 1) if "</h1>" in page else block + page


def embedded(value: Any) -> str:
    """JSON that may stand in a script element: no character of it can open or close markup."""
    return json.dumps(value, ensure_ascii=False).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")


def annotation_page(task: str, rows: list[dict[str, Any]], labels: list[str]) -> str:
    """A page on which a person labels rows without seeing any prediction, and saves them as JSON."""
    options = "".join(f"<option>{html.escape(x)}</option>" for x in labels)
    script = f"const rows = {embedded(rows)}; const at = document.getElementById('rows'); rows.forEach((r, i) => {{ const p = document.createElement('p'); p.textContent = r.text; const s = document.createElement('select'); s.innerHTML = '<option></option>{options}'; s.onchange = () => {{ rows[i].gold_label = s.value; }}; at.append(p, s); }}); document.getElementById('save').onclick = () => {{ const a = document.createElement('a'); a.href = URL.createObjectURL(new Blob([JSON.stringify(rows)])); a.download = 'annotations.json'; a.click(); }};"
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(task)}</title><button id="save">save</button><div id="rows"></div><script>{script}</script>'
