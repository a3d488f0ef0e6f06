"""Evaluation reports: rendered as rows by one plan, written by a sink that shows whole reports or nothing.

``rendered`` makes the Markdown lines of a report (table of cells, conditions, observations)
with their place, so that any number of observations is rendered where it lies. The sink
``report`` writes rows (place, line), sorted within tasks by place, as part files under a name of their own; on
commit it writes a manifest of the parts in the order of their first places, by one rename.
What no manifest names is not part of the report: a failed or aborted job, or a task that ran
twice, leaves nothing that can be read, and the last complete report stays as it was.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "manifest.json"


@dataclass
class Part(WriterCommitMessage):
    """A part file, its first place and how many lines it has."""

    file: str
    first: str
    lines: int


class ReportWriter(DataSourceWriter):
    """The folder must be one that all executors share."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.run, self.overwrite = Path(folder), uuid.uuid4().hex, overwrite
        if not overwrite and (self.folder / MANIFEST).exists():
            raise FileExistsError(f"there is a report in {folder}")

    def write(self, iterator: Iterator[Row]) -> Part:
        """Lines of one task; rows come sorted by place."""
        self.folder.mkdir(parents=True, exist_ok=True)
        name, first, n = f"part-{self.run}-{uuid.uuid4().hex}.md", None, 0
        with open(self.folder / name, "w", encoding="utf-8", newline="\n") as out:
            for row in iterator:
                first = row["place"] if first is None else first
                out.write(f"{row['line']}\n")
                n += 1
        if not n:
            (self.folder / name).unlink()
        return Part(name, first or "", n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m.first, m.file, m.lines) for m in messages if isinstance(m, Part) and m.lines)
        old = _manifest(self.folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        draft = self.folder / f".{self.run}"
        draft.write_text(json.dumps({"parts": [f for _, f, _ in parts], "lines": sum(n for _, _, n in parts)}))
        os.replace(draft, self.folder / MANIFEST)
        kept = {f for _, f, _ in parts}
        for name in [*old, *(p.name for p in self.folder.glob(f"part-{self.run}-*"))]:
            if name not in kept:  # parts of the report before, and of tasks that ran twice
                (self.folder / name).unlink(missing_ok=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for part in self.folder.glob(f"part-{self.run}-*"):
            part.unlink(missing_ok=True)


def _manifest(folder: Path) -> list[str]:
    file = folder / MANIFEST
    return json.loads(file.read_text())["parts"] if file.exists() else []


class ReportSink(DataSource):
    """``df.write.format("report").mode("overwrite").save(folder)`` of rows (place, line)."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(self.options["path"], overwrite)


def save(lines: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Write a rendered report; ``mode`` append refuses a folder that has one."""
    lines.sparkSession.dataSource.register(ReportSink)
    lines.select("place", "line").repartitionByRange("place").sortWithinPartitions("place").write.format("report").mode(mode).save(folder)


def read(spark: SparkSession, folder: str) -> str | None:
    """The text of the last complete report of a folder."""
    parts = _manifest(Path(folder))
    return "".join((Path(folder) / p).read_text(encoding="utf-8") for p in parts) if (Path(folder) / MANIFEST).exists() else None


def _shown(form: str, value: Column) -> Column:
    """A value in a format, a dash where it is null."""
    return F.when(value.isNull(), "—").otherwise(F.format_string(form, value))


def _percent(value: Column) -> Column:
    return _shown("%.1f%%", value * 100)


def rendered(cells: DataFrame, rows: DataFrame, title: str, facts: dict[str, str]) -> DataFrame:
    """place and line of a report over cells (label, search, mode, n, hit1, hit3, hit5, mrr, gate_recall, no_evidence_recall, p95) and their rows.

    ``rows`` has label, search, mode, id, answerable, rank, has_evidence, top_score and
    first_path. Observed are answers that were not found, answerable questions under the
    threshold (pipeline mode), and evidence for questions that have none.
    """
    spark = cells.sparkSession
    at = lambda *parts: F.concat_ws("/", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    head = [f"# {title}", "", *(f"- {k}: `{v}`" for k, v in facts.items()), "", "| cell | search | mode | n | Hit@1 | Hit@3 | Hit@5 | MRR | answerable passed | no-evidence recall | p95 ms |", "|---|---|---|---:|---:|---:|---:|---:|---:|---:|---:|"]
    fixed = spark.createDataFrame([(f"0/{i:04d}", line) for i, line in enumerate(head)] + [("2/0", ""), ("2/1", "## Misses and refusals"), ("2/2", "")], "place string, line string")
    # a cell's place: labels and modes in order; "!" sorts before all that names hold
    own = lambda *more: at("", *[F.coalesce(c, F.lit("")) for c in ("label", "search", "mode")], *more)
    table = cells.select(
        F.concat(F.lit("1"), own()).alias("place"),
        F.concat(F.lit("| "), F.concat_ws(" | ", F.format_string("`%s`", "label"), "search", "mode", F.col("n").cast("string"), *map(_percent, map(F.col, ("hit1", "hit3", "hit5"))), _shown("%.3f", F.col("mrr")), *map(_percent, map(F.col, ("gate_recall", "no_evidence_recall"))), _shown("%s", F.col("p95").cast("string"))), F.lit(" |")).alias("line"),
    )
    top = _shown("%.3f", F.col("top_score"))
    name, path = F.format_string("`%s`", "id"), _shown("`%s`", F.col("first_path"))
    kinds = F.array_compact(F.array(
        F.when(F.col("answerable") & F.col("rank").isNull(), F.struct(F.lit("1").alias("k"), F.concat(F.lit("- answer not found: "), name, F.lit(", first is "), path).alias("line"))),
        F.when(F.col("answerable") & (F.col("mode") == "pipeline") & ~F.coalesce("has_evidence", F.lit(False)), F.struct(F.lit("2").alias("k"), F.concat(F.lit("- answerable but under the threshold: "), name, F.lit(", top "), top).alias("line"))),
        F.when(~F.col("answerable") & F.coalesce("has_evidence", F.lit(False)), F.struct(F.lit("3").alias("k"), F.concat(F.lit("- evidence without an answer: "), name, F.lit(", "), path, F.lit(", top "), top).alias("line"))),
    ))
    seen = rows.select("label", "search", "mode", "id", F.explode(kinds).alias("x"))
    lines = seen.select(F.concat(F.lit("3"), own("1", F.col("x.k"), F.col("id").cast("string"))).alias("place"), "x.line")
    heads = seen.select("label", "search", "mode").distinct().select(F.concat(F.lit("3"), own("0")).alias("place"), F.concat(F.lit("### "), F.concat_ws(" / ", "label", "search", "mode")).alias("line"))
    gaps = seen.select("label", "search", "mode").distinct().select(F.concat(F.lit("3"), own("2")).alias("place"), F.lit("").alias("line"))
    return fixed.unionByName(table).unionByName(heads).unionByName(lines).unionByName(gaps)
