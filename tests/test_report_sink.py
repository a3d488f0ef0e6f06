"""Rendered reports, and a sink of which no unfinished job can be read."""

import pytest
from pyspark.sql import functions as F

from lodestone.sources import report_sink

CELLS = "label string, search string, mode string, n long, hit1 double, hit3 double, hit5 double, mrr double, gate_recall double, no_evidence_recall double, p95 double"
ROWS = "label string, search string, mode string, id string, answerable boolean, rank int, has_evidence boolean, top_score double, first_path string"


def report(spark):
    cells = spark.createDataFrame([("b", "s", "retrieval", 3, 0.5, 0.75, 1.0, 0.6123, None, None, 12.5), ("a", "s", "pipeline", 2, 0.0, 0.0, 0.0, None, 0.5, 1.0, None)], CELLS)
    rows = [
        ("b", "s", "retrieval", "q2", True, None, None, 0.4, "x.py"), ("b", "s", "retrieval", "q1", True, None, None, None, None), ("b", "s", "retrieval", "q3", True, 1, None, 0.9, "y.py"),
        ("a", "s", "pipeline", "q4", True, 2, False, 0.31, "z.py"), ("a", "s", "pipeline", "q5", False, None, True, 0.8, "w.py"),
    ]
    return report_sink.rendered(cells, spark.createDataFrame(rows, ROWS), "Runs", {"run": "r1"})


EXPECTED = """# Runs

- run: `r1`

| cell | search | mode | n | Hit@1 | Hit@3 | Hit@5 | MRR | answerable passed | no-evidence recall | p95 ms |
|---|---|---|---:|---:|---:|---:|---:|---:|---:|---:|
| `a` | s | pipeline | 2 | 0.0% | 0.0% | 0.0% | — | 50.0% | 100.0% | — |
| `b` | s | retrieval | 3 | 50.0% | 75.0% | 100.0% | 0.612 | — | — | 12.5 |

## Misses and refusals

### a / s / pipeline
- answerable but under the threshold: `q4`, top 0.310
- evidence without an answer: `q5`, `w.py`, top 0.800

### b / s / retrieval
- answer not found: `q1`, first is —
- answer not found: `q2`, first is `x.py`

"""


def test_report_text(spark, tmp_path):
    folder = str(tmp_path / "r")
    assert report_sink.read(spark, folder) is None
    report_sink.save(report(spark), folder)
    assert report_sink.read(spark, folder) == EXPECTED
    with pytest.raises(Exception, match="there is a report"):
        report_sink.save(report(spark), folder, "append")
    report_sink.save(report(spark).where("place < '1'"), folder)
    assert report_sink.read(spark, folder) == "".join(x + "\n" for x in EXPECTED.split("\n")[:6])
    assert len(list((tmp_path / "r").glob("part-*"))) == len(report_sink._manifest(tmp_path / "r"))


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "r")
    broken = spark.range(0, 4000, 1, 4).select(F.format_string("%05d", "id").alias("place"), F.when(F.col("id") == 3500, F.raise_error(F.lit("broken"))).otherwise(F.lit("line")).alias("line"))
    spark.dataSource.register(report_sink.ReportSink)
    with pytest.raises(Exception, match="broken"):  # one task fails while others have written their parts
        broken.write.format("report").mode("overwrite").save(folder)
    assert report_sink.read(spark, folder) is None and not (tmp_path / "r" / report_sink.MANIFEST).exists()
    # a report that is there stays as it was
    report_sink.save(report(spark), folder)
    with pytest.raises(Exception, match="broken"):
        broken.write.format("report").mode("overwrite").save(folder)
    assert report_sink.read(spark, folder) == EXPECTED


def test_rows_of_many_tasks_keep_their_order(spark, tmp_path):
    rows = spark.range(5000).repartition(7).select(F.format_string("%05d", "id").alias("place"), F.col("id").cast("string").alias("line"))
    report_sink.save(rows, str(tmp_path / "r"))
    assert report_sink.read(spark, str(tmp_path / "r")).split() == [str(i) for i in range(5000)]
