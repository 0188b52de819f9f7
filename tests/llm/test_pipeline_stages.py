"""Each stage of the pipeline on rows with nulls, empty and long texts, ties, repeats and names of its own; and without a shared folder."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, uid string, Size int, IDS string, component_id long, kept string, copies int"
LONG = " ".join(f"word{k % 977} on line {k}" for k in range(6000))
TEXTS = [
    (1, "a plain text of some words that tell of a house by the sea and of those who live in it now", "s1"), (2, None, "s1"), (3, "", None), (4, LONG, "s2"), (5, LONG.upper(), "s2"),
    (6, "A plain text of some words that tell of a house by the sea and of those who live in it now", "s1"), (None, "no id here but words enough to be a text of its own for all stages", "s1"),
    (7, LONG.replace("word5 ", "other5 "), "s3"), (8, "short", "s1"), (8, "short", "s1"), (9, " \n\t ", "s1"), (10, "x" * 50_000, "s3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, "u", 1, "i", 7, "k", 2) for i, t, s in TEXTS], SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_row_and_keep_the_columns(spark, docs, name):
    stage, folder = dict(corpus_pipeline.STAGES)[name], "/root/testdata/sf0.001"
    out = stage(spark, docs, folder)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    rows = out.collect()
    texts = [r["text"] for r in rows] if "text" in out.columns else []
    if name == "exact dedup":
        assert sorted(t or "" for t in texts) == sorted({(t or "").lower(): t or "" for _, t, _ in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0]))}.values())
    if name == "near dedup":
        assert sum((t or "").lower().startswith("word0 on line 0") for t in texts) == 1 and sum((t or "").lower().startswith("a plain text") for t in texts) == 1
        assert "x" * 50_000 in texts and any((t or "").startswith("no id") for t in texts)
    if name == "mixing":
        assert {t for t in texts if t} <= {t for _, t, _ in TEXTS}
    if name == "encoding":
        assert len(rows) == len(TEXTS) and all(r["round_trip"] for r in rows) and all((r["n_ids"] == 0) == (not t) for r, t in ((r, dict((i, t) for i, t, _ in TEXTS)[r["doc_id"]]) for r in rows))
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_written_steps_need_no_setting(tmp_path):
    """On one machine without spark.checkpoint.dir a temporary folder serves."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "assert not spark.conf.get('spark.checkpoint.dir', '')\n"
        "from textquarry.llm import queries\n"
        "print('ROWS', queries.op11_warc(spark, '/root/testdata/sf0.001').count(), queries.op9_mixing(spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {"PYTHONPATH": str(ROOT), "TMPDIR": str(tmp_path), "SPARK_CONF_DIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in run.stdout, run.stderr[-2000:]
