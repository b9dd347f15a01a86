"""The entry points, with and without the corpus subpackage, and the command line."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__
from corvane import __main__ as command

REPO = Path(__file__).resolve().parents[1]


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not Path(__spark_entry__.FLAGSHIP_DIR).exists(), reason="no tables")
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["class", "ap", "n_positive", "n_total"] and df.count() == 10


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)], ids=["all deleted", "pipeline left in place"])
def test_entry_without_the_corpus_subpackage(tmp_path, left):
    for name in ("corvane", "__spark_entry__.py", *left):
        if (REPO / name).exists():
            (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, tmp_path / name)
    shutil.rmtree(tmp_path / "corvane/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; names = e.queries(); assert len(names) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in names) and e.oracle_sql(); assert e.__file__.startswith(%r)" % str(tmp_path)
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_subpackage():
    for path in (REPO / "corvane").rglob("*.py"):
        if "llm" not in path.parts:
            assert "corvane.llm" not in path.read_text(), path


def test_report_command(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = [(f, f % 3, c, float(draw.random() * 0.6 + 0.4 * (c == f % 3))) for f in range(12) for _ in range(2) for c in range(3)]
    tables = command.report(spark, spark.createDataFrame(rows, "file long, label int, class int, score double"), str(tmp_path), "lme", resamples=10)
    back = spark.read.option("header", True).csv(f"{tmp_path}/species")
    assert back.columns == ["class", "ap", "ci_lower", "ci_upper", "n_positive", "n_total"] and back.count() == 3
    assert [float(r["ap"]) for r in back.collect()] == sorted((float(r["ap"]) for r in back.collect()), reverse=True)
    assert spark.read.text(f"{tmp_path}/benchmark").first()[0].startswith('{"model_path":"","num_classes":3,"num_files":12,"metrics":{') and "<table>" in spark.read.text(f"{tmp_path}/page").first()[0]
    assert tables["predictions"].count() == 12


def test_board_command(spark, tmp_path):
    log = tmp_path / "log.txt"
    log.write_text("[1/1] a.wav\n  [BENCH] read=1ms stft=2ms npu=3ms total=6ms\n    [1] kind: 50.0%\nProcessed: 1 / 1 files (0 errors)\nBenchmark: all (avg read=1ms stft=2ms npu=3ms total=6ms)\n")
    command.board(spark, str(log), str(tmp_path / "out"))
    row = spark.read.option("header", True).csv(f"{tmp_path}/out/board").first()
    assert tuple(row) == ("a.wav", "kind", "0.5000")
    totals = spark.read.option("header", True).csv(f"{tmp_path}/out/totals").first()
    assert totals["processed"] == "1" and float(totals["rtf"]) == 0.002 and float(totals["speedup"]) == 500
