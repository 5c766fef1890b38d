"""The driver's contract, and results that don't depend on partitioning."""

import pathlib
import subprocess
import sys

import pytest

import __spark_entry__ as entry_point
from quakeframe.plans import catalogue

ROOT = pathlib.Path(entry_point.__file__).parent
DIR = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns[:2] == ["station", "tolerance"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_nothing_else_imports_the_corpus_part():
    for p in (ROOT / "quakeframe").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "quakeframe.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p


def test_entry_imports_without_the_corpus_part(tmp_path):
    import shutil

    shutil.copytree(ROOT / "quakeframe", tmp_path / "quakeframe", ignore=lambda d, names: ["llm"] if d.endswith("quakeframe") else [])
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


@pytest.mark.parametrize("name", ["flagship_pick_metrics", "w4_event_split", "j8_pair_events", "w13_match_distribution", "w11_pick_ids", "x28_upsample_minority", "a3_fence_stats"])
def test_partitioning_changes_nothing(spark, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = catalogue.QUERIES[name](spark, DIR)
        return sorted(map(str, df.select(*sorted(df.columns)).collect()))

    try:
        assert run("1") == run("9")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
