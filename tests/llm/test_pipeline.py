from __future__ import annotations

import os
import subprocess
import sys

import corpus_pipeline
from fleetlens.llm import near_dedup
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    sizes = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = corpus_pipeline.stage(step(spark, kept, SF), name)
        assert kept.columns == columns
        assert kept.exceptAll(before).isEmpty()  # rows go or stay as they are
        sizes[name] = {r.doc_id for r in kept.collect()}
        if name == "near_dedup":
            groups = brute([(r.doc_id, r.text) for r in before.collect()])
            assert sizes[name] == {i for i, c in groups.items() if i == c}
    assert len(sizes["quality_rules"] & good) > 0.9 * len(good)
    assert len(sizes["quality_rules"] & bad) < 0.5 * len(bad)
    final = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert final.count() == kept.count() and final.where("NOT restored").isEmpty()
    assert corpus_pipeline.run(spark, SF).count() == final.count()
    assert near_dedup.near_duplicates(kept).where("NOT kept").isEmpty()


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, SF)
        assert empty.count() == 0


def test_entry_point_without_this_package(tmp_path):
    """The other queries register when the package and the pipeline are gone."""
    for name in ("__spark_entry__.py", "fleetlens"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "fleetlens").mkdir()
    for name in os.listdir(f"{ROOT}/fleetlens"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/fleetlens/{name}", tmp_path / "fleetlens" / name)
    code = (
        "import importlib.util as u, sys; s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s);"
        " s.loader.exec_module(m); sys.path.insert(0, '.'); q = m.queries();"
        " assert q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert m.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
