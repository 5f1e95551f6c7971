"""Written tables go with their owners."""

from __future__ import annotations

from pathlib import Path

import pytest

from lotwise.plans import clean as job
from lotwise.plans.clean import CleanSpec, clean_and_learn, step_counts
from lotwise.sources import workspace as W


def tables(spark) -> set[str]:
    folder = Path(W.shared_folder(spark).removeprefix("file:")) / "lotwise" / spark.sparkContext.applicationId
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def test_scope_deletes_on_success_and_on_failure(spark):
    before = tables(spark)
    with W.scope(spark):
        df = W.materialize(spark.range(5), "kept")
        assert df.count() == 5 and len(tables(spark) - before) == 1
    assert tables(spark) == before
    with pytest.raises(ValueError), W.scope(spark) as owner:
        owner.retain()  # a result that is never handed out
        W.materialize(spark.range(5), "failed")
        raise ValueError
    assert tables(spark) == before


def test_tables_stay_while_a_result_needs_them(spark):
    before = tables(spark)
    with W.scope(spark) as outer:
        W.materialize(spark.range(3), "outer")
        with W.scope(spark) as inner:
            df = W.materialize(spark.range(7), "inner")
            first, second = inner.retain(), inner.retain()
        assert df.count() == 7
        first.release()
        assert df.count() == 7 and len(tables(spark) - before) == 2
        second.release()
        assert len(tables(spark) - before) == 1
        assert outer.holds == 1
    assert tables(spark) == before


def test_cleaning_leaves_no_table_behind(spark, vehicles, monkeypatch):
    before = tables(spark)
    step_counts(vehicles)
    assert tables(spark) == before
    with clean_and_learn(vehicles, CleanSpec()) as cleaned:
        assert cleaned.rows.count() > 0 and len(tables(spark) - before) == 1
    assert tables(spark) == before

    def fails(*args):
        raise RuntimeError("no fence")

    monkeypatch.setattr(job, "learn", fails)
    with pytest.raises(RuntimeError):
        clean_and_learn(vehicles, CleanSpec())
    assert tables(spark) == before


def test_clear_leaves_the_shared_folder_empty(tmp_path):
    """A session of its own, as a whole run has it: nothing is left of tables and checkpoints."""
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from lotwise.session import get_session
from lotwise.sources.workspace import clear, materialize, scope
spark = get_session("own", cpus=1, **{{"spark.checkpoint.dir": {str(tmp_path / 'shared')!r}}})
materialize(spark.range(3)); spark.range(4).checkpoint()
with scope(spark) as owner:
    owner.retain(); materialize(spark.range(3))
if {{clears}}: clear(spark)
"""
    for clears in (True, False):  # without the call it is done when Python ends
        subprocess.run([sys.executable, "-c", code.replace("{clears}", str(clears))], check=True, capture_output=True, timeout=120)
        left = [p for p in (tmp_path / "shared").rglob("*") if p.is_file()]
        assert left == []
