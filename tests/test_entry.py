import os
import sys

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_registry():
    names = __spark_entry__.queries()
    assert len(names) > 50 and set(__spark_entry__.oracle_sql()) <= set(names)


def test_imports_without_the_other_subpackage(monkeypatch):
    from palimpsest import stored_workload, workload

    monkeypatch.setattr(__spark_entry__, "_llm", lambda: False)
    assert __spark_entry__.queries().keys() == workload.queries().keys() | stored_workload.queries().keys() == __spark_entry__.oracle_sql().keys()
    assert not workload.queries().keys() & stored_workload.queries().keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns == ["s", "p", "o"] and __spark_entry__.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["vm_backward", "dm_across", "vq_all", "count_vm", "deletion_positions", "orders_vq", "dictionary", "compacted_vm_o", "two_snapshots_dm", "store_purged", "store_prepended", "files_vq", "stream_versions", "patch_over_patch", "pattern_counts_by_version"])
def test_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("events", "orders"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(x[c] for c in columns) for x in got.collect()))) == sorted(map(str, (tuple(x[i] for i in order) for x in want.fetchall())))
    assert "palimpsest" in sys.modules
