"""Every registered query against its DuckDB oracle (the driver's check)."""

import pytest

from harness import SF_MID, SF_SMALL, compare, duck
from labelspark.oracles import ORACLES
from labelspark.queries import QUERIES

ORACLE_KEYS = sorted(k for k in QUERIES if k in ORACLES)
# a spread of keys that is also checked one scale up
MID_KEYS = ["prepare_labels", "consensus_l2", "clean_text", "surrogate_ids", "stratified_split",
            "sample_frac", "evaluation_report", "icm_baselines", "early_stop", "scoring_job",
            "group_study", "loss_by_batch"]


@pytest.fixture(scope="module")
def con_small():
    return duck(SF_SMALL)


@pytest.fixture(scope="module")
def con_mid():
    return duck(SF_MID)


def test_every_query_is_wired():
    import importlib.util
    import os
    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    assert set(mod.oracle_sql()) <= set(mod.queries())
    assert len(mod.queries()) >= 55


@pytest.mark.parametrize("name", ORACLE_KEYS)
def test_query_matches_oracle_small(spark, con_small, name):
    problems = compare(QUERIES[name](spark, SF_SMALL), con_small, ORACLES[name])
    assert problems == []


@pytest.mark.parametrize("name", MID_KEYS)
def test_query_matches_oracle_mid(spark, con_mid, name):
    problems = compare(QUERIES[name](spark, SF_MID), con_mid, ORACLES[name])
    assert problems == []


def test_entry_smoke(spark):
    import importlib.util
    import os
    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields][:2] == ["data_id", "text"]
