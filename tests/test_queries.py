"""Every query with SQL gives the SQL's rows."""

import pytest
from conftest import same

from heddle.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(name, spark, sf, duck):
    same(catalogue.QUERIES[name](spark, sf), duck, catalogue.ORACLE[name])


@pytest.mark.parametrize("name", ["vendi_dual", "logdet_distance", "logdet_draws", "vocd_summary", "semantic_classes", "component_count", "vendi_orders", "ngram_vendi"])
def test_others_give_rows(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
