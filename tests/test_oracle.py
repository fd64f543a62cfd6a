"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from tracequery.plans import catalog

from .oracle import compare, connect


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    if name not in catalog.ORACLE_SQL:
        assert catalog.QUERIES[name](spark, sf_dir).count() > 0
        return
    with connect(sf_dir) as con:
        assert compare(name, spark, sf_dir, catalog.QUERIES[name], catalog.ORACLE_SQL[name], con) is None


def test_the_rest_stands_without_the_training_data_subpackage():
    import re
    from pathlib import Path

    for p in Path(catalog.__file__).parents[1].rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text(encoding="utf-8")), p
