"""Every registered query of the reference operators beside its SQL, on the smallest tables."""

import pytest

from lectern.plans import registry

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


#: queries without SQL; tests/test_characters.py holds the rows of each against a plain version
PLAIN = {"a7_html_parsed", "n4_name_groups", "n5_characters", "n6_character_table", "t27_similarity"}


def test_every_query_has_rows_to_meet():
    assert set(registry.queries()) - set(registry.oracles()) == PLAIN


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, SF, registry.queries()[name], registry.oracles()[name]) == ""
