from __future__ import annotations

from checks import all_checks

SF_DIR = "/root/testdata/sf0.001"


def test_gaps_are_looked_for_in_the_whole_table(spark):
    rows = all_checks()["rule_gas_day_gaps_all"].run(spark, SF_DIR).collect()
    assert rows
    assert min(r.first_date for r in rows).year < 1999 < max(r.last_date for r in rows).year
