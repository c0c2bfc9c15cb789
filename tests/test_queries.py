"""Each registered query against its oracle on the smallest tables."""

import pytest

from citeplane.plans.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def shape(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = shape([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        assert got == shape(found.fetchall(), [d[0] for d in found.description])


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
