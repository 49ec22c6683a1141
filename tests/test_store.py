"""Parquet layout: write_school / read_school round-trip with declared types."""

from __future__ import annotations

import tempfile

from conftest import SF_SMALL
from rollbook.operators import fees
from rollbook.sources.fixtures import derive_school
from rollbook.sources.schema import SCHEMAS
from rollbook.sources.store import read_school, write_school


def test_round_trip_keeps_rows_types_and_results(spark):
    s = derive_school(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="run-store-", dir="/tmp") + "/school"
    write_school(s, path, files_per_table=3)
    back = read_school(spark, path)
    types = lambda st: [(f.name, f.dataType) for f in st.fields]
    for name, schema in SCHEMAS.items():
        assert types(back.table(name).schema) == types(s.table(name).schema) == types(schema), name
        assert back.table(name).count() == s.table(name).count(), name
    assert sorted(map(tuple, fees.defaulters(back).collect())) == sorted(map(tuple, fees.defaulters(s).collect()))


def test_writing_over_the_source_is_refused(spark):
    import pytest
    path = tempfile.mkdtemp(prefix="run-store-", dir="/tmp") + "/school"
    write_school(derive_school(spark, SF_SMALL), path)
    with pytest.raises(ValueError, match="read from"):
        write_school(read_school(spark, path), path)
