"""Registered queries over the given tables and over tables whose later days are multiplied: rows of earlier days stay as they are."""

import os
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from tests.conftest import SMALL
from tickloom.plans import catalog

CUT = pa.scalar("2024-01-20").cast(pa.timestamp("us"))
#: Queries whose rows of a day may only know that day and earlier ones.
NAMES = (
    "eng_03", "eng_04", "eng_05", "eng_06", "eng_07", "eng_08", "eng_11", "eng_12", "eng_13", "eng_14", "eng_15", "eng_16", "eng_18", "eng_20", "eng_29", "eng_30", "fn_13", "fn_15", "win_08", "win_24", "win_25", "win_26", "agg_11", "agg_12",
)


#: These need more rows than the smallest tables have.
LARGER = {"eng_11": "/root/testdata/sf0.01", "eng_12": "/root/testdata/sf0.01", "eng_13": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def poisoned(tmp_path_factory):
    def made(source):
        folder = tmp_path_factory.mktemp("poisoned")
        for p in Path(source).glob("*.parquet"):
            if p.stem != "events":
                os.symlink(p, folder / p.name)
        t = pq.read_table(f"{source}/events.parquet")
        late = pc.greater_equal(t.column("ts").cast(pa.timestamp("us")), CUT)
        value = pc.if_else(late, pc.multiply(t.column("value"), 37.0), t.column("value"))
        pq.write_table(t.set_column(t.schema.get_field_index("value"), "value", value), folder / "events.parquet")
        return str(folder)

    return {source: made(source) for source in {SMALL, *LARGER.values()}}


@pytest.mark.parametrize("name", NAMES)
def test_later_days_change_no_earlier_row(spark, poisoned, name):
    source = LARGER.get(name, SMALL)
    one, two = (catalog.queries()[name](spark, folder).where("session_date < '2024-01-20'").toPandas() for folder in (source, poisoned[source]))
    said = [sorted(map(str, x[sorted(x.columns)].itertuples(index=False, name=None))) for x in (one, two)]
    assert len(one) > 0 and said[0] == said[1]
