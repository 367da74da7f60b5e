import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from strataloom.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    return DATA


def same(df, sql, sf_dir):
    """Rows of a query and of its SQL, as sorted tuples of text and rounded numbers."""
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.sql(sql).df()
    got = df.toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(frame):
        plain = frame[columns].astype(object).where(frame[columns].notna(), None)
        value = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        return sorted((tuple(None if v is None else value(v) for v in r) for r in plain.itertuples(index=False)), key=repr)

    assert rows(got) == rows(want)
    return len(got)
