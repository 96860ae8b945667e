import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from policygrid.session import build_session, ship

    s = build_session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def compare(spark, sf):
    """Rows of a query beside those of its SQL, both as sorted lists of comparable tuples."""
    import math

    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return v if v is None or isinstance(v, (bool, int, str)) else str(v)

    def run(query, sql):
        df = query(spark, sf)
        cols = sorted(df.columns)
        mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        return mine, sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)

    return run
