import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lattica.session import local_session

    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.codegen.wholeStage", "false")  # tables are tiny: compiling takes longer than running
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(SMALL).iterdir()):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(frame, columns):
    """Comparable rows of a pandas frame."""
    plain = lambda x: None if x is None or x != x else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr)
