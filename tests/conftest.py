import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from spanmart.operators import hotkeys  # noqa: E402
from spanmart.session import build_session  # noqa: E402

# Small tables are to be cut into many slices.
hotkeys.LEAST_SLICE = 1


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = build_session(
        "spanmart-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "2",
            # Plans here are large and the rows few: compiling them would take most of the time.
            "spark.sql.codegen.wholeStage": "false",
            "spark.ui.enabled": "false",
            "spark.sql.warehouse.dir": str(warehouse),
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(df, *cols):
    """Rows as sorted tuples, NULL first."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: [(v is not None, v) for v in t])
