import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from tradeloom.session import get_spark

    # tiny inputs: compiling their plans would take most of the time; test_entry runs the compiled ones
    s = get_spark("local[4]", shuffle_partitions=2, memory="3g", **{"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Sorted tuples of a DataFrame."""
    return lambda df, *cols: sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
