import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowloom import schema  # noqa: E402
from flowloom.session import local_session  # noqa: E402

SMALL = os.environ.get("FLOWLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture
def flows(spark):
    """Makes a flow table from dicts; what a dict leaves out is an ordinary value, except None, which stays."""
    from pyspark.sql import types as T

    kind = T.StructType([*schema.raw_schema().fields, T.StructField("source_row_id", T.LongType()), T.StructField("flow_group_id", T.StringType()), T.StructField("split", T.StringType())])

    def make(rows, extra=""):
        usual = {f.name: 1.5 if isinstance(f.dataType, T.DoubleType) else 7 for f in kind.fields}
        usual |= {"IPV4_SRC_ADDR": "10.0.0.1", "IPV4_DST_ADDR": "10.0.0.2", "Label": 0, "Attack": "Benign", "Dataset": schema.DATASETS[0], "flow_group_id": None, "split": "train"}
        full = [usual | {"source_row_id": i + 1} | r for i, r in enumerate(rows)]
        df = spark.createDataFrame([tuple(r[f.name] for f in kind.fields) for r in full], kind)
        for c in extra.split():
            df = df.selectExpr("*", f"'clash' AS `{c}`")
        return df

    return make
