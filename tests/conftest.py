import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


DOCS = "dataset string, split string, did string, ord bigint, units array<string>, text string, entities array<struct<start: int, end: int, type: string, surface: string>>, loaded_at timestamp"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Records from (did, units, spans) or (did, units, spans, split, dataset)."""

    def make(*rows):
        out = []
        for i, (did, units, spans, *rest) in enumerate(rows):
            split, dataset = (*rest, "train", "ncbi")[:2] if len(rest) == 2 else (rest[0] if rest else "train", "ncbi")
            units = units.split() if isinstance(units, str) else units
            sep = "" if dataset == "cmeee" else " "
            ents = None if spans is None else [(s, e, t, sep.join(units[s:e])) for s, e, t in spans]
            out.append((dataset, split, did, i, units, None if units is None else sep.join(units), ents, None))
        return spark.createDataFrame(out, DOCS)

    return make
