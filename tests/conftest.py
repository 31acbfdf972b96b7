import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny():
    """The smallest tables of the driver."""
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


CONCEPT = "ord long, type string, title string, description string, resource string, tags array<string>, timestamp string, content string, file_path string, custom map<string,string>"


@pytest.fixture(scope="session")
def make_concepts(spark):
    def make(*rows):
        full = [(k, r.get("type", "table"), r.get("title", ""), r.get("description", ""), r.get("resource", ""), r.get("tags", []), r.get("timestamp", ""), r.get("content", ""), r.get("file_path", f"c{k}.md"), r.get("custom", {})) for k, r in enumerate(rows)]
        return spark.createDataFrame(full, CONCEPT)

    return make
