from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def corpus(tmp_path):
    """Write Markdown files under a root; call it with {path: text}."""

    def write(files: dict[str, str]):
        for name, text in files.items():
            path = tmp_path / "root" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text, "utf-8")
        return tmp_path / "root"

    return write
