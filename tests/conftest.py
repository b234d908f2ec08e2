import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pulsegrid.session import local_session

    session = local_session(8, 4, "4g")
    yield session
    session.stop()


@pytest.fixture()
def many_chunks(spark):
    """Keep small shuffles apart, so that range partitioning really cuts a series."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.fixture()
def plan(spark):
    """Physical plan of a DataFrame as text."""

    def text(df):
        import contextlib
        import io

        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain()
        return out.getvalue()

    return text
