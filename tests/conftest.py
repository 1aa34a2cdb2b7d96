import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from crisislens.session import get_spark
    s = get_spark("crisislens-tests", master="local[4]", shuffle_partitions=4,
                  local_checkpoint_dir=tempfile.mkdtemp(prefix="crisislens-test-ckpt-"))
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="crisislens-test-")


def make_raw(spark, rows, schema="Date string, Author string, Tweet string"):
    return spark.createDataFrame(rows, schema)


def posts_df(spark, rows):
    """Raw posts in the fixture layout (explicit mapping POSTS_MAPPING)."""
    schema = ("post_id long, dt timestamp_ntz, author_src string, full_text string, engagement_src string, "
              "sentiment_src string, repost_src string, likes double, comments double, shares double, "
              "reach double, impressions double, followers double")
    return spark.createDataFrame(rows, schema)
