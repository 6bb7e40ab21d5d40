import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gleaner.session import local_session

    s = local_session("4", app="gleaner-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_dom(spark):
    from gleaner.sources.dom import parse_dom

    def _make(*htmls, urls=None):
        rows = [(i, (urls[i] if urls else f"https://example.com/p{i}"), h) for i, h in enumerate(htmls)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        return parse_dom(pages, min_partitions=1)

    return _make
