"""A branch is literal by its labels, whatever the size of its host."""

import pytest

from pairsim.llm import urlfilter as uf


@pytest.mark.parametrize("others", [4_000, 8_000])
def test_small_branch_of_a_large_host(spark, others):
    urls = [(i, f"http://big.org/{'news' if i % 2 else 'blog'}/{i}", 0) for i in range(others)]
    urls += [(others + i, f"http://big.org/spam/{i}", 1) for i in range(60)]
    df = spark.createDataFrame(urls, "page_id long, url string, bad int")
    got = {(r.template, r.verdict) for r in uf.judge(df).where(f"page_id >= {others}").collect()}
    assert got == {("/spam/*", "block")}
