import pytest

from seqloom.plans import fixtures
from seqloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(same, name):
    same(QUERIES[name], ORACLES[name])


def test_known_totals(spark, sf_dir):
    hits = {r["strand"]: r["count"] for r in QUERIES["seed_hits"](spark, sf_dir).groupBy("strand").count().collect()}
    assert hits == {0: 4907, 1: 2400}
    marks = QUERIES["mark_reads_default"](spark, sf_dir).toPandas()
    assert (len(marks), marks.covered_bases.sum()) == (104, 10351)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tiles_of_long_documents(spark, tmp_path):
    """A text of over 1000 tiles shares no read with its successors."""
    data = [(i, "acgt" * n) for i, n in ((0, 10), (1, 75_000), (2, 200), (3, 50))]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = fixtures.tiles(spark, str(tmp_path)).select("read_ord", "read_id").collect()
    assert len(got) == len({r.read_ord for r in got}) == len({r.read_id for r in got}) == 1 + 2000 + 6 + 2
    assert {0, 1000, 1999, 2000, 2005, 3000, 3001} <= {r.read_ord for r in got}
