"""b5 meets every item of the benchmark, not a query set of them."""

import pyarrow.parquet as pq

from maploom.plans import catalog

DIR = "/root/testdata/sf0.001"


def test_every_document_meets_every_item(spark):
    docs, items = (pq.read_table(f"{DIR}/{t}.parquet", columns=[c]).column(c).to_pylist() for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = catalog.QUERIES["b5_token_jaccard"](spark, DIR)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted((d, i) for d in docs for i in items)
    assert "% 20" not in catalog.ORACLES["b5_token_jaccard"]
