"""The digest of a group's ids is that of their whole list in order."""

from __future__ import annotations

import hashlib
import random

from sparquill.operators import lifecycle
from sparquill.plans import catalog, catalog_runs  # noqa: F401


def test_ids_md5(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 7, 7, r.randrange(-50, 5000)])) for _ in range(900)] + [("c", None)]
    got = {x.g: (x.n, x.ids_md5) for x in lifecycle.ids_md5(spark.createDataFrame(rows, "g string, k long").repartition(5), "g", "k", block=7).collect()}
    for g in ("a", "b", "c", None):
        ids = sorted(k for h, k in rows if h == g and k is not None)
        want = hashlib.md5(",".join(map(str, ids)).encode()).hexdigest() if ids else None
        assert got[g] == (sum(h == g for h, _ in rows), want)


def test_split_ids_is_the_list(spark, tiny):
    assert "ids_md5" in catalog.QUERIES["split_ids"](spark, tiny).columns and "ORDER BY doc_id" in catalog.SQL["split_ids"]
