"""Queries that SQL cannot express, against plain Python over the same tables."""

from difflib import SequenceMatcher

import numpy as np
import pytest

from blockloom.operators import matching as A
from blockloom.operators import models as L
from blockloom.plans import model_queries, registry
from blockloom.plans.table_queries import wanted


def key(text):
    return "".join(c for c in (text or "").lower() if c.isascii() and c.isalnum())


def test_near_keys_of_the_query_equal_all_pairs(spark, sf):
    got = {r.key: (r.catalogue_key, r.score) for r in registry.QUERIES["city_fuzzy_match"](spark, sf).collect()}
    names = {key(r.c_mktsegment) for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    want = {}
    for a in {n + "s" for n in names}:
        score, other = max((SequenceMatcher(None, a, b).ratio(), b) for b in names)
        if score >= A.NEAR_KEY:
            want[a] = (other, round(score, 6))
    assert want and got == want


def test_match_plan_of_the_query(spark, sf):
    """Every wanted name: an override, an equal key, one name like it, one key near it, or none."""
    names = [r.n_name for r in spark.read.parquet(f"{sf}/nation.parquet").collect()]
    got = {r.row_index: (r.match_method, r.name) for r in registry.QUERIES["city_match_plan"](spark, sf).collect()}
    rows = wanted(spark, sf).collect()
    assert len(got) == len(rows)
    seen = set()
    for r in rows:
        k, like = key(r.city), r.city.strip().lower()
        same = [n for n in names if key(n) == k]
        liked = [n for n in names if like and like in n.lower()]
        near = sorted(((SequenceMatcher(None, k, key(n)).ratio(), n) for n in names), reverse=True) if k else []
        near = [n for s, n in near if s >= A.NEAR_KEY and s == near[0][0]]
        if not k:
            want = ("EMPTY_CITY_KEY", None)
        elif r.city == "Germany":
            want = ("OVERRIDE", "DEUTSCHLAND")
        elif len(same) == 1:
            want = ("NAME_KEY_UNIQUE", same[0])
        elif len(liked) == 1 and " " not in like and "_" not in like:
            want = ("LIKE_UNIQUE", liked[0])
        elif not liked and near:
            want = ("FUZZY_UNIQUE", near[0])
        elif not liked:
            want = ("NO_GPKG_MATCH", None)
        else:
            assert got[r.row_index][0] in ("NAME_KEY_MULTI_BEST_GUESS", "LIKE_UNIQUE") and got[r.row_index][1] in liked
            continue
        seen.add(want[0])
        assert got[r.row_index] == want
    assert len(seen) >= 3


@pytest.fixture(scope="module")
def metrics(spark, sf):
    return model_queries.labelled(spark, sf).select(*L.ALL, "subdivisions_settlements").toPandas()


def test_components_of_the_query(spark, sf, metrics):
    rows = registry.QUERIES["principal_components"](spark, sf).orderBy("component").toPandas()
    x = metrics[L.ALL].dropna().to_numpy(float)
    deviation = x.std(axis=0)
    m = np.eye(x.shape[1])
    some = deviation > 1e-12
    m[np.ix_(some, some)] = np.corrcoef(x[:, some].T)
    values = np.linalg.eigvalsh(m)[::-1]
    assert np.allclose(rows.eigenvalue, values, atol=1e-5) and np.allclose(rows.cumulative, np.cumsum(values) / len(values), atol=1e-5)
    assert rows.retained.tolist() == sorted(rows.retained, reverse=True)
