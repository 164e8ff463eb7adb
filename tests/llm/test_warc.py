import duckdb
import pytest
from pyspark.sql import functions as F

from blockloom.llm import warc as W

SCHEMA = "record_id long, url string, ts long, is_full boolean, headers array<struct<name:string,value:string>>, payload string, url_key int, status string"


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://WWW.Example.com:80/a/b/?b=2&a=1&utm_source=x#top", "example.com/a/b?a=1&b=2"),
        ("https://example.com", "example.com"),
        ("https://example.com/?", "example.com"),
        ("example.com/A?x=HTTP://y/?z", "example.com/A?x=HTTP://y/?z"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(W.canonical_url(F.col("url"))).first()[0] == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    out = W.op5_revisit_resolution(spark, d)
    want = con.execute(W.ORACLE_SQL).df()[out.columns]
    got = out.toPandas()
    key = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).replace({float("nan"): None}).itertuples(index=False, name=None)))
    got.source_id, want.source_id = got.source_id.astype("Int64"), want.source_id.astype("Int64")
    got.payload_bytes, want.payload_bytes = got.payload_bytes.astype("Int64"), want.payload_bytes.astype("Int64")
    assert key(got) == key(want)
    assert {"full", "resolved", "validator_mismatch"} <= set(got.status)


def plain(rows):
    """As-of by scanning each URL's records in order."""
    order = sorted((r for r in rows if r[1] and r[2] is not None), key=lambda r: (r[2], r[0], r[3]))
    last, out = {}, {}
    for r in order:
        if r[3]:
            last[r[1]] = r[0]
        else:
            out[r[0]] = last.get(r[1])
    return out


def test_a_hot_url_over_many_spans(spark):
    rows = []
    for i in range(3_000):
        url = "hot.example/x" if i % 3 else f"cold.example/{i % 40}"
        rows.append((i, url, (i * 7919) % 2_000, i % 5 == 0, [("ETag", '"a"')], f"body {i}" if i % 5 == 0 else None, 0, ""))
    out = W.resolve_revisits(spark.createDataFrame(rows, SCHEMA), spans=16).collect()
    want = plain(rows)
    assert len(out) == len(rows)
    for r in out:
        if r.is_full:
            assert r.status == "full" and r.source_id == r.record_id
        else:
            assert r.source_id == want[r.record_id]
            assert r.payload == (None if want[r.record_id] is None else f"body {want[r.record_id]}")


def test_validators_and_headers(spark):
    full = (1, "http://a.b/", 10, True, [("ETag", 'W/"x"'), ("Last-Modified", "m"), ("Set-Cookie", "1"), ("set-cookie", "2"), ("Vary", "*")], "body", 0, "")
    ask = lambda i, headers: (i, "https://www.a.b", 20 + i, False, headers, None, 0, "")
    rows = [full, ask(2, [("etag", '"x"'), ("VARY", "accept"), ("X-A", "1")]), ask(3, [("etag", '"y"'), ("last-modified", "m")]), ask(4, [("last-modified", "m")]), ask(5, [("last-modified", "n")]), ask(6, []), ask(7, None), (8, "http://a.b", 5, False, None, None, 0, "")]
    out = {r.record_id: r for r in W.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[i].status for i in range(1, 9)] == ["full", "resolved", "validator_mismatch", "resolved", "validator_mismatch", "no_validator", "no_validator", "no_earlier_response"]
    assert [tuple(h) for h in out[2].headers] == [("Last-Modified", "m"), ("Set-Cookie", "1"), ("set-cookie", "2"), ("etag", '"x"'), ("VARY", "accept")]
    assert out[2].payload == "body" and out[3].payload is None


def test_null_repeated_and_empty(spark):
    tag = [("ETag", '"x"')]
    rows = [
        (1, "a.b/c", 1, True, tag, "one", 0, ""), (1, "a.b/c", 1, True, tag, "one", 0, ""), (2, "a.b/c", 2, False, tag, None, 0, ""), (2, "a.b/c", 2, False, tag, None, 0, ""),
        (3, None, 3, False, tag, None, 0, ""), (4, "a.b/c", None, False, tag, None, 0, ""), (None, "a.b/c", 5, True, tag, "two", 0, ""), (6, "a.b/c", 6, None, tag, None, 0, ""),
        (7, None, 7, True, None, None, 0, ""), (None, "a.b/c", 8, False, tag, None, 0, ""), (9, "a.b/c" + "x" * 50_000, 9, False, tag, None, 0, ""), (10, "a.b/c", 1, False, tag, None, 0, ""),
    ]
    out = sorted(((r.record_id is None, r.record_id, r.status, r.source_id) for r in W.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    got = [x[1:] for x in out]
    assert sorted(got, key=str) == sorted([
        (1, "full", 1), (1, "full", 1), (2, "resolved", 1), (2, "resolved", 1), (3, "no_earlier_response", None), (4, "no_earlier_response", None), (6, "resolved", 1),
        (7, "full", 7), (9, "no_earlier_response", None), (10, "resolved", 1), (None, "full", None), (None, "resolved", 1),
    ], key=str)
    assert W.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_full_responses_with_one_id(spark):
    """Validators, headers and payload come from one of them, whatever the order of the rows."""
    fulls = [(1, "a.b/x", 5, True, [("ETag", f'"{i}"'), ("Server", f"s{i}")], f"body {i}", 0, "") for i in range(6)]
    asks = [(10 + i, "a.b/x", 9, False, [("ETag", f'"{i}"')], None, 0, "") for i in range(6)]
    seen = set()
    for rows in (fulls + asks, asks[::-1] + fulls[::-1]):
        out = [r for r in W.resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect() if not r.is_full]
        (one,) = [r for r in out if r.status == "resolved"]
        i = one.record_id - 10
        assert one.payload == f"body {i}" and dict(one.headers)["Server"] == f"s{i}" and one.source_id == 1
        assert {r.status for r in out if r is not one} == {"validator_mismatch"}
        seen.add(i)
    assert len(seen) == 1


def test_a_source_that_many_ask_for_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(W, "heavy_limit", lambda rows: 7)
    rows = [(0, "a.b/x", 0, True, [("ETag", '"x"')], "hot", 0, ""), (1, "a.b/y", 0, True, [("ETag", '"x"')], "cold", 0, "")]
    rows += [(i, "a.b/x" if i % 10 else "a.b/y", i, False, [("ETag", '"x"')], None, 0, "") for i in range(2, 102)]
    out = [r for r in W.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect() if not r.is_full]
    assert len(out) == 100 and {r.status for r in out} == {"resolved"}
    assert all((r.source_id, r.payload) == ((0, "hot") if r.record_id % 10 else (1, "cold")) for r in out)
