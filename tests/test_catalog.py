"""Every registered query against its SQL, on the small tables."""

import math

import duckdb
import pytest

from brindle.operators import fulltext, relational
from brindle.plans import catalog
from brindle.sources.tables import NAMES
from brindle.streaming import feeds

_duck = {}


def duck(sf_dir):
    if sf_dir not in _duck:
        _duck[sf_dir] = duckdb.connect()
        _duck[sf_dir].execute("SET TimeZone = 'UTC'")
        for n in NAMES:
            _duck[sf_dir].execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf_dir}/{n}.parquet')")
    return _duck[sf_dir]


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "tzinfo") and x.tzinfo is not None:
        return x.replace(tzinfo=None)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([columns[i] for i in order], [tuple(plain(r[i]) for i in order) for r in data])[1], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in catalog.ORACLE_SQL:
        return
    want = duck(sf_dir).execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_vec_hybrid_scores_every_embedding(spark, sf_dir):
    got = {r["vec_id"] for r in catalog.QUERIES["vec_hybrid"](spark, sf_dir).collect()}
    assert {r["vec_id"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()} <= got


def test_json_roundtrip_is_the_whole_table(spark, sf_dir):
    want = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate")
    got = catalog.QUERIES["json_roundtrip"](spark, sf_dir)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_join_full_has_every_key(spark, sf_dir):
    got = [tuple(r) for r in catalog.QUERIES["join_full"](spark, sf_dir).collect()]
    for at, name, key in ((0, "supplier", "s_suppkey"), (1, "customer", "c_custkey")):
        assert sorted(r[at] for r in got if r[at] is not None) == sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key).collect())
        assert any(r[at] is None for r in got)


def test_histogram_counts(spark, sf_dir):
    prices = [r[0] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_totalprice").collect()]
    for values, got in ((prices, catalog.QUERIES["profile_histogram"](spark, sf_dir)), ([None, 1.0, 1.0, 1.0, 2.0, 3.0], relational.histogram(spark.createDataFrame([(x,) for x in (None, 1.0, 1.0, 1.0, 2.0, 3.0)], "v double"), "v", 4))):
        values, last = [v for v in values if v is not None], -math.inf
        got = sorted(map(tuple, got.select("bucket", "upper", "cumulative_count", "ndv_in_bucket").collect()))
        assert got[-1][2] == len(values)
        for _, upper, rows_, ndv in got:
            assert (rows_, ndv) == (sum(v <= upper for v in values), len({v for v in values if last < v <= upper}))
            last = upper


def test_upsert_error(spark):
    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string")
    assert sorted(map(tuple, relational.upsert_error(old, new, ["k"]).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="there already"):
        relational.upsert_error(old, old, ["k"]).collect()


def test_queries_without_tokens(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    for q in ("", " .,"):
        assert fulltext.bm25(docs, "id", q, "text").count() == fulltext.match_all(docs, q, "text").count() == 0


def test_feeds_go_on(spark, tmp_path):
    """A replica and a view that are called again with more changes, and empty feeds."""
    schema, log = "k int, at int, v int, op string", str(tmp_path / "log")
    kind = spark.createDataFrame([], schema).schema
    feeds.append_changes(spark.createDataFrame([(1, 1, 10, "insert"), (2, 1, 20, "insert")], schema), log)
    want = [{(1, 1, 10), (2, 1, 20)}, {(1, 2, 11)}]
    for rows in want:
        made = feeds.replicate(feeds.follow(spark, log, kind), "k", "at", "op", str(tmp_path / "replica"))
        assert {tuple(r) for r in made.select("k", "at", "v").collect()} == rows
        total = feeds.refresh_view(feeds.follow(spark, log, kind), ["k"], "v", str(tmp_path / "view"))
        got = {r["k"]: r["n"] for r in total.collect()}
        feeds.append_changes(spark.createDataFrame([(1, 2, 11, "update"), (2, 2, None, "delete")], schema), log)
    assert got == {1: 2, 2: 2}
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(empty)
    stream = feeds.follow(spark, empty, kind)
    assert feeds.refresh_view(stream, ["k"], "v").count() == feeds.replicate(stream, "k", "at", "op").count() == feeds.running_totals(stream, ["k"], "v").count() == 0


def test_no_key_carries_a_sketch(spark, sf_dir):
    plan = catalog.QUERIES["random_bounds"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "approx_count_distinct" in plan
    assert not [line for line in plan.splitlines() if "keys=[l_partkey" in line and "approx_count_distinct" in line]


ODD_TEXTS = [(1, "b a b"), (1, "B c"), (2, None), (3, "..."), (4, "a"), (None, "a x"), (None, "x"), (5, ""), (6, "z z z Z"), (7, "ab a ab")]


def odd_counts():
    found = {}
    for doc, text in ODD_TEXTS:
        for w in (text or "").lower().replace(".", "").split():
            found[doc, w] = found.get((doc, w), 0) + 1
    return found


@pytest.mark.parametrize("narrow", [500_000, 0])
def test_vocabulary_of_shared_ids(spark, monkeypatch, narrow):
    monkeypatch.setattr(fulltext, "NARROW_ROWS", narrow, raising=False)
    want = {}
    for (_, w), tf in odd_counts().items():
        want[w] = (want.get(w, (0, 0))[0] + 1, want.get(w, (0, 0))[1] + tf)
    docs = spark.createDataFrame(ODD_TEXTS, "id int, text string")
    assert {r["token"]: (r["df"], r["total"]) for r in fulltext.vocabulary(docs, "id", "text").collect()} == want
    assert fulltext.vocabulary(docs.where("id in (2, 3, 5)"), "id", "text").collect() == []


@pytest.mark.parametrize("name", ["fts_postings", "fts_two_columns"])
def test_vocabulary_shuffles_tokens_only(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(token") == 1


@pytest.mark.parametrize("narrow", [500_000, 0])
def test_postings_of_shared_ids(spark, monkeypatch, narrow):
    monkeypatch.setattr(fulltext, "NARROW_ROWS", narrow, raising=False)
    docs = spark.createDataFrame(ODD_TEXTS, "id int, text string")
    got = fulltext.postings(docs, "id", "text").collect()
    assert {(r["doc"], r["token"]): r["tf"] for r in got} == odd_counts() and len(got) == len(odd_counts())
    assert {r["field_len"] for r in got if r["doc"] in (6, 7)} == {4, 3}


def test_postings_count_within_rows(spark, sf_dir):
    plan = fulltext.postings(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_index_files_are_sorted_by_token(spark, sf_dir, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "index")
    fulltext.write_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", path, "text")
    listed = [pq.ParquetFile(f).read(columns=["token"])["token"].to_pylist() for f in (tmp_path / "index" / "postings").rglob("*.parquet")]
    assert listed and all(x == sorted(x) for x in listed)
