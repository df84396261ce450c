"""Every query of the library beside DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from varloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("none" if x is None else f"{x:.8g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    other = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in other.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.select(*sorted(df.columns)).collect()) == plain([tuple(r[names.index(c)] for c in sorted(names)) for r in other.fetchall()])


@pytest.mark.parametrize("name", ["foreign_segments", "segment_adjacency", "split_tags"])
def test_repeated_rows_stay(spark, name, tmp_path):
    """Rows that come twice, and rows of one place that differ in their quality or tail only."""
    con = duckdb.connect()
    one = f"SELECT * FROM '{DATA}/lineitem.parquet' WHERE l_orderkey % 20 = 0"
    con.execute(f"COPY ({one} UNION ALL {one} UNION ALL SELECT * REPLACE (l_linenumber % 7 + 1 AS l_linenumber) FROM ({one}) UNION ALL SELECT * REPLACE (l_partkey + 7 AS l_partkey) FROM ({one})) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    other = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in other.description]
    assert plain(registry.queries()[name](spark, str(tmp_path)).select(*names).collect()) == plain(other.fetchall())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_queries_without_sql(spark):
    """Whole texts, ASCII or not, beside plain Python."""
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"seq_similarity_pairs", "aligned_distance", "similar_neighbours"}
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    run = lambda name: registry.queries()[name](spark, DATA).collect()
    pairs = {k: (texts[k].upper(), texts[k + 1].upper()) for k in texts if k + 1 in texts}
    far = {k: distance(*p) for k, p in pairs.items()}
    assert {(r.a, r.b, r.distance) for r in run("aligned_distance")} == {(k, k + 1, n) for k, n in far.items()}
    assert {r.a: r.similarity for r in run("seq_similarity_pairs")} == pytest.approx({k: round(1 - n / max(map(len, pairs[k])), 9) for k, n in far.items()})
    order = sorted(texts)
    assert {r.k: r.alike for r in run("similar_neighbours")} == {b: 1 - distance(texts[a].upper(), texts[b].upper()) / max(len(texts[a].upper()), len(texts[b].upper())) >= 0.25 for a, b in zip(order, order[1:])}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
