"""Every registered query of the core against its SQL, on the smallest tables."""

import duckdb
import pytest

from lumenline.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    if name not in queries.SQL:
        assert got
        return
    found = duck.execute(queries.SQL[name])
    order = [x[0] for x in found.description]
    assert sorted(order) == names
    want = sorted((tuple(r[order.index(c)] for c in names) for r in found.fetchall()), key=str)
    assert got == want


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def near_whole(spark, tmp_path_factory):
    """Pictures of values whose single product with 1000 or 100 is the next whole number, while the double one lies below it."""
    import numpy as np

    found = []
    for by in (1000, 100):
        k = np.arange(1, 1001, dtype=np.float32) / np.float32(by)
        own = np.concatenate([k, np.nextafter(k, np.float32(0), dtype=np.float32)])
        found += own[np.trunc(own * np.float32(by)) != np.trunc(own.astype(float) * by)].tolist()
    assert len(found) > 64
    where = tmp_path_factory.mktemp("near_whole")
    rows = [(i, [found[(i * 7 + j * j) % len(found)] for j in range(64)], i % 3) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{where}/embeddings.parquet")
    return str(where)


def equal_to_sql(spark, d, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{d}/{table}.parquet/*.parquet')")
    found = con.execute(queries.SQL[name])
    names = [x[0] for x in found.description]
    want = sorted(found.fetchall(), key=str)
    got = sorted((tuple(r[c] for c in names) for r in queries.QUERIES[name](spark, d).collect()), key=str)
    assert got == want and want


@pytest.mark.parametrize("name", ["crop_frames", "pixel_events", "frame_resize"])
def test_products_near_whole_numbers(spark, near_whole, name):
    equal_to_sql(spark, near_whole, name, "embeddings")


def test_a_table_of_several_files_is_one_video(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "pages.parquet").mkdir()
    for k, n in enumerate([3, 0, 506, 90, 1]):
        pq.write_table(pa.table({"url": [f"https://{k}/{i}" for i in range(n)]}, pa.schema([("url", pa.string())])), tmp_path / f"pages.parquet/part-{k}.parquet", row_group_size=100)
    equal_to_sql(spark, str(tmp_path), "frame_scan", "pages")
