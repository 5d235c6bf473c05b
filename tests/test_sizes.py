"""Queries on tables of other layouts and lengths than those their SQL was first compared on."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rowdex.functions import order
from rowdex.plans.selection import contiguous
from rowdex.queries import ORACLE_SQL, QUERIES, P, _blocks
from rowdex.sources.index import build_index

SF = "/root/testdata/sf0.01"


def rows(table) -> list:
    names = sorted(table.column_names)
    return sorted(tuple(map(str, r)) for r in zip(*(table[c].to_pylist() for c in names), strict=True))


def against(con, spark, name: str, folder: str, sql: str | None = None) -> int:
    """Rows of a query on a folder, once they are found to be those of its SQL."""
    got, want = QUERIES[name](spark, folder).toArrow(), con.sql(sql or ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
    return got.num_rows


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """embeddings as a folder: files of uneven lengths, one of them empty, beside what writers leave."""
    root = tmp_path_factory.mktemp("parts")
    folder = root / "embeddings.parquet"
    (folder / "_temporary").mkdir(parents=True)
    table = pq.read_table(f"{SF}/embeddings.parquet")
    edges = [0, 170, 170, 171, 400, table.num_rows]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        pq.write_table(table.slice(a, b - a), folder / f"part-{k:05d}.parquet", row_group_size=100)
    pq.write_table(table.slice(0, 5), folder / "_temporary/part-00000.parquet")
    for name in ("_SUCCESS", ".hidden.parquet"):
        (folder / name).write_bytes(b"")
    return str(root)


def mounted(spark, folder: str) -> str:
    """The folder by a path that only Spark's readers open."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{folder}")
    return "viewfs://store/in"


@pytest.mark.parametrize("kind", ["path", "file", "store"])
def test_folder_of_files(spark, parts, kind):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{parts}/embeddings.parquet/part-*.parquet')")
    assert against(con, spark, "nested_passthrough_all", {"path": parts, "file": f"file://{parts}", "store": mounted(spark, parts)}[kind]) == 500


def test_index_of_folder(spark, parts, tmp_path):
    folder = f"{parts}/embeddings.parquet"
    index = build_index([folder])
    assert [os.path.basename(f) for f in index.files] == [f"part-{k:05d}.parquet" for k in range(5)]
    assert index.file_starts == [0, 170, 170, 171, 400] and index.num_rows == 500
    stored = build_index([f"{mounted(spark, parts)}/embeddings.parquet"], spark=spark, cache_dir=str(tmp_path), on_executors=2)
    assert [(g.rg_index, g.start, g.end, g.byte_start, g.byte_end) for g in stored.groups] == [(g.rg_index, g.start, g.end, g.byte_start, g.byte_end) for g in index.groups]
    assert stored.sizes == index.sizes and stored.schema == index.schema
    assert build_index([folder], cache_dir=str(tmp_path)).files == index.files


def connected(folder: str, *tables: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


@pytest.mark.parametrize(("folder", "n"), [("sf0.001", 0), ("sf0.1", 91_000)])
def test_stream_from(spark, folder, n):
    folder = f"/root/testdata/{folder}"
    assert against(connected(folder, "events"), spark, "stream_from", folder) == n


@pytest.mark.parametrize(("folder", "n"), [("sf0.001", 3), ("sf0.1", 4)])
def test_select_rows(spark, folder, n):
    folder = f"/root/testdata/{folder}"
    assert against(connected(folder, "customer"), spark, "select_rows", folder) == n


#: Queries whose SQL lists positions of the lengths at sf0.01: table, positions of n rows in order, and columns.
LISTED = {
    "block_shuffle_all": ("orders", lambda n: order.block_order(*_blocks(n), 42), "ord, o_orderkey"),
    "buffer_shuffle_all": ("events", lambda n: order.rolling_buffer(n, 500, 42), "ord, event_id"),
    "distributed_padded": ("customer", lambda n: np.resize(np.arange(n), -(-n // 7) * 7)[6::7], "ord, c_custkey"),
    "loader_plan_all": ("orders", lambda n: order.permutation(n, 3), "ord, ord // 40 AS batch_id, o_orderkey"),
    "remote_shuffle_take": ("events", lambda n: order.permutation(n, 42)[:200], "ord, event_id"),
    "save_load_all": ("orders", lambda n: order.permutation(n, 5), "ord, * EXCLUDE (ord, pos)"),
    "shard_contiguous": ("orders", lambda n: np.arange(*contiguous(n, 7, 3)), "ord, o_orderkey"),
}


def listed_sql(con: duckdb.DuckDBPyConnection, name: str, folder: str) -> str:
    """The SQL of a query for the length that its table has in a folder."""
    table, positions, columns = LISTED[name]
    found = np.asarray(positions(pq.read_metadata(f"{folder}/{table}.parquet").num_rows), np.int64)
    con.register(f"v_{name}", pa.table({"ord": np.arange(len(found)), "pos": found}))
    return f"SELECT {columns} FROM v_{name} JOIN {P(table)} USING (pos)"


@pytest.mark.parametrize("name", sorted(LISTED))
def test_listed_for_its_length(spark, name):
    folder, con = SF, connected(SF, LISTED[name][0])
    made, own = (rows(con.sql(sql).to_arrow_table()) for sql in (listed_sql(con, name, folder), ORACLE_SQL[name]))
    assert made == own
    folder = "/root/testdata/sf0.1"
    con = connected(folder, LISTED[name][0])
    assert against(con, spark, name, folder, listed_sql(con, name, folder)) > 0
