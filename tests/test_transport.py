"""Range requests, footers and downloads against a local HTTP server."""

from __future__ import annotations

import os
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rowdex.errors import CorruptParquetError, NetworkRangeError, RateLimitError
from rowdex.sources import transport
from rowdex.sources.index import build_index

quick = lambda _: None


@pytest.fixture
def server(tmp_path):
    table = pa.table({f"c{k}": list(range(200)) for k in range(5)})
    pq.write_table(table, tmp_path / "x.parquet", row_group_size=50)
    wide = pa.table({f"column_with_a_long_name_{k}": [1, 2] for k in range(900)})
    pq.write_table(wide, tmp_path / "wide.parquet", row_group_size=1)
    (tmp_path / "bad.parquet").write_bytes(b"PAR1" + b"0" * 500)
    asked, fail = [], {}

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body: bool):
            asked.append((self.command, self.path, self.headers.get("Range"), self.headers.get("Authorization")))
            if fail.get(self.path):
                self.send_response(fail[self.path].pop(0))
                self.send_header("Retry-After", "7")
                self.end_headers()
                return
            data = (tmp_path / self.path.strip("/")).read_bytes()
            found = re.match(r"bytes=(\d*)-(\d*)", self.headers.get("Range", ""))
            part = data
            if found:
                part = data[-int(found[2]) :] if not found[1] else data[int(found[1]) : int(found[2]) + 1]
            self.send_response(206 if found else 200)
            self.send_header("Content-Length", str(len(part)))
            if found:
                self.send_header("Content-Range", f"bytes {len(data) - len(part)}-{len(data) - 1}/{len(data)}")
            self.end_headers()
            if body:
                self.wfile.write(part)

        def do_GET(self):
            self._answer(True)

        def do_HEAD(self):
            self._answer(False)

        def log_message(self, *_):
            pass

    held = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}", asked, fail, tmp_path
    held.shutdown()


def test_footers(server):
    url, asked, fail, folder = server
    size, meta = transport.remote_footer(f"{url}/x.parquet", "secret")
    assert size == os.path.getsize(folder / "x.parquet") and meta.num_row_groups == 4
    assert asked[0][2] == "bytes=-65536" and asked[0][3] == "Bearer secret" and len(asked) == 1
    asked.clear()
    _, meta = transport.remote_footer(f"{url}/wide.parquet")
    assert meta.num_columns == 900 and len(asked) == 2
    with pytest.raises(NetworkRangeError):
        transport.remote_footer(f"{url}/bad.parquet", sleep=quick)
    fail["/x.parquet"] = [503, 500]
    assert transport.remote_footer(f"{url}/x.parquet", sleep=quick)[0] == size
    asked.clear()
    fail["/x.parquet"] = [429]
    with pytest.raises(RateLimitError) as e:
        transport.remote_footer(f"{url}/x.parquet", sleep=quick)
    assert e.value.retry_after == "7" and len(asked) == 1
    remote, local = build_index([f"{url}/x.parquet"]), build_index([str(folder / "x.parquet")])
    assert [(g.start, g.byte_start, g.byte_end) for g in remote.groups] == [(g.start, g.byte_start, g.byte_end) for g in local.groups]


def test_download(server, tmp_path):
    url, asked, fail, folder = server
    target = str(tmp_path / "out" / "x.parquet")
    fail["/x.parquet"] = [502]
    assert transport.download(f"{url}/x.parquet", target, sleep=quick) == target
    assert pq.read_table(target).num_rows == 200
    asked.clear()
    transport.download(f"{url}/x.parquet", target, sleep=quick)
    assert [a[0] for a in asked] == ["HEAD"]
    asked.clear()
    fail["/wide.parquet"] = [429]
    with pytest.raises(RateLimitError):
        transport.download(f"{url}/wide.parquet", str(tmp_path / "w"), sleep=quick)
    assert [a[0] for a in asked] == ["HEAD"]
    with pytest.raises(CorruptParquetError):
        transport.download(f"{url}/bad.parquet", str(tmp_path / "b"), sleep=quick)
    assert not [n for n in os.listdir(tmp_path) if ".part." in n]
    paths = transport.download_all([f"{url}/x.parquet", target, f"{url}/wide.parquet"], str(tmp_path / "all"))
    assert paths[1] == target and [pq.read_metadata(p).num_rows for p in paths] == [200, 200, 2]
    assert transport.cache_name("http://a/f.parquet") != transport.cache_name("http://b/f.parquet")


def test_load_through_file_cache(server, spark, tmp_path):
    import rowdex

    url, asked, _, folder = server
    names = []
    for k in range(3):
        pq.write_table(pa.table({"id": list(range(10 * k, 10 * k + 10))}), folder / f"part{k}.parquet", row_group_size=5)
        names.append(f"{url}/part{k}.parquet")
    held = rowdex.load_dataset(names, split="train", streaming=True, max_cached_files=1, spark=spark, manage=False, cache_dir=str(tmp_path))
    assert len(held) == 30 and not [a for a in asked if a[0] == "HEAD"]
    assert held[12]["id"] == 12 and held[[29, 3, 14]]["id"] == [29, 3, 14]
    assert [r["id"] for r in held] == list(range(30))
    whole = rowdex.load_dataset(names, split="train", spark=spark, manage=False, cache_dir=str(tmp_path))
    assert sorted(r.id for r in whole.to_df().collect()) == list(range(30))
