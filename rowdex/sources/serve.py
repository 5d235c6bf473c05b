"""A small HTTP server of one folder that answers range requests: for tests, the
bench and queries of remote files, where no network is at hand."""

from __future__ import annotations

import os
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


class RangeServer:
    """Serves files below ``folder``; counts requests and the bytes sent of each file."""

    def __init__(self, folder: str, host: str = "127.0.0.1"):
        self.requests: list[tuple[str, str, str | None]] = []
        self.sent: dict[str, int] = {}
        lock, root = threading.Lock(), os.path.realpath(folder)

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def _answer(handler, body: bool) -> None:
                name = handler.path.lstrip("/").split("?")[0]
                path = os.path.realpath(os.path.join(root, name))
                if not path.startswith(root + os.sep) or not os.path.isfile(path):
                    handler.send_error(404)
                    return
                size = os.path.getsize(path)
                asked = re.fullmatch(r"bytes=(\d*)-(\d*)", handler.headers.get("Range", ""))
                first, last = 0, size
                if asked and asked[1]:
                    first, last = int(asked[1]), min(size, int(asked[2]) + 1 if asked[2] else size)
                elif asked:
                    first = max(0, size - int(asked[2]))
                handler.send_response(206 if asked else 200)
                handler.send_header("Content-Length", str(last - first))
                if asked:
                    handler.send_header("Content-Range", f"bytes {first}-{last - 1}/{size}")
                handler.end_headers()
                with lock:
                    self.requests.append((handler.command, name, handler.headers.get("Range")))
                    self.sent[name] = self.sent.get(name, 0) + (last - first if body else 0)
                if body:
                    with open(path, "rb") as f:
                        f.seek(first)
                        handler.wfile.write(f.read(last - first))

            def do_GET(handler) -> None:
                handler._answer(True)

            def do_HEAD(handler) -> None:
                handler._answer(False)

            def log_message(handler, *_) -> None:
                pass

        self._server = ThreadingHTTPServer((host, 0), Handler)
        self.url = f"http://{host}:{self._server.server_port}"
        threading.Thread(target=self._server.serve_forever, daemon=True).start()

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()
