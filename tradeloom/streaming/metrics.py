"""Counters of a pipeline as Prometheus text."""

from __future__ import annotations

from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

from pyspark.sql.streaming import StreamingQueryListener


class Metrics:
    FAMILIES = {"stream_events_total": ("counter", "Events by symbol and status"), "stream_bytes_total": ("counter", "Payload bytes"), "stream_windows_total": ("counter", "Windows emitted by symbol"), "stream_dlq_total": ("counter", "Dead letters by code"), "stream_watermark_ms": ("gauge", "Watermark"), "stream_rows_per_second": ("gauge", "Rows per second")}

    def __init__(self) -> None:
        self.values: Counter = Counter()

    def add(self, family: str, n: float = 1, **labels: str) -> None:
        self.values[(family, tuple(sorted(labels.items())))] += n

    def set(self, family: str, n: float, **labels: str) -> None:
        self.values[(family, tuple(sorted(labels.items())))] = n

    def text(self) -> str:
        out = []
        for f, (kind, help_) in self.FAMILIES.items():
            out += [f"# HELP {f} {help_}", f"# TYPE {f} {kind}"]
            for (name, labels), v in sorted(self.values.items()):
                if name == f:
                    tags = ",".join(f'{k}="{x}"' for k, x in labels)
                    out.append(f"{f}{'{' + tags + '}' if tags else ''} {v:g}")
        return "\n".join(out) + "\n"


class ProgressListener(StreamingQueryListener):
    """Feeds a Metrics from the progress of streaming queries."""

    def __init__(self, metrics: Metrics) -> None:
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.metrics.add("stream_events_total", p.numInputRows, symbol="all", status="read")
        self.metrics.set("stream_rows_per_second", p.processedRowsPerSecond or 0.0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def serve(metrics: Metrics, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Answer GET /metrics with the text, in a thread of its own; port 0 takes a free one (``server_port``). ``shutdown()`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            body = metrics.text().encode() if self.path.split("?")[0] == "/metrics" else None
            self.send_response(200 if body is not None else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.send_header("Content-Length", str(len(body or b"")))
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    return server
