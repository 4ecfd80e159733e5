import http.server
import json
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheafline.sources import payloads, providers


@pytest.fixture
def server():
    """A stub: /ok/k answers at once, /twice/k at the second try, others never. Counts its requests."""
    seen: Counter = Counter()

    class Stub(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] += 1
            good = self.path.startswith("/ok") or self.path.startswith("/twice") and seen[self.path] > 1
            self.send_response(200 if good else 503)
            self.end_headers()
            if good:
                self.wfile.write(b"\xff payload of " + self.path.encode())

        def log_message(self, *_):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", seen
    made.shutdown()


def test_payloads_equal_fetched_ones_and_dead_urls_are_rows(spark, server):
    base, seen = server
    urls = [f"{base}/ok/{k}" for k in range(9)] + [f"{base}/twice/1", f"{base}/dead/1", "file:///etc/hostname", "http://127.0.0.1:9/none"]
    payloads.register(spark)
    df = spark.read.format("payloads").option("urls", json.dumps(urls)).option("urlsPerTask", 4).option("pause", 0.01).load()
    assert df.rdd.getNumPartitions() == 4
    got = {r.url: r for r in df.collect()}
    assert got.keys() == set(urls)
    fetched = {r.url: r for r in providers.fetch(spark.createDataFrame([(u,) for u in urls], "url string"), "url", payloads.client(tries=2)).collect()}
    for u in urls:
        assert got[u].content == fetched[u].content and (got[u].error is None) == (fetched[u].provider_error is None) == (got[u].content is not None)
    assert (got[f"{base}/twice/1"].attempts, got[f"{base}/dead/1"].attempts, got["file:///etc/hostname"].attempts) == (2, 3, 1)
    assert "503" in got[f"{base}/dead/1"].error and got[f"{base}/ok/1"].length == len(got[f"{base}/ok/1"].content)


def test_filters_by_url_fetch_nothing_else(spark, server):
    base, seen = server
    payloads.register(spark)
    read = spark.read.format("payloads").option("urls", json.dumps([f"{base}/ok/{k}" for k in range(20)]))
    assert [r.length for r in read.load().where(F.col("url") == f"{base}/ok/3").collect()] == [len(b"\xff payload of /ok/3")] and sum(seen.values()) == 1
    assert read.load().where(F.col("url").isin([f"{base}/ok/1", f"{base}/ok/2", "x"]) & (F.col("length") > 3)).count() == 2 and sum(seen.values()) == 3
    assert read.option("content", "false").load().where("url LIKE '%/7'").first().content is None
    assert spark.read.format("payloads").load().collect() == []


def counter_of(tmp_path):
    folder = tmp_path / "counted"
    folder.mkdir()
    path = str(folder)

    def make():
        import os
        import uuid

        def count(text):
            open(os.path.join(path, uuid.uuid4().hex), "w").close()
            if text == "bad":
                raise ValueError("no tokens")
            return len(text.split())

        return count

    return make, lambda: len(list(folder.iterdir()))


@pytest.mark.parametrize("often", [2, 1 << 12])
def test_each_distinct_text_is_counted_once(spark, tmp_path, monkeypatch, often):
    monkeypatch.setattr(providers, "OFTEN", often)
    make, calls = counter_of(tmp_path)
    rows = [(k, ["a hot line", f"line {k % 5} of it", "", None][: k % 5]) for k in range(60)] + [(100, None), (101, ["bad", "a hot line"])]
    df = spark.createDataFrame(rows, "row long, lines array<string>").repartition(5)
    got = {r.row: r.costs for r in providers.token_costs(df, "row", "lines", make).collect()}
    want = {k: [None if t == "bad" else len((t or "").split()) for t in lines] for k, lines in rows if lines}
    assert got == want and calls() == len({t or "" for _, lines in rows for t in lines or []})


def test_one_text_column_by_the_same_memo(spark, tmp_path):
    make, calls = counter_of(tmp_path)
    df = spark.createDataFrame([("a b", 1), ("a b", 2), (None, 3), ("", 4), ("c", 5)], "t string, tokens_before int")
    got = sorted((r.tokens_before, r.tokens) for r in providers.count_tokens(df, "t", make).collect())
    assert got == [(1, 2), (2, 2), (3, 0), (4, 0), (5, 1)] and calls() == 3
