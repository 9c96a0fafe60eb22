"""Web connectors against servers of the test's own."""

import base64
import hashlib
import json
import socketserver
import struct
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidemark.plans.script import Engine
from tidemark.plans.validate import PlanError
from tidemark.sources import web


class Http(BaseHTTPRequestHandler):
    posts, polls, failures = [], 0, 0

    def _answer(self, body, status=200):
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        if self.path == "/sse":
            assert self.headers["X-Token"] == "secret"
            at = int(self.headers.get("Last-Event-ID") or 0)
            events = ["id: 1\nevent: tick\ndata: {\"a\": 1}\n\n", ": note\n\nid: 2\nevent: other\ndata: {\"a\": 2}\n\n", "id: 3\nevent: tick\ndata: {\"a\":\ndata: 3}\n\n"]
            self._answer("".join(events[at:]).encode())
        else:
            Http.polls += 1
            self._answer(b'{"a": 1}\n{"a": 2}\n')

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        if Http.failures:
            Http.failures -= 1
            self._answer(b"", 503)
        else:
            Http.posts.append(body)
            self._answer(b"")

    def log_message(self, *_):
        pass


class Socket(socketserver.StreamRequestHandler):
    """Says what it was told, in two frames, pings, and closes."""

    def handle(self):
        key = ""
        while (line := self.rfile.readline().strip()) != b"":
            if line.lower().startswith(b"sec-websocket-key:"):
                key = line.split(b":")[1].strip().decode()
        accept = base64.b64encode(hashlib.sha1((key + web.WEBSOCKET_SALT).encode()).digest())
        self.wfile.write(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: " + accept + b"\r\n\r\n")

        def told():
            _, size = self.rfile.read(2)
            n = size & 127
            n = struct.unpack(">H", self.rfile.read(2))[0] if n == 126 else n
            mask = self.rfile.read(4)
            return bytes(b ^ mask[i % 4] for i, b in enumerate(self.rfile.read(n)))

        said = told()
        self.wfile.write(b"\x89\x00" + bytes([1, 3]) + said[:3] + bytes([0x80, 126]) + struct.pack(">H", len(said) - 3) + said[3:])
        assert told() == b""  # the answer to the ping
        self.wfile.write(b"\x88\x00")


class Redis(socketserver.StreamRequestHandler):
    store, asked = {}, []

    def handle(self):
        while line := self.rfile.readline():
            parts = []
            for _ in range(int(line[1:])):
                n = int(self.rfile.readline()[1:])
                parts.append(self.rfile.read(n + 2)[:-2].decode())
            self.wfile.write(self.run(*parts))

    def run(self, name, *a):
        s = Redis.store
        if name == "MGET":
            Redis.asked.extend(a)
            return b"*%d\r\n" % len(a) + b"".join(b"$%d\r\n%s\r\n" % (len(s[k].encode()), s[k].encode()) if k in s else b"$-1\r\n" for k in a)
        if name == "SET":
            s[a[0]] = a[1]
        elif name == "RPUSH":
            s.setdefault(a[0], []).append(a[1])
        elif name == "LTRIM":
            s[a[0]] = s[a[0]][int(a[1]) :]
        elif name == "HSET":
            s.setdefault(a[0], {})[a[1]] = a[2]
        else:
            return b"-ERR unknown command\r\n"
        return b"+OK\r\n"


@pytest.fixture(scope="module")
def ports():
    servers = [ThreadingHTTPServer(("127.0.0.1", 0), Http), socketserver.ThreadingTCPServer(("127.0.0.1", 0), Socket), socketserver.ThreadingTCPServer(("127.0.0.1", 0), Redis)]
    for s in servers:
        s.daemon_threads = True
        threading.Thread(target=s.serve_forever, daemon=True).start()
    yield [s.server_address[1] for s in servers]
    for s in servers:
        s.shutdown()
        s.server_close()


def select(spark, columns, options):
    return sorted(map(tuple, Engine(spark).run(f"CREATE TABLE i ({columns}) WITH ({options}, format = 'json', type = 'source'); SELECT * FROM i;")[0].collect()))


def insert(spark, columns, options, values):
    e = Engine(spark)
    e.run(f"CREATE TABLE o ({columns}) WITH ({options}, format = 'json', type = 'sink'); INSERT INTO o SELECT * FROM (VALUES {values});")
    e.flush()


def test_polling_http(spark, ports):
    url = f"http://127.0.0.1:{ports[0]}/poll"
    assert select(spark, "a BIGINT", f"connector = 'polling_http', endpoint = '{url}', framing = 'newline'") == [(1,), (2,)]


def test_polls_of_a_stream(ports):
    o = {"endpoint": f"http://127.0.0.1:{ports[0]}/poll", "poll_interval_ms": "0", "emit_behavior": "changed"}
    changed, every = web._Polls(o), web._Polls(o | {"emit_behavior": "all"})
    rows, at = changed.read(changed.initialOffset())
    assert len(list(rows)) == 1 and at["polls"] == 1
    rows, again = changed.read(at)
    assert list(rows) == [] and again == at
    assert every.read(every.read(every.initialOffset())[1])[1]["polls"] == 2


def test_server_sent_events(spark, ports):
    o = f"connector = 'sse', endpoint = 'http://127.0.0.1:{ports[0]}/sse', headers = 'X-Token: secret'"
    assert select(spark, "a BIGINT", o) == [(1,), (2,), (3,)]
    assert select(spark, "a BIGINT", o + ", events = 'tick'") == [(1,), (3,)]
    left = list(web.sse({"endpoint": f"http://127.0.0.1:{ports[0]}/sse", "headers": "X-Token: secret"}, "1"))
    assert [i for i, _ in left] == ["2", "3"]


def test_server_sent_events_as_a_stream(spark, ports, tmp_path):
    web.register(spark)
    s = spark.readStream.format("sse").option("endpoint", f"http://127.0.0.1:{ports[0]}/sse").option("headers", "X-Token: secret").load()
    q = s.writeStream.format("memory").queryName("sse_seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    for _ in range(30):
        q.awaitTermination(1)
        if spark.table("sse_seen").count() >= 3:
            break
    q.stop()
    assert sorted(json.loads(r.value)["a"] for r in spark.table("sse_seen").collect()) == [1, 2, 3]


def test_websocket(spark, ports):
    long = "x" * 300
    o = f"connector = 'websocket', endpoint = 'ws://127.0.0.1:{ports[1]}/feed', subscription_message = '{json.dumps({'a': long})}'"
    assert select(spark, "a TEXT", o) == [(long,)]


def test_webhook_tries_again(spark, ports):
    Http.posts.clear()
    Http.failures = 2
    insert(spark, "a BIGINT, b TEXT", f"connector = 'webhook', endpoint = 'http://127.0.0.1:{ports[0]}/hook'", "(1, 'x'), (2, 'y')")
    assert sorted(Http.posts) == ['{"a":1,"b":"x"}', '{"a":2,"b":"y"}']


def test_redis_targets_and_lookup(spark, ports):
    at = f"connector = 'redis', address = 'redis://127.0.0.1:{ports[2]}'"
    insert(spark, "a BIGINT, b TEXT", f"{at}, target = 'string', target.key_prefix = 's:', target.key_column = 'a'", "(1, 'x'), (2, 'y')")
    insert(spark, "a BIGINT, b TEXT", f"{at}, target = 'list', target.list_prefix = 'l', target.max_length = '2'", "(1, 'x'), (2, 'y'), (3, 'z')")
    insert(spark, "a BIGINT, b TEXT", f"{at}, target = 'hash', target.hash_key_prefix = 'h', target.hash_field_column = 'a'", "(1, 'x'), (2, 'y')")
    assert Redis.store["s:1"] == '{"a":1,"b":"x"}' and len(Redis.store["l"]) == 2 and sorted(Redis.store["h"]) == ["1", "2"]
    d = spark.createDataFrame([(1, "p"), (2, "q"), (9, "r"), (None, "n"), (1, "t")], "k long, c string").coalesce(1)
    got = web.lookup_redis(d, "k", {"address": f"redis://127.0.0.1:{ports[2]}", "target.key_prefix": "s:"})
    assert sorted((r.c, r.k, r.value) for r in got.collect()) == [("n", None, None), ("p", 1, '{"a":1,"b":"x"}'), ("q", 2, '{"a":2,"b":"y"}'), ("r", 9, None), ("t", 1, '{"a":1,"b":"x"}')]
    assert sorted(Redis.asked) == ["s:1", "s:2", "s:9"]


def test_refusals():
    with pytest.raises(ValueError, match="not a header"):
        web.headers("a: b, c")
    from tidemark.plans.script import parse_table

    with pytest.raises(PlanError, match="cluster.addresses"):
        parse_table("CREATE TABLE t (a INT) WITH (connector = 'redis', cluster.addresses = 'x', type = 'sink')")
