"""Message sources and sinks over plain sockets: polled HTTP, server-sent events, websockets, webhooks, Redis.

Each is a Python data source of the connector's name: rows are one text column, value. Bounded reads take one poll, or a feed until its server ends it.
Streams read on the driver, as these protocols have no partitions, and cannot be replayed: what was read but not yet written when a driver is lost
is asked for again (a feed of server-sent events by its last id). Sinks run on the executors and deliver at least once."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import os
import socket
import ssl
import struct
import threading
import time
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from http.client import HTTPException
from urllib.error import HTTPError, URLError
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

TIMEOUT, ATTEMPTS, LONGEST_WAIT = 30.0, 8, 5.0
#: How a websocket's server answers a key (fixed value of the protocol).
WEBSOCKET_SALT = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"


def headers(text: str | None) -> dict[str, str]:
    """'name: value, name: value' as a dict; a part without a colon is an error."""
    out = {}
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        name, colon, value = part.partition(":")
        if not colon:
            raise ValueError(f"not a header: {part}")
        out[name.strip()] = value.strip()
    return out


def again(call: Callable[[], object]) -> object:
    """call, repeated with growing pauses while the other side is away or fails; its last error in the end."""
    for attempt in range(ATTEMPTS):
        try:
            return call()
        except (URLError, OSError) as e:
            refused = isinstance(e, HTTPError) and e.code < 500 and e.code not in (408, 429)
            if refused or attempt == ATTEMPTS - 1:
                raise
            time.sleep(min(LONGEST_WAIT, 0.05 * 2**attempt))


def fetch(o: dict[str, str]) -> str:
    body = o["body"].encode() if o.get("body") else None
    request = urllib.request.Request(o["endpoint"], data=body, headers=headers(o.get("headers")), method=o.get("method", "GET").upper())
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        return answer.read().decode("utf-8", "replace")


def sse(o: dict[str, str], last: str = "") -> Iterator[tuple[str, str]]:
    """Id so far and data of each event until the server ends; only the kinds that option events names."""
    wanted = {e.strip() for e in o.get("events", "").split(",") if e.strip()}
    more = {"Accept": "text/event-stream", **({"Last-Event-ID": last} if last else {})}
    kind, data = "", []
    with urllib.request.urlopen(urllib.request.Request(o["endpoint"], headers=headers(o.get("headers")) | more)) as answer:
        for raw in answer:
            line = raw.decode("utf-8", "replace").rstrip("\r\n")
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if not line:
                if data and (not wanted or (kind or "message") in wanted):
                    yield last, "\n".join(data)
                kind, data = "", []
            elif name == "data":
                data.append(value)
            elif name == "event":
                kind = value
            elif name == "id":
                last = value


def _exactly(s: socket.socket, n: int) -> bytes:
    out = bytearray()
    while len(out) < n:
        part = s.recv(n - len(out))
        if not part:
            raise EOFError
        out += part
    return bytes(out)


def _frame(s: socket.socket, code: int, payload: bytes) -> None:
    """A masked frame, as clients must send them."""
    n, mask = len(payload), os.urandom(4)
    size = bytes([128 | n]) if n < 126 else b"\xfe" + struct.pack(">H", n) if n < 1 << 16 else b"\xff" + struct.pack(">Q", n)
    s.sendall(bytes([128 | code]) + size + mask + bytes(b ^ m for b, m in zip(payload, itertools.cycle(mask))))


def websocket(o: dict[str, str], last: str = "") -> Iterator[tuple[str, str]]:
    """Text of each message until the server closes; subscription messages go out first."""
    u = urlsplit(o["endpoint"])
    s = socket.create_connection((u.hostname, u.port or (443 if u.scheme == "wss" else 80)), TIMEOUT)
    if u.scheme == "wss":
        s = ssl.create_default_context().wrap_socket(s, server_hostname=u.hostname)
    with s:
        key = base64.b64encode(os.urandom(16)).decode()
        lines = [f"GET {u.path or '/'}{'?' + u.query if u.query else ''} HTTP/1.1", f"Host: {u.netloc}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {key}", "Sec-WebSocket-Version: 13"]
        s.sendall("\r\n".join([*lines, *(f"{k}: {v}" for k, v in headers(o.get("headers")).items()), "", ""]).encode())
        answer = b""
        while not answer.endswith(b"\r\n\r\n"):
            answer += _exactly(s, 1)
        accept = base64.b64encode(hashlib.sha1((key + WEBSOCKET_SALT).encode()).digest()).decode()
        if b" 101 " not in answer.split(b"\r\n")[0] or accept.encode() not in answer:
            raise ConnectionError("the server refuses a websocket")
        s.settimeout(None)
        for message in filter(None, [o.get("subscription_message"), *json.loads(o.get("subscription_messages", "[]"))]):
            _frame(s, 1, message.encode())
        whole = b""
        while True:
            try:
                first, size = _exactly(s, 2)
            except EOFError:
                return
            n = size & 127
            n = struct.unpack(">H", _exactly(s, 2))[0] if n == 126 else struct.unpack(">Q", _exactly(s, 8))[0] if n == 127 else n
            payload, code = _exactly(s, n), first & 15
            if code == 8:
                return
            if code == 9:
                _frame(s, 10, payload)
            elif code in (0, 1, 2):
                whole += payload
                if first & 128:
                    yield "", whole.decode("utf-8", "replace")
                    whole = b""


FEEDS = {"sse": sse, "websocket": websocket}


class _Once(DataSourceReader):
    """A bounded read in one task."""

    def __init__(self, rows: Callable[[], Iterator[tuple[str]]]):
        self.rows = rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        return self.rows()


class _Polls(SimpleDataSourceStreamReader):
    """One poll a batch, at most one an interval; emit_behavior = changed leaves out answers equal to the one before."""

    def __init__(self, o: dict[str, str]):
        self.o, self.last = o, 0.0

    def initialOffset(self) -> dict:
        return {"polls": 0, "seen": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        if time.monotonic() - self.last < int(self.o.get("poll_interval_ms", 1000)) / 1000:
            return iter([]), start
        self.last = time.monotonic()
        body = again(lambda: fetch(self.o))
        seen = hashlib.sha256(body.encode()).hexdigest()
        if self.o.get("emit_behavior", "all").lower() == "changed" and seen == start["seen"]:
            return iter([]), start
        return iter([(body,)]), {"polls": start["polls"] + 1, "seen": seen}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        return iter([(fetch(self.o),)])


class _Feed(SimpleDataSourceStreamReader):
    """A thread reads; a batch takes what has come since. The feed is opened again where its server ends it."""

    def __init__(self, name: str, o: dict[str, str]):
        self.name, self.o, self.thread, self.rows = name, o, None, deque()

    def __getstate__(self) -> dict:
        return {"name": self.name, "o": self.o, "thread": None, "rows": deque()}  # tasks that replay get no thread

    def _run(self, last: str) -> None:
        while True:
            try:
                for last, text in FEEDS[self.name](self.o, last):
                    self.rows.append((last, text))
            except (URLError, OSError, EOFError, HTTPException):
                pass  # opened again below
            time.sleep(1.0)

    def initialOffset(self) -> dict:
        return {"read": 0, "id": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        if self.thread is None:
            self.thread = threading.Thread(target=self._run, args=(start["id"],), daemon=True)
            self.thread.start()
        rows = [self.rows.popleft() for _ in range(len(self.rows))]
        return iter([(text,) for _, text in rows]), {"read": start["read"] + len(rows), "id": rows[-1][0]} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        found = ((text,) for _, text in FEEDS[self.name](self.o, start["id"]))
        return itertools.islice(found, end["read"] - start["read"])


class _Source(DataSource):
    def schema(self) -> str:
        return "value string"


class PollingHttp(_Source):
    @classmethod
    def name(cls) -> str:
        return "polling_http"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        o = dict(self.options)
        return _Once(lambda: iter([(again(lambda: fetch(o)),)]))

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return _Polls(dict(self.options))


class Sse(_Source):
    @classmethod
    def name(cls) -> str:
        return "sse"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        o, kind = dict(self.options), self.name()
        return _Once(lambda: ((text,) for _, text in FEEDS[kind](o)))

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return _Feed(self.name(), dict(self.options))


class Websocket(Sse):
    @classmethod
    def name(cls) -> str:
        return "websocket"


class _Posts(DataSourceWriter):
    """One request a row; a server that is away is asked again, one that refuses fails the task."""

    def __init__(self, o: dict[str, str]):
        self.o = o

    def write(self, iterator: Iterator[T.Row]) -> WriterCommitMessage:
        more = {"Content-Type": "application/json"} | headers(self.o.get("headers"))

        def post(text: str) -> None:
            with urllib.request.urlopen(urllib.request.Request(self.o["endpoint"], data=text.encode(), headers=more, method="POST"), timeout=TIMEOUT) as answer:
                answer.read()

        for row in iterator:
            again(lambda: post(row[0]))
        return WriterCommitMessage()


class _StreamPosts(_Posts, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        pass

    def abort(self, messages: list, batchId: int) -> None:
        pass


class Webhook(_Source):
    @classmethod
    def name(cls) -> str:
        return "webhook"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Posts(dict(self.options))

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamPosts(dict(self.options))


class Redis:
    """A connection that speaks the serialisation protocol; many commands go out before their answers are read."""

    def __init__(self, o: dict[str, str]):
        u = urlsplit(o["address"])
        self.s = socket.create_connection((u.hostname, u.port or 6379), TIMEOUT)
        if u.scheme == "rediss":
            self.s = ssl.create_default_context().wrap_socket(self.s, server_hostname=u.hostname)
        self.lines = self.s.makefile("rb")
        user, password = o.get("username") or u.username, o.get("password") or u.password
        if password:
            self.send([["AUTH", *([user] if user else []), password]])

    def send(self, commands: list[list[str]]) -> list[object]:
        out = bytearray()
        for c in commands:
            out += b"*%d\r\n" % len(c)
            for part in c:
                b = part.encode()
                out += b"$%d\r\n%s\r\n" % (len(b), b)
        self.s.sendall(out)
        return [self._answer() for _ in commands]

    def _answer(self) -> object:
        line = self.lines.readline().rstrip(b"\r\n")
        kind, rest = line[:1], line[1:]
        if kind == b"-":
            raise ConnectionError(rest.decode("utf-8", "replace"))
        if kind in (b"+", b":"):
            return rest.decode()
        n = int(rest)
        if kind == b"*":
            return [self._answer() for _ in range(n)]
        return None if n < 0 else self.lines.read(n + 2)[:-2].decode("utf-8", "replace")

    def close(self) -> None:
        self.lines.close()
        self.s.close()


BATCH = 500


def _commands(o: dict[str, str], row: T.Row, text: str) -> list[list[str]]:
    """What writes one row: a string under its key, an entry at an end of a list, or a field of a hash."""
    target = o.get("target", "string")
    key = lambda p, c: o.get(p, "") + (str(row[o[c]]) if o.get(c) else "")
    if target == "string":
        ttl = o.get("target.ttl_secs")
        return [["SET", key("target.key_prefix", "target.key_column"), text, *(["EX", ttl] if ttl else [])]]
    if target == "list":
        name, prepend = key("target.list_prefix", "target.list_key_column"), o.get("target.operation", "append").lower() == "prepend"
        longest = o.get("target.max_length")
        trim = [] if not longest else [["LTRIM", name, "0", str(int(longest) - 1)]] if prepend else [["LTRIM", name, f"-{longest}", "-1"]]
        return [["LPUSH" if prepend else "RPUSH", name, text], *trim]
    if target == "hash":
        return [["HSET", key("target.hash_key_prefix", "target.hash_key_column"), str(row[o["target.hash_field_column"]]), text]]
    raise ValueError(f"redis: unknown target {target}")


def write_redis(df: DataFrame, o: dict[str, str], text: str = "_value") -> None:
    """Writes rows from the executors; column text holds each row's message, the others its keys."""

    def run(rows: Iterator) -> Iterator:
        redis = None
        for batch in rows:
            redis = redis or Redis(o)
            todo = [c for row in batch.to_dict("records") for c in _commands(o, row, row[text])]
            for i in range(0, len(todo), BATCH):
                redis.send(todo[i : i + BATCH])
        if redis:
            redis.close()
        yield from ()

    df.mapInPandas(run, "done int").write.format("noop").mode("overwrite").save()


def lookup_redis(df: DataFrame, key: str, o: dict[str, str], value: str = "value") -> DataFrame:
    """df with the text that Redis holds under the prefix and each row's key, null without one. Each key is asked for once a batch of rows and kept
    for the task while lookup.cache.max_bytes (64 MB) holds; lookup.cache.ttl (seconds) bounds how long."""
    room, ttl, prefix = int(o.get("lookup.cache.max_bytes", 64 << 20)), float(o.get("lookup.cache.ttl", 60)), o.get("target.key_prefix", "")
    schema = T.StructType([*df.schema.fields, T.StructField(value, T.StringType())])

    def run(batches: Iterator) -> Iterator:
        redis, kept, used = None, {}, 0
        for pdf in batches:
            now = time.monotonic()
            keys = [k if isinstance(k, str) else None for k in pdf.pop("_key")]
            found = {k: kept[k][1] for k in set(keys) if k in kept and now - kept[k][0] <= ttl}
            asked = sorted({k for k in keys if k is not None} - found.keys())
            for i in range(0, len(asked), BATCH):
                redis = redis or Redis(o)
                part = asked[i : i + BATCH]
                found.update(zip(part, redis.send([["MGET", *(prefix + k for k in part)]])[0]))
            if used > room:
                kept, used = {}, 0
            for k in asked:
                kept[k] = (now, found[k])
                used += len(k) + len(found[k] or "") + 100
            pdf[value] = [found.get(k) for k in keys]
            yield pdf
        if redis:
            redis.close()

    return df.withColumn("_key", F.col(key).cast("string")).mapInPandas(run, schema)


def register(spark: SparkSession) -> None:
    for source in (PollingHttp, Sse, Websocket, Webhook):
        spark.dataSource.register(source)
