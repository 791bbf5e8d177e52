"""WARC archives and their global capture index (operator 8).

Pages are written as gzip-per-record WARC files, one or more per task, into
the shared folder and read back from there. Equal payloads are stored once:
the record with the largest page_id is a response, the others are revisits
that name it.

Reading an archive yields its captures, sorted by URL key and time: a local
run. The runs are cut at common ranges of (URL key, time, page_id), and each
range's pieces are merged by a loser tree: k - 1 nodes hold the losers of past
matches, so the next capture costs log2(k) comparisons along one path. The
ranges in order are the global index; a URL with very many captures is spread
over several ranges, since time and page_id are part of the cut.

Defined cases: a null html is an empty payload; a null url has the empty key
and no target header; a null page_id is written without its header, and such
records refer to a page only if the group has one with a page_id (else all are
responses); equal payloads under equal page_ids are each a response if that
page_id is the largest; an empty table writes no archive; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentcf.llm.common import settle, table
from latentcf.llm.files import Publisher, filesystem
from latentcf.session import scratch_path

#: an archive is closed once it has this many bytes
ROLL_BYTES = 1 << 30
#: payloads of fewer bytes are always stored
LEAST_BYTES = 0
#: runs merged at once
FAN_IN = 128
#: captures of a page: seconds after this moment by page_id (the table has no capture time)
EPOCH = 1_704_067_200


def url_key(url: str | None) -> str:
    """Host labels from the top down, then path and query: a.b.com/x -> com,b,a)/x."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return url.strip().lower()
    if host.startswith("www."):
        host = host[4:]
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}".lower()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def timestamp(page_id: int | None) -> str:
    import time

    return time.strftime("%Y%m%d%H%M%S", time.gmtime((EPOCH + (page_id or 0)) % (1 << 36)))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to: int | None, has_response: bool) -> bytes:
    """One WARC/1.1 record, gzipped by itself."""
    t = timestamp(page_id)
    fields = {
        "WARC-Type": "revisit" if has_response else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:]}Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="".join(chr(c) for c in range(33, 127)))
    if page_id is not None:
        fields["WARC-Page-ID"] = str(page_id)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if has_response:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = record_id(refers_to, digest)
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        block = head + payload
    fields["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def records(stream, step: int = 1 << 20) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, payload) of each record of an archive."""
    ahead, at = b"", 0
    while True:
        if not ahead:
            ahead = stream.read(step)
            if not ahead:
                return
        unpack, whole, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not ahead:
                ahead = stream.read(step)
                if not ahead:
                    raise EOFError("archive ends inside a record")
            whole.append(unpack.decompress(ahead))
            used += len(ahead) - len(unpack.unused_data)
            ahead = unpack.unused_data
        head, _, rest = b"".join(whole).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        yield at, used, fields, block.partition(b"\r\n\r\n")[2]
        at += used


def _write_task(folder: str, roll: int):
    def run(batches):
        import pyarrow as pa

        names, out, worker, n = [], None, TaskContext.get().partitionId(), 0
        for b in batches:
            for page_id, url, html, refers_to, again in zip(*[b.column(i).to_pylist() for i in range(5)]):
                payload = html.encode()
                if out is None:
                    out = Publisher(folder, f"pages-{worker:06d}-{n:04d}.warc.gz")
                out.write(record(page_id, url, payload, digest32(payload), refers_to, again))
                if out.size >= roll:
                    out.publish()
                    names.append((out.name, out.size))
                    out, n = None, n + 1
        if out is not None:
            out.publish()
            names.append((out.name, out.size))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in names], pa.string()),
                                          pa.array([x[1] for x in names], pa.int64())], names=["file", "size"])

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, roll: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; returns the manifest (file, size)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sha = F.sha1(F.col("html").cast("binary"))
    seen = settle(rows.select("page_id", sha.alias("sha")).where(F.octet_length("html") >= least_bytes), "warc-seen")
    owner = settle(seen.groupBy("sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
                   .where("n > 1 and owner is not null").select("sha", "owner"), "warc-owner")
    again = settle(seen.join(owner, "sha").where(~F.col("page_id").eqNullSafe(F.col("owner")))
                   .select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "owner").distinct(), "warc-again")
    # joined by page, so copies of one payload do not meet in a task
    dealt = rows.withColumn("sha", sha).join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")
    picked = dealt.select("page_id", "url", "html", "owner", F.col("owner").isNotNull().alias("again"))
    return settle(picked.mapInArrow(_write_task(folder, roll), "file string, size long"), "warc-manifest")


CAPTURE = ("run string, seq long, url_key string, timestamp string, page_id long, record_type string, record_id string, "
           "refers_to_record string, payload_bytes long, payload_digest string, offset long, length long")
ORDER = ("url_key", "timestamp", "page_id", "run", "offset")


def _read_task(folder: str):
    """Archives -> their captures as locally sorted runs."""

    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in CAPTURE.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        types = [kinds[f.split()[1]] for f in CAPTURE.split(", ")]
        fs, base = filesystem(folder)
        for b in batches:
            for file in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base.rstrip('/')}/{file}", compression=None) as stream:
                    for at, n, head, payload in records(stream):
                        page = int(head["WARC-Page-ID"]) if "WARC-Page-ID" in head else None
                        stored = head["WARC-Type"] == "response"
                        when = "".join(c for c in head["WARC-Date"] if c.isdigit())
                        rows.append((url_key(head.get("WARC-Target-URI")), when, page, head["WARC-Type"],
                                     head["WARC-Record-ID"], head.get("WARC-Refers-To"),
                                     len(payload) if stored else None,
                                     digest32(payload) if stored else head["WARC-Payload-Digest"].removeprefix("sha1:"), at, n))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[8]))
                for lo in range(0, max(1, len(rows)), 10_000):
                    part = rows[lo : lo + 10_000]
                    columns = [[file] * len(part), list(range(lo, lo + len(part))), *(list(c) for c in zip(*part))]
                    if part:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The captures of all archives; rows of one archive are a sorted run."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(parts, "file").mapInArrow(_read_task(folder), CAPTURE)


class LoserTree:
    """Merges sorted iterators of (key, value): every node keeps the loser of its match."""

    _END = object()

    def __init__(self, sources):
        self.sources = [iter(s) for s in sources]
        self.k = len(self.sources)
        self.heads = [next(s, self._END) for s in self.sources]
        self.losers = [-1] * self.k  # place 0: the winner
        for i in range(self.k):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is self._END or self.heads[b] is self._END:
            return self.heads[b] is self._END and (self.heads[a] is not self._END or a < b)
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def _replay(self, player: int) -> None:
        node = (player + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # first arrival at this node waits for its opponent
                self.losers[node] = player
                return
            if self._before(other, player):
                self.losers[node], player = player, other
            node //= 2
        self.losers[0] = player

    def __iter__(self):
        while self.k:
            winner = self.losers[0]
            if self.heads[winner] is self._END:
                return
            yield self.heads[winner]
            self.heads[winner] = next(self.sources[winner], self._END)
            self._replay(winner)


def _merge_task(batches):
    """Rows by (run, seq) -> one order. Runs wait in the task's own temporary files, which go
    with the task; more than FAN_IN runs are merged in passes."""
    import pyarrow as pa

    def key(row):
        return row[2], row[3], row[4] is not None, row[4] or 0, row[0], row[10]

    with tempfile.TemporaryDirectory() as spool:
        schema, made, files, out, last = None, 0, [], None, None

        def fresh():
            nonlocal made
            made += 1
            return os.path.join(spool, f"{made}.arrow")

        def rows(path):
            with pa.OSFile(path) as f, pa.ipc.open_stream(f) as r:
                for b in r:
                    for row in zip(*[c.to_pylist() for c in b.columns]):
                        yield key(row), row

        def chunks(merged, n=1_000):
            part = []
            for _, row in merged:
                part.append(row)
                if len(part) == n:
                    yield part
                    part = []
            if part:
                yield part

        def as_batch(part):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part), schema.types)], schema=schema)

        for b in batches:
            schema = schema or b.schema
            run = b.column(0).to_pylist()
            lo = 0
            for hi in range(1, len(run) + 1):
                if hi == len(run) or run[hi] != run[lo]:
                    if run[lo] != last:
                        if out:
                            out.close()
                        files.append(fresh())
                        out, last = pa.ipc.new_stream(files[-1], schema), run[lo]
                    for at in range(lo, hi, 1_000):
                        out.write_batch(b.slice(at, min(1_000, hi - at)))
                    lo = hi
        if out:
            out.close()
        while len(files) > FAN_IN:
            path = fresh()
            with pa.ipc.new_stream(path, schema) as w:
                for part in chunks(LoserTree([rows(f) for f in files[:FAN_IN]])):
                    w.write_batch(as_batch(part))
            for f in files[:FAN_IN]:
                os.remove(f)
            files = files[FAN_IN:] + [path]
        if files:
            for part in chunks(LoserTree([rows(f) for f in files]), 5_000):
                yield as_batch(part)


def merge_index(runs: DataFrame) -> DataFrame:
    """The captures of all runs in the order of ORDER, over ranges in order."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = runs.repartitionByRange(parts, *ORDER).sortWithinPartitions("run", "seq")
    return ranged.mapInArrow(_merge_task, CAPTURE)


def resolve(index: DataFrame) -> DataFrame:
    """Captures with ``refers_to`` (the response's page_id) and the size of its payload."""
    stored = index.where("record_type = 'response'").select(
        F.col("record_id").alias("to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"))
    stored = stored.dropDuplicates(["to"])
    revisits = index.where("record_type = 'revisit'").join(stored, F.col("refers_to_record") == F.col("to"), "left")
    first = index.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    rest = revisits.withColumns({"refers_to": F.col("to_page"), "payload_bytes": F.col("to_bytes")})
    return first.unionByName(rest.select(*first.columns))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc-archives")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    runs = settle(read_archives(manifest, folder), "warc-runs")
    found = resolve(settle(merge_index(runs), "warc-index"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
