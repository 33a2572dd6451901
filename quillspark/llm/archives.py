"""WARC archives: written, read back, and indexed by an external merge of sorted capture runs.

Writing: each task streams its pages into archives in the shared folder, one gzip member for each record. Among records
of equal payloads of at least LEAST bytes the one with the largest page_id is a response and the others are revisits of
it, which carry the payload's digest and, in their HTTP header, its length, but not the payload. An archive is written
under a name of its task's attempt and renamed when whole, so a task that runs again replaces its file.

Reading: archives are streamed member by member; a response's digest and length are taken from its payload and held
against its headers. The captures of one archive, sorted by URL key, timestamp and page, are a run.

Index: range partitions of the key receive their slice of every run and merge the slices by a loser tree, which gives
capture histories in global order: partition after partition, row after row. The merge is external: a partition holds
slices as Arrow batches up to HELD bytes; what exceeds that is merged into a longer run, which goes to the shared folder,
and the last merge reads these runs back batch by batch. The range key ends with the page, so one URL or host with many
captures spreads over partitions.

Null html counts as empty, a null url as an empty one. Repeated page_ids each have their record, whose ID tells page and
URL; rows that agree in both share it. Which of several equal payloads of one largest page_id is the response is settled by
url. A URL that a header line can't hold as it is comes along in base64 as well, and is read from there.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import batches, may_hold, partitions, shared_path, small_batches, table_of, written

LEAST = 1000
#: An archive is closed when it has this many compressed bytes.
ROLL = 64 << 20
#: Bytes of slices that a merging task holds before it merges them into a run of its own.
HELD = 32 << 20
#: The header of a URL that isn't one printable line.
WHOLE_URL = "X-Target-URI-Base64"
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages with refers_to and refers_url (null for a response), page_id, url, html; html is moved once, and only if it has a twin.

    Twins are found on digests. A bit table of fixed size tells the rows whose digest may have one; all others stay where
    they are, at any size, and those are told apart by a join.
    """
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    mark = F.sha2(F.col("html").cast("binary"), 256)
    marks = pages.where(F.octet_length("html") >= least).select(mark.alias("mark"), "page_id", "url")
    best = marks.groupBy("mark").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count("*").alias("n")).where("n > 1").select("mark", "best")
    best = written(best, "twins")
    brief = F.xxhash64("mark")
    table = table_of(best.select(brief.alias("hash")))
    keyed = pages.withColumn("mark", F.when(F.octet_length("html") >= least, mark).otherwise(""))
    may = (F.col("mark") != "") & may_hold(pages.sparkSession, table, brief)
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("refers_to", "long"), ("refers_url", "string"))]
    other = F.col("best").isNotNull() & ~F.struct("page_id", "url").eqNullSafe(F.col("best"))
    met = keyed.where(may).join(best, "mark", "left")
    told = [F.when(other, F.col("best.page_id")).alias("refers_to"), F.when(other, F.col("best.url")).alias("refers_url"), other.alias("revisit")]
    alone = keyed.where(~may).select("page_id", "url", "html", *none, F.lit(False).alias("revisit"))
    return alone.unionByName(met.select("page_id", "url", "html", *told))


def place(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store behind a URI, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _id(page_id: int | None, url: str) -> str:
    return f"<urn:page:{page_id}:{hashlib.sha1(url.encode()).hexdigest()[:16]}>"


def _record(page_id: int, url: str, html: str, refers_to: int | None, refers_url: str | None, revisit: bool) -> bytes:
    payload = html.encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    when = (EPOCH + datetime.timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    line = " ".join(url.split())
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id, url)}", f"WARC-Target-URI: {line}", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{digest}"]
    if line != url or not url.isprintable():
        lines.append(f"{WHOLE_URL}: {base64.b64encode(url.encode()).decode()}")
    if revisit:
        lines += [f"WARC-Refers-To: {_id(refers_to, refers_url or '')}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


WROTE = pa.schema([("archive", pa.string()), ("records", pa.int64())])


def write(plan: DataFrame, folder: str) -> DataFrame:
    """Writes the planned pages as archives and returns their names and numbers of records, as a written table."""

    def archives(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        store, base = place(folder)
        store.create_dir(base, recursive=True)
        task, number, out, n, size, name = TaskContext.get().partitionId(), 0, None, 0, 0, ""

        def closed() -> tuple:
            out.close()
            final = f"part-{task:05d}-{number:04d}.warc.gz"
            store.move(name, f"{base}/{final}")
            return final, n

        for part in parts:
            columns = [part.column(i) for i in range(6)]
            for i in range(part.num_rows):
                if out is None:
                    name = f"{base}/.open-{task}-{uuid.uuid4().hex}"
                    out, n, size = store.open_output_stream(name), 0, 0
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(_record(*(c[i].as_py() for c in columns))) + packer.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ROLL:
                    yield closed()
                    out, number = None, number + 1
        if out is not None:
            yield closed()

    made = plan.select("page_id", "url", "html", "refers_to", "refers_url", "revisit").mapInArrow(lambda parts: batches(archives(parts), WROTE), "archive string, records long")
    return written(made, "archives")


def url_key(url: str) -> str:
    """Host labels in reverse, then path and query, lower-cased: com,example,www)/path?query."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return ")" + url.lower()
    tail = parts.path + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + (tail or "/").lower()


CAPTURES = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])
CAPTURES_SQL = "url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long"


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream."""
    at, start, out, unpacker, data = 0, 0, [], zlib.decompressobj(31), b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                if out:
                    raise EOFError("the last member of the archive is cut off")
                return
        out.append(unpacker.decompress(data))
        used = len(data) - len(unpacker.unused_data)
        at += used
        if unpacker.eof:
            data = unpacker.unused_data
            yield start, b"".join(out)
            start, out, unpacker = at, [], zlib.decompressobj(31)
        else:
            data = b""


def _page_of(urn: str) -> int | None:
    said = urn.split(":")[2]
    return None if said == "None" else int(said)


def _capture(offset: int, raw: bytes, archive: str) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != said or len(payload) != length):
        raise ValueError(f"the payload at {offset} of {archive} isn't the one that its header describes")
    url = base64.b64decode(fields[WHOLE_URL]).decode() if WHOLE_URL in fields else fields["WARC-Target-URI"]
    refers = _page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return url_key(url), fields["WARC-Date"], _page_of(fields["WARC-Record-ID"]), url, fields["WARC-Type"], length, said, refers, archive, offset


def read(archives: DataFrame, folder: str) -> DataFrame:
    """The captures of all archives, each archive's as a run sorted by url_key, captured and page_id."""

    def captures(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, base = place(folder)
        for part in parts:
            for name in part.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    run = [_capture(at, raw, name) for at, raw in members(stream)]
                run.sort(key=_order)
                yield from run

    # an archive each, as far as there are tasks; names alone are moved
    names = archives.select("archive").repartition(partitions(archives.sparkSession))
    return names.mapInArrow(lambda parts: batches(captures(parts), CAPTURES), CAPTURES_SQL)


def _order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[8], row[9]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the root the winner."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key = runs, key
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.k = len(runs)
        self.tree = [-1] * max(1, self.k)
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.top = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def __iter__(self) -> Iterator:
        while self.k and self.keys[self.top] is not None:
            won = self.top
            yield self.heads[won]
            self.heads[won] = head = next(self.runs[won], None)
            self.keys[won] = None if head is None else self.key(head)
            node = (won + self.k) // 2
            while node:
                if self._before(self.tree[node], won):
                    won, self.tree[node] = self.tree[node], won
                node //= 2
            self.top = won


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, a few at a time as Python values."""
    for at in range(0, batch.num_rows, 1024):
        some = batch.slice(at, 1024)
        yield from zip(*(some.column(i).to_pylist() for i in range(len(CAPTURES))))


def slices(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Sorted pieces of batches; with each whether it goes on with the slice before it.

    Slices are what comes in order: a new one begins where the order breaks, wherever blocks of runs begin and end.
    """
    before = None
    for part in parts:
        keys = [_order(row) for row in _rows(part)]
        if not keys:
            continue
        edges = [i for i in range(1, len(keys)) if keys[i] < keys[i - 1]]
        for a, b in zip([0, *edges], [*edges, len(keys)]):
            yield part.slice(a, b - a), a == 0 and before is not None and before <= keys[0]
        before = keys[-1]


def merged(parts: Iterator[pa.RecordBatch], folder: str, held: int = HELD) -> Iterator[tuple]:
    """The rows of sorted slices in one order, by loser trees; runs that exceed what may be held wait in the folder."""
    store, base = place(folder)
    runs: list[list[pa.RecordBatch]] = []
    files: list[str] = []
    size = 0

    def in_order() -> Iterator[tuple]:
        return iter(LoserTree([(row for batch in run for row in _rows(batch)) for run in runs], _order))

    def put_aside() -> None:
        store.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}.run"
        with store.open_output_stream(name) as out, pa.ipc.new_stream(out, CAPTURES) as writer:
            for batch in batches(in_order(), CAPTURES):
                writer.write_batch(batch)
        files.append(name)

    def read_back(name: str) -> Iterator[tuple]:
        with store.open_input_stream(name) as source, pa.ipc.open_stream(source) as reader:
            for batch in reader:
                yield from _rows(batch)

    try:
        for piece, goes_on in slices(parts):
            if goes_on and runs:
                runs[-1].append(piece)
            else:
                runs.append([piece])
            size += piece.nbytes
            if size >= held:
                put_aside()
                runs, size = [], 0
        yield from LoserTree([*map(read_back, files), in_order()], _order)
    finally:
        for name in files:
            store.delete_file(name)


def merge_index(captures: DataFrame, held: int = HELD) -> DataFrame:
    """Captures in global order of url_key, captured and page_id: rows of partition i come before those of i + 1."""
    n = partitions(captures.sparkSession)
    folder = shared_path(captures.sparkSession, "runs")
    dealt = captures.repartitionByRange(n, "url_key", "captured", "page_id", "archive", "offset")
    return dealt.mapInArrow(lambda parts: batches(merged(parts, folder, held), CAPTURES), CAPTURES_SQL)


def archive_and_index(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes pages as archives in the shared folder, reads them back and merges their runs into one index."""
    folder = shared_path(pages.sparkSession, "warc")
    made = write(planned(pages, least), folder)
    return merge_index(written(read(made, folder), "captures"))


def histories(index: DataFrame) -> DataFrame:
    """For each URL key the number of its captures, the first and the last, and that of different payloads."""
    return index.groupBy("url_key").agg(F.count("*").alias("captures"), F.min("captured").alias("first"), F.max("captured").alias("last"), F.count_distinct("payload_digest").alias("payloads"))
