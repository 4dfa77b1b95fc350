"""WARC files read in splits, with record boundaries verified as a chain.

Each task searches its split of a file for record magic ("WARC/1.x", or a gzip member's in .gz files) at every byte, and emits
each candidate's offset and its successor's, by Content-Length or the member's end. Within a split, pointer jumping tells
where each candidate's chain leaves it; the few places where chains enter a split are linked to where they leave it, and
pointer jumping over a file's links from its start tells which are reached. From those the records of each split
follow; magic inside payloads is on no such chain. Only the ranges of reachable records are read again, for their contents.
No task holds more than one split's candidates, or a file's links: some for each split, however many records there are.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, filesystem, ship, table

SPLIT_BYTES = 16 << 20
_SLACK = 1 << 16
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", re.I)
RECORD = "path string, offset long, length long, warc_type string, uri string, date string, record_id string, content_type string, headers map<string,string>, http_status int, payload binary"
_RECORD_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def _head(f, at: int, size: int, data: bytes, base: int) -> tuple[int, int] | None:
    """Where the block of a record at `at` begins, and its length; data holds the file's bytes from base."""
    end, length = data.find(b"\r\n\r\n", at - base), None
    if end >= 0:
        found = _LENGTH.search(data, at - base, end + 2)
        return (base + end + 4, int(found[1])) if found else None
    f.seek(at)
    data, base = b"", at
    while more := f.read(_SLACK):  # read on in pieces, of which only a line that may state the length is kept
        data += more
        end = data.find(b"\r\n\r\n")
        if length is None and (found := _LENGTH.search(data, 0, end + 2 if end >= 0 else len(data))):
            length = int(found[1])
        if end >= 0:
            return (base + end + 4, length) if length is not None else None
        line = max(0, data.rfind(b"\r\n"))
        keep = len(data) - line if len(data) - line < 64 or data[line : line + 17].lower() == b"\r\ncontent-length:" else 3
        base, data = base + len(data) - keep, data[-keep:]
    return None


def _member(f, at: int, size: int) -> int | None:
    """Where the gzip member at `at` ends, if it is one that holds a WARC record."""
    z, f_at, first = zlib.decompressobj(31), at, b""
    f.seek(at)
    try:
        while not z.eof:
            chunk = f.read(1 << 16)
            if not chunk:
                return None
            f_at += len(chunk)
            rest = chunk
            while rest and not z.eof:
                out = z.decompress(rest, 1 << 20)
                if len(first) < 10:
                    first += out[:10]
                    if len(first) >= 10 and not _MAGIC.match(first):
                        return None
                rest = z.unconsumed_tail
    except zlib.error:
        return None
    return f_at - len(z.unused_data) if _MAGIC.match(first) else None


def _candidates(batches):
    """Rows (path, size, start, at, next, leaves) for the splits (path, size, start, stop): candidates, their successors, and
    where chains of them leave the split."""
    for b in batches:
        for path, size, start, stop in zip(*(c.to_pylist() for c in b.columns)):
            fs, p = filesystem(path)
            at, to = [], []
            with fs.open_input_file(p) as f:
                f.seek(start)
                data = f.read(min(size, stop + _SLACK) - start)
                if path.endswith(".gz"):
                    i = data.find(_GZIP)
                    while 0 <= i < stop - start:
                        end = _member(f, start + i, size)
                        if end is not None:
                            at.append(start + i), to.append(end)
                        i = data.find(_GZIP, i + 1)
                else:
                    for m in _MAGIC.finditer(data):
                        if m.start() >= stop - start:
                            break
                        head = _head(f, start + m.start(), size, data, start)
                        if head and (end := sum(head) + 4) <= size:
                            at.append(start + m.start()), to.append(end)
            leaves = np.unique(ends(np.array(at, np.int64), np.array(to, np.int64)))
            leaves = leaves[leaves >= stop]
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (at, to, leaves)]
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([start]), *lists], ["path", "size", "start", "at", "next", "leaves"])


def _jumps(offset: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """The place of each one's successor among the ascending offsets; their number where it isn't there."""
    n = len(offset)
    jump = np.searchsorted(offset, next_)
    return np.where((jump < n) & (offset[np.minimum(jump, n - 1)] == next_), jump, n) if n else jump


def ends(offset: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """Where the chain from each of the ascending offsets ends, that is the first successor that is none of them, by pointer jumping."""
    n = len(offset)
    jump = np.append(_jumps(offset, next_), n)
    last = np.arange(n + 1)
    while True:  # last: the furthest reached; jump: beyond it
        ahead = jump[last]
        if (ahead == n).all():
            return next_[last[:n]]
        last = np.where(ahead == n, last, ahead)
        last = last[last]


def reachable(offset: np.ndarray, next_: np.ndarray, entries: np.ndarray | None = None) -> np.ndarray:
    """Which of the ascending offsets the chains from the entries (by default, from 0) visit, by pointer jumping."""
    n = len(offset)
    seen = np.append(np.isin(offset, np.zeros(1, np.int64) if entries is None else entries), True)
    jump = np.append(_jumps(offset, next_), n)
    while True:
        ahead = jump[np.flatnonzero(seen)]
        if seen[ahead].all():
            return seen[:n]
        seen[ahead] = True
        jump = jump[jump]


def _arrays(b: pa.RecordBatch, *names: str):
    """A tuple of numpy arrays of the list columns, row by row."""
    columns = [b.column(n) for n in names]
    for i in range(b.num_rows):
        yield tuple(c[i].values.to_numpy(zero_copy_only=False) if c[i].is_valid else np.zeros(0, np.int64) for c in columns)


def _links(batches):
    """Rows (path, entry, leaves): where the chain of each place of entry leaves its split."""
    for b in batches:
        for path, (at, to, entries) in zip(b.column("path").to_pylist(), _arrays(b, "at", "next", "entries")):
            known = np.intersect1d(at, entries)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(known), pa.string()), pa.array(known), pa.array(ends(at, to)[np.searchsorted(at, known)])], ["path", "offset", "next"])


def _chain(t: pa.Table) -> pa.Table:
    t = t.sort_by("offset")
    return t.filter(pa.array(reachable(t.column("offset").to_numpy(), t.column("next").to_numpy()))).select(["path", "offset"])


def _parse(path: str, at: int, raw: bytes) -> tuple:
    if path.endswith(".gz"):
        length, raw = len(raw), gzip.decompress(raw)
    else:
        length = len(raw)
    head, _, rest = raw.partition(b"\r\n\r\n")
    pairs: list[tuple[str, str]] = []
    for line in head.split(b"\r\n")[1:]:
        if line[:1] in b" \t" and line and pairs:
            pairs[-1] = (pairs[-1][0], pairs[-1][1] + " " + line.decode("utf8", "replace").strip())
        elif b":" in line:
            k, _, v = line.decode("utf8", "replace").partition(":")
            pairs.append((k.strip().lower(), v.strip()))
    headers = dict(pairs)
    block, status = rest[: int(headers.get("content-length", 0))], None
    if headers.get("content-type", "").lower().startswith("application/http") and block[:5] == b"HTTP/":
        first = block[:64].split(b"\r\n")[0].split()
        status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
        block = block.partition(b"\r\n\r\n")[2]
    return path, at, length, headers.get("warc-type"), headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-record-id"), headers.get("content-type"), list(headers.items()), status, block


def _records(batches):
    """The records of splits' chains (path, at, next, entries)."""
    types = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *((c, pa.string()) for c in _RECORD_NAMES[3:8]), ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("payload", pa.binary())])
    opened, f = None, None
    for b in batches:
        rows, held = [], 0
        for path, (offsets, next_, entries) in zip(b.column("path").to_pylist(), _arrays(b, "at", "next", "entries")):
            if path != opened:
                fs, p = filesystem(path)
                opened, f = path, fs.open_input_file(p)
            on = reachable(offsets, next_, entries)
            for at, to in zip(offsets[on].tolist(), next_[on].tolist()):
                f.seek(at)
                rows.append(_parse(path, at, f.read(to - at)))
                held += len(rows[-1][-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """RECORD for every verified record of the files (path, size); .gz files hold a gzip member for each record.

    Header names are in lower case. A record that is cut short or malformed ends its file's chain, and what follows isn't read; nor
    is a file that doesn't begin with a record. Empty files and an empty list give no rows; rows with a null path are left
    out, a file listed twice is read once; records of any length are read whole. Other columns of files don't matter.
    """
    ship(spark)
    f = files.select(column(files, "path").cast("string").alias("path"), column(files, "size").cast("long").alias("size")).filter("path is not null and size > 0").groupBy("path").agg(F.max("size").alias("size"))
    f = table(f, "warc-list")
    total = f.agg(F.sum("size")).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-total // max(split_bytes, SPLIT_BYTES)))  # by number, so that small shuffles of offsets don't make few tasks of much reading
    cuts = f.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = cuts.select("path", "size", "start", F.least("size", F.col("start") + split_bytes).alias("stop")).repartition(n, "path", "start")
    found = table(splits.mapInArrow(_candidates, "path string, size long, start long, at array<long>, next array<long>, leaves array<long>"), "warc-candidates")

    def entered(by: DataFrame) -> DataFrame:
        """The splits with a chain that is entered at one of by's offsets, and those offsets."""
        e = by.select("path", "offset", (F.floor(F.col("offset") / split_bytes) * split_bytes).cast("long").alias("start")).groupBy("path", "start").agg(F.collect_set("offset").alias("entries"))
        return found.join(e, ["path", "start"]).repartition(n, "path", "start").select("path", "at", "next", "entries")

    starts = f.select("path", F.lit(0).cast("long").alias("offset"))
    entries = found.select("path", F.explode("leaves").alias("offset")).union(starts).distinct()
    links = entered(entries).mapInArrow(_links, "path string, offset long, next long")
    chain = table(links.groupBy("path").applyInArrow(_chain, "path string, offset long"), "warc-chain")
    return entered(chain).mapInArrow(_records, RECORD)


# writing


def _record(kind: str, block: bytes, record_id: str, uri: str | None, content_type: str, more: tuple[str, ...] = ()) -> bytes:
    clean = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", uri) if uri is not None else None
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2024-01-01T00:00:00Z", *([f"WARC-Target-URI: {clean}"] if clean is not None else []), f"Content-Type: {content_type}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, html: str | None, pack=lambda r: r):
    """A page's response; for every page a resource before it, too, whose payload is that whole record under another name.
    pack makes a record of a file: for compressed ones, a gzip member, as which the decoy then stands in the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode()
    none = ("X-Null: 1",) if html is None else ()
    decoy = _record("response", http, f"<urn:page:{'decoy' if page_id is None else -1 - page_id}>", url, "application/http; msgtype=response", none)
    yield _record("resource", pack(decoy), f"<urn:copy:{'' if page_id is None else page_id}>", url, "application/octet-stream")
    yield _record("response", http, f"<urn:page:{'' if page_id is None else page_id}>", url, "application/http; msgtype=response", none)


def write_warc(pages: DataFrame, uri: str, compress: bool | None = False) -> DataFrame:
    """(path, size) of new files under uri, one for each task with rows, with the records of pages (page_id, url, html).

    compress None: every other task's file is a .warc.gz. Nulls in page_id, url and html come back as nulls (control characters of a
    url as %XX); rows repeated or empty and texts of any length are written as they are, an empty table gives no file. Other columns
    of pages, whatever their names, don't matter.
    """
    spark = pages.sparkSession
    ship(spark)

    def write(batches):
        from pyspark import TaskContext

        fs, folder = filesystem(uri)
        fs.create_dir(folder, recursive=True)
        gz = TaskContext.get().partitionId() % 2 == 1 if compress is None else compress
        name = f"{uuid.uuid4().hex}.warc{'.gz' if gz else ''}"
        pack = (lambda r, level=6: gzip.compress(r, level, mtime=0)) if gz else (lambda r, level=6: r)
        rows = 0
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            out.write(pack(_record("warcinfo", b"format: WARC File Format 1.0\r\n", "<urn:info>", None, "application/warc-fields")))
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    rows += 1
                    decoy, response = page_records(*row, pack)
                    out.write(pack(decoy, 0) + pack(response))  # stored, so that the member in its payload lies open
        if not rows:
            fs.delete_file(f"{folder}/{name}")
            return
        size = fs.get_file_info(f"{folder}/{name}").size
        yield pa.RecordBatch.from_arrays([pa.array([f"{uri}/{name}"]), pa.array([size], pa.int64())], ["path", "size"])

    p = pages.select(column(pages, "page_id").cast("long").alias("page_id"), column(pages, "url").cast("string").alias("url"), column(pages, "html").cast("string").alias("html"))
    return table(p.mapInArrow(write, "path string, size long"), "warc-files")


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, url, html of the responses; null where the page had a null. No records give no rows; other columns don't matter."""
    r = records.filter("warc_type = 'response'")
    html = F.when(~F.map_contains_key("headers", "x-null"), F.decode("payload", "utf-8"))
    return r.select(F.regexp_extract("record_id", r"<urn:page:(-?\d*)>", 1).try_cast("long").alias("page_id"), F.col("uri").alias("url"), html.alias("html"))
