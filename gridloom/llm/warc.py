"""WARC archives with revisit records, and a global capture index merged from sorted runs.

Pages are written as records in gzip members, so that each can be read by its
offset.  Of records with equal payloads the one with the smallest id is a
response, and the others are revisits that refer to it.

The index is merged externally.  Reading an archive back gives its captures as a
run: a file in the shared folder, sorted by URL key, time and id, in blocks whose
first keys are the run's sparse index.  A merge task opens, in each of at most
``FAN_IN`` runs, the blocks of its key range and feeds a loser tree from readers
that hold one block each; more runs than that are merged in passes.  Ranges are
cut from the sparse indexes, so a pass has as many tasks as its rows ask for, and
the captures of one URL spread over tasks too.

Defined cases: a null html is an empty payload; a null url has the empty URL
key; a very long page makes a record, and so an archive, of its own length; rows
without an id are responses each, come first in their URL's history and nothing
refers to them; of repeated rows with one id all are the response's record if
that id is the smallest; ids whose time would leave years 1 to 9999 have the
first or last second, and the id orders them there; an empty table gives no
archive and an empty result.  Only the id, url and html columns are read, so
other columns can't clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.arrow import arrow_schema, file_system, make_dir, rows_of, text_or_empty, to_batch, write_file
from gridloom.operators.sorting import dense_positions
from gridloom.plans.durable import fresh_path, materialize

#: An archive is closed once it has so many compressed bytes.
ARCHIVE_BYTES = 32_000_000
#: Time of page 0; a page's capture follows by as many seconds as its id.
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)
#: Ids between which times are dates of years 1 to 9999.
FIRST_ID = -int((FIRST_CAPTURE - datetime(1, 1, 1, tzinfo=timezone.utc)).total_seconds())
LAST_ID = int((datetime(9999, 12, 31, 23, 59, 59, tzinfo=timezone.utc) - FIRST_CAPTURE).total_seconds())
#: Runs that one merge reads at once, captures in a block of a run, and captures that a merge task takes about.
FAN_IN, BLOCK_ROWS, RANGE_ROWS = 64, 1024, 25_000
#: A payload is hot if over one in so many of the repeated rows have it; there are fewer hot payloads than that.
HOT_PAYLOADS = 10_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "urlkey string, ts string, page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, archive string, offset bigint, length bigint"


def url_key(url: str | None) -> str:
    """The host's labels reversed, in lower case, the port unless it is the scheme's own, then path and query as they are."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    own = port in (None, {"http": 80, "https": 443}.get(parts.scheme))
    return f"{','.join(reversed(host.split('.')))}{'' if own else f':{port}'}){rest}"


def timestamp(page_id: int | None) -> str:
    """The capture time of a page, 14 digits."""
    t = FIRST_CAPTURE + timedelta(seconds=min(max(page_id or 0, FIRST_ID), LAST_ID))
    return f"{t.year:04d}{t:%m%d%H%M%S}"


def record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None) -> bytes:
    """A WARC record; ``original`` is the page that a revisit refers to."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: {0:.4}-{0[4]}{0[5]}-{0[6]}{0[7]}T{0[8]}{0[9]}:{0[10]}{0[11]}:{0[12]}{0[13]}Z".format(timestamp(page_id)),
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if original is not None:
        head += [f"WARC-Refers-To: {record_id(original)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """``offset, length, record`` of each gzip member."""
    view, at = memoryview(data), 0
    while at < len(data):
        z = zlib.decompressobj(31)
        out = z.decompress(view[at : at + 65_536])
        end = at + 65_536
        parts = [out]
        while not z.eof:
            if end >= len(data):
                raise ValueError(f"the archive ends within the record at {at}")
            parts.append(z.decompress(view[end : end + 262_144]))
            end += 262_144
        end = min(end, len(data)) - len(z.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def headers(lines: bytes) -> dict[str, str]:
    pairs = (x.split(": ", 1) for x in lines.decode().split("\r\n")[1:] if ": " in x)
    return {k.lower(): v for k, v in pairs}


def parse(raw: bytes) -> tuple:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of a record (payload None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(headers(http)["content-length"])
    kind = h["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != h["warc-payload-digest"][5:]):
        raise ValueError(f"payload of {h['warc-record-id']} is damaged")
    of = lambda x: None if x in (None, record_id(None)) else int(x[10:-1])
    return of(h["warc-record-id"]), h.get("warc-target-uri", ""), kind, of(h.get("warc-refers-to")), size, h["warc-payload-digest"][5:], payload if kind == "response" else None


def originals(df: DataFrame, id_col: str, html_col: str, least: int = 0) -> DataFrame:
    """Each row with ``original``, the page that it revisits, or null for a response.

    Digests are summed up to the least id before rows meet them.  Rows of hot
    payloads get theirs from a broadcast table of fewer than ``HOT_PAYLOADS``
    rows, and go to the other rows' join under keys of their own, so no key there
    has many rows.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col("_url").alias("url"), text_or_empty(html_col).alias("html")).withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    ids = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.unhex(F.sha1(F.encode(text_or_empty(html_col), "UTF-8"))).alias("sha"))
    repeated = materialize(ids.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "payloads")
    most = (repeated.agg(F.sum("n")).first()[0] or 0) // HOT_PAYLOADS
    hot = F.broadcast(repeated.filter(F.col("n") > most).filter(F.col("n") > 1000).select("sha", F.col("first").alias("hot")))
    met = rows.join(hot, "sha", "left")
    own = F.unhex(F.sha1(F.concat(F.col("url"), F.lit(" "), F.col("page_id").cast("string"))))
    keyed = met.withColumn("key", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit(b"hot"), F.coalesce(own, F.lit(b"")))))
    first = F.coalesce("hot", "first")
    revisit = F.when((F.col("page_id") > first) & (F.octet_length("html") >= least), first)
    return keyed.join(repeated.select(F.col("sha").alias("key"), "first"), "key", "left").select("page_id", "url", "html", revisit.alias("original"))


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; ``archive, records`` of each.  Payloads under ``least`` bytes are never revisits."""
    make_dir(folder)
    rows = originals(df.withColumn("_url", F.col(url_col)).select(id_col, "_url", html_col), id_col, html_col, least)

    def run(batches):
        import uuid

        schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])
        out, n = io.BytesIO(), 0

        def close():
            name = f"{uuid.uuid4().hex}.warc.gz"
            write_file(f"{folder}/{name}", out.getvalue())
            return to_batch([(name, n)], schema)

        for page_id, url, html, original in rows_of(batches):
            out.write(gzip.compress(record(page_id, url, html.encode(), original), 4, mtime=0))
            n += 1
            if out.tell() >= archive_bytes:
                yield close()
                out, n = io.BytesIO(), 0
        if n:
            yield close()

    return materialize(rows.mapInArrow(run, "archive string, records bigint"), "archives")


#: A file of a run: of which run it is and its place there, captures, the first key of each block, and the last key.
KEY = "struct<urlkey:string,ts:string,page_id:bigint>"
RUN_FILE = f"run string, seq bigint, file string, archive string, n bigint, blocks array<{KEY}>, last {KEY}"


def key_order(k: dict) -> tuple:
    """A key as a tuple in the order of Spark's, nulls first."""
    return k["urlkey"], k["ts"], k["page_id"] is not None, k["page_id"] or 0


def capture_order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def write_run(folder: str, name: str, rows: Iterator[tuple], schema: pa.Schema) -> tuple[int, list[dict], dict]:
    """Sorted captures as a run file: how many, each block's first key, and the last key.  One block is held at once."""
    system, path = file_system(folder)
    n, blocks, last, block = 0, [], None, []
    key = lambda row: dict(zip(("urlkey", "ts", "page_id"), row))
    with system.open_output_stream(f"{path}/{name}", compression=None) as out, pa.ipc.new_file(out, schema) as sink:
        while block := list(islice(rows, BLOCK_ROWS)):
            sink.write_batch(to_batch(block, schema))
            blocks.append(key(block[0]))
            n, last = n + len(block), key(block[-1])
    return n, blocks, last


def read_run(folder: str, files: list[dict], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The captures of a run from ``low`` to before ``high``: blocks are found by the sparse index and read one by one."""
    for f in sorted(files, key=lambda x: x["seq"]):
        system, path = file_system(f"{folder}/{f['file']}")
        starts = [key_order(k) for k in f["blocks"]]
        with system.open_input_file(path) as source:
            reader = pa.ipc.open_file(source)
            for k in range(max(0, bisect_left(starts, low) - 1) if low else 0, reader.num_record_batches):
                if high and starts[k] >= high:
                    return
                for row in rows_of([reader.get_batch(k)]):
                    at = capture_order(row)[:4]
                    if high and at >= high:
                        return
                    if not low or at >= low:
                        yield row


def capture_runs(spark: SparkSession, folder: str, archives: DataFrame, runs: str) -> DataFrame:
    """The captures of each archive, read back and written to folder ``runs`` as a run, sorted by URL key, time and id: rows of ``RUN_FILE``."""
    make_dir(runs)
    schema, target = arrow_schema(CAPTURE), arrow_schema(RUN_FILE)

    def run(batches):
        import uuid

        for batch in batches:
            for path, content in zip(*[c.to_pylist() for c in batch.columns]):
                archive, rows = path.rsplit("/", 1)[-1], []
                for offset, length, raw in members(content):
                    page_id, url, kind, refers, size, digest, _ = parse(raw)
                    rows.append((url_key(url), timestamp(page_id), page_id, kind, refers, size, digest, archive, offset, length))
                rows.sort(key=capture_order)
                name = f"{uuid.uuid4().hex}.run"
                n, blocks, last = write_run(runs, name, iter(rows), schema)
                yield to_batch([(name, 0, name, archive, n, blocks, last)], target)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    found = files.mapInArrow(run, RUN_FILE)
    # An attempt that was lost may have left an archive; only those of attempts that ended count.
    return materialize(found.join(archives.select("archive"), "archive", "left_semi").select("run", "seq", "file", "archive", "n", "blocks", "last"), "runs")


def merge_runs(runs: list, key=capture_order) -> Iterator[tuple]:
    """K-way merge of sorted iterables by a loser tree.

    Inner nodes hold the loser of the match between their subtrees' winners, so
    the next row takes one comparison a level on the path of the last winner.
    Only the first row of each run is held here.
    """
    k = len(runs)
    if not k:
        return
    sources, end = [iter(r) for r in runs], object()
    rows = [next(s, end) for s in sources]
    heads = [end if r is end else key(r) for r in rows]

    def beats(a: int, b: int) -> bool:
        if heads[a] is end or heads[b] is end:
            return heads[b] is end and (heads[a] is not end or a < b)
        return (heads[a], a) < (heads[b], b)

    losers = [0] * k
    winner_of = [0] * k + [*range(k)]
    for node in range(k - 1, 0, -1):
        a, b = winner_of[2 * node], winner_of[2 * node + 1]
        winner_of[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    winner = winner_of[1] if k > 1 else 0
    while heads[winner] is not end:
        yield rows[winner]
        row = rows[winner] = next(sources[winner], end)
        heads[winner] = end if row is end else key(row)
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def merge_tasks(files: DataFrame, range_rows: int) -> DataFrame:
    """``group, range, low, high, files`` of each merge: a group's key space cut in ranges of about ``range_rows`` captures.

    Ranges come from a sample of the blocks' first keys, about 16 a range; where
    a file's keys lie among them, from one sorted pass over cuts and files.
    """
    stride = max(1, range_rows // (16 * BLOCK_ROWS))
    ranges = F.ceil(F.sum("n").over(Window.partitionBy("group")) / range_rows)
    wide = files.select("*", ranges.cast("bigint").alias("ranges"))
    sampled = wide.select("group", "ranges", F.posexplode("blocks").alias("p", "key")).filter(F.col("p") % stride == 0)
    order = Window.partitionBy("group").orderBy("key")
    placed = sampled.select("group", "key", F.floor((F.row_number().over(order) - 1) * F.col("ranges") / F.count("*").over(Window.partitionBy("group"))).alias("r"))
    # A cut is where a range's sample begins; equal cuts are one.
    cuts = placed.groupBy("group", "r").agg(F.min("key").alias("key")).filter("r > 0").select("group", "key").distinct()
    ends = files.select("group", "run", "seq", "file", "blocks", F.get("blocks", F.lit(0)).alias("first"), "last")
    marks = cuts.select("group", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("file"))
    for kind, c in ((1, "first"), (2, "last")):
        marks = marks.union(ends.select("group", F.col(c).alias("key"), F.lit(kind), "file"))
    at = marks.select("*", F.sum((F.col("kind") == 0).cast("bigint")).over(Window.partitionBy("group").orderBy("key", "kind")).alias("range"))
    spans = at.filter("kind > 0").groupBy("group", "file").agg(F.min("range").alias("a"), F.max("range").alias("b"))
    parts = ends.join(spans, ["group", "file"]).select("group", F.explode(F.sequence("a", "b")).alias("range"), F.struct("run", "seq", "file", "blocks").alias("f"))
    listed = parts.groupBy("group", "range").agg(F.collect_list("f").alias("files"))  # FAN_IN runs with a few files each
    lows = at.filter("kind = 0").select("group", "range", F.col("key").alias("low"))
    highs = lows.select("group", (F.col("range") - 1).alias("range"), F.col("low").alias("high"))
    return listed.join(lows, ["group", "range"], "left").join(highs, ["group", "range"], "left").select("group", "range", "low", "high", "files")


def _merged(runs: str, low: dict | None, high: dict | None, files: list[dict]) -> Iterator[tuple]:
    """The captures of one range of several runs, in order."""
    by_run: dict[str, list[dict]] = {}
    for f in files:
        by_run.setdefault(f["run"], []).append(f)
    low, high = low and key_order(low), high and key_order(high)
    return merge_runs([read_run(runs, own, low, high) for _, own in sorted(by_run.items())])


def merge_index(files: DataFrame, runs: str, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in global order of URL key, time and id, over ascending partitions, from runs in folder ``runs``.

    While there are more than ``fan_in`` runs, groups of so many are merged to
    one each.  The last merge streams its ranges to the result.
    """
    if fan_in < 2:
        raise ValueError("a merge needs at least two runs")
    target, file_target = arrow_schema(CAPTURE), arrow_schema(RUN_FILE)

    def merge_to_files(batches):
        import uuid

        for group, at, low, high, parts in rows_of(batches):
            name = f"{uuid.uuid4().hex}.run"
            n, blocks, last = write_run(runs, name, _merged(runs, low, high, parts), target)
            if n:
                yield to_batch([(f"merged-{group:012d}", at, name, "", n, blocks, last)], file_target)

    def merge_to_rows(batches):
        for _, _, low, high, parts in rows_of(batches):
            rows = _merged(runs, low, high, parts)
            while out := list(islice(rows, 8 * BLOCK_ROWS)):
                yield to_batch(out, target)

    while files.select("run").distinct().count() > fan_in:
        numbered = dense_positions(files.select("run").distinct(), [F.col("run")]).select("run", F.floor(F.col("position") / fan_in).alias("group"))
        tasks = merge_tasks(files.join(numbered, "run"), range_rows)
        files = materialize(tasks.repartition("group", "range").mapInArrow(merge_to_files, RUN_FILE), "runs")
    tasks = materialize(merge_tasks(files.withColumn("group", F.lit(0).cast("bigint")), range_rows), "merges")
    return tasks.repartitionByRange(max(1, tasks.count()), "range").sortWithinPartitions("range").mapInArrow(merge_to_rows, CAPTURE)


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, folder: str | None = None, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives, read them back and merge their captures: columns of ``CAPTURE``."""
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "warc")
    archives = write(df, folder, id_col, url_col, html_col, least, archive_bytes)
    if archives.isEmpty():
        return spark.createDataFrame([], CAPTURE)
    runs = fresh_path(spark, "capture-runs")
    return merge_index(capture_runs(spark, folder, archives, runs), runs, fan_in, range_rows)


def read_record(folder: str, archive: str, offset: int, length: int) -> tuple:
    """One record by its place in the index, as :func:`parse` gives it."""
    system, path = file_system(f"{folder}/{archive}")
    with system.open_input_file(path) as f:
        f.seek(offset)
        return parse(gzip.decompress(f.read(length)))
