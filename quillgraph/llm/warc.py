"""WARC archives of pages, and a normaliser for archives that were gzipped as one stream.

Archives are written as monolithic gzip files. The normaliser inflates each such stream once, from front to back, writes
every record again as a gzip member of its own, and keeps a sidecar index with each record's offset and length, so that records can be
read one by one. All files go to the shared folder; each task names the ones it finished, and only these are read, so a task that is
run again after an executor was lost does no harm.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.files import new_folder, opened
from quillgraph.llm.tables import table
from quillgraph.plans.cut import cut

#: Payloads from this size on are looked up among their equals.
REVISIT_BYTES = 1000
#: Record bytes after which a task begins another archive.
ROLL_BYTES = 32_000_000
GZIP, LEVEL, CHUNK = 31, 1, 1 << 20
DATE = "2026-01-01T00:00:00Z"
PAGE = "urn:x-page:"
#: Duplicate groups up to which the table of their responses, at most 100 bytes a row, is broadcast.
BROADCAST_GROUPS = 80_000


def _name(page_id: int | None) -> str:
    return f"<{PAGE}{'' if page_id is None else page_id}>"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, n: int) -> bytes:
    """A response record with its payload, or a revisit record without; both carry the whole payload's digest and length `n`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def records_of(stream) -> Iterator[bytes]:
    """The records of a gzip stream of one or more members, whole, in order. Raises ValueError if it ends within one."""
    held = bytearray()
    for chunk in _inflated(stream):
        held += chunk
        begin = 0
        while (at := held.find(b"\r\n\r\n", begin)) >= 0:
            m = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", held[begin:at], re.I)
            if not m:
                raise ValueError("a record has no length")
            end = at + 8 + int(m[1])
            if end > len(held):
                break
            yield bytes(held[begin:end])
            begin = end
        del held[:begin]
    if held:
        raise ValueError("the stream ends within a record")


def _inflated(stream) -> Iterator[bytes]:
    d, open_ = zlib.decompressobj(GZIP), False
    while raw := stream.read(CHUNK):
        while raw:
            open_ = True
            if out := d.decompress(raw, 4 * CHUNK):
                yield out
            raw = d.unconsumed_tail
            if d.eof:
                raw, d, open_ = d.unused_data, zlib.decompressobj(GZIP), False
    if open_:
        raise ValueError("the gzip stream is cut off")


def _write(folder: str, roll: int):
    """Monolithic archives, a row for each that is finished."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        me = TaskContext.get()
        out = None
        done: list[str] = []
        size = 0

        def close():
            out.write(z.flush())
            out.close()

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit", "n")), strict=True):
                if out is None:
                    name = f"{me.partitionId()}-{me.taskAttemptId()}-{len(done)}.warc.gz"
                    out, z, size = system.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=GZIP), 0
                    done.append(f"{folder}/{name}")
                page_id, url, html, digest, refers_to, revisit, n = r
                raw = record(page_id, url, html or b"", digest, refers_to, revisit, n)
                out.write(z.compress(raw))
                size += len(raw)
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["archive"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes a record for each row and returns (archive), the URIs of the monolithic files.

    Of records with equal payloads of at least `revisit_bytes`, those with the largest id are responses, and the others revisit
    it (rows that repeat that id are responses too; null ids are never the largest). A null html is an empty payload.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))
    p = p.withColumn("digest", F.sha1("html"))
    big = F.octet_length("html") >= revisit_bytes
    groups = p.where(big).groupBy(F.col("digest").alias("_d")).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = cut(groups)
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    p = p.join(groups, (F.col("digest") == F.col("_d")) & big, "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    p = p.select("page_id", "url", F.when(revisit, F.lit(b"").cast("binary")).otherwise(F.col("html")).alias("html"), "digest", "refers_to", revisit.alias("revisit"), F.octet_length("html").alias("n"))
    return cut(p.mapInArrow(_write(folder, roll), "archive string"))


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        me = TaskContext.get().taskAttemptId()
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                name = f"{uri.rpartition('/')[2].removesuffix('.warc.gz')}-{me}"
                store, path = opened(uri)
                offset, n = 0, 0
                with store.open_input_stream(path, compression=None) as raw, system.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out, system.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                    for rec in records_of(raw):
                        z = zlib.compressobj(LEVEL, wbits=GZIP)
                        member = z.compress(rec) + z.flush()
                        out.write(member)
                        fields, _ = parse(rec)
                        index.write(f"{offset}\t{len(member)}\t{fields['warc-type']}\t{fields['warc-record-id']}\t{fields['warc-target-uri']}\n".encode("utf-8", "surrogatepass"))
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}.warc.gz"], "index": [f"{folder}/{name}.idx"], "records": [n]})

    return run


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, index, records): for each gzip file of `archives.archive`, the same records a member each, and their index.

    An index line has offset, length, type, record id and target URI, with tabs between. Files with any number of members are read. A file that
    ends within a record or a member raises ValueError.
    """
    return cut(archives.mapInArrow(_normalise(folder), "archive string, index string, records long"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda name: int(name[1:-1].removeprefix(PAGE)) if name and name != _name(None) else None
    for batch in batches:
        for uri, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
            store, path = opened(uri)
            of_index, at = opened(index)
            with of_index.open_input_stream(at, compression=None) as f:
                lines = f.read().decode("utf-8", "surrogatepass").split("\n")[:-1]
            rows: list[tuple] = []
            with store.open_input_file(path) as f:
                for line in lines:
                    offset, length = map(int, line.split("\t")[:2])
                    fields, block = parse(zlib.decompress(f.read_at(length, offset), GZIP))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    n = int(re.search(rb"content-length:[ \t]*(\d+)", http, re.I)[1])
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{uri}: the payload at {offset} is damaged")
                    rows.append((number(fields["warc-record-id"]), n, digest, fields["warc-type"], number(fields.get("warc-refers-to"))))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)


ROW = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), ROW.values(), strict=True)], names=list(ROW))


def read_archives(normalised: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, read at its offset, its payload's digest checked."""
    return normalised.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll: int = ROLL_BYTES) -> DataFrame:
    """Writes `pages` as archives, normalises them, and reads every record back. Repeated rows are records of their own; an empty table gives none."""
    written = write_archives(pages, f"{folder}/whole", id_col, url_col, html_col, roll)
    return read_archives(normalise(written, f"{folder}/records"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an archived record, read back. A null html is an empty payload."""
    return archive_pages(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))


QUERIES = {"op7_warc": op7_warc}
ORACLES = {
    "op7_warc": f"""
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
d as (select page_id, n, sha1(h) as digest from p),
g as (select digest, max(page_id) as first from d where n >= {REVISIT_BYTES} group by digest having count(*) > 1)
select page_id, n as payload_bytes, d.digest as payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to
from d left join g on d.digest = g.digest and n >= {REVISIT_BYTES}"""
}
