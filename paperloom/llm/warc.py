"""Deterministic sharded WARC writer, and a reader.

Records are sorted by page_id (nulls first) and, within one page_id, by a hash of the payload (of payload and url, where
there is no page_id) into shards. Their bounds share out the bytes of a sample, the keys of least hash, so that neither
partitioning nor cluster size changes them, and rows that share a page_id, or have none, spread as well. There are at most
SAMPLE / 4 shards, which grow with the table from then on. A shard is one task's output; it rolls to a new file once ROLL_BYTES of
compressed records are in it. Each record is a gzip member of its own with headers and digests made anew. A task
writes under temporary names of its attempt and returns its files; that list is written as a table, which holds
the files of successful attempts alone; a second job renames them, which may be repeated, and writes the manifest. A
reader takes the files of the manifest and no others.

Of records with equal payloads of LEAST_REVISIT bytes or more, that with the smallest page_id is a response and the
others revisit it; smaller ones are all responses. Rows of one page_id, payload and url are told apart by a number.

Defined cases: null html is an empty payload; a null url leaves its header out; rows with a null page_id are responses;
of repeated rows (same page_id and payload) one is the response; an empty table gives an empty archive; other columns are
not written.
"""

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from paperloom.llm.store import bounded, new_folder, saved

SHARD_BYTES, ROLL_BYTES, LEAST_REVISIT, SAMPLE = 16 << 20, 4 << 20, 100, 40_000
#: Bytes of a record's headers, about; the number that stands for a null page_id.
OVERHEAD, LEAST = 600, np.iinfo(np.int64).min
DATE, LEVEL = "2024-01-01T00:00:00Z", 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, temporary string, name string, bytes long, sha256 string, records long"


def record_id(page_id, digest: str, nth: int) -> str:
    """From page_id (or what stands for it), payload and the number of the row among those alike."""
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}|{digest}|{nth}'.encode()).hexdigest()[:32], version=5)}>"


def header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def safe_url(url: str) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record(page_id, url, payload: bytes, digest: str, refers, nth: int) -> bytes:
    """One WARC record; refers: the page_id whose response this one revisits, or None."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers is not None else head + payload
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(f"{url}" if page_id is None else page_id, digest, nth)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", safe_url(url)))
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers, digest, 0)), ("X-Refers-To-Page", str(refers))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    return header([*fields, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


class _File:
    def __init__(self, root: str, shard: int, seq: int, attempt: str):
        self.fs, path = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(f"{path}/_temporary", recursive=True)
        self.row = {"shard": shard, "seq": seq, "temporary": f"_temporary/{shard:06d}-{seq:05d}-{attempt}", "name": f"part-{shard:06d}-{seq:05d}.warc.gz"}
        self.out, self.sha, self.bytes, self.records = self.fs.open_output_stream(f"{path}/{self.row['temporary']}"), hashlib.sha256(), 0, 0
        self.add(header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", self.row["name"], 0)), ("WARC-Date", DATE), ("WARC-Filename", self.row["name"]), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")]) + b"\r\n\r\n")

    def add(self, data: bytes):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        data = z.compress(data) + z.flush()
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        return self.row | {"bytes": self.bytes, "sha256": self.sha.hexdigest(), "records": self.records - 1}


def _write(root: str, roll: int):
    def run(batches):
        attempt, file, done, mark, last, nth = uuid.uuid4().hex, None, [], None, None, 0
        for batch in batches:
            for shard, page_id, kind, url, html, digest, refers in zip(*(batch.column(c) for c in ("_shard", "page_id", "_kind", "url", "html", "_digest", "_refers")), strict=True):
                shard, page_id, digest = shard.as_py(), page_id.as_py(), digest.as_py()
                if kind.as_py() == 0:  # told before the pages it is about
                    mark = (page_id, digest, refers.as_py())
                    continue
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                u = url.as_py()
                this = (page_id, digest, u if page_id is None else None)
                nth, last, to = nth + 1 if last == this else 0, this, None
                if mark and mark[:2] == this[:2]:
                    to = mark[2]
                elif nth and page_id is not None and len(payload) >= LEAST_REVISIT:
                    to = page_id
                if file is None or file.row["shard"] != shard or file.bytes >= roll:
                    seq = 0 if file is None or file.row["shard"] != shard else file.row["seq"] + 1
                    if file:
                        done.append(file.close())
                    file = _File(root, shard, seq, attempt)
                file.add(record(page_id, u, payload, digest, to, nth))
        if file:
            done.append(file.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("records", pa.int64())]))

    return run


def _commit(root: str):
    def run(batches):
        fs, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for r in batch.to_pylist():
                if fs.get_file_info(f"{path}/{r['name']}").type == pafs.FileType.NotFound:
                    fs.move(f"{path}/{r['temporary']}", f"{path}/{r['name']}")
            yield batch

    return run


def _bounds(light: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """page_id and hash at which the second and later shards begin: even shares of the bytes of a sample of keys."""
    keys = light.groupBy("page_id", "_hash").agg(F.sum(F.col("bytes") + OVERHEAD).alias("bytes"))
    some = keys.orderBy(F.xxhash64("page_id", "_hash"), "page_id", "_hash").limit(SAMPLE).collect()
    some = sorted((LEAST if r["page_id"] is None else r["page_id"], r["_hash"], r["bytes"]) for r in some)
    upto = np.cumsum([r[2] for r in some])
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards))
    return np.array([some[i][0] for i in at], np.int64), np.array([some[i][1] for i in at], np.int64)


def write_archive(pages: DataFrame, root: str | None = None, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> str:
    """pages (page_id, url, html) -> the URI of a folder with WARC files and, as `manifest`, the table of them."""
    spark = pages.sparkSession
    root = root or new_folder(spark, "warc")
    html = F.col("html").cast("string")
    digest = F.sha2(F.coalesce(html, F.lit("")), 256)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    spread = lambda of: F.xxhash64(of, F.when(F.col("page_id").isNull(), F.col("url"))).alias("_hash")
    light = saved(pages.select("page_id", spread(digest), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("bytes"), digest.alias("_digest")), "payloads")
    total = light.agg(F.sum("bytes")).first()[0] or 0
    shards = int(min(max(1, -(-total // shard_bytes)), SAMPLE // 4))
    page, mark = _bounds(light, shards) if shards > 1 else (np.zeros(0, np.int64),) * 2

    @F.arrow_udf(IntegerType())
    def shard(page_id: pa.Array, hashed: pa.Array) -> pa.Array:
        p, h = page_id.fill_null(LEAST).to_numpy(zero_copy_only=False), hashed.to_numpy(zero_copy_only=False)
        out, until = np.searchsorted(page, p, "left"), np.searchsorted(page, p, "right")
        on = np.flatnonzero(until > out)  # at a page_id that has bounds, the hash decides
        for one in np.unique(p[on]):
            rows = on[p[on] == one]
            lo, hi = out[rows[0]], until[rows[0]]
            out[rows] = lo + np.searchsorted(mark[lo:hi], h[rows], "right")
        return pa.array(out.astype(np.int32))

    large = light.where(F.col("page_id").isNotNull() & (F.col("bytes") >= LEAST_REVISIT))
    first = saved(large.groupBy("_digest").agg(F.min("page_id").alias("_refers"), F.max("page_id").alias("_last")).where("_refers <> _last").drop("_last"), "responses")
    told = large.join(bounded(first), "_digest").where("page_id <> _refers").select("page_id", "_hash", "_digest", "_refers").distinct()
    text = F.lit(None).cast("string")
    rows = told.select("page_id", "_hash", F.lit(0).alias("_kind"), text.alias("url"), text.alias("html"), "_digest", "_refers").unionByName(
        pages.select("page_id", spread(digest), F.lit(1).alias("_kind"), "url", "html", digest.alias("_digest"), F.lit(None).cast("long").alias("_refers"))
    )
    rows = rows.withColumn("_shard", shard("page_id", "_hash")).repartitionById(shards, F.col("_shard")).sortWithinPartitions("_shard", "page_id", "_hash", "_digest", "_kind", "url")
    rows.mapInArrow(_write(root, roll_bytes), MANIFEST).write.parquet(f"{root}/_written")
    written = spark.read.schema(MANIFEST).parquet(f"{root}/_written")
    written.mapInArrow(_commit(root), MANIFEST).write.parquet(f"{root}/manifest")
    fs, path = pafs.FileSystem.from_uri(root)
    if fs.get_file_info(f"{path}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{path}/_temporary")
    return root


def records(stream):
    """(headers, block) of each record of a gzip-member stream, however its reads fall."""
    parts, rest, z = [], b"", zlib.decompressobj(31)
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            break
        rest = b""
        parts.append(z.decompress(data))
        if z.eof:  # a member is a record
            raw, rest, z = b"".join(parts), z.unused_data, zlib.decompressobj(31)
            head, _, body = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            if len(body) != size + 4 or body[size:] != b"\r\n\r\n":
                raise ValueError(f"record {fields.get('WARC-Record-ID')} is broken")
            yield fields, body[:size]
            parts = []
    if any(parts):
        raise ValueError("the last record is not whole")


def _read(root: str):
    def run(batches):
        fs, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for f in batch.to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{f['name']}", compression=None) as stream:
                    for fields, block in records(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        payload, digest = block.partition(b"\r\n\r\n")[2], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                            raise ValueError(f"block digest of {fields['WARC-Record-ID']} in {f['name']}")
                        kind = fields["WARC-Type"]
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']} in {f['name']}")
                        page, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                        rows.append({"page_id": page and int(page), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": to and int(to), "url": fields.get("WARC-Target-URI")})
                if len(rows) != f["records"]:
                    raise ValueError(f"{f['name']} has {len(rows)} records, its manifest {f['records']}")
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]))

    return run


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """A row for each response and revisit in an archive, its digests checked."""
    files = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    many = min(max(1, files.count()), SAMPLE // 4)
    return files.repartition(many, "name").mapInArrow(_read(root), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame) -> DataFrame:
    return read_archive(pages.sparkSession, write_archive(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
