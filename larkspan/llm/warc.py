"""Operator 1: WARC archives with segmented records, written as files and reassembled on reading."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import scratch_path, table

#: Smallest payload for which a later equal record becomes a revisit.
REVISIT_BYTES = 1000
#: Characters of a chunk of the transfer coding, and of a record's content before it goes on in a
#: continuation. Both are cut between characters, so each piece is valid UTF-8.
CHUNK_CHARS, SEGMENT_CHARS = 4096, 16384
#: Records of one archive file: at most 64 KB each besides headers, so a file stays below 32 MB.
FILE_RECORDS = 500
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(text: str) -> str:
    """A text in chunked transfer framing: hexadecimal byte counts before pieces, a zero count at the end."""
    cut = [text[i : i + CHUNK_CHARS] for i in range(0, len(text), CHUNK_CHARS)]
    return "".join(f"{len(c.encode()):x}\r\n{c}\r\n" for c in cut) + "0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over. Raises on bad framing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].partition(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n
        if len(out[-1]) < n or body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk ends early")
        at += 2


def record(headers: dict[str, object], content: str) -> str:
    """One WARC record without the two line ends that close it; headers without a value are left out."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(content.encode())}\r\n\r\n{content}"


def records(name: str, url: str | None, html: str, digest: str, size: int, refers: str | None) -> Iterator[str]:
    """A page's records: a revisit, or a response and the continuations that hold the rest of its content."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    common = {"WARC-Date": DATE, "WARC-Target-URI": uri}
    own = {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": size}
    if refers is not None:
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": f"<{name}>"} | common | own | {"WARC-Refers-To": f"<{refers}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, "")
        return
    content = HTTP + chunked(html)
    cut = [content[i : i + SEGMENT_CHARS] for i in range(0, len(content), SEGMENT_CHARS)]
    for n, piece in enumerate(cut, 1):
        last = {"WARC-Segment-Total-Length": len(content.encode())} if n == len(cut) > 1 else {}
        if n == 1:
            yield record({"WARC-Type": "response", "WARC-Record-ID": f"<{name}>"} | common | own | ({"WARC-Segment-Number": 1} if len(cut) > 1 else {}), piece)
        else:
            yield record({"WARC-Type": "continuation", "WARC-Record-ID": f"<{name}/{n}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": n} | last, piece)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as gzipped WARC files of at most FILE_RECORDS records.

    Equal payloads of at least REVISIT_BYTES are grouped by digest and length (summed before they move; a
    group's row is dealt over 32 salts for the join, so one payload with a third of all pages has no task
    of its own): the largest page_id is the response, the others revisit it. Null html is an empty payload;
    pages that share the largest id are responses all; so are pages of a group without any id, and a page
    without an id revisits. Spark's text sink ends each record with the two line ends of the format.
    """
    salts = 32
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html").cast("long")})
    groups = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where(F.col("n") > 1)
    groups = groups.select("digest", "size", "top", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(groups, ["digest", "size", "salt"], "left")
    rows = rows.withColumn("revisits", F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, held = [], 0
            for page, url, html, digest, size, refers, row in zip(b["page"], b["url"], b["html"], b["digest"], b["size"], b["refers"], b["row"], strict=True):
                got = list(records(f"urn:page:{page}:{row}", url, html, digest, size, f"urn:page:{refers}" if refers else None))
                out += got
                held += sum(map(len, got))
                if held > 1 << 23:
                    yield pd.DataFrame({"value": out})
                    out, held = [], 0
            yield pd.DataFrame({"value": out})

    rows = rows.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), "url", "html", "digest", "size",
        F.when(F.col("revisits"), F.col("top").cast("string")).alias("refers"), "row",
    )
    rows.mapInPandas(run, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of each record of an archive, plain or gzipped as a whole or record by record."""
    if archive[:2] == b"\x1f\x8b":
        archive = gzip.decompress(archive)
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        content = archive[end + 4 : end + 4 + n]
        if len(content) < n or archive[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record ends early")
        yield headers, content
        at = end + 8 + n


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


PIECES = "origin string, number int, total long, type string, url string, refers string, digest string, size long, content binary, bytes long, sha1 string, intact boolean"


def decoded(content: bytes, digest: str | None) -> tuple[bytes | None, int | None, str | None, bool]:
    """(payload, its bytes, its SHA-1, whether framing and digest are right) of a whole response."""
    head, _, rest = content.partition(b"\r\n\r\n")
    try:
        payload = dechunked(rest) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else rest
    except ValueError:
        return None, None, None, False
    own = hashlib.sha1(payload).hexdigest()
    return payload, len(payload), own, digest is None or own == digest


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record that isn't a continuation: record_id, type, url, refers_to, payload_digest,
    payload_bytes, payload (binary; null for revisits and damaged records) and intact.

    Continuations are grouped with their origin by its id, ordered by segment number, joined, and held
    against the total length; then the transfer framing is decoded and the digest compared. A record with
    a missing, doubled or odd segment, wrong length, framing or digest has intact = false. One record's
    segments are gathered in a task, never those of several. Without payloads a response in one piece is
    decoded where it is read, and only its length and digest move. A very long payload takes memory in proportion
    to it where its record is; archives without records, and empty ones, give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["content"]:
                out = []
                for h, content in parse(archive):
                    if h.get("warc-type") not in ("response", "revisit", "continuation"):
                        continue
                    own = _bare(h.get("warc-segment-origin-id")) or _bare(h["warc-record-id"])
                    total = h.get("warc-segment-total-length")
                    size = h.get("x-payload-length")
                    digest = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    number = int(h.get("warc-segment-number", 0))
                    done = (None, None, None)
                    if not payloads and not number and h["warc-type"] == "response":
                        _, *done = decoded(content, digest)
                        content = None
                    out.append((own, number, int(total) if total else None, h["warc-type"], h.get("warc-target-uri"), _bare(h.get("warc-refers-to")), digest, int(size) if size else None, content, *done))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"number": "int32", "total": "Int64", "size": "Int64", "bytes": "Int64", "intact": "boolean"})

    pieces = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, PIECES)
    head = lambda c: F.max(F.when(F.col("type") != "continuation", F.col(c)))
    whole = pieces.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "content"))).alias("parts"),
        F.max("total").alias("total"),
        *[head(c).alias(c) for c in ("url", "refers", "digest", "size", "bytes", "sha1", "intact")],
        F.max(F.when(F.col("type") != "continuation", F.col("type"))).alias("type"),
    )
    numbers = F.transform("parts", lambda p: p["number"])
    single = (F.size("parts") == 1) & (F.col("parts")[0]["number"] == 0)
    complete = single | (numbers == F.sequence(F.lit(1), F.size("parts")))
    body = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["content"]))
    whole = whole.withColumn("content", F.when(complete & (F.col("type") == "response"), body))
    fits = F.col("total").isNull() & single | (F.octet_length("content") == F.col("total"))
    whole = whole.withColumn("content", F.when(fits, F.col("content"))).drop("parts", "total")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, digest, content, n, sha1, intact in zip(b["type"], b["digest"], b["content"], b["bytes"], b["sha1"], b["intact"], strict=True):
                if content is not None:
                    out.append(decoded(content, digest))
                elif sha1 is not None or kind == "revisit":
                    out.append((None, None if sha1 is None else int(n), sha1, kind == "revisit" or bool(intact)))
                else:
                    out.append((None, None, None, False))
            got = pd.DataFrame(out, columns=["payload", "bytes", "sha1", "intact"])
            revisit = (b["type"] == "revisit").to_numpy()
            yield pd.DataFrame(
                {
                    "record_id": b["origin"], "type": b["type"], "url": b["url"], "refers_to": b["refers"],
                    "payload_digest": got["sha1"].where(~revisit, b["digest"]), "payload_bytes": got["bytes"].astype("Int64").where(~revisit, b["size"].astype("Int64")),
                    "payload": got["payload"], "intact": got["intact"].astype(bool),
                }
            )

    return whole.where("type IS NOT NULL").mapInPandas(decode, "record_id string, type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary, intact boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    back = read_archives(spark, path, payloads=False).drop("payload")
    page = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) AS BIGINT)")
    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top AS revisit FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN top END AS refers_to
FROM r
"""
