"""WARC archives: written with one gzip member for each record, read back in sequence.

Equal payloads are stored once: of the pages that hold one, the smallest id is a response, the
others are revisits that name it and carry its digest and length. Archives are written by the tasks, each under a
name of its own attempt; the list of archives is a table that Spark commits, so what a lost or repeated
attempt left behind is never read.

The reader streams an archive: compressed bytes come in pieces, each member is inflated step by
step, a record's head is read up to its empty line and its block by Content-Length, and the digests of
block and payload are computed and compared as the bytes pass. Only one record is held at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import whole_text
from reportlake.session import scratch, stage

END = b"\r\n\r\n"
PIECE = 1 << 20
ARCHIVE = 64 << 20  # an archive is closed when it holds so many bytes
BATCH = 16 << 20  # payload bytes that leave the reader at a time
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def head_line(value: str) -> str:
    """Control characters would break the head apart, so they are written in percent form."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record as a gzip member."""
    digest = base32_sha1(hashlib.sha1(payload).digest())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    kind = "response" if refers_to is None else "revisit"
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {head_line(url)}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).digest())}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8") + END + block + END) + packer.flush()


class Member:
    """The inflated bytes of one gzip member, as much as is asked for."""

    def __init__(self, more: Callable[[], bytes], raw: bytes):
        self.more, self.raw, self.out = more, raw, b""
        self.inflate = zlib.decompressobj(31)

    def pull(self) -> bool:
        """Inflate a little more; false at the member's end."""
        if self.inflate.eof:
            return False
        raw = self.inflate.unconsumed_tail or self.raw
        self.raw = b""
        if not raw:
            raw = self.more()
            if not raw:
                raise OSError("archive ends inside a record")
        self.out += self.inflate.decompress(raw, PIECE)
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if not self.pull():
                raise OSError("record head has no end")
        found, self.out = self.out[:at], self.out[at + len(mark) :]
        return found

    def pieces(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.out and not self.pull():
                raise OSError("record is shorter than its Content-Length")
            piece, self.out = self.out[:size], self.out[size:]
            size -= len(piece)
            yield piece


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])} | {"": lines[0]}


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def records(more: Callable[[], bytes]) -> Iterator[dict]:
    """Records of one archive, from a function that returns its next bytes and nothing at the end.

    Raises OSError where a member, a frame or a digest is wrong.
    """
    rest = more()
    while rest:
        member = Member(more, rest)
        head = fields(member.until(END))
        if head[""] != "WARC/1.1":
            raise OSError(f"not a record: {head['']!r}")
        whole, payload, parts = hashlib.sha1(), hashlib.sha1(), []
        inner = b""
        http = None
        for piece in member.pieces(int(head["content-length"])):
            whole.update(piece)
            if http is None:
                inner += piece
                if END not in inner:
                    continue
                first, _, piece = inner.partition(END)
                http = fields(first)
            payload.update(piece)
            parts.append(piece)
        while member.pull():
            pass
        if member.out != END:
            raise OSError("a member must hold one record and its end")
        rest = member.inflate.unused_data or more()
        if head["warc-block-digest"] != f"sha1:{base32_sha1(whole.digest())}" or http is None:
            raise OSError(f"block digest of {head['warc-record-id']} is wrong")
        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
        size = int(http["content-length"])
        body = b"".join(parts)
        if kind == "response" and (digest != base32_sha1(payload.digest()) or size != len(body)):
            raise OSError(f"payload digest of {head['warc-record-id']} is wrong")
        yield {
            "page_id": page_of(head["warc-record-id"]),
            "url": head.get("warc-target-uri"),
            "payload_bytes": size,
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": page_of(head.get("warc-refers-to")),
            "payload": body if kind == "response" else None,
        }


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to). Equal payloads are found by SHA-256 and byte length.

    Null html is an empty payload. Rows that repeat the smallest id of a payload are all
    responses; a page without an id revisits a payload that a page with an id holds, and is a
    response otherwise.
    """
    payload = whole_text("html")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.sha2(payload, 256).alias("content"))
    firsts = rows.groupBy("content").agg(F.min("page_id").alias("first"))
    joined = rows.join(firsts.hint("shuffle_hash"), "content")
    again = (F.octet_length("payload") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write ``pages`` below ``folder``, which all executors reach; (path, records, bytes) of the archives.

    The list is a written table, so reading it does not write again. No pages, no archives.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(folder)
        out, path, count, size = None, "", 0, 0
        for batch in batches:
            for page, url, text, first in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"], strict=True):
                if out is None:
                    files.create_dir(base, recursive=True)
                    path = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
                    out, count, size = files.open_output_stream(path, compression=None), 0, 0
                packed = record(None if pd.isna(page) else int(page), url, text.encode("utf-8"), None if pd.isna(first) else int(first))
                out.write(packed)
                count, size = count + 1, size + len(packed)
                if size >= archive_bytes:
                    out.close()
                    yield pd.DataFrame([(path, count, size)], columns=["path", "records", "bytes"])
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame([(path, count, size)], columns=["path", "records", "bytes"])

    plan = planned(pages, least_bytes).select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))
    return stage(plan.mapInPandas(run, "path string, records long, bytes long"), "archives")


ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the listed archives (column ``path``), one task for each archive."""
    names = [part.split()[0] for part in ROW.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = fs.FileSystem.from_uri(folder)
        rows, size = [], 0
        for batch in batches:
            for path in batch["path"]:
                with files.open_input_stream(path, compression=None) as stream:
                    for found in records(lambda stream=stream: stream.read(PIECE)):
                        if not payloads:
                            found["payload"] = None
                        rows.append(found)
                        size += len(found["payload"] or b"") + 256
                        if size >= BATCH:
                            yield typed(rows)
                            rows, size = [], 0
        if rows:
            yield typed(rows)

    def typed(rows: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=names)
        return frame.astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})

    return archives.select("path").repartition(max(1, archives.count()), "path").mapInPandas(run, ROW)


def archived(pages: DataFrame, least_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Write the pages as archives below the shared folder and read these back."""
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes), folder, payloads)


def oracle() -> str:
    """DuckDB SQL; base 32 takes 40 bits of the digest at a time."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    char = f"substr('{letters}', CAST(1 + ((CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS BIGINT), 1)"
    return (
        "WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),"
        " f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)"
        f" SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: {char}), '') AS payload_digest,"
        " CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,"
        " CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"
    )
