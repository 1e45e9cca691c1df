"""Legacy archives: ARC files (versions 1 and 2) read by their declared lengths and turned into WARC 1.1 records.

A converted record gets an identifier derived from its page id (a version 8 UUID that holds the id, so that it can be
referred to before the other record is seen), a WARC-Date from the 14-digit ARC date, a type (response, resource, or revisit
where an equal payload is kept elsewhere) and SHA-1 digests of block and payload. An archive begins with a warcinfo record made
of the ARC file's version block. Archives hold some MOST bytes, and a page more at most.

Null html counts as empty, null url as urn:page:<id>; spaces and controls in a url are escaped. A null page id gets a version 5 UUID; it is never referred to unless
all ids of its payload are null, and then all are responses. Rows that repeat the smallest id of a payload are all
responses. Truncated or malformed archives raise ValueError. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import calendar
import hashlib
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The fields of an ARC header line, by version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "20240101000000"
#: Bytes of payload after which an archive is full.
MOST = 32 << 20
#: A group of equal payloads is met in as many parts as this; groups themselves are copied to each part.
SALTS = 32


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, url: str = "", digest: str = "") -> str:
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}>"
    n = page_id & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=0x8 << 76 | (n >> 62) << 64 | 0b10 << 62 | n & (1 << 62) - 1)}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if n >> 76 & 15 != 8:
        return None
    n = (n >> 64 & 3) << 62 | n & (1 << 62) - 1
    return n - (1 << 64) if n >> 63 else n


def arc_archive(records: list[tuple[str, str, str, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, date, content type, content). Fields hold no spaces."""
    # The version block has the date of the first record.
    opened = records[0][1] if records else EPOCH
    fields = " ".join({1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"), 2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")}[version])
    note = f"{version} 0 Kinweave\n{fields}\n".encode()

    def head(url, date, kind, size, at):
        middle = "" if version == 1 else f" 200 - - {at} {name}"
        return f"{url} 0.0.0.0 {date} {kind}{middle} {size}\n".encode()

    out = [head(f"filedesc://{name}", opened, "text/plain", len(note), 0) + note]
    at = len(out[0])
    for url, date, kind, content in records:
        out.append(b"\n" + head(url, date, kind, len(content), at) + content)
        at += len(out[-1])
    return b"".join(out)


def version_block(data: bytes) -> tuple[dict, int]:
    """name, date, version and note of an ARC file's first record, and where it ends."""
    stop = data.find(b"\n")
    opening = data[: max(stop, 0)].decode("utf-8", "surrogateescape").split(" ")
    if not opening[0].startswith("filedesc:") or not opening[-1].isdigit():
        raise ValueError("an ARC file begins with a filedesc record")
    end = stop + 1 + int(opening[-1])
    note = data[stop + 1 : end]
    version = int(note.split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version}")
    return {"name": opening[0].removeprefix("filedesc:").lstrip("/"), "date": opening[2], "version": version, "note": note}, end


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file after its version block: the fields of its version's header line, and content."""
    block, at = version_block(data)
    names = ARC_FIELDS[block["version"]]
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        values = data[at:end].decode("utf-8", "surrogateescape").split(" ")
        if end < 0 or len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"a broken ARC header line at byte {at}")
        n = int(values[-1])
        if end + 1 + n > len(data):
            raise ValueError(f"the record at byte {at} is shorter than it says")
        yield dict(zip(names, values, strict=True)) | {"content": data[end + 1 : end + 1 + n]}
        at = end + 1 + n


def http_parts(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields by lower-case name, the head as it is, and the body."""
    head, sep, body = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + sep, body


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def to_warcinfo(arc: bytes) -> bytes:
    """The warcinfo record of an ARC file, from its version block."""
    of, _ = version_block(arc)
    block = f"software: kinweave\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version {of['version']}\r\n".encode()
    seed = f"{of['name']} {of['date']} {hashlib.sha1(arc).hexdigest()}"
    return warc_record(
        [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>"),
            ("WARC-Date", warc_date(of["date"])),
            ("WARC-Filename", of["name"].removesuffix(".arc") + ".warc"),
            ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
            ("Content-Type", "application/warc-fields"),
        ],
        block,
    )


def to_warc(record: dict, page_id: int | None, first_id: int | None) -> bytes:
    """The WARC record of an ARC record. first_id: the page whose response has the same payload; page_id itself or null for none."""
    http = record["content"].startswith(b"HTTP/1.")
    _, head, body = http_parts(record["content"]) if http else ({}, b"", record["content"])
    digest = base32(hashlib.sha1(body).digest())
    again = first_id is not None and first_id != page_id
    block = head if again else head + body
    fields = [
        ("WARC-Type", "revisit" if again else "response" if http else "resource"),
        ("WARC-Record-ID", record_id(page_id, record["url"], digest)),
        ("WARC-Date", warc_date(record["date"])),
        ("WARC-Target-URI", record["url"]),
        ("WARC-IP-Address", record["ip"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response" if http else record["type"]),
    ]
    if again:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(first_id))]
    return warc_record(fields, block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by lower-case name and the block, of each record; lengths and block digests are checked."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4
        if len(block) < n or at > len(data):
            raise ValueError("a WARC record is shorter than it says")
        if (said := fields.get("warc-block-digest")) and said != f"sha1:{base32(hashlib.sha1(block).digest())}":
            raise ValueError("a block does not have its digest")
        yield fields, block


def first_ids(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, raw and first_id: the smallest id among the rows with the same payload, null if none has it too or it is under `least` bytes."""
    raw = common.text_bytes(payload_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("raw"), F.sha1(raw).alias("digest"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"))
    groups = pages.select(F.col(id_col).cast("long").alias("page_id"), raw.alias("raw")).where(F.octet_length("raw") >= least).groupBy(F.sha1("raw").alias("digest")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.join(groups, ["digest", "salt"], "left").select("page_id", "url", "raw", "first_id")


def arc_date(page_id: int | None) -> str:
    """A date for a page that comes without one: a second for each id, from EPOCH on, over some three years."""
    return time.strftime("%Y%m%d%H%M%S", time.gmtime(calendar.timegm(time.strptime(EPOCH, "%Y%m%d%H%M%S")) + (page_id or 0) % 100_000_000))


def warc_archives(pages: DataFrame, most: int = MOST) -> DataFrame:
    """archive (binary): ARC files of a batch of pages, of some `most` bytes each, converted. Pages as first_ids() gives them; versions alternate."""

    def make():
        turn = [0]

        def convert(records, ids, firsts):
            turn[0] += 1
            arc = arc_archive(records, turn[0] % 2 + 1)
            return b"".join([to_warcinfo(arc), *(to_warc(r, i, f) for r, i, f in zip(read_arc(arc), ids, firsts, strict=True))])

        def step(rows):
            out, held, size = [], [], 0
            for i, url, raw, first in zip(rows["page_id"], rows["url"], rows["raw"], rows["first_id"], strict=True):
                name = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{i}"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n".encode()
                held.append(((name, arc_date(i), "text/html", head + raw), i, first))
                size += len(raw)
                if size > most:
                    out.append(convert(*zip(*held, strict=True)))
                    held, size = [], 0
            if held:
                out.append(convert(*zip(*held, strict=True)))
            return {"archive": out}

        return step

    return common.map_rows(pages, make, "archive binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each response or revisit of WARC archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, warc_date."""

    def make():
        def step(rows):
            out: dict[str, list] = {n: [] for n in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "warc_date")}
            for data in rows["archive"]:
                for fields, block in read_warc(data):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    http, _, body = http_parts(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (int(http["content-length"]) != len(body) or base32(hashlib.sha1(body).digest()) != digest):
                        raise ValueError("a payload does not have its length or digest")
                    refers = fields.get("warc-refers-to")
                    row = (page_of(fields["warc-record-id"]), int(http["content-length"]), digest, fields["warc-type"], page_of(refers) if refers else None, fields["warc-target-uri"], fields["warc-date"])
                    for name, x in zip(out, row, strict=True):
                        out[name].append(x)
            return out

        return step

    return common.map_rows(archives, make, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string")


def op9_warc_convert(spark, sf_dir: str) -> DataFrame:
    """All pages as ARC, converted to WARC, written in the shared folder and read back."""
    archives = common.written(warc_archives(first_ids(common.table(spark, sf_dir, "pages"))), "warc")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_FIVE = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(dg, 5 * j + 1, 5) as bigint) >> {}) & 31 as integer) + 1, 1)"
OP9_SQL = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as dg from pages),
g as (select *, min(page_id) over (partition by dg) as first_id from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  list_aggregate(list_transform(range(8), lambda j: {" || ".join(_FIVE.format(s) for s in (15, 10, 5, 0))}), 'string_agg', '') as payload_digest,
  case when page_id is null or page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from g
"""
