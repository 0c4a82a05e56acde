"""WARC derivatives: responses become linked metadata and plain-text conversion records."""

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


VERSION = "WARC/1.1"
#: Rows of a batch of derived records.
BATCH = 256

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCKS = (
    "p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|main|title|blockquote|pre|hr|aside|form|dd|dt"
)
_BREAK = re.compile(rf"</?(?:{_BLOCKS})\b[^<>]*>", re.I)
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>|<![^<>]*>")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9._:-]+)", re.I)
#: Bytes of a page in which it may declare its own charset.
_DECLARED = 1024
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def plain_text(page: str) -> str:
    """The visible text of an HTML page: scripts, styles and comments dropped, block tags as line breaks, entities
    resolved, white space squeezed. Linear in the page: no pattern looks past the next tag or closing mark."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("\n", page)))
    return _LINES.sub("\n", _BLANK.sub(" ", html.unescape(text))).strip()


def decoded(body: bytes, content_type: str | None) -> str:
    """The body as text, by the charset of the content type or else the one that the page declares at its start; UTF-8
    without either or with one unknown. Bytes that the charset has no character for become U+FFFD."""
    named = _CHARSET.search(content_type or "") or _CHARSET.search(body[:_DECLARED].decode("latin-1"))
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """A urn:uuid that the parts decide, so a task that runs twice names its records alike."""
    name = chr(0).join(parts).encode("utf-8", "surrogatepass")
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(name).digest(), version=4)}>"


def _one_line(value: str) -> str:
    """A header's value, line breaks in it folded to blanks."""
    return re.sub(r"\s*[\r\n]+\s*", " ", value).strip()


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record; headers carry Content-Length."""
    lines = [VERSION, *(f"{k}: {_one_line(v)}" for k, v in headers)]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The records of a file of plain or gzip members, as (headers, block)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *rest = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in rest)]
        length = int(next(v for k, v in headers if k.lower() == "content-length"))
        out.append((headers, data[end + 4 : end + 4 + length]))
        at = end + 4 + length + 4
    return out


_SCHEMA = pa.schema([
    ("source_id", pa.string()), ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
    ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("refers_to_date", pa.string()),
    ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()),
    ("source_payload_digest", pa.string()), ("source_headers", pa.string()), ("block", pa.binary()),
])
_TYPES = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
_DDL = ", ".join(f"{f.name} {_TYPES[f.type]}" for f in _SCHEMA)


def derive(source_id: str | None, response_id: str, uri: str | None, date: str | None, headers: dict[str, str], body: bytes) -> list[dict]:
    """The metadata and the conversion record of one response. The metadata name the conversion in their fields."""
    payload_digest = digest(body)
    kind_of = {k.lower(): v for k, v in headers.items()}.get("content-type")
    text = plain_text(decoded(body, kind_of)).encode("utf-8", "surrogatepass")
    ids = {kind: record_id(kind, response_id) for kind in ("metadata", "conversion")}
    fields = [
        ("source-payload-digest", payload_digest), ("source-payload-length", str(len(body))), ("text-length", str(len(text))),
        ("conversion-record-id", ids["conversion"]), *[("source-header", f"{k}: {v}") for k, v in sorted(headers.items())],
    ]
    about = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    common = {
        "source_id": source_id, "refers_to": response_id, "target_uri": uri, "warc_date": date, "refers_to_date": date,
        "source_payload_digest": payload_digest, "source_headers": json.dumps(headers, sort_keys=True, ensure_ascii=False),
    }
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text)):
        # The standard has concurrency for records of one capture, not for conversions.
        concurrent = response_id if kind == "metadata" else None
        own = {"warc_type": kind, "record_id": ids[kind], "concurrent_to": concurrent, "content_type": content_type}
        out.append(common | own | {"content_length": len(block), "block_digest": digest(block), "block": block})
    return out


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            rows = batch.slice(at, BATCH).to_pylist()
            found = []
            for r in rows:
                headers = {k: v if v is not None else "" for k, v in (r["headers"] or [])}
                body = r["payload"] or b""
                rid = r["response_id"] or record_id("response", r["uri"] or "", r["date"] or "", hashlib.sha1(body).hexdigest())
                found += derive(r["source_id"], rid, r["uri"], r["date"], headers, body)
            yield pa.RecordBatch.from_pylist(found, schema=_SCHEMA)


def derivatives(
    responses: DataFrame, *, source_id: Column, uri: Column, date: Column, headers: Column, payload: Column, response_id: Column | None = None
) -> DataFrame:
    """Two records for each response: `metadata` (application/warc-fields with the source's headers and digests) and
    `conversion` (its plain text). Both refer to the response's record id and date and carry its headers and payload
    digest; the metadata are concurrent to the response and name the conversion. Columns: source_id, warc_type,
    record_id, refers_to, concurrent_to, target_uri, warc_date, refers_to_date, content_type, content_length,
    block_digest, source_payload_digest, source_headers (JSON), block (bytes).

    The payload is bytes, or text that stands for its UTF-8 bytes: digests are of these bytes, and text is what their
    charset makes of them (see decoded). Rows are handled by themselves, without a shuffle, and other columns are
    ignored. Null payload is an empty body; null headers are none; line breaks in a header's value are blanks in
    written records. A null uri or date stays null (and is left out of written records). Without a response_id one is
    made of uri, date and payload. Repeated rows give repeated records with equal ids; an empty table gives none."""
    given = F.lit(None) if response_id is None else response_id
    slim = responses.select(
        source_id.cast("string").alias("source_id"), given.cast("string").alias("response_id"), uri.cast("string").alias("uri"),
        date.cast("string").alias("date"), headers.cast("map<string,string>").alias("headers"), payload.cast("binary").alias("payload"),
    )
    return slim.mapInArrow(_build, _DDL)


_NAMES = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To",
    "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "refers_to_date": "WARC-Refers-To-Date",
    "content_type": "Content-Type", "block_digest": "WARC-Block-Digest",
    "source_payload_digest": "WARC-Source-Payload-Digest", "content_length": "Content-Length",
}


def to_bytes(records: DataFrame) -> DataFrame:
    """records as (record_id, warc): one gzip member each, so that members written one after the other are a file."""

    @F.pandas_udf("binary")
    def member(rows: pd.DataFrame) -> pd.Series:
        out = [gzip.compress(serialize([(_NAMES[k], str(r[k])) for k in _NAMES if r[k] is not None], r["block"]), mtime=0) for r in rows.to_dict("records")]
        return pd.Series(out, dtype=object)

    return records.select("record_id", member(F.struct(*_NAMES, "block")).alias("warc"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no capture headers: each is taken as a 200 response in HTML, dealt over a year by its id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    headers = F.create_map(
        F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.octet_length("html").cast("string"),
        F.lit("X-Page-Id"), F.col("page_id").cast("string"),
    )
    out = derivatives(
        pages, source_id=F.col("page_id"), uri=F.col("url"), date=F.concat(day.cast("string"), F.lit("T00:00:00Z")), headers=headers, payload=F.col("html")
    )
    return out.select(
        F.col("source_id").cast("long").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type",
        "content_length", "block_digest", "source_payload_digest", F.length(F.decode("block", "utf-8")).cast("long").alias("n_chars"),
    )
