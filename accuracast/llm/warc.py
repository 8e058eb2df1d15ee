"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accuracast.llm.html_text import parse
from accuracast.llm.textarrays import slices

NAMESPACE = uuid.UUID("5a1c9f52-3a7e-5d53-8f0e-0c6b7f3f9a11")
END = "\r\n"
COLUMNS = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length bigint, block_digest string, payload_digest string, headers string, content string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_BREAKS = set("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
_UNSEEN = {"script", "style", "head", "title", "template", "noscript"}
_LINK = re.compile(r"""<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_LANG = re.compile(r"""<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)


def digest(data: bytes) -> str:
    """Labelled digest as archives write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same parts give the same identifier, so a repeated task writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def _record(kind: str, identifier: str, refers: str | None, uri: str, date: str, content_type: str, content: str, payload: str | None, more: list[tuple[str, str]]) -> tuple:
    body = content.encode()
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", identifier), ("WARC-Target-URI", uri), *([("WARC-Date", date)] if date else []), *([("WARC-Refers-To", refers)] if refers else []), *more,
        ("WARC-Block-Digest", digest(body)), *([("WARC-Payload-Digest", payload)] if payload else []), ("Content-Type", content_type), ("Content-Length", str(len(body))),
    ]
    return kind, identifier, refers, uri, date, content_type, len(body), digest(body), payload, END.join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields)]), content


def response(key: str, uri: str, page: str, date: str) -> tuple:
    """A response record of a page with the HTTP headers under which it is kept."""
    uri, payload = " ".join(uri.split()), page.encode()
    head = END.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""])
    return _record("response", record_id("response", key, uri, date, digest(payload)), None, uri, date, "application/http; msgtype=response", head + page, digest(payload), [])


def plain_text(page: str) -> str:
    """All visible text, one block a line."""
    import html

    lines, run, stack = [], [], [iter(parse(page).parts)]
    names = [""]

    def flush():
        line = " ".join(html.unescape("".join(run)).split())
        if line:
            lines.append(line)
        run.clear()

    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if names.pop() in _BREAKS:
                flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.name not in _UNSEEN:
            if x.name in _BREAKS:
                flush()
            stack.append(iter(x.parts))
            names.append(x.name)
    flush()
    return "\n".join(lines)


def derive(source: tuple) -> list[tuple]:
    """The metadata and the conversion record of a response record (in the order of COLUMNS)."""
    import html

    _, identifier, _, uri, date, _, _, block, payload, _, content = (x if x is not None or i == 8 else "" for i, x in enumerate(source))
    head, _, page = content.partition(END + END)
    status, *headers = head.split(END)
    link = [("WARC-Refers-To-Target-URI", uri), *([("WARC-Refers-To-Date", date)] if date else [])]
    title, lang = _TITLE.search(page), _LANG.search(page)
    text = plain_text(page)
    facts = [("source-status", status), *(("source-header", h) for h in headers), ("source-block-digest", block), ("source-payload-digest", payload or "")]
    facts += [("title", " ".join(html.unescape(title[1]).split()))] if title else []
    facts += [("language", lang[1])] if lang else []
    facts += [("text-length", str(len(text)))]
    facts += [("outlink", " ".join(html.unescape(m[1] or m[2] or m[3] or "").split())) for m in _LINK.finditer(page)]
    fields = "".join(f"{k}: {v}{END}" for k, v in facts)
    return [
        _record("metadata", record_id("metadata", identifier), identifier, uri, date, "application/warc-fields", fields, None, link),
        _record("conversion", record_id("conversion", identifier), identifier, uri, date, "text/plain; charset=utf-8", text, None, [*link, ("WARC-Source-Payload-Digest", payload or "")]),
    ]


def _rows(keys: pa.Array, key: str, owner: list[int], records: list[tuple]) -> pa.RecordBatch:
    kinds = {"content_length": pa.int64()}
    columns = [pa.array([r[i] for r in records], kinds.get(n, pa.string())) for i, n in enumerate(NAMES)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(owner, pa.int64())), *columns], [key, *NAMES])


def response_records(pages: DataFrame, key: str = "page_id", uri: str = "url", source: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of stored pages: ``key`` and the record columns. NULL pages have an empty payload."""
    rows = pages.select(F.col(key).alias(key), F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("_uri"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            keys = batch.column(key)
            found = [response(str(k), u, h, date) for k, u, h in zip(keys.to_pylist(), batch.column("_uri").to_pylist(), batch.column("_html").to_pylist())]
            yield _rows(keys, key, list(range(len(found))), found)

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {COLUMNS}")


def derivative_records(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records per response: ``key`` and the record columns of its metadata and its conversion.

    General operator: the project archives no pages. ``responses`` has ``key`` and the columns of
    ``response_records``; other record types are passed over, other columns ignored. Both derivatives
    name the response in ``refers_to`` and in WARC-Refers-To, with its URI and date; the metadata record
    keeps its status line, every HTTP header and its digests, and adds title, language and links; the
    conversion record holds the visible text, one block a line. Identifiers follow from the response's
    own, so repeated rows give repeated records and a lost task writes the same again. NULL content is a
    response without status, headers and text; a NULL date is left out of the headers and '' in ``date``,
    other NULL fields are ''. Very long pages stand alone in their batch. An empty table gives no record. A projection: no shuffle, a few megabytes of pages in a task at a time.
    """
    rows = responses.where("record_type = 'response'").select(key, *NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content"):
            owner, records = [], []
            for i, source in enumerate(zip(*(batch.column(n).to_pylist() for n in NAMES))):
                for record in derive(source):
                    owner.append(i), records.append(record)
            yield _rows(batch.column(key), key, owner, records)

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {COLUMNS}")


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzip-compressed WARC/1.1 files, one per partition, where ``path`` leads."""
    whole = F.concat("headers", F.lit(END + END), F.coalesce("content", F.lit("")))
    records.select(whole.alias("value")).write.option("lineSep", END + END).option("compression", "gzip").text(path)


def split_records(data: bytes) -> list[dict]:
    """Header fields and content of every record of a WARC file, by the lengths it states."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split(END)[1:])
        at = end + 4 + int(fields["Content-Length"])
        out.append({"fields": fields, "content": data[end + 4 : at].decode()})
        at += 4
    return out
