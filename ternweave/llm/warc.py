"""WARC derivatives: metadata and plain-text conversion records of response records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")       # fixed value: the UUID namespace of URLs
RECORD = ("warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
          "content_length long, block_digest string, source_payload_digest string, block string")

HIDDEN = ("script", "style", "noscript", "template")
#: Elements on a line of their own, and cells.
BREAK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
                  "html li main nav ol option p pre section table tbody tfoot thead tr ul".split())
CELL = frozenset(("td", "th"))
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in (*HIDDEN, "head", "title")}
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
BLANK = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*")


class Page:
    """Visible text, title, language and links of a page, in one run over it from tag to tag.

    Text is what stands outside of comments, scripts, styles, head and tags, one line per block element, entities
    resolved, runs of white space as one.  The end of a tag is the next ``>``, and what is not found behind one place is not looked for behind a later
    one, so the time is in proportion to the page, whatever is in it."""

    def __init__(self, page: str):
        self.page, self.links, self.title, self.lang = page, [], None, None
        self.none: set[str] = set()                                   # elements that are not closed any more
        out, at, head = [], 0, None
        while (start := page.find("<", at)) >= 0:
            out.append(page[at:start].replace("\n", " "))
            after = page[start + 1:start + 2]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = len(page) if end < 0 else end + 3
                continue
            name = NAME.match(page, start, start + 40)
            if not name and after not in ("!", "?"):
                out.append("<")
                at = start + 1
                continue
            end = page.find(">", start)
            if end < 0:                                               # no tag ends any more
                at = start
                break
            at, closing = end + 1, after == "/"
            kind = name[1].lower() if name else ""
            if kind in HIDDEN and not closing:
                at = self._closed(kind, at) or len(page)
                continue
            if kind == "head" and not closing and head is None and self._closed("head", at):
                head = len(out)
            elif kind == "head" and closing and head is not None:
                out[head:], head = ["\n"], None
            elif kind == "title" and not closing and self.title is None and (end := self._closed("title", at)):
                self.title = page[at:page.rfind("</", at, end)]
            elif kind == "a" and not closing and (m := HREF.search(page, start, at)):
                self.links.append(next(g for g in m.groups() if g is not None))
            elif kind == "html" and not closing and self.lang is None and (m := LANG.search(page, start, at)):
                self.lang = m[1]
            out.append("\n" if kind in BREAK else " " if kind in CELL else "")
        out.append(page[at:].replace("\n", " "))
        self.text = LINES.sub("\n", BLANK.sub(" ", html.unescape("".join(out)))).strip()

    def _closed(self, kind: str, at: int) -> int | None:
        """Where the closing tag ends, or None."""
        if kind in self.none:
            return None
        m = CLOSE[kind].search(self.page, at)
        if m is None:
            self.none.add(kind)
        return m and m.end()


def plain_text(page: str) -> str:
    """Visible text of a page."""
    return Page(page).text


def one_line(text: str) -> str:
    return " ".join(html.unescape(text).split())


def digest(block: bytes) -> str:
    """A labelled digest as WARC files have it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """An identifier that depends on its parts alone, so that a task that runs again gives it again."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def responses_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records (key, record_id, target_uri, date, http, payload) of fetched pages."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    url = F.coalesce(F.col(url_col), F.lit(""))
    payload = F.coalesce(F.col(html_col), F.lit(""))
    h = F.sha1(F.concat_ws("\0", key, url, payload).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    name = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"),
                    part(21, 12), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).alias("key"), name.alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"),
                        http.alias("http"), payload.alias("payload"))


def derivatives_of(name: str, uri: str, date: str, http: str, page: str) -> list[tuple]:
    """The metadata and the conversion record of one response, as RECORD rows."""
    source = digest(page.encode("utf-8", "replace"))
    parsed = Page(page)
    text = parsed.text
    body = text.encode("utf-8", "replace")
    meta_id, text_id = record_id("metadata", name), record_id("conversion", name)
    status, *headers = http.rstrip("\r\n").split("\r\n") if http else [""]
    fields = [("derived-from", name), ("conversion", text_id), ("source-block-digest", digest((http + page).encode("utf-8", "replace"))),
              ("source-payload-digest", source), ("source-content-length", str(len((http + page).encode("utf-8", "replace")))),
              ("source-status", status), *[("source-header", h) for h in headers if h],
              *([("title", one_line(parsed.title))] if parsed.title is not None else []), *([("language", parsed.lang)] if parsed.lang else []),
              ("text-length", str(len(body))),
              *[("outlink", one_line(link)) for link in parsed.links]]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields)
    rows = []
    for kind, own, content, block in (("metadata", meta_id, "application/warc-fields", meta), ("conversion", text_id, "text/plain; charset=utf-8", text)):
        raw = block.encode("utf-8", "replace")
        rows.append((kind, own, name, uri, date, content, len(raw), digest(raw), source, block))
    return rows


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records of every response: (key, then RECORD): ``metadata`` with the source's status line, headers, digests, title,
    language and links, and ``conversion`` with the page's plain text.  Both refer to the response by its identifier
    and keep its URI and date; the metadata names the conversion.

    A narrow job over (key, record_id, target_uri, date, http, payload).  Nulls are empty: an empty payload
    gives an empty conversion.  Repeated rows give repeated records of the same identifiers, an empty table
    none; other columns are not read."""
    kind = responses.schema["key"].dataType.simpleString()
    names = [c.split()[0] for c in RECORD.split(", ")]
    schema = pa.schema([(n, pa.int64() if n == "content_length" else pa.string()) for n in names])

    def build(batches):
        for batch in batches:
            cols = [[x or "" for x in batch.column(c).to_pylist()] for c in ("record_id", "target_uri", "date", "http", "payload")]
            for a in range(0, batch.num_rows, 500):
                rows, keys = [], []
                for i in range(a, min(a + 500, batch.num_rows)):
                    rows += derivatives_of(*(c[i] for c in cols))
                    keys += [i, i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(keys)), *[pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)]],
                    names=["key", *names])

    return responses.select("key", "record_id", "target_uri", "date", "http", "payload").mapInArrow(build, f"key {kind}, {RECORD}")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files, one file per partition, through Spark's own writer."""
    field = lambda name, c: F.concat(F.lit(f"\r\n{name}: "), F.col(c).cast("string"))
    text = F.concat(F.lit(VERSION), field("WARC-Type", "warc_type"), field("WARC-Record-ID", "record_id"), field("WARC-Refers-To", "refers_to"),
                    F.when(F.col("target_uri") != "", field("WARC-Target-URI", "target_uri")).otherwise(""), field("WARC-Date", "date"),
                    field("WARC-Block-Digest", "block_digest"), field("WARC-Source-Payload-Digest", "source_payload_digest"),
                    field("Content-Type", "content_type"), field("Content-Length", "content_length"), F.lit("\r\n\r\n"), F.col("block"))
    records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def parse(data: bytes) -> list[dict]:
    """Records of a WARC file: header fields in lower case, and the block in bytes.  A block that has another
    digest than its record says, where that is a SHA-1, is an error."""
    out, at = [], 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields: dict = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        fields["block"] = data[end + 4:end + 4 + size]
        named = fields.get("warc-block-digest", "")
        if named.startswith("sha1:") and digest(fields["block"]) != named:
            raise ValueError("a block does not have its digest")
        out.append(fields)
        at = end + 4 + size + 4
    return out


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("content")


def responses_of_warc(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Response records (key, record_id, target_uri, date, http, payload) of the WARC files in a folder, for :func:`derivatives`; the key is
    the record's identifier.  Bytes that aren't UTF-8 become replacement characters; a block without an end of its HTTP header is all payload;
    records of other types are left out."""
    names = ["key", "record_id", "target_uri", "date", "http", "payload"]

    def run(batches):
        import gzip
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                found = [f for f in parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw) if f.get("warc-type") == "response"]
                for a in range(0, len(found), 500):
                    rows = []
                    for f in found[a:a + 500]:
                        head, end, body = f["block"].partition(b"\r\n\r\n")
                        http, payload = (head + end, body) if end else (b"", head)
                        rows.append((f.get("warc-record-id", ""), f.get("warc-record-id", ""), f.get("warc-target-uri", ""), f.get("warc-date", ""),
                                     http.decode("utf-8", "replace"), payload.decode("utf-8", "replace")))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], names=names)
    return _files(spark, path, pattern).mapInArrow(run, ", ".join(f"{n} string" for n in names))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of the WARC files in a folder; each file is read by one task and bounded by its writer."""
    def run(batches):
        import gzip
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                found = parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                cols = {"warc_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri",
                        "date": "warc-date", "content_type": "content-type", "content_length": "content-length", "block_digest": "warc-block-digest",
                        "source_payload_digest": "warc-source-payload-digest", "block": "block"}
                for a in range(0, len(found), 500):
                    part = found[a:a + 500]
                    yield pa.RecordBatch.from_pydict({n: ([int(f[k]) for f in part] if n == "content_length" else [f[k].decode("utf-8", "replace") if k == "block" else f.get(k, "") for f in part])
                                                      for n, k in cols.items()})
    return _files(spark, path, "part-*").mapInArrow(run, RECORD)
