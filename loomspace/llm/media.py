"""Media columns: documents as interleaved sequences of text and media.

A page's HTML is parsed to an ordered list of structs: pieces of text, and media references
with the digest that their src names and the caption of their figure.  Payloads lie in a
store, a row for each digest, as 8-bit greyscale images (PNG) 64 samples wide; the join on
the digest resolves references, and positions and captions stay with their structs.

`documents_as_media` makes such pages of plain documents: the first line, a figure, the other
lines, and another figure.  The first figure's image is the text's bytes, padded with zeros
to a positive multiple of 64; the second's is the last 64 of them.  A page's row comes from
its two resolved references, told apart by their positions.

Defined results: null is the empty text; its payload is 64 zero bytes.  A reference without
a payload stays, with null in the payload's columns; a malformed digest is such a reference.
Equal texts have equal digests and rows.  Repeated rows stay; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hot_keys, salted_join, trim, whole_text

WIDTH = 64
SEQUENCE = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
# Fixed values of the PNG format: its signature, and a header for 8-bit greyscale samples.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_GREY8 = (8, 0, 0, 0, 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes, width: int = WIDTH) -> bytes:
    """A greyscale PNG; the number of samples is a positive multiple of the width."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), dtype=np.uint8)  # each line begins with filter 0: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), *_GREY8)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(stored: bytes) -> bytes:
    """The samples of an image that encode_png has stored; raises where a checksum is wrong."""
    if stored[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width = 8, [], 0
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + n]
        if struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("PNG checksum")
        if kind == b"IHDR":
            width, _, *form = struct.unpack(">IIBBBBB", body)
            if tuple(form) != _GREY8:
                raise ValueError("not 8-bit greyscale")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def payload(text: str) -> bytes:
    b = text.encode()
    return b.ljust(max(1, -(-len(b) // WIDTH)) * WIDTH, b"\0")


def features(samples: bytes) -> str:
    """A few statistics of an image: rows, mean, deviation, and a 64-bit gradient hash in hex."""
    x = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    bands = np.array_split(np.arange(len(x)), 8)
    grid = np.array([x[b].mean(axis=0).reshape(8, 8).mean(axis=1) if len(b) else np.zeros(8) for b in bands])
    bits = np.diff(grid, axis=1, append=grid[:, :1]) > 0
    return f"rows={len(x)};mean={x.mean():.4f};std={x.std():.4f};grad={np.packbits(bits).tobytes().hex()}"


# Digests are bytes while they travel; results write them in hex.
_STORE = "digest binary, media binary, n long"
_SEEN = "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            held: dict[str, list] = {}
            for text in b.column(0).slice(at, 256).to_pylist():
                p = payload(text)
                for samples in (p, p[-WIDTH:]):
                    held.setdefault(hashlib.sha256(samples).digest(), [samples, 0])[1] += 1
            digests = list(held)
            media = [encode_png(held[d][0]) for d in digests]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(media, pa.binary()), pa.array([held[d][1] for d in digests], pa.int64())], names=["digest", "media", "n"])
    trim()


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, media, n): every text's payload, and its last 64 bytes, as images in stored form.

    A digest may have several equal rows; their n add up to the number of references to it.
    """
    return docs.select(whole_text(text_col).alias("text")).mapInArrow(_stored, _STORE)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for d, stored in zip(b.column(0).to_pylist(), b.column(1)):
            stored = stored.as_py()
            p = decode_png(stored)
            rows.append((d, len(p), hashlib.sha256(p).digest(), zlib.crc32(p[-WIDTH:]), len(stored), hashlib.sha256(stored).digest(), features(p)))
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        cols = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in _SEEN.split(", ")])
    trim()


def read_back(stored: DataFrame) -> DataFrame:
    """One row per digest with what the stored bytes decode to: sizes, digests, features."""
    return stored.select("digest", "media").mapInArrow(_read_back, _SEEN).dropDuplicates(["digest"])


# Markup of a sequence: comments, what is no text, captions, images, other tags, text.
_PARTS = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<figcaption\b[^>]*>(?P<caption>.*?)</figcaption\s*>|<img\b(?P<img>[^>]*)>|(?P<tag></?[a-zA-Z][^>]*>)|(?P<text>[^<]+|<)", re.S | re.I)
_SRC = re.compile(r"""\bsrc\s*=\s*["']?sha256:([0-9a-fA-F]{64})\b""")
_INLINE = re.compile(r"</?(a|abbr|b|code|em|i|small|span|strong|sub|sup|u)\b", re.I)


def _plain(markup: str) -> str:
    return " ".join(unescape(re.sub(r"<[^>]*>", "", markup)).split())


def sequence(html: str) -> list[dict]:
    """Text pieces and media references of a page in their order; a caption goes to the image before it."""
    out, words = [], []

    def end() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            out.append({"pos": len(out), "kind": "text", "text": text, "digest": None, "caption": None})

    for m in _PARTS.finditer(html):
        if m["text"]:
            words.append(unescape(m["text"]))
        elif m["img"] is not None:
            end()
            src = _SRC.search(m["img"])
            out.append({"pos": len(out), "kind": "media", "text": None, "digest": src[1].lower() if src else None, "caption": None})
        elif m["caption"] is not None:
            end()
            if out and out[-1]["kind"] == "media":
                out[-1]["caption"] = _plain(m["caption"])
            else:
                words.append(_plain(m["caption"]))
                end()
        elif m["tag"] and not _INLINE.match(m["tag"]):
            end()
    end()
    return out


def _parse(html: pd.Series) -> pd.Series:
    return html.map(sequence)


def sequences(pages: DataFrame, html_col: str) -> DataFrame:
    """The pages with a column `pieces`: the structs of each page in their order."""
    parse = F.pandas_udf(_parse, SEQUENCE)
    return pages.select("*", F.explode(F.array(parse(whole_text(html_col)))).alias("pieces")).drop(html_col)


def interleaved(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, pos, kind, text, digest, caption): a row for each piece of each page."""
    rows = sequences(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")), "html")
    return rows.select("id", F.explode("pieces").alias("s")).select("id", "s.*")


def _hex(c: str) -> Column:
    return F.lower(F.hex(c))


def _joined(pieces: DataFrame, media: DataFrame, hot: DataFrame) -> DataFrame:
    return salted_join(pieces.withColumn("digest", F.unhex("digest")), media, "digest", hot, "left")


def resolve(pieces: DataFrame, media: DataFrame, hot: DataFrame) -> DataFrame:
    """The pieces with the columns of the media row that their digest names.

    media: one row per digest.  hot: digests of very many pieces (see hot_keys), which are
    dealt to copies of their media row.
    """
    return _joined(pieces, media, hot).withColumns({c: _hex(c) for c in ("digest", "payload_sha256", "media_sha256")})


def as_page(text: Column, digest: Column, tail: Column, n_bytes: Column) -> Column:
    """HTML of a document: its first line, its image, its other lines, the image of its end."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lead = F.substring_index(safe, "\n", 1)
    rest = F.replace(F.substr(safe, F.length(lead) + 2), F.lit("\n"), F.lit("</p><p>"))
    figure = lambda d, caption: F.concat(F.lit('<figure><img src="sha256:'), d, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<p>"), lead, F.lit("</p>"), figure(digest, F.concat(n_bytes.cast("string"), F.lit(" bytes"))), F.lit("<p>"), rest, F.lit("</p>"), figure(tail, F.lit("the end")))


def documents_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_pieces, pos and caption of its image in the page,
    end_pos and end_caption of its end's, and what the images were found to hold.

    The stored images are written before they are read back, in the shared folder.
    """
    stored = checkpointed(store(docs, text_col))
    hot = hot_keys(stored.groupBy("digest").agg(F.sum("n").alias("n")), "digest", "n")
    body = whole_text(text_col)
    size = F.octet_length(body)
    fill = (F.greatest(F.lit(1), F.ceil(size / WIDTH)) * WIDTH - size).cast("int")
    samples = F.concat(body.cast("binary"), F.encode(F.repeat(F.lit("\0"), fill), "UTF-8"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), size.cast("long").alias("n_bytes"), body.alias("body"), samples.alias("samples"))
    page = as_page(F.col("body"), F.sha2("samples", 256), F.sha2(F.substring(F.col("samples"), -WIDTH, WIDTH), 256), F.col("n_bytes"))
    pages = sequences(rows.select("row", "doc_id", "n_bytes", page.alias("html")), "html")
    # A page has two references: the whole image's and its end's.
    pieces = pages.select("row", "doc_id", "n_bytes", F.size("pieces").alias("n_pieces"), F.posexplode(F.filter("pieces", lambda p: p["kind"] == "media")).alias("k", "s"))
    found = _joined(pieces.select("row", "doc_id", "n_bytes", "n_pieces", "k", "s.pos", "s.caption", "s.digest"), read_back(stored), hot)
    image = F.when(F.col("k") == 0, F.struct("pos", "caption", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))
    end = F.when(F.col("k") == 1, F.struct("pos", "caption"))
    both = found.groupBy("row", "doc_id", "n_bytes", "n_pieces").agg(F.max(image).alias("image"), F.max(end).alias("end"))
    return both.select(
        "doc_id", "n_bytes", "n_pieces", "image.pos", "image.caption", F.col("end.pos").alias("end_pos"), F.col("end.caption").alias("end_caption"), "image.payload_bytes",
        _hex("image.payload_sha256").alias("payload_sha256"), "image.tail_crc32", "image.media_bytes", _hex("image.media_sha256").alias("media_sha256"), "image.feature",
    )
