"""Secret scan with a recursive decoding worklist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import unwrap_kernel as kernel
from .common import map_rows, ship

ship(kernel)

_SPAN = "struct<kind:string,start:int,`end`:int,layers:string,value:string>"


def find_secrets(docs: DataFrame, total: int | None = kernel.TOTAL_CHARS) -> DataFrame:
    """(doc_id, spans, n_layers, bounded) for every row of docs(doc_id, text, ...).

    spans holds kind, start, end (code points of the document), the layers unwrapped to reach
    it ('' in the text itself, else for instance 'url>base64>compressed') and the value as
    decoded. Layers are unwrapped until nothing new appears; a layer seen before is not taken
    up again. Bytes that are no UTF-8 stand as one character each, so rules also match in
    partly binary layers, and streams are found behind any encoding and in the middle of a
    layer. A place inside a compressed layer maps to the whole encoded stream; all members of
    one are unpacked, in blocks that overlap. Of a tower of escapes deeper than COPIES whole texts
    each further layer holds the parts that still change, and is scanned like any other. zlib
    streams with a window below 32 K, and raw deflate in base64, count where they end well;
    UTF-16 is told by its zero bytes.

    `total` and a share for each character of the document bound the characters of all its
    layers, against decompression bombs, and an unpacker may take UNPACKER bytes of memory;
    bounded tells where one of them ended the search, and total=None lifts the former. The text
    itself is always scanned whole, however long. Null and empty texts have no spans; repeated
    rows repeat theirs; other columns of docs, whatever their names, are left aside; an empty
    table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), lambda rows: kernel.scan(rows, total), f"doc_id {kind}, spans array<{_SPAN}>, n_layers int, bounded boolean")


def query(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["layers"] == "")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: (s["layers"] == "") & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    return find_secrets(docs).select(
        "doc_id", *[count(k) for k in kernel.KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), "n_layers", "bounded"
    )
