"""Byte-level BPE over whole texts by overlapping chunks.

Every text is cut into chunks of ``chunk`` characters that overlap, and every chunk is split into
pre-tokens on its own. A chunk that starts in the middle of a pre-token soon meets a boundary that its
left neighbour also has; from a common boundary on, both split alike, since the pattern looks at nothing
to the left of a match. The pieces between these points are encoded one by one and their ids joined in
order. Only boundaries after a character that isn't white space count, some characters before a chunk's
end, where the text to the right can't change the match on the left. Where an overlap has no common
boundary (one very long word), the chunks are joined and encoded as one: a run of one kind of characters
ends for all alike, so the next overlap with a boundary is in step again.

Documents are dealt over tasks as the scan deals them, each with its chunks. The chunks of a text of over
``spread`` characters are dealt over tasks themselves, and only boundaries meet where they are stitched.

Nulls: a null text is empty: no ids. Empty table: empty result. Repeated rows and ids stay apart:
rows are numbered. A very long text is cut, split and encoded in many tasks. Other columns are ignored. Decoding joins the ids' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_of, written

CHUNK, OVERLAP, SPREAD, MARGIN = 2048, 128, 1 << 18, 4


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str):
    """The encoder of a rank file; each Python worker builds it once."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_piece(enc, text: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids := enc.encode_ordinary(text))}I", *ids)


def decode(enc, ids: bytes) -> bytes:
    return enc.decode_bytes(struct.unpack(f"<{len(ids) // 4}I", ids))


def boundaries(splitter, text: str) -> list[int]:
    """Ends of pre-tokens, each after something that isn't white space; the last few before the cut don't count."""
    end = len(text) - MARGIN
    return [e for m in splitter.finditer(text) if (e := m.end()) <= end and not text[e - 1].isspace()]


def zone(found: list[int], start: int, at: int, overlap: int) -> list[int]:
    """The boundaries, of a chunk that starts at start, in the overlap around at; as places in the text."""
    return [start + e for e in found[bisect_right(found, at - overlap - start) : bisect_left(found, at + overlap - start)]]


def chunk_at(text: str, k: int, chunk: int, overlap: int) -> tuple[int, str]:
    """Where chunk k starts, and its characters: from k * chunk - overlap to (k + 1) * chunk + overlap."""
    start = max(0, k * chunk - overlap)
    return start, text[start : (k + 1) * chunk + overlap]


def pieces_of(splitter, text: str, chunk: int, overlap: int) -> list[str]:
    """The text in pieces that can be encoded one by one."""
    seams, right = [0], []
    for k in range(-(-len(text) // chunk) if len(text) > chunk else 0):
        start, piece = chunk_at(text, k, chunk, overlap)
        found = boundaries(splitter, piece)
        if k and (common := set(right).intersection(zone(found, start, k * chunk, overlap))):
            seams.append(min(common))
        right = zone(found, start, (k + 1) * chunk, overlap)
    return [text[a:b] for a, b in zip(seams, [*seams[1:], len(text)])]


def cut(rows: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    """(row, text) to (row, k, start, piece)."""
    for pdf in rows:
        for row, text in zip(pdf["row"], pdf["text"]):
            n = -(-len(text) // chunk)
            for at in range(0, n, 64):  # some chunks at a time: a text is never copied whole
                ks = list(range(at, min(n, at + 64)))
                starts, pieces = zip(*(chunk_at(text, k, chunk, overlap) for k in ks))
                yield pd.DataFrame({"row": row, "k": ks, "start": starts, "piece": pieces})


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD, keep_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids and decoded."""
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * keep_ids

    def summary(ids: bytes, decoded: bytes) -> tuple:
        return (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()) + (ids, decoded) * keep_ids

    names = [c.split()[0] for c in schema.split(", ")]

    def whole(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, splitter = encoding(ranks_path, pattern), _splitter(pattern)
        for pdf in rows:
            ids = [b"".join(encode_piece(enc, t) for t in pieces_of(splitter, text, chunk, overlap)) for text in pdf["text"]]
            yield pd.DataFrame([(i, *summary(x, decode(enc, x))) for i, x in zip(ids_of(pdf["id"]), ids)], columns=names)

    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = docs.where(F.length("text") <= spread).mapInPandas(whole, schema)
    return short.unionByName(_spread(docs.where(F.length("text") > spread), ranks_path, pattern, chunk, overlap, summary, names, schema))


def _spread(docs: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int, summary, names: list[str], schema: str) -> DataFrame:
    def split(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = _splitter(pattern)
        for pdf in rows:
            left, right = [], []
            for k, start, piece in zip(pdf["k"], pdf["start"], pdf["piece"]):
                found = boundaries(splitter, piece)
                left.append(zone(found, start, k * chunk, overlap) if k else [])
                right.append(zone(found, start, (k + 1) * chunk, overlap))
            yield pdf.assign(left=left, right=right)

    # the row number is fixed by writing the table; texts and ids may repeat
    docs = written(docs.withColumn("row", F.monotonically_increasing_id()))
    chunks = docs.select("row", "text").mapInPandas(lambda rows: cut(rows, chunk, overlap), "row long, k int, start int, piece string")
    chunks = chunks.repartition(F.col("row"), F.col("k")).mapInPandas(split, "row long, k int, start int, piece string, left array<int>, right array<int>")
    chunks = written(chunks)
    # the stitching needs the boundaries only, not the texts: a window over the few chunks of a document
    order = Window.partitionBy("row").orderBy("k")
    common = F.array_min(F.array_intersect("left", F.lag("right").over(order)))
    seams = chunks.select("row", "k", common.alias("seam"))
    seams = seams.withColumn("run", F.sum(F.when((F.col("k") == 0) | F.col("seam").isNotNull(), 1).otherwise(0)).over(order))
    seams = seams.withColumn("from", F.when(F.col("k") == 0, 0).otherwise(F.coalesce("seam", F.col("k") * chunk)))
    seams = seams.withColumn("to", F.lead("from").over(order))
    part = F.when(F.col("to").isNull(), F.expr("substring(piece, from - start + 1)")).otherwise(F.expr("substring(piece, from - start + 1, to - from)"))
    parts = chunks.join(seams, ["row", "k"]).select("row", "run", "k", part.alias("part"))
    pieces = parts.groupBy("row", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda p: p["part"]), "").alias("piece"))

    def encode(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks_path, pattern)
        for pdf in rows:
            ids = [encode_piece(enc, t) for t in pdf["piece"]]
            yield pd.DataFrame({"row": pdf["row"], "run": pdf["run"], "ids": ids, "decoded": [decode(enc, x) for x in ids]})

    coded = pieces.mapInPandas(encode, "row long, run long, ids binary, decoded binary")
    joined = coded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("run", "ids", "decoded"))).alias("parts"))

    def join(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = [(i, *summary(b"".join(p["ids"] for p in parts), b"".join(p["decoded"] for p in parts))) for i, parts in zip(ids_of(pdf["id"]), pdf["parts"])]
            yield pd.DataFrame(out, columns=names)

    return docs.select("row", "id").join(joined, "row").select("id", "parts").mapInPandas(join, schema)


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)
