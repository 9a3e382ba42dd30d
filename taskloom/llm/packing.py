"""Packing by power-of-two decomposition: no sequence crosses documents, and none is padded."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, ranked, ready, saved

LENGTH = 1024
#: Stands after each document.
END = 0
_SPECIAL = "<|endoftext|>"


@cache
def _encoding(ranks: str):
    """The byte-level BPE whose ranks are in the file: the ids of byte_bpe_50k.json of the same folder."""
    import public_tokenizers
    import tiktoken

    path = ranks if "/" in ranks else public_tokenizers.path(ranks)
    with open(path, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={_SPECIAL: len(known)})


def encode(text: str, ranks: str) -> list[int]:
    """The ids that tokenizers gives with add_special_tokens=False; the special token's own string is its id there."""
    coder = _encoding(ranks)
    return coder.encode(text, allowed_special="all") if _SPECIAL in text else coder.encode_ordinary(text)


def binary_pieces(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, then the binary digits of the rest, large first."""
    out = [(i, length) for i in range(0, n - n % length, length)]
    at, rest = n - n % length, n % length
    while rest:
        out.append((at, size := 1 << rest.bit_length() - 1))
        at, rest = at + size, rest - size
    return out


def _pieces(batches: Iterator[pa.RecordBatch], ranks: str, length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    def made(rows: list, of: list[int], keys: pa.Array) -> pa.RecordBatch:
        cols = [list(c) for c in zip(*rows)]
        arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
        out = [keys.take(pa.array(of, pa.int64())), *arrays]
        names = ["_key", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            out.append(pa.array(cols[4], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names=names)

    for batch in batches:
        rows, of, held = [], [], 0
        for i, text in enumerate(batch.column(1)):
            ids = np.array([*encode(text.as_py() or "", ranks), END], "<u4")
            for start, size in binary_pieces(len(ids), length):
                piece = ids[start : start + size]
                rows.append((start, size, zlib.crc32(piece.tobytes()), len(ids), *([piece] if with_ids else [])))
                of.append(i)
            held += len(ids) * with_ids
            if held > 1 << 20:
                yield made(rows, of, batch.column(0))
                rows, of, held = [], [], 0
        if rows:
            yield made(rows, of, batch.column(0))


def pack(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", length: int = LENGTH, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids).

    A document is the ids of its text and then id 0; a null text is empty. It is cut into as many whole sequences as
    it holds and then into the powers of two of the rest, so every piece is a sequence by itself: its length is a
    power of two, it begins at offset 0 and needs no padding. Sequences are numbered without gaps by length (bucket,
    its logarithm), so a batch takes equal lengths from a run of ids. Order in a bucket: key, start, then checksum;
    rows of the same key each have their pieces, and null keys come first. Other columns are not read. No rows give
    no rows. ranks: a file of the public tokenizers or a path to one of the same form on all machines.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    ready(spark)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    # Tokenised once; what follows moves the pieces' numbers.
    pieces = saved(rows.mapInArrow(lambda it: _pieces(it, ranks, length, with_ids), schema))
    placed = ranked(pieces, F.col("length").desc(), F.col("_key").asc_nulls_first(), F.col("start"), F.col("ids_crc32"), rank="sequence_id")
    bucket = F.log2("length").cast("int")
    return placed.select(F.col("_key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), bucket.alias("bucket"), *["ids"] * with_ids)


def op3_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
