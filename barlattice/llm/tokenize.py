"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Texts of more characters are cut at safe boundaries, so that one text never needs its ids whole.
PIECE = 1 << 20

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding of a rank file; one per Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_cut(text: str, at: int) -> int:
    """The last boundary at or before ``at`` that no match of the split pattern crosses, or 0.

    White space never follows other characters within a match, letters and digits never share one, and
    a letter is followed in a match by no punctuation but an apostrophe, so a cut there leaves every
    match as it was. Scripts without spaces have only the last kind.
    """
    for i in range(min(at, len(text) - 1), 0, -1):
        before, after = text[i - 1], text[i]
        if before.isspace():
            continue
        if after in " \n\t\r" or (before.isascii() and after.isascii() and ((before.isalpha() and after.isdigit()) or (before.isdigit() and after.isalpha()))):
            return i
        if before.isalpha() and after not in "'\u2019" and unicodedata.category(after)[0] == "P":
            return i
    return 0


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of ``text`` whose encodings, one after the other, are the encoding of ``text``."""
    start = 0
    while len(text) - start > size:
        part = text[start : start + size + 1]
        end = safe_cut(part, size)
        if not end:  # one run without a boundary: take it as far as it goes
            reach = 2 * size
            while not end and start + reach < len(text):
                part = text[start : start + reach + 1]
                end = safe_cut(part, reach)
                reach *= 2
            if not end:
                break
        yield text[start : start + end]
        start += end
    yield text[start:]


def encode(text: str | None, coder, size: int = PIECE) -> Iterator[np.ndarray]:
    """The ids of a text, part by part, as unsigned 32-bit integers."""
    for part in pieces(text or "", size):
        yield np.asarray(coder.encode_ordinary(part), dtype="<u4")


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = False, piece: int = PIECE) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the decoded bytes), and with ``with_ids`` the column ids (array of int).
    A null text is an empty one: no token, the hashes of no bytes. Repeated rows give repeated
    rows; a null doc_id stays null. Special tokens' strings in a text are ordinary text.
    """
    import public_tokenizers

    ranks_path = ranks_path or public_tokenizers.path(RANKS)
    pattern = pattern or public_tokenizers.PATTERN

    @tidy
    def run(batches):
        coder = encoding(ranks_path, pattern)
        for batch in batches:
            counts, hashes, decoded, all_ids = [], [], [], []
            for text in batch.column(1):
                n, ids_hash, text_hash, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in encode(text.as_py(), coder, piece):
                    n += len(ids)
                    ids_hash.update(ids.tobytes())
                    text_hash.update(coder.decode_bytes(ids.tolist()))
                    if with_ids:
                        kept.append(ids)
                counts.append(n)
                hashes.append(ids_hash.hexdigest())
                decoded.append(text_hash.hexdigest())
                if with_ids:
                    all_ids.append(np.concatenate(kept).astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def decode(rows: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the raw bytes (column ``decoded``) of the ids in column ``ids``; null ids give null."""
    import public_tokenizers

    ranks_path = ranks_path or public_tokenizers.path(RANKS)
    pattern = pattern or public_tokenizers.PATTERN

    @tidy
    def run(batches):
        coder = encoding(ranks_path, pattern)
        for batch in batches:
            texts = [None if x is None else coder.decode_bytes(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
