"""Repeated 200-byte strings, found by winnowing and hashes of windows of bytes.

This stands in the place of bucket-pointer refinement: no suffix is sorted and
no bucket identifier is shared between slices or updated. Within a slice of
texts each position gets hashes of its next 8, 16, 32, 64, 128 and 200 bytes,
each made of two of the size before. A 200-byte string belongs to the anchor
inside it that winnowing chooses (its least 32-byte gram by hash), and
``repeats.find`` compares the strings of equal anchors across all documents:
runs of consecutive strings first, then blocks of runs, then single strings;
settled parts go no further. Equal strings have equal anchors, so none is
missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.repeats import covered, find, of_documents
from corpusmill.llm.common import back_id, keyed, mix, slices

GRAM = 32


def _first_buckets(data: np.ndarray) -> np.ndarray:
    """The 8-byte string at each position, as a number."""
    level, size = data.astype(np.uint64), 1
    while size < 8:
        level = level[:-size] | (level[size:] << np.uint64(8 * size)) if len(level) > size else level[:0]
        size *= 2
    return mix(level)


def _refine(level: np.ndarray, offset: int) -> np.ndarray:
    """Buckets by the identifiers here and at a later offset."""
    return mix(level[:-offset], level[offset:]) if len(level) > offset else level[:0]


def _ids(length: int):
    def ids(texts: list[str]):
        data = [text.encode() for text in texts]
        sizes = np.array([len(x) for x in data], dtype=np.int64)
        level = _refine(_refine(_first_buckets(np.frombuffer(b"".join(data), dtype=np.uint8)), 8), 16)
        grams, size = level, GRAM
        while size < length:
            offset = min(size, length - size)
            level, size = _refine(level, offset), size + offset
        return grams, level, sizes

    return ids


RESULT = "_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            out = []
            for key, text, spans in zip(*(batch.column(c).to_pylist() for c in ("_id", "_text", "spans")), strict=True):
                kept = data = text.encode()
                pieces = 0
                if spans:
                    lo, n = np.array([(s["lo"], s["n"]) for s in spans], dtype=np.int64).T
                    gone = covered(lo, n, length, len(data))
                    pieces = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                out.append((key, kept, len(data), len(data) - len(kept), pieces, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)],
                ["_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(id, kept, n_bytes, n_removed, n_spans, kept_sha256), a row for each input row.

    Every byte covered by a ``length``-byte string that also starts anywhere
    else goes; ``kept`` has the others (cuts may split a character). Null and
    empty texts have no bytes. Rows equal in id and text count as one document
    and get the same result; other rows that share an id are different
    documents. A null id stays null. Extra columns are not looked at, whatever
    their names. An empty table gives no rows.
    """
    if not GRAM < length:
        raise ValueError(f"length must be over {GRAM}")
    rows = keyed(docs, id_col, text_col)
    spans = find(rows, _ids(length), length, GRAM, later_only=False, blocks=True)
    done = of_documents(rows, spans, "left").select("_id", "_text", "spans").mapInArrow(_cut(length), RESULT)
    return done.select(back_id().alias(id_col), "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")
