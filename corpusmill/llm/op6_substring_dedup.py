"""Substring dedup: seed and extend over words.

Documents are joined on winnowed anchors (of every ``length`` consecutive words
the six-word gram of least hash), matches are extended both ways from the
anchor, and what repeats over at least ``length`` words is removed, but for its
first occurrence by (doc id, position).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.repeats import covered, find, of_documents
from corpusmill.llm.common import back_id, keyed, mix, slices, word_ids

GRAM = 6


def _span_ids(ids: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of every ``length`` consecutive units, by doubling."""
    size, level = 1, ids
    while size * 2 <= length:
        level = mix(level[:-size], level[size:]) if len(level) > size else level[:0]
        size *= 2
    if size < length:
        gap = length - size
        level = mix(level[:-gap], level[gap:]) if len(level) > gap else level[:0]
    return level


def _ids(length: int):
    def ids(texts: list[str]):
        words = [text.encode().split() for text in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        of_word = mix(word_ids([w for doc in words for w in doc]))
        return _span_ids(of_word, GRAM), _span_ids(of_word, length), sizes

    return ids


RESULT = "_id long, text string, n_words long, n_removed long, kept_sha256 string"


def _cut(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            out = []
            for key, text, spans in zip(*(batch.column(c).to_pylist() for c in ("_id", "_text", "spans")), strict=True):
                words = text.encode().split()
                kept = words
                if spans:
                    lo, n = np.array([(s["lo"], s["n"]) for s in spans], dtype=np.int64).T
                    gone = covered(lo, n, length, len(words))
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                text = b" ".join(kept)
                out.append((key, text.decode(), len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                ["_id", "text", "n_words", "n_removed", "kept_sha256"],
            )

    return rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20) -> DataFrame:
    """(id, text, n_words, n_removed, kept_sha256), a row for each input row.

    ``text`` has the kept words, joined by one space. Null and empty texts have
    no words; texts under ``length`` words lose none. Rows equal in id and text
    count as one document and get the same result; other rows that share an id
    are taken in the order of their texts. A null id sorts first. Extra columns
    are not looked at, whatever their names. An empty table gives no rows.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    rows = keyed(docs, id_col, text_col)
    spans = find(rows, _ids(length), length, GRAM, later_only=True, blocks=False)
    done = of_documents(rows, spans, "left").select("_id", "_text", "spans").mapInArrow(_cut(length), RESULT)
    return done.select(back_id().alias(id_col), *[c for c in ("text", "n_words", "n_removed", "kept_sha256")])
