"""Token counts of fields and sections from one encoding of the whole document.

The document is encoded once; each token keeps the characters it stands for. Tokens and sections, both in order, are joined
as intervals, and a token over a boundary goes where the rule says: "first" or "last" section it touches, the one with the
"largest" overlap (the earlier of equals), or "each" of them.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import encoder, released

RULES = ("first", "last", "largest", "each")


def line_sections(text: str, most: int) -> np.ndarray:
    """The (first, past last) characters of each line that isn't empty; a line is cut after every most characters."""
    out = []
    for m in re.finditer(r"[^\n]+", text):
        at = range(m.start(), m.end(), most)
        out += [(i, min(i + most, m.end())) for i in at]
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def apart(spans: list[tuple[int | None, int | None]]) -> np.ndarray:
    """Sections in order that don't overlap; those without a start, an end or a character left have no tokens but stay."""
    rows, end = [], 0
    for a, b in sorted((0 if a is None else a, 0 if b is None else b) for a, b in spans):
        a = max(a, end)
        b = max(a, b)
        rows.append((a, b))
        end = b
    return np.array(rows, np.int64).reshape(-1, 2)


def allocate(tokens: np.ndarray, sections: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of each section, those of them that cross a boundary, and tokens outside every section. Both inputs in order, sections apart."""
    n = len(sections)
    if not n or not len(tokens):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), len(tokens)
    lo = np.searchsorted(sections[:, 1], tokens[:, 0], "right")
    hi = np.searchsorted(sections[:, 0], np.maximum(tokens[:, 1], tokens[:, 0] + 1), "left") - 1
    inside, crossing = lo <= hi, lo < hi
    counts, crossed = np.bincount(lo[inside & ~crossing], minlength=n), np.zeros(n, np.int64)
    for t in np.flatnonzero(crossing):
        over = np.arange(lo[t], hi[t] + 1)
        if rule != "each":
            lap = np.minimum(sections[over, 1], tokens[t, 1]) - np.maximum(sections[over, 0], tokens[t, 0])
            over = over[{"first": 0, "last": -1, "largest": int(lap.argmax())}[rule]][None]
        counts[over] += 1
        crossed[over] += 1
    return counts, crossed, int((~inside).sum())


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "largest", most_chars: int = 1000, spans_col: str | None = None) -> DataFrame:
    """doc_id, section (from 0), start_char, end_char, n_tokens, n_crossing: a row for each section of each document.

    Tokens that touch no section are counted in a row of section -1 with null characters, so that sums are the documents' own.

    Sections are lines, cut after most_chars characters, or, with spans_col, that column's array of structs of two integers
    (sorted here; where two overlap the later one starts at the end of the one before). A text that is null or empty gives
    only rows of its given sections; equal ids stay rows of their own. Texts may be of any length.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    schema = "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long"
    names = [x.split()[0] for x in schema.split(", ")]

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            encode, keys = encoder(tokenizer), batch.column(0)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                given = [apart([tuple(x.values()) for x in s or [] if x is not None]) for s in part.column(2).to_pylist()] if spans_col else [line_sections(x or "", most_chars) for x in texts]
                sums = [allocate(t, s, rule) for t, s in zip(encode.char_spans(texts), given, strict=True)]
                many, outside = np.array([len(s) for s in given]), np.array([x[2] for x in sums])
                ids = keys.slice(at, 1000)
                if many.sum():
                    spans = np.concatenate(given)
                    cols = [np.concatenate([np.arange(n) for n in many]), spans[:, 0], spans[:, 1], np.concatenate([x[0] for x in sums]), np.concatenate([x[1] for x in sums])]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(many)), many))), *(pa.array(x, pa.int64()) for x in cols)], names)
                if len(lost := np.flatnonzero(outside)):
                    none = pa.nulls(len(lost), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(lost)), pa.array(np.full(len(lost), -1)), none, none, pa.array(outside[lost]), pa.array(np.zeros(len(lost), np.int64))], names)
        released()

    bounded_batches(docs.sparkSession)
    cols = [F.col(id_col).cast("long"), F.col(text_col).cast("string"), *([F.col(spans_col)] if spans_col else [])]
    return docs.select(*cols).mapInArrow(count, schema)
