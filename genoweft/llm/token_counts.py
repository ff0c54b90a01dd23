"""Token counts per section by offset-mapped attribution.

A whole document is encoded once. The byte lengths of its tokens give each token's span; spans
are joined to the sections' intervals by binary search over both sorted lists. A token that
crosses a boundary is allocated by an explicit rule:

- "start": to the section that holds its first byte;
- "majority": to the section that holds most of its bytes, the earlier one if equal;
- "share": to every section by its part of the bytes.

Sections are the document's lines with the line feed that ends them, or its fields: text columns
joined by line feeds, each field with the one that ends it. Spans are in code points.

Edge cases: a null or empty text has one empty section with no tokens; blank lines are sections; a
null field is an empty one;
texts of any length are encoded whole; repeated rows stay; special-token strings are ordinary
text; an empty table gives an empty result; other columns,
of whatever names, are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that parts text before byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "majority", "share")


@lru_cache(maxsize=2)
def encoder(path: str):
    """(tiktoken encoding, byte length of each token)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def line_starts(text: str, data: bytes) -> np.ndarray:
    """First byte of each line."""
    at = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.concatenate([[0], at[at < len(data)]])


def attribute(first: np.ndarray, size: np.ndarray, starts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and tokens that cross its end, from token spans and section starts."""
    n = len(starts)
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, first + size - 1, "right") - 1
    over = np.flatnonzero(a != b)
    crossing = np.bincount(a[over], minlength=n)
    if rule == "start" or not len(over):
        return np.bincount(a, minlength=n).astype(float), crossing
    # Every section that a crossing token meets, with the bytes it has there.
    met = b[over] - a[over] + 1
    k = np.repeat(over, met)
    at = a[k] + np.arange(len(k)) - np.repeat(np.cumsum(met) - met, met)
    held = np.minimum(first[k] + size[k], np.append(starts[1:], total)[at]) - np.maximum(first[k], starts[at])
    if rule == "share":
        tokens = np.bincount(a[a == b], minlength=n).astype(float)
        np.add.at(tokens, at, held / size[k])
        return tokens, crossing
    order = np.lexsort((at, -held, k))
    a[over] = at[order][np.append(True, np.diff(k[order]) > 0)]
    return np.bincount(a, minlength=n).astype(float), crossing


def _sections(batches: Iterator[pa.RecordBatch], path: str, rule: str, fields: int = 0) -> Iterator[pa.RecordBatch]:
    """Sections of (id, text), or with `fields` of (id, list of so many fields)."""
    enc, size_of = encoder(path)
    names = ("doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing")
    for batch in batches:
        ids = batch.column(0)
        rows, out, held = [], [[] for _ in range(5)], 0

        def flush():
            arrays = [np.concatenate(x) for x in out]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(rows))), *map(pa.array, arrays)], list(names))

        for i, text in enumerate(batch.column(1).to_pylist()):
            parts = [x or "" for x in text] if fields else []
            text = "\n".join(parts) if fields else text or ""
            data = text.encode("utf-8")
            if fields:
                starts = np.cumsum([0, *(len(x.encode("utf-8")) + 1 for x in parts[:-1])])
            else:
                starts = line_starts(text, data)
            if data:
                size = size_of[np.array(enc.encode_ordinary(text), np.int64)]
                tokens, crossing = attribute(np.cumsum(size) - size, size, starts, len(data), rule)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                edge = np.append(chars[starts], chars[-1])
            else:
                tokens, crossing, edge = np.zeros(1), np.zeros(1, np.int64), np.zeros(2, np.int64)
            n = len(starts)
            rows.append(np.full(n, i))
            for x, v in zip(out, (np.arange(n), edge[:-1], edge[1:], tokens, crossing), strict=True):
                x.append(v)
            held += n
            if held > 100_000:
                yield flush()
                rows, out, held = [], [[] for _ in range(5)], 0
        if rows:
            yield flush()


def section_tokens(docs: DataFrame, rule: str = "start", vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens, n_crossing), a row per section of every row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        partial(_sections, path=vocabulary, rule=rule),
        "doc_id long, section long, start_char long, end_char long, n_tokens double, n_crossing long",
    )


def field_tokens(docs: DataFrame, fields: list[str], rule: str = "start", vocabulary: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, field, start_char, end_char, n_tokens, n_crossing): the fields of a row are encoded as one
    text, line feeds between them, and its tokens are told apart by field."""
    if rule not in RULES or not fields:
        raise ValueError(f"rule must be one of {RULES}, and one field is needed")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.array(*[F.col(c).cast("string") for c in fields]).alias("parts"))
    found = rows.mapInArrow(
        partial(_sections, path=vocabulary, rule=rule, fields=len(fields)),
        "doc_id long, section long, start_char long, end_char long, n_tokens double, n_crossing long",
    )
    name = F.element_at(F.array(*map(F.lit, fields)), F.col("section").cast("int") + 1)
    return found.select("doc_id", name.alias("field"), "start_char", "end_char", "n_tokens", "n_crossing")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
