"""Phrase collocations from generalised suffix automata.

A run of texts (a shard) becomes one generalised suffix automaton over words, cut at `most_words`:
its states are held level by level as the tree of its suffix links. A node of level k stands for a
phrase of k words, its link drops the first word, and its count is the number of its end positions
in the shard; a phrase and its link with equal counts are one state of the automaton, of which
the longer is the longest string. The levels come from sorting whole arrays: the key of a phrase is
the node of its link and the word put before it.

Shards cut their trees into fragments by the last two words, so that a phrase lies in the fragment
of its link. A fragment sums its trees over all shards level by level and follows only nodes that
occur `least` times in all: a phrase is never more frequent than what its link names. Phrases are
compared as bytes, never by hash; counts are those of the whole table. Candidates then meet the
counts of their parts by a join, and the longer candidates around them by a maximum.

What a task holds: one shard (`most` bytes of text, or one text, whole), or one fragment, whose
number grows with the number of partitions of the table. All left extensions of one two-word ending
lie in one fragment: distinct phrases, not occurrences. The last two words of a language never
meet in one task; only each task's `top` best rows of a language do.

Edge cases: null and empty texts and texts of separators only give no phrase; a null lang is `und`;
repeated rows count as often as they occur; null ids do not matter (ids are not read); a word or
text of any length is read whole; equal scores are ordered by count, then by the phrase's bytes; a
lang without candidates gives no row; an empty table gives an empty result; other columns, of
whatever names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, materialize, mix64, per_group, shuffle_partitions, text_chunks, tidy, word_bounds, word_hashes

#: Bytes that end a piece, and those that part words within one.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True
_PARTS = _ENDS.copy()
_PARTS[list(BLANKS)] = True

#: A row holds the nodes of one fragment of a shard: lines `lang word ...`, the lang in hexadecimal.
BLOCKS = "frag int, n_words int, nodes binary, counts binary, kids binary"
COUNTED = "lang string, n_words int, phrase string, f long"


def _pack(data) -> bytes:
    raw = bytes(data)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(block: bytes) -> bytes:
    n = int.from_bytes(block[:8], "little")
    return pa.decompress(block[8:], n, codec="zstd", asbytes=True) if n else b""


def _binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Values of the given lengths out of bytes that lie end to end."""
    offs = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offs[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(value: bytes) -> pa.Scalar:
    return pa.scalar(value, pa.large_binary())


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary array."""
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offs


def _lines(blob: bytes) -> pa.Array:
    """The values of a blob in which each ends with a newline."""
    data = np.frombuffer(blob, np.uint8)
    at = np.flatnonzero(data == 10)
    return _binaries(data[data != 10], np.diff(at, prepend=-1) - 1)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of runs laid end to end: first[i], first[i] + 1, ... size[i] of them."""
    total = int(size.sum())
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)


def link_tree(buf: np.ndarray, offs: np.ndarray, lang: np.ndarray, most_words: int) -> tuple:
    """(words, levels) of a shard: distinct words in byte order, and for each level of the suffix-link
    tree (key of the parent's node or lang, word put before, count). Words of different pieces or
    texts are never neighbours. `lang`: a number per text."""
    start, end = word_bounds(buf, offs, _PARTS)
    told = _binaries(buf[~_PARTS[buf]], end - start).dictionary_encode()
    order = pc.sort_indices(told.dictionary).to_numpy()
    words = told.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word = rank[told.indices.to_numpy()] if len(start) else np.empty(0, np.int64)
    text = np.searchsorted(offs, start, "right") - 1
    piece = np.searchsorted(np.union1d(np.flatnonzero(_ENDS[buf]) + 1, offs), start, "right")
    near = piece[1:] == piece[:-1]
    n, levels = max(1, len(words)), []
    parent, at = lang[text], np.arange(len(word))  # of each occurrence: its link's node, its first word
    for _ in range(most_words):
        distinct, node, count = np.unique(parent * n + word[at], return_inverse=True, return_counts=True)
        levels.append((distinct // n, distinct % n, count))
        go = np.flatnonzero(at > 0)
        go = go[near[at[go] - 1]]
        parent, at = node[go], at[go] - 1
    return words, levels


def _blocks(text: pa.ChunkedArray, lang: pa.ChunkedArray, most_words: int, frags: int, most: int) -> Iterator[dict]:
    told = lang.combine_chunks().dictionary_encode()
    names, tongue = told.dictionary.to_pylist(), told.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    salt = np.array([zlib.crc32(t.encode()) for t in names], np.uint64) << np.uint64(32)
    marks = pa.array([t.encode().hex().encode() for t in names], pa.large_binary())
    for a, b, buf, offs in text_chunks(text, most):
        words, levels = link_tree(LOWER[buf], offs, tongue[a:b], most_words)
        if not len(words):
            continue
        data, at = _flat(words)
        hashed = word_hashes(data, at[:-1], at[1:])
        lines = pc.binary_join_element_wise(words, _bytes(b""), _bytes(b"\n"))
        own, word, count = levels[0]
        ones = pc.binary_join_element_wise(marks.take(pa.array(own)), lines.take(pa.array(word)), _bytes(b" "))
        yield from _cut(ones, count, [], mix64(hashed[word] ^ salt[own]), frags, 1)
        if most_words < 2:
            continue
        under, first, count = levels[1]
        last, own = word[under], own[under]
        pairs = pc.binary_join_element_wise(marks.take(pa.array(own)), words.take(pa.array(first)), lines.take(pa.array(last)), _bytes(b" "))
        where = mix64(hashed[last] * np.uint64(3) + mix64(hashed[first]) ^ salt[own])
        yield from _cut(pairs, count, [(up, lines.take(pa.array(w)), c) for up, w, c in levels[2:]], where, frags, 2)


def _cut(nodes: pa.Array, count: np.ndarray, deeper: list, where: np.ndarray, frags: int, n_words: int) -> Iterator[dict]:
    """Rows of BLOCKS: the nodes of each fragment, with all that hangs on them."""
    group = (where % np.uint64(frags)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    layers = [(nodes.take(pa.array(order)), count[order], None)]
    for up, left, c in deeper:  # children lie in the order of their parents
        size = np.bincount(up, minlength=len(order))
        kids = size[order]
        order = _runs((np.cumsum(size) - size)[order], kids)
        layers.append((left.take(pa.array(order)), c[order], kids))
    group = np.sort(group)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    bound = [np.append(first, len(group))]
    for _, _, kids in layers[1:]:
        bound.append(np.append(0, np.cumsum(kids))[bound[-1]])
    flat = [_flat(x) for x, _, _ in layers]
    for g in range(len(first)):
        cut = [(b[g], b[g + 1]) for b in bound]
        yield {
            "frag": int(group[first[g]]), "n_words": n_words,
            "nodes": _pack(b"".join(bytes(d[o[i] : o[j]]) for (d, o), (i, j) in zip(flat, cut, strict=True))),
            "counts": _pack(b"".join(c[i:j].astype("<u4").tobytes() for (_, c, _), (i, j) in zip(layers, cut, strict=True))),
            "kids": _pack(b"".join(k[p:q].astype("<u4").tobytes() for (_, _, k), (p, q) in zip(layers[1:], cut[:-1], strict=True))),
        }


@tidy
def _shards(batches: Iterator[pa.RecordBatch], most_words: int, frags: int, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("frag", pa.int32()), ("n_words", pa.int32()), ("nodes", pa.binary()), ("counts", pa.binary()), ("kids", pa.binary())])

    def give(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        rows: list[dict] = []
        size = 0
        for r in _blocks(table.column("text"), table.column("lang"), most_words, frags, most):
            rows.append(r)
            size += len(r["nodes"])
            if size > most >> 3:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from give(held)
            held, size = [], 0
    if held:
        yield from give(held)


def _summed(table: pa.Table, least: int) -> pa.Table:
    """Counts over all shards of one fragment; nodes below `least` and all that hangs on them go.
    A row of no words holds the word occurrences of a lang in this fragment."""
    out: dict[str, list] = {"lang": [], "n_words": [], "phrase": [], "f": []}

    def add(lang: list, n_words: list, phrase: list, f: list) -> None:
        for k, v in zip(out, (lang, n_words, phrase, f), strict=True):
            out[k] += v

    for n_words in (1, 2):
        levels: list[list[tuple]] = []
        for r in table.filter(pc.equal(table["n_words"], n_words)).select(["nodes", "counts", "kids"]).to_pylist():
            names, counts, kids = _lines(_unpack(r["nodes"])), np.frombuffer(_unpack(r["counts"]), "<u4"), np.frombuffer(_unpack(r["kids"]), "<u4").astype(np.int64)
            a, k, d, size = 0, 0, 0, len(counts) - int(kids.sum())
            while True:
                if d == len(levels):
                    levels.append([])
                own = kids[k : k + size] if len(kids) > k else None
                levels[d].append((names.slice(a, size), counts[a : a + size].astype(np.int64), own))
                if own is None:
                    break
                a, k, d, size = a + size, k + size, d + 1, int(own.sum())
        up = names = tongue = None
        for d, parts in enumerate(levels):
            told = pa.chunked_array([x for x, _, _ in parts], pa.large_binary()).combine_chunks().dictionary_encode()
            code, count = told.indices.to_numpy().astype(np.int64), np.concatenate([c for _, c, _ in parts])
            n = max(1, len(told.dictionary))
            if d == 0:
                node = code
                total = np.zeros(len(told.dictionary), np.int64)
                np.add.at(total, code, count)
                keep = total >= least
                found = [x.split(b" ", 1) for x in told.dictionary.filter(pa.array(keep)).to_pylist()]
                tongue, names = [bytes.fromhex(x.decode()).decode() for x, _ in found], pa.array([x for _, x in found], pa.large_binary())
                if n_words == 1:
                    sums: dict[bytes, int] = {}
                    for line, f in zip(told.dictionary.to_pylist(), total.tolist(), strict=True):
                        mark = line[: line.index(b" ")]
                        sums[mark] = sums.get(mark, 0) + f
                    add([bytes.fromhex(m.decode()).decode() for m in sums], [0] * len(sums), [None] * len(sums), list(sums.values()))
            else:
                live = up >= 0
                distinct, node_live = np.unique(up[live] * n + code[live], return_inverse=True)
                total = np.zeros(len(distinct), np.int64)
                np.add.at(total, node_live, count[live])
                node = np.full(len(code), -1)
                node[live] = node_live
                keep = total >= least
                at = distinct[keep]
                names = pc.binary_join_element_wise(told.dictionary.take(pa.array(at % n)), names.take(pa.array(at // n)), _bytes(b" "))
                tongue = [tongue[i] for i in (at // n).tolist()]
            number = np.full(len(keep) + 1, -1)
            number[:-1][keep] = np.arange(int(keep.sum()))
            add(tongue, [n_words + d] * len(names), names.to_pylist(), total[keep].tolist())
            if d + 1 < len(levels):
                # A level's rows lie block by block; every block has rows of all levels above its deepest.
                up = np.concatenate([np.repeat(number[node[i : i + len(c)]], own) for i, (_, c, own) in zip(np.cumsum([0] + [len(c) for _, c, _ in parts[:-1]]), parts, strict=True) if own is not None])
    kinds = {"lang": pa.string(), "n_words": pa.int32(), "phrase": pa.binary(), "f": pa.int64()}
    made = pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})
    return made.set_column(2, "phrase", made["phrase"].cast(pa.string()))


def phrase_counts(docs: DataFrame, most_words: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, n_words, phrase, f): phrases of 1 to most_words words that occur at least `least` times in
    the texts of a lang; rows of n_words 0 (phrase null) hold word occurrences, to be summed by lang."""
    if most_words < 1 or least < 1:
        raise ValueError("most_words and least must be at least 1")
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    frags = 2 * max(shuffle_partitions(docs.sparkSession), rows.rdd.getNumPartitions())
    blocks = rows.mapInArrow(partial(_shards, most_words=most_words, frags=frags), BLOCKS)
    return per_group(blocks, "frag", _summed, COUNTED, least=least)


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, top: int = 2000, inside: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's `top` phrases of 2 to most_words words.

    score = floor(10^6 a^2 / (l r)) of the lowest-scoring cut, l and r the counts of its parts. A
    phrase inside a longer one that occurs at least `inside` percent as often is left out."""
    counted = materialize(phrase_counts(docs, most_words, least, text_col, lang_col), "phrases")
    n = counted.where("n_words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    found = counted.where("n_words >= 2").select("lang", "n_words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    piece = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cuts = found.select("lang", "phrase", "n_words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), piece(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("left"), piece(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("part")),
    )).alias("s")).select("lang", "phrase", "a", "k", "s.left", "s.part")
    parts = counted.where(F.col("n_words").between(1, most_words - 1)).select("lang", F.col("phrase").alias("part"), "f")
    met = sides.join(parts, ["lang", "part"]).groupBy("lang", "phrase", "k").agg(
        F.max("a").alias("a"), F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    d = lambda c: F.col(c).cast("decimal(15,0)").cast("decimal(38,0)")
    met = met.withColumns({"num": d("a") * d("a") * F.lit(1000000).cast("decimal(38,0)"), "den": d("l") * d("r")}).withColumn("score", F.expr("cast(num div den as bigint)"))
    # What stands inside a longer phrase stands in its suffix link or in it less its last word, of which
    # neither is rarer: so these two alone decide.
    around = found.where("n_words >= 3").select("lang", "a", F.explode(F.array(piece(F.lit(2), F.col("n_words") - 1), piece(F.lit(1), F.col("n_words") - 1))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    best = met.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", "b.score")


def op11_suffix_automata(spark, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of 2 to 3 words of each language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
g AS MATERIALIZED (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(m)) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
c AS MATERIALIZED (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS p FROM g WHERE m >= 2),
x AS MATERIALIZED (SELECT lang, phrase, m, a, k, array_to_string(p[1:k], ' ') AS lp, array_to_string(p[k + 1:m], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
k AS (SELECT x.lang, x.phrase, x.m, a, k, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM x JOIN g l ON l.lang = x.lang AND l.phrase = lp JOIN g r ON r.lang = x.lang AND r.phrase = rp),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS q FROM k) WHERE q = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(p[1:2], ' ') AS phrase FROM c WHERE m = 3 UNION ALL SELECT lang, a, array_to_string(p[2:3], ' ') FROM c WHERE m = 3) GROUP BY ALL),
s AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase AND b.m = 2 WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT s.lang, rank, phrase, a, l, r, n, score FROM s JOIN n USING (lang) WHERE rank <= 2000
"""
