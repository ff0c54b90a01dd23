"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes; it is cut into fragments, and
each fragment is one group that knows every holder of its n-grams:

1. every document becomes the set of its distinct word n-grams; equal sets form a class (a
   64-bit digest of set and size stands for it), so copies cost nothing from here on;
2. fragments count the holders (df) of each n-gram and pass on those held twice or more;
3. per class, n-grams are ordered by (df, hash), those of df 1 first. Two sets with Jaccard
   >= t meet among the first n - ceil(t n) + 1 n-grams of each; a class with fewer shared
   n-grams than ceil(t n) cannot link at all and drops out here, exactly;
4. fragments count partial overlaps of each n-gram's most central holder (largest shared
   part) with its other holders; the sums per pair prove most links with one row per member
   instead of one per pair;
5. in `chance_rounds` rounds each place in a prefix proposes its next holder of another
   component, in a random order, and two of those that pass the bounds of the last round;
   proposals are verified on their n-grams and links join components, so that groups of near
   copies grow together at a cost linear in their size;
6. last, all pairs of different components that meet in their prefixes are found per fragment, at
   n-grams from which on both hold enough shared n-grams for a link (the first that two linked
   sets share is such a one); those whose bitmaps do not rule a link out are listed, verified
   and added. Pairs inside one component cannot change it and are not listed.

The components are therefore exact at any size of group.

Edge cases: null, empty or blank texts have an empty set and link with nothing; texts with
fewer words than n have one n-gram, the whole sequence; repeated rows and equal texts share a
class; texts of any length are read whole; null ids take part and name no component;
an empty table gives an empty result; other columns,
of whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, connected_components, joined, lookup, materialize, mix64, per_group, text_chunks, tidy, word_bounds, word_hashes

#: n-grams that one fragment should hold, and the least number of fragments.
PER_FRAGMENT, LEAST_FRAGMENTS = 1_000_000, 32
#: Words of a class's bitmap: one bit for each shared n-gram, by its hash.
BITMAP = 64
_STEP = [np.uint64(x) for x in np.random.default_rng(5).integers(1, 1 << 62, 64) * 2 + 1]


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text of an Arrow column."""
    for a, b, buf, offs in text_chunks(column, 1 << 19):
        buf = LOWER[buf]
        start, end = word_bounds(buf, offs)
        h = word_hashes(buf, start, end)
        first = np.searchsorted(start, offs)  # word number at each document's start
        grams = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            grams += h[k : len(h) - width + 1 + k] * _STEP[k]
        grams = mix64(grams)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= width:
                yield a + i, np.unique(grams[lo : hi - width + 1])
            elif hi > lo:
                part = h[lo:hi] * np.array(_STEP[: hi - lo])
                yield a + i, mix64(np.append(part, np.uint64(hi - lo)).cumsum(dtype=np.uint64)[-1:])
            else:
                yield a + i, np.empty(0, np.uint64)


def set_digest(grams: np.ndarray) -> int:
    """A signed 64-bit digest of a set; equal sets agree."""
    x = mix64(grams ^ np.uint64(0xA0761D6478BD642F))
    return int(mix64(np.append(x, np.uint64(len(grams))).cumsum(dtype=np.uint64)[-1:]).view(np.int64)[0])


@tidy
def _classes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for i, grams in shingle_sets(batch.column(1), width):
            n[i] = len(grams)
            digest[i] = set_digest(grams) if len(grams) else 0
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(digest, mask=n == 0)], ["doc_id", "n_shingles", "cls"]
        )


RUNS = "frag int, tok binary, cls binary, n binary, aux binary, cnt binary, bits binary, left binary"


def _packed(tok: np.ndarray, cls: np.ndarray, n: np.ndarray, aux: np.ndarray, cnt: np.ndarray, frags: int, bits: np.ndarray | None = None, left: np.ndarray | None = None) -> pa.RecordBatch | None:
    """Rows of RUNS: per fragment its n-grams and the runs (class, size, aux, length) they come in; bits are of runs, left of n-grams."""
    if not len(tok):
        return None
    frag = ((tok >> np.uint64(40)) * np.uint64(frags) >> np.uint64(24)).astype(np.int32)
    run = np.repeat(np.arange(len(cnt)), cnt)
    order = np.argsort(frag, kind="stable")
    frag, run, tok = frag[order], run[order], tok[order]
    left = None if left is None else left[order]
    cut = np.flatnonzero(np.diff(frag)) + 1
    edge = np.concatenate([[0], np.flatnonzero((np.diff(run) != 0) | (np.diff(frag) != 0)) + 1, [len(run)]])
    heads, sizes = run[edge[:-1]], np.diff(edge).astype(np.int32)
    bounds = np.concatenate([[0], cut, [len(tok)]])
    at = np.searchsorted(edge[:-1], bounds)
    out: dict[str, list] = {k: [] for k in ("frag", "tok", "cls", "n", "aux", "cnt", "bits", "left")}
    for k in range(len(bounds) - 1):
        a, b, r = bounds[k], bounds[k + 1], slice(at[k], at[k + 1])
        out["frag"].append(int(frag[a]))
        out["tok"].append(tok[a:b].tobytes())
        for name, values in (("cls", cls), ("n", n), ("aux", aux)):
            out[name].append(values[heads[r]].tobytes())
        out["cnt"].append(sizes[r].tobytes())
        out["bits"].append(b"" if bits is None else bits[heads[r]].tobytes())
        out["left"].append(b"" if left is None else left[a:b].tobytes())
    kinds = [pa.int32()] + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


@tidy
def _cut_texts(batches: Iterator[pa.RecordBatch], width: int, frags: int, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    sets: dict[int, np.ndarray] = {}

    def flush():
        if not sets:
            return None
        cls = np.fromiter(sets, np.int64, len(sets))
        cnt = np.array([len(s) for s in sets.values()], np.int64)
        return _packed(np.concatenate(list(sets.values())), cls, cnt.astype(np.int32), np.zeros(len(cls), np.int64), cnt, frags)

    held = 0
    for batch in batches:
        for _, grams in shingle_sets(batch.column(0), width):
            if len(grams) and (key := set_digest(grams)) not in sets:
                sets[key] = grams
                held += len(grams)
                if held >= most:
                    yield flush()
                    sets, held = {}, 0
    if sets:
        yield flush()


class _Fragment:
    """All n-grams of one fragment: token, and the number of the run (class) each is of."""

    def __init__(self, table: pa.Table):
        tok, cnt = joined(table["tok"], np.uint64), joined(table["cnt"], np.int32)
        self.cls, self.n = joined(table["cls"], np.int64), joined(table["n"], np.int32)
        self.aux, self.bits = joined(table["aux"], np.int64), joined(table["bits"], np.uint64).reshape(-1, BITMAP + 1)
        self.left = joined(table["left"], np.int32)
        # Equal sets that came from several batches: one run of each class stays.
        once = np.zeros(len(self.cls), bool)
        once[np.unique(self.cls, return_index=True)[1]] = True
        if once.all():
            self.tok, self.cnt = tok, cnt
        else:
            held = np.repeat(once, cnt)
            self.tok, self.cnt = tok[held], cnt[once]
            self.left = self.left[held] if len(self.left) else self.left
            self.bits = self.bits[once] if len(self.bits) else self.bits
        self.cls, self.n, self.aux = self.cls[once], self.n[once], self.aux[once]
        self.run = np.repeat(np.arange(len(self.cnt), dtype=np.int32), self.cnt)
        self.order = np.argsort(self.tok, kind="stable")
        sorted_tok = self.tok[self.order]
        self.first = np.concatenate([[0], np.flatnonzero(np.diff(sorted_tok)) + 1]) if len(tok) else np.empty(0, np.int64)
        self.df = np.diff(np.concatenate([self.first, [len(sorted_tok)]])) if len(tok) else np.empty(0, np.int64)


def _shared(table: pa.Table, frags: int) -> pa.Table:
    """The n-grams of a fragment that several classes hold, with df, by class bucket."""
    f = _Fragment(table)
    df = np.empty(len(f.tok), np.int64)
    df[f.order] = np.repeat(f.df, f.df)
    keep = df > 1
    out: dict[str, list] = {k: [] for k in ("bucket", "tok", "df", "cls", "n", "cnt")}
    if keep.any():
        tok, df, run = f.tok[keep], df[keep].astype(np.int32), f.run[keep]
        heads, cnt = np.unique(run, return_counts=True)
        bucket = (f.cls[heads].view(np.uint64) % np.uint64(frags)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        begin = np.concatenate([[0], np.cumsum(cnt)])
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            runs = order[a:b]
            at = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in runs])
            out["bucket"].append(int(bucket[runs[0]]))
            out["tok"].append(tok[at].tobytes())
            out["df"].append(df[at].tobytes())
            out["cls"].append(f.cls[heads[runs]].tobytes())
            out["n"].append(f.n[heads[runs]].tobytes())
            out["cnt"].append(cnt[runs].astype(np.int32).tobytes())
    kinds = [pa.int32()] + [pa.binary()] * 5
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def _survivors(table: pa.Table, percent: int) -> pa.Table:
    """Classes whose shared n-grams reach the least overlap a link needs, n-grams by (df, hash)."""
    tok, cnt = joined(table["tok"], np.uint64), joined(table["cnt"], np.int32)
    df = joined(table["df"], np.int32)
    key, size = joined(table["cls"], np.int64), joined(table["n"], np.int32)
    cls = np.repeat(key, cnt)
    names, where, shared = np.unique(cls, return_index=True, return_counts=True)
    n = np.repeat(size, cnt)[where].astype(np.int64)
    prefix = shared - (percent * n + 99) // 100 + 1
    good = prefix >= 1
    mask = good[np.searchsorted(names, cls)]
    tok, df, cls = tok[mask], df[mask], cls[mask]
    order = np.lexsort((tok, df, cls))
    tok = tok[order]
    bounds = np.concatenate([[0], np.cumsum(shared[good])])
    return pa.table(
        {
            "cls": pa.array(names[good]),
            "n": pa.array(n[good].astype(np.int32)),
            "shared": pa.array(shared[good].astype(np.int32)),
            "prefix": pa.array(prefix[good].astype(np.int32)),
            "tok": pa.array([tok[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
        }
    )


def _bitmaps(toks: list[np.ndarray], rest: np.ndarray) -> np.ndarray:
    """Per class a bit for each of its shared n-grams, and the number of its other n-grams."""
    out = np.zeros((len(toks), BITMAP + 1), np.uint64)
    row, tok = np.repeat(np.arange(len(toks)), [len(t) for t in toks]), np.concatenate(toks)
    place = (tok >> np.uint64(8)) % np.uint64(64 * BITMAP)
    np.bitwise_or.at(out, (row, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    out[:, BITMAP] = rest
    return out


@tidy
def _cut_classes(batches: Iterator[pa.RecordBatch], frags: int, prefixes: bool) -> Iterator[pa.RecordBatch]:
    """Classes (cls, n, shared, prefix, tok, aux) to RUNS; only the prefixes, with bitmaps and the
    number of shared n-grams from each on, if so asked."""
    for batch in batches:
        whole = [np.frombuffer(t, np.uint64) for t in batch["tok"].to_pylist()]
        left = [np.arange(len(t), len(t) - p, -1, dtype=np.int32) for t, p in zip(whole, batch["prefix"].to_pylist(), strict=True)]
        rest = (batch["n"].to_numpy() - batch["shared"].to_numpy()).astype(np.uint64)
        toks = [t[:p] for t, p in zip(whole, batch["prefix"].to_pylist(), strict=True)] if prefixes else whole
        a = 0
        while a < len(toks):
            b, held = a, 0
            while b < len(toks) and held < 500_000:
                held += len(whole[b])
                b += 1
            cols = [batch[c].to_numpy(zero_copy_only=False)[a:b] for c in ("cls", "n", "aux")]
            more = (_bitmaps(whole[a:b], rest[a:b]), np.concatenate(left[a:b])) if prefixes else ()
            out = _packed(np.concatenate(toks[a:b]), *cols, np.array([len(t) for t in toks[a:b]], np.int64), frags, *more)
            if out is not None:
                yield out
            a = b


def _star_overlaps(table: pa.Table) -> pa.Table:
    """Partial overlaps, in one fragment, of each n-gram's most central holder with the others.
    aux is the number of shared n-grams of a class."""
    f = _Fragment(table)
    rank = np.empty(len(f.cls), np.int64)
    rank[np.lexsort((f.cls, -f.aux / np.maximum(f.n, 1)))] = np.arange(len(f.cls))
    if not len(f.tok):
        return pa.table({k: pa.array([], t) for k, t in (("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("c", pa.int64()))})
    at = np.empty(len(rank), np.int64)
    at[rank] = np.arange(len(rank))
    run = f.run[f.order]
    lead = at[np.repeat(np.minimum.reduceat(rank[run], f.first), f.df)]
    other = lead != run
    pair, c = np.unique(lead[other] * len(rank) + run[other], return_counts=True)
    a, b = pair // len(rank), pair % len(rank)
    return pa.table({"a": f.cls[a], "b": f.cls[b], "na": f.n[a], "nb": f.n[b], "c": c})


def _crossing(table: pa.Table, percent: int, salt: int | None = None) -> pa.Table:
    """Pairs of classes of different components (aux) that meet in a prefix and whose sizes allow a
    link: all that may link, or, with a salt, at most three for each place in a prefix.

    Two sets that link share so many n-grams that, at the first they share, either holds (n of both)
    * percent / (100 + percent) shared n-grams or more from there on. So a holder reaches partners up
    to a size, and pairs that do not reach each other at an n-gram are left to others. Bits that
    differ and n-grams that no other class holds are each an n-gram of one side only; pairs with more
    of these than a link allows are none (never a link lost: the count is a lower bound)."""
    f = _Fragment(table)

    def may(x, y) -> np.ndarray:
        apart = np.bitwise_count(f.bits[x, :BITMAP] ^ f.bits[y, :BITMAP]).sum(-1, dtype=np.int64) + (f.bits[x, BITMAP] + f.bits[y, BITMAP]).astype(np.int64)
        return apart * (100 + percent) <= (f.n[x].astype(np.int64) + f.n[y]) * (100 - percent)

    def possible(pairs: list[np.ndarray]) -> np.ndarray:
        pair = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        good = np.empty(len(pair), bool)
        for k in range(0, len(pair), 20_000):
            x, y = pair[k : k + 20_000] // len(f.cls), pair[k : k + 20_000] % len(f.cls)
            good[k : k + 20_000] = may(x, y)
        return pair[good]

    def mixed(first: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first)

    tok, run = f.tok[f.order], f.run[f.order].astype(np.int64)
    found: list[np.ndarray] = []
    held, most = 0, 2_000_000
    if len(run) and salt is not None:
        comp = f.aux[run]
        some = mixed(f.first)
        for a, m in zip(f.first[some], f.df[some], strict=True):
            runs = run[a : a + m]  # each holder with the next in a random order
            runs = runs[np.argsort(mix64(f.cls[runs].view(np.uint64) ^ mix64(tok[a : a + 1] + np.uint64(salt))), kind="stable")]
            x, y = runs[:-1], runs[1:]
            small, large = np.minimum(f.n[x], f.n[y]).astype(np.int64), np.maximum(f.n[x], f.n[y]).astype(np.int64)
            fit = (f.aux[x] != f.aux[y]) & (small * 100 >= large * percent)
            found.append(np.minimum(x, y)[fit] * len(f.cls) + np.maximum(x, y)[fit])
    if len(run):
        # By n-gram and size; holders that reach none of the n-gram's sizes leave.
        at = np.lexsort((f.n[run], tok))
        tok, run, n = tok[at], run[at], f.n[run[at]].astype(np.int64)
        reach = f.left[f.order][at].astype(np.int64) * (100 + percent) // percent - n
        alive = (reach >= np.repeat(n[f.first], f.df)) & (n <= np.repeat(np.maximum.reduceat(reach, f.first), f.df))
        tok, run, n, reach = tok[alive], run[alive], n[alive], reach[alive]
        comp = f.aux[run]
        first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])) if len(tok) else np.empty(0, np.int64)
        df = np.diff(np.append(first, len(tok)))
        some = mixed(first) if len(tok) else np.empty(0, bool)
        for a, m in zip(first[some], df[some], strict=True):
            runs, size, far, c = run[a : a + m], n[a : a + m], reach[a : a + m], comp[a : a + m]
            low = np.searchsorted(size, -(-size * percent // 100), "left")
            high = np.searchsorted(size, np.minimum(size * 100 // percent, far), "right")
            names, count = np.unique(c, return_counts=True)
            for i in np.flatnonzero((c != names[np.argmax(count)]) & (low < high)):  # pairs inside the largest component are none
                if salt is None:
                    j = np.arange(low[i], high[i])
                else:  # a few of those in reach, by chance
                    dice = mix64(np.arange(min(high[i] - low[i], 64), dtype=np.uint64) + mix64(f.cls[runs[i : i + 1]].view(np.uint64) ^ mix64(tok[a : a + 1] + np.uint64(salt))))
                    j = low[i] + (np.argsort(dice) if high[i] - low[i] <= 64 else (dice % np.uint64(high[i] - low[i])).astype(np.int64))
                j = j[(c[j] != c[i]) & (far[j] >= size[i])]
                if salt is not None and len(j):
                    j = j[may(runs[i], runs[j])][:2]
                if len(j):
                    found.append(np.minimum(runs[i], runs[j]) * len(f.cls) + np.maximum(runs[i], runs[j]))
                    held += len(j)
            if held > most:
                found = [possible(found)]
                held = len(found[0])
                most = 2_000_000 + 2 * held
    pair = possible(found)
    return pa.table({"a": f.cls[pair // max(1, len(f.cls))], "b": f.cls[pair % max(1, len(f.cls))]})


@tidy
def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, ta, tb) to (a, b, na, nb, c)."""
    for batch in batches:
        c = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True)) for x, y in zip(batch["ta"].to_pylist(), batch["tb"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch[k] for k in ("a", "b", "na", "nb")), pa.array(c, pa.int64())], ["a", "b", "na", "nb", "c"])


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, chance_rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): components of the links 100 |A & B| >= percent |A | B|."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    light = materialize(
        texts.mapInArrow(partial(_classes, width=width), "doc_id long, n_shingles long, cls long"), "sets"
    )
    total = light.agg(F.sum("n_shingles")).first()[0] or 0
    frags = max(LEAST_FRAGMENTS, -(-total // PER_FRAGMENT))
    enough = f"100 * c >= {percent} * (na + nb - c)"

    runs = texts.select("text").mapInArrow(partial(_cut_texts, width=width, frags=frags), RUNS)
    shared = per_group(
        runs, "frag", _shared, "bucket int, tok binary, df binary, cls binary, n binary, cnt binary", frags=frags
    )
    near = materialize(
        per_group(shared, "bucket", _survivors, "cls long, n int, shared int, prefix int, tok binary", percent=percent),
        "near",
    )
    frags = max(LEAST_FRAGMENTS, -(-(near.agg(F.sum(F.col("shared").cast("long"))).first()[0] or 0) // PER_FRAGMENT))
    cut = near.withColumn("aux", F.col("shared").cast("long"))
    runs = cut.mapInArrow(partial(_cut_classes, frags=frags, prefixes=False), RUNS)
    stars = (
        per_group(runs, "frag", _star_overlaps, "a long, b long, na int, nb int, c long")
        .groupBy("a", "b")
        .agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"))
        .where(enough)
    )
    links = materialize(stars.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    first = materialize(connected_components(links), "comp")
    comp, known = first, first.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    a = near.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tok").alias("ta"))
    b = near.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tok").alias("tb"))
    for salt in (*range(1, chance_rounds + 1), None):
        cut = near.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select(
            *near.columns, F.coalesce("component", "cls").alias("aux")
        )
        runs = cut.mapInArrow(partial(_cut_classes, frags=frags, prefixes=True), RUNS)
        pairs = per_group(runs, "frag", _crossing, "a long, b long", percent=percent, salt=salt).distinct()
        more = (
            pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ta", "tb")
            .mapInArrow(_overlap, "a long, b long, na int, nb int, c long")
            .where(enough)
        )
        more = materialize(more.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        if not more.isEmpty():
            comp = materialize(connected_components(known.union(more)), "comp")
            known = comp.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    classes = light.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("held"))
    classes = materialize(classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left"), "classes")
    # Classes of one document and no link keep its id; only the others are looked up.
    alone = classes.where("component is null and held > 1").select("cls", "held", F.col("least").alias("component_id"))
    linked = classes.where("component is not null")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("held"))
    named = lookup(linked, materialize(least, "least"), "component", linked.count()).select("cls", "held", "component_id")
    found = lookup(light, materialize(alone.unionByName(named), "named"), "cls", light.count())
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
