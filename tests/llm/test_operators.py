"""The training-data operators against brute force on small tables, edge cases included."""

from __future__ import annotations

import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genoweft.llm import common, context_mixing, html_text, language_net, ngram_join, piece_codec, projection_forest, simhash, source_mix, token_counts, toxicity

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te") for b in ("sa", "no", "vi", "du", "pe")]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cls string")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 60))) for _ in range(40)]
    for t in texts[:20]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[rnd.randrange(len(v))] = rnd.choice(WORDS)
            texts.append(" ".join(v))
    texts += [None, "", " \n\t", "One", texts[0], texts[0].upper(), "a b c d", "é " * 30]
    return [(i, t, "en" if i % 2 else "de", None if i % 7 == 0 else f"s{i % 3}", 0, "x") for i, t in enumerate(texts)]


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))


def test_jaccard_components(spark, rows):
    sets = {}
    for i, t, *_ in rows:
        w = _words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(_docs(spark, rows)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def _near_copies(rnd, count, edits, size=400):
    """Texts of `size` words, each a copy of one text with some of `edits` words of its own."""
    base = [f"w{k}" for k in range(size)]
    out = []
    for i in range(count):
        v = list(base)
        for k in rnd.sample(range(size), rnd.choice(edits)):
            v[k] = f"x{i}y{k}"
        out.append(" ".join(v))
    return out


def _crossing_of(texts, percent=80):
    """Pairs (places of texts) that the last round lists when no two texts are joined yet, and their sets."""
    sets = [g for _, g in ngram_join.shingle_sets(pa.array(texts), 5)]
    df = Counter(x for g in sets for x in g.tolist())
    cols = {k: [] for k in ("cls", "n", "shared", "prefix", "tok", "aux")}
    for i, g in enumerate(sets):
        tok = sorted((x for x in g.tolist() if df[x] > 1), key=lambda x: (df[x], x))
        prefix = len(tok) - -(-percent * len(g) // 100) + 1
        if prefix >= 1:
            for k, v in zip(cols, (i, len(g), len(tok), prefix, np.array(tok, np.uint64).tobytes(), i), strict=True):
                cols[k].append(v)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)], list(cols))
    listed = set()
    for part in ngram_join._cut_classes([batch], 4, True):
        for k in range(len(part)):
            found = ngram_join._crossing(pa.Table.from_batches([part.slice(k, 1)]), percent)
            listed |= {(min(a, b), max(a, b)) for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist())}
    return listed, sets


def test_crossing_leaves_out_hopeless_pairs(monkeypatch):
    """Near copies that all meet at the same n-grams, but are each too far from any other, are not paired."""
    seen = []
    count = np.bitwise_count
    monkeypatch.setattr(ngram_join.np, "bitwise_count", lambda x: seen.append(len(x)) or count(x))
    listed, _ = _crossing_of(_near_copies(random.Random(3), 200, [11, 12, 13]))
    assert not listed
    assert sum(seen) < 1000  # all pairs, in each of four fragments: 4 * 200 * 199 / 2


@pytest.mark.parametrize(("edits", "size"), [([0, 1, 4, 8, 9, 12], 400), ([0, 1, 2, 3], 60), ([0, 1], 14)])
def test_crossing_by_brute_force(edits, size):
    rnd = random.Random(8)
    texts = _near_copies(rnd, 60, edits, size)
    texts += [t[: rnd.randrange(len(t) * 6 // 10, len(t))] for t in texts[:40]]  # other sizes
    texts = list(dict.fromkeys(texts))
    listed, sets = _crossing_of(texts)
    sets = [set(g.tolist()) for g in sets]
    links = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links and links <= listed


@pytest.mark.parametrize("rounds", [0, 1])
def test_near_copy_components(spark, rounds):
    texts = _near_copies(random.Random(5), 70, [2, 4, 5, 8, 9, 12], 300)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    least = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if least[a] != least[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((least[a], least[b]))
            least = [x if c == y else c for c in least]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, chance_rounds=rounds).collect()}
    assert got == dict(enumerate(least)) and 1 < len({*least}) < len(least)


def test_components_agree(spark, monkeypatch):
    rnd = random.Random(2)
    edges = spark.createDataFrame([(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)], "u long, v long")
    one = {tuple(r) for r in common.connected_components(edges).collect()}
    monkeypatch.setattr(common, "ONE_TASK_EDGES", -1)
    assert one == {tuple(r) for r in common.connected_components(edges).collect()}


@pytest.mark.parametrize("parts", [1, 3, 1000])
def test_lookup(spark, parts):
    rnd = random.Random(6)
    keys = [7] * 40 + [rnd.randrange(30) for _ in range(60)] + [None] * 5
    left = spark.createDataFrame(list(enumerate(keys)), "i long, k long")
    right = spark.createDataFrame([(k, keys.count(k), f"v{k}") for k in sorted({*keys} - {None, 3})], "k long, held long, v string")
    got = {(r.i, r.k, r.v) for r in common.lookup(left, right, "k", len(keys), parts).collect()}
    assert got == {(i, k, None if k in (None, 3) else f"v{k}") for i, k in enumerate(keys)}


def test_base_score(spark, rows):
    got = context_mixing.score_texts(_docs(spark, rows)).collect()
    tokens = {i: [*_words(t), None] for i, t, *_ in rows}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got:
        ws = tokens[r.doc_id]
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.score < 0
    assert len(got) == len(rows)


def test_followers_by_brute_force():
    rnd = random.Random(6)
    rows = [(rnd.randrange(12), rnd.randrange(4), rnd.randrange(3)) for _ in range(200)]
    ctx, nxt, n = (np.array(x) for x in zip(*rows))
    total = Counter()
    for c, f, k in rows:
        total[c, f] += k

    def state(counts, f):
        best, n = max(counts.values(), default=0), sum(counts.values())
        if n <= 0:
            return 0
        sure = (1 if n == 1 else 2 if n == 2 else 3 if n < 8 else 4) if best == n else 5 if best * 2 > n else 6 if best * 4 > n else 7
        return sure * 2 + (f == min(counts, key=lambda g: (-counts[g], g)))

    got = context_mixing.followers(ctx, nxt, n)
    for (c, f, _), plain, left in zip(rows, *got, strict=True):
        counts = {g: k for (d, g), k in total.items() if d == c}
        assert plain == state(counts, f)
        if counts[f]:
            less = {**counts, f: counts[f] - 1}
            tie = [g for g in less if less[g] == max(less.values())]
            assert left >> 1 == state(less, f) >> 1 and (len(tie) > 1 or left == state(less, f))


def test_cells_by_brute_force():
    rnd = random.Random(7)
    state, doc = np.array([rnd.randrange(16) for _ in range(300)]), np.sort([rnd.randrange(9) for _ in range(300)])
    want = Counter()
    row, last = None, None
    for s, d in zip(state, doc, strict=True):
        if s < 2:
            continue
        row = None if d != last else row
        past = 1 if row is None else 0 if row == 0 else 2 if row < 4 else 3
        want[d, ((s >> 1) * 4 + past) * 2 + (s & 1)] += 1
        row, last = ((row or 0) + 1 if s & 1 else 0), d
    got = context_mixing._cells(state.astype(np.uint8), doc, 9)
    assert {(i, k): v for i, r in enumerate(got) for k, v in enumerate(r) if v} == dict(want)


def test_word_model_is_a_distribution():
    """The costs of all words of up to two letters over a small alphabet, and of the end, leave no probability out and use none twice."""
    code = context_mixing.prefix_code(np.array([50 if b in b"ab \n" else 0 for b in range(256)]))
    assert math.isclose(sum(2.0 ** -float(n) for n in code[1]), 1.0)
    words = [b"", *(bytes(w) for n in (1, 2, 3) for w in itertools.product(b"ab", repeat=n))]
    full = [b"\n" if not w else w for w in words]
    n = np.array([4] + [3 if len(w) == 1 else 0 for w in words[1:]])
    bits = context_mixing.Bits(np.ones(len(full), np.uint8), n, np.array([len(w) for w in full]), np.frombuffer(b"".join(full), np.uint8), code)
    tables = np.zeros((context_mixing.OFFSETS[-1], 2), np.float32)
    for at, bit, slots, _ in bits.steps():
        far = np.flatnonzero(~bits.local[at])
        for i, s in enumerate(slots):
            own = slice(None) if i < 2 else far
            np.add.at(tables, (s, bit[own]), bits.n[at][own])
    mixer = context_mixing.Mixer(tables)
    before = (mixer.cost(bits) * n).sum()
    mixer.learn(bits)
    cost = mixer.cost(bits)
    assert (cost * n).sum() < before and 0.5 < (2.0 ** -cost).sum() <= 1 + 1e-6


def test_scores_know_copies(spark):
    """Texts that others share cost less than their own like; equal texts cost the same; held-out texts beat the base."""
    rnd = random.Random(9)
    make = lambda: " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(120))
    texts = [make() for _ in range(80)]
    texts += texts[:10] + [None, "", "x" * 30_000]
    data = [(i, t, "en", "s", 0, "x") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0, "x"), (None, "kasa", "en", "s", 0, "x")]
    rows = context_mixing.score_texts(_docs(spark, data).withColumn("run", F.lit(1)).withColumn("part", F.lit("p"))).collect()
    assert len(rows) == len(data)
    held = {i for i in range(len(data)) if zlib.crc32(str(i).encode()) % 7 == 2}
    per = {r.doc_id: r.score / r.n_tokens for r in rows}
    twice = [i for i in range(10) if i not in held and i + 80 not in held]
    once = [i for i in range(10, 80) if i not in held]
    assert max(once, key=per.get) not in twice and min(per[i] for i in twice) > max(per[i] for i in once) + 0.3
    assert all(math.isclose(per[i], per[i + 80], rel_tol=1e-9) for i in twice if i != 3)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_next_and_fingerprints(spark, rows):
    got = {r.doc_id: r for r in simhash.with_next(_docs(spark, rows)).where("not ghost").collect()}
    for i in range(len(rows)):
        assert got[i].next_text == (rows[(i + 1) % len(rows)][1] or "")
    fps = {r["k"]: r["fp"] for r in simhash.add_fingerprints(spark.createDataFrame([(i, t or "") for i, t, *_ in rows], "k long, t string"), ["k"], "t").collect()}
    same = [i for i, t, *_ in rows if t == rows[0][1]]
    assert len(same) > 1 and len({fps[i] for i in same}) == 1
    table = spark.createDataFrame([(v,) for v in fps.values()], "fp long")
    for r in simhash.count_near(table, table, 3).collect():
        assert r.n_near == sum(bin((r.fp ^ v) & (2**64 - 1)).count("1") <= 3 for v in fps.values())


def test_mix(spark, rows):
    got = source_mix.mix_sources(_docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    targets = {r.source_size: r.target for r in got}
    assert math.isclose(sum(targets.values()), 1.5 * total, rel_tol=1e-9)
    assert sorted(map(tuple, got)) == sorted(map(tuple, source_mix.mix_sources(_docs(spark, rows)).collect()))


def _brute_mix(rows, draw, power=0.5, top_ups=3):
    """Copies of each row by the definition: targets by water filling, certain documents found one by one, order sampling, top-ups."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    key = lambda s: (s is None, s or "")
    names = sorted({r[3] for r in rows}, key=key)
    own = {n: [k for k, r in enumerate(rows) if r[3] == n] for n in names}
    total = {n: sum(sizes[k] for k in own[n]) for n in names}
    weight, fixed, left = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}, {}, 1.5 * sum(total.values())
    while True:
        free = [n for n in names if n not in fixed]
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 2 * total[n] + 1e-9]
        if not over:
            break
        for n in over:
            fixed[n] = 2.0 * total[n]
            left -= fixed[n]
    target = {**share, **fixed}
    copies = [0] * len(rows)
    for n in names:
        whole = int(target[n] // total[n]) if total[n] else 0
        rest = target[n] - whole * total[n]
        pool, sure = [k for k in own[n] if sizes[k]], []
        while pool:
            factor = (rest - sum(sizes[k] for k in sure)) / sum(sizes[k] ** (power + 1) for k in pool)
            big = [k for k in pool if factor * sizes[k] ** power >= 1]
            if not big:
                break
            sure += big
            pool = [k for k in pool if k not in big]
        odds = lambda p: p / (1 - p)
        order = sorted(pool, key=lambda k: (math.log(odds(draw[k])) - math.log(odds(max(factor * sizes[k] ** power, 1e-12))), rows[k][0] or -1))
        held, taken = sum(sizes[k] for k in sure), set(sure)
        for k in order:
            held += sizes[k]
            if held > rest:
                break
            taken.add(k)
        for _ in range(top_ups):
            gap = rest - sum(sizes[k] for k in taken)
            fit = [k for k in pool if k not in taken and sizes[k] <= gap]
            if fit:
                most = max(sizes[k] for k in fit)
                taken.add([k for k in order if k in fit and sizes[k] == most][-1])
        for k in own[n]:
            copies[k] = whole + (k in taken)
    return copies


def test_mix_by_brute_force(spark, rows):
    rnd = random.Random(8)
    data = [r for r in rows] + [(1000 + i, "w " * n, "en", "s1", 0, "x") for i, n in enumerate([900, 500, 3, 2])] + [(2000 + i, "v " * rnd.randrange(1, 9), "en", "tiny", 0, "x") for i in range(5)]
    table = _docs(spark, data)
    u = {r.doc_id: r.u for r in table.select("doc_id", ((F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u")).collect()}
    got = {r.doc_id: r.copies for r in source_mix.mix_sources(table).collect()}
    assert got == {r[0]: c for r, c in zip(data, _brute_mix(data, [u[r[0]] for r in data]), strict=True)}


def test_mix_buckets_are_bounded(spark):
    """A source at its cap, with nothing left to sample, and one of tiny probabilities part as well as others."""
    n = 40_000
    sizes = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("skey"), (F.col("id") % 300 + 1).alias("size"))
    hist = sizes.groupBy("skey", "size").agg(F.count("*").alias("m"))
    source = spark.createDataFrame([("a", n // 2, 0.0), ("b", n // 2, 500.0)], "skey string, n long, rest double")
    got = source_mix.ranked(sizes, source_mix.inclusion(hist, source, 0.5), 0.5, 1).groupBy("skey", "bucket").count().collect()
    assert sum(r["count"] for r in got) == n and max(r["count"] for r in got) <= 1.3 * source_mix.PER_BUCKET


def test_mix_edges(spark):
    data = [(1, "a b", "en", "s", 0, "x")] * 3 + [(None, "c d e", "en", "s", 0, "x")] * 2 + [(4, None, "en", None, 0, "x"), (5, "word " * 60_000, "en", "t", 0, "x")]
    got = source_mix.mix_sources(_docs(spark, data)).collect()
    assert len(got) == len(data) and all(r.taken <= 2 * r["size"] for r in got) and max(r["size"] for r in got) == 60_000


def test_parity_with_sentencepiece():
    rnd = random.Random(1)
    signs = " \n\t()abté中.▁12"
    texts = ["", "a  b", "    a", "<s> x"] + ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(500)]
    assert all(piece_codec.parity(texts))


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


@pytest.mark.parametrize("fallback", [0, 1])
def test_unigram_parity(tmp_path, fallback):
    """A hand-written unigram model: plain text never becomes a control, unknown or byte piece."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if fallback]
    rnd = random.Random(3)
    pieces += [(c, -5.0 - rnd.random(), 1) for c in "abct<>/s0x41 unk".replace(" ", "▁")]
    pieces += [(p, -2.0 - 3 * rnd.random(), 1) for p in ("▁a", "ab", "▁ab", "cab", "bc", "▁t", "▁<", "s>", "un", "▁▁")]
    seen, kept = set(), []
    for p in pieces:
        if p[0] not in seen:
            kept.append(p)
            seen.add(p[0])
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, t)) for p, s, t in kept)
    data += _field(2, _field(3, 1) + _field(4, len(kept)) + _field(35, fallback)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1))
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(data)
    texts = ["<s> x", "</s>", "<unk>", "<0x41>", "ab cab", "", "é中 a", "a  b", " ⁇ "] + ["".join(rnd.choice("abc t<>s/0x41é中") for _ in range(rnd.randrange(30))) for _ in range(300)]
    assert [t for t, same in zip(texts, piece_codec.parity(texts, path), strict=True) if not same] == []


def test_codec_rows(spark, rows):
    got = piece_codec.codec_report(_docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got) and all(r.parity for r in got if r.doc_id % 50 == 0)


def test_parity_of_every_row(spark, rows, monkeypatch):
    docs = _docs(spark, [*rows, (None, "no id 12", "en", "s", 0, "x"), (900, "word " * 80_000, "en", "s", 0, "x"), (900, "tab\tand\nline  two ▁ é中", "en", "s", 0, "x")])
    for whole in (False, True):
        got = piece_codec.codec_report(docs, whole_parity=whole).collect()
        assert len(got) == len(rows) + 3 and all(r.parity is True for r in got)


def test_parity_sees_differences():
    """A wrong unit, wherever it stands, or a wrong normalised text makes parity false."""
    c, theirs = piece_codec.Codec(piece_codec.MODEL), piece_codec.reference_processor(piece_codec.MODEL)
    texts = ["one two", "two three", "a\ttwo b", "four"]
    assert c.encode(texts, theirs=theirs)[2].all()
    c._forget()
    good = c._encode_units

    def wrong(units):
        ids, size = good(units)
        at = np.repeat(np.array([u == "▁two" for u in units]), size)
        return np.where(at, 5, ids).astype(np.int32), size

    c._encode_units = wrong
    assert c.encode(texts, theirs=theirs)[2].tolist() == [False, False, True, True]  # after a tab the unit is "two"
    c._forget()
    c._encode_units, plain = good, c.normalise
    c.normalise = lambda t: plain(t).replace("four", "for")
    assert c.encode(texts, theirs=theirs)[2].tolist() == [True, True, True, False]


def test_forest_finds_links(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    v = np.concatenate([base, base[:30] + 0.05 * rng.normal(size=(30, 16)), base[:5]])
    data = [(i, [float(z) for z in x], i % 30 % 2) for i, x in enumerate(v)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, data0 := [1.0] * 16, None)]
    del data0
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in projection_forest.near_vectors(table, leaf=16).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = np.arange(len(v)) % 30 % 2
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    want = link.sum(1) - 1
    assert len(got) == len(data)
    assert sum(got[i].n_links for i in range(len(v))) >= 0.9 * want.sum() and all(got[i].n_links <= want[i] for i in range(len(v)))
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))


def _brute_forest(data):
    """(n_links, component_id, kept) of each (id, vector, label) row by all pairs."""
    good = lambda v, y: y is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    items = sorted({(i, tuple(v), y) for i, v, y in data if good(v, y)}, key=repr)
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in items]
    near = [[a != b and items[a][2] == items[b][2] and len(unit[a]) == len(unit[b]) and (items[a][1] == items[b][1] or unit[a] @ unit[b] >= 0.93) for b in range(len(items))] for a in range(len(items))]
    out = []
    for i, v, y in data:
        if not good(v, y):
            out.append((i, 0, i, True))
            continue
        at, seen = items.index((i, tuple(v), y)), set()
        todo = [at]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += [m for m in range(len(items)) if near[k][m]]
        least = min((items[k][0] for k in seen if items[k][0] is not None), default=None)
        out.append((i, sum(near[at]), least, i == least))
    return out


@pytest.mark.parametrize("deal", [{}, {"leaf": 30}, {"leaf": 12, "group_rows": 40, "round_levels": 1, "spill": 0.25, "trees": 8}])
def test_forest_by_brute_force(spark, deal):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    v = np.concatenate([base, base[:40] + 0.03 * rng.normal(size=(40, 8)), base[:20] + 0.03 * rng.normal(size=(20, 8)), base[:6]])
    data = [(i, [float(z) for z in x], int(i % 60 % 2)) for i, x in enumerate(v)]
    data += [data[3], data[70], (None, data[5][1], 1), (None, data[5][1], 1), (None, [9.0, -9.0] * 4, 0), (700, [0.5, 1.0], 1), (701, [0.51, 1.0], 1)]
    data += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0] * 8, None), (904, [], 1), (905, [None] * 8, 1), (906, [float("inf")] * 8, 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("cid", F.lit(1)).withColumn("node", F.lit("x"))
    got = Counter(tuple(r) for r in projection_forest.near_vectors(table, **deal).collect())
    want = Counter(_brute_forest(data))
    if not deal:
        assert got == want  # one leaf holds all
    else:  # the forest is approximate: no link too many, nine in ten found
        key = lambda c: {(r[0],): r for r in c}
        a, b = key(got), key(want)
        assert sum(got.values()) == len(data) and all(a[k][1] <= b[k][1] for k in b)
        assert sum(a[k][1] for k in b) >= 0.9 * sum(b[k][1] for k in b) and sum(a[k][2] == b[k][2] for k in b) >= 0.9 * len(b)
    assert projection_forest.near_vectors(table.limit(0)).count() == 0


def test_leaves_have_names_of_their_own():
    """Leaves of different labels, lengths, trees and nodes never share a name."""
    names = []
    for label, dim, tree, node in itertools.product((0, 1, 3, 9), (2, 3, 8), range(12), (1, 2)):
        table = pa.table({"label": [label] * 2, "dim": [dim] * 2, "tree": [tree] * 2, "node": [node] * 2, "cid": [1, 2], "vec": [[1.0] * dim, [2.0] * dim]})
        names += set(projection_forest._leaves(table, 4, 0.05, 11)["leaf"].to_pylist())
    assert len(names) == len(set(names)) == 4 * 3 * 12 * 2


def test_html_blocks():
    page = "<html><head><title>t</title><script>x</p></script></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>Big &amp; bold</h1><p>one\n two<p>three<br>four</article><footer>f</footer>"
    assert [t for z, t in html_text.blocks(page) if z == "main"] == ["Big & bold", "one two", "three", "four"]
    assert html_text.blocks(None) == [] and html_text.blocks("plain") == [("open", "plain")]


def _brute_texts(data, run=10, share=0.5, least=3, main_share=0.8, main_least=5):
    """Boilerplate by comparing all pages of a host, token by token."""
    hosts = {}
    for i, url, html in data:
        hosts.setdefault(re.sub(r"^\w+://([^/]*).*", r"\1", url or ""), []).append((i, html_text.blocks(html)))
    out = {}
    for pages in hosts.values():
        distinct = {tuple(t for _, t in found) for _, found in pages}
        grams = lambda t: [tuple(w[k : k + run]) for w in [t.split(" ")] for k in range(max(1, len(w) - run + 1))]
        on = Counter(g for page in distinct for g in {g for t in page for g in grams(t)})

        def covered(t, part, n):
            hit = [False] * len(t.split(" "))
            for k, g in enumerate(grams(t)):
                if on[g] >= part * len(distinct) and on[g] >= n:
                    hit[k : k + len(g)] = [True] * len(g)
            return hit

        for i, found in pages:
            main = [t for z, t in found if z == "main" and not all(covered(t, main_share, main_least))]
            every, n_open = [], 0
            for z, t in found:
                kept = [w for w, hit in zip(t.split(" "), covered(t, share, least), strict=True) if not hit]
                if z == "main" and t in main:
                    every.append(t)
                elif z == "open" and kept:
                    every.append(" ".join(kept))
                    n_open += len(kept)
            out.setdefault(i, []).append("\n".join(every if n_open > sum(len(t.split(" ")) for t in main) else main))
    return out


def _site_pages(n):
    rnd = random.Random(5)
    say = lambda k: " ".join(rnd.choice(WORDS) + str(rnd.randrange(99)) for _ in range(k))
    menu, notes, share = [say(2) for _ in range(4)], [say(30) for _ in range(8)], say(12)
    data = []
    for i in range(n):
        host = "big" if i % 6 else f"small{i % 5}"
        body = f"<p>{say(40)}</p><p>{notes[rnd.randrange(8)]}</p><p>{share} {say(15)}</p>"
        main = f"<article><h1>{say(5)}</h1><p>{notes[rnd.randrange(8)]}<p>{share}</article>" if i % 4 == 0 else ""
        data.append((i, f"http://{host}/{i}", "".join(f"<div>{m}</div>" for m in menu) + (main + body if i % 8 else main) + "<footer>f</footer>"))
    return data


def test_html_pages_by_brute_force(spark):
    """Menus, share lines and other repeats go, passages that some pages share stay, in hosts of any size and any dealing of them."""
    data = _site_pages(240)
    data += [(500, "http://big/0", data[1][2]), (501, "http://big/0", None), (None, None, "<p>one</p>"), (502, "http://big/x", ""), (1, "http://big/1", data[1][2])]
    table = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("text", F.lit("y"))
    want = {i: sorted(v) for i, v in _brute_texts(data).items()}
    assert any(v != ["\n".join(t for z, t in html_text.blocks(h) if z != "chrome")] for (i, v), (_, _, h) in zip(want.items(), data, strict=False))
    for deal in ({}, {"frag_pages": 20}, {"frag_pages": 7, "part_pages": 50}):
        rows = html_text.main_texts(table.repartition(5), **deal).collect()
        got = {}
        for r in rows:
            got.setdefault(r.page_id, []).append(r.text)
        assert {i: sorted(v) for i, v in got.items()} == want, deal
        assert len(rows) == len(data) and all(r.n_chars == len(r.text) for r in rows)


def test_html_zones():
    main = lambda page: [t for z, t in html_text.blocks(page) if z == "main"]
    assert main('<article><div class="article-header"><h1>Head</h1></div><p class="related-work">one<p class="search-results">two<div class="ad">buy</div></article>') == ["Head", "one", "two"]
    assert main('<main><p>x</p><article class="comment"><p>reader</p></article></main>') == ["x"]
    assert html_text.blocks('<div class="site-header">a</div><div class="cookie-banner">b</div><p>c') == [("chrome", "a"), ("chrome", "b"), ("open", "c")]


def test_html_teaser_and_edges(spark):
    long = " ".join(f"w{k}" for k in range(50_000))
    data = [(1, "http://a/x", "<article><p>teaser</article><div>the body of it</div>"), (2, "http://b/y", "<article><p>t one</article><div>x</div>"), (3, "http://c", f"<p>{long}</p><p>two &amp; three")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_texts(pages).collect()} == {1: "teaser\nthe body of it", 2: "t one", 3: long + "\ntwo & three"}
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_token_rules():
    first, size, starts = np.array([0, 4, 8]), np.array([4, 4, 2]), np.array([0, 5])
    assert token_counts.attribute(first, size, starts, 10, "start")[0].tolist() == [2, 1]
    assert token_counts.attribute(first, size, starts, 10, "majority")[0].tolist() == [1, 2]
    assert token_counts.attribute(first, size, starts, 10, "share")[0].tolist() == [1.25, 1.75]


def test_token_rows(spark, rows):
    got = token_counts.section_tokens(_docs(spark, rows)).collect()
    enc = token_counts.encoder(token_counts.VOCABULARY)[0]
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert all(total[i] == len(enc.encode_ordinary(t or "")) for i, t, *_ in rows)


def test_restoring():
    n = np.zeros(27**3, int)
    batch = pa.RecordBatch.from_pydict({"text": ["idiot stupid trash disgusting scum " * 50]})
    for b in toxicity._letters(iter([batch])):
        n[b["at"].to_numpy()] = b["n"].to_numpy()
    read = toxicity.Reader(toxicity.Restorer(n))
    assert {"idiot", "stupid", "trash", "scum"} <= read("1diot, stuuupid tr@sh and $cum") and "idiot" in read("you i d i o t")
    assert read(None) == set()


def test_restoring_every_place():
    n = np.zeros(27**3, int)
    batch = pa.RecordBatch.from_pydict({"text": ["idiot stupid hate garbage useless die moron " * 50]})
    for b in toxicity._letters(iter([batch])):
        n[b["at"].to_numpy()] = b["n"].to_numpy()
    read = toxicity.Reader(toxicity.Restorer(n))
    seen = {"hat3": "hate", "garbag3": "garbage", "useles$": "useless", "usele55": "useless", "idi07": "idiot", "(hat3!)": "hate", "stuupid": "stupid", "i-d-1-o-t": "idiot", "d.i.e": "die"}
    assert {t: w for t, w in seen.items() if w not in read(f"so {t} it")} == {}
    parted = {"i d 1 0 t": "idiot", "s t u p 1 d": "stupid", "1 d i o t": "idiot", "d i e": "die", "m. o. r. o. n": "moron"}
    assert {t: w for t, w in parted.items() if w not in read(f"they {t}")} == {}
    assert read("1 2 3 and 507") == {"and"}


def test_toxicity_rows(spark, rows):
    docs = _docs(spark, [(i, (t or "") + (" trash" if i % 3 == 0 else ""), *r) for i, t, *r in rows])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(len(rows))], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows) and sum(got[i].predicted == (i % 3 == 0) for i in got) >= 0.9 * len(rows)
    none = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and all(r.score == 0 for r in none)


def test_pipeline_rows(spark, rows, monkeypatch):
    import corpus_pipeline as cp

    long = " ".join(WORDS[:20])
    data = [(1, long, "en", "a", 9), (1, long, "en", "a", 9), (1, "other " + " ".join(WORDS[5:24]), "de", "a", 9), (None, " ".join(WORDS[::-1]), None, None, None), (7, long, "en", "b", 9), (None, None, "en", "b", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    out = Counter(map(tuple, cp.near_duplicates(spark, docs, "").collect()))
    assert out == Counter([data[0], data[2], data[3], data[5]])
    want = Counter()
    for r in source_mix.mix_sources(cp._row(docs), id_col="row").collect():
        want[r.doc_id] += r.copies
    got = Counter(r["row"] for r in cp._row(cp.mixing(spark, docs, "")).collect())
    assert got == +want and sum(got.values()) <= 2 * len(data)
    toxic = {data[2][1]}
    monkeypatch.setattr(cp, "identify", lambda d, keep: d.select("doc_id", F.when(F.col("text").isNull(), "und").otherwise("en").alias("lang_pred"), F.lit(0.9).alias("score"), *[F.col(c).alias(f"kept_{c}") for c in keep]))
    assert Counter(map(tuple, cp.language_id(spark, docs, "").collect())) == Counter(data[:5])
    monkeypatch.setattr(cp, "score_toxicity", lambda d, labels, keep: d.select("doc_id", F.col("text").isin(*toxic).cast("int").alias("predicted"), *[F.col(c).alias(f"kept_{c}") for c in keep]).fillna(0, "predicted"))
    assert Counter(map(tuple, cp.toxicity(spark, docs, "/root/testdata/sf0.001").collect())) == Counter([*data[:2], *data[3:]])


def test_kept_columns(spark, rows):
    docs = _docs(spark, rows)
    want = Counter((i, t) for i, t, *_ in rows)
    for got in (language_net.identify(docs, keep=("doc_id", "text")), toxicity.score_toxicity(docs, spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int"), keep=("doc_id", "text"))):
        assert Counter((r.kept_doc_id, r.kept_text) for r in got.collect()) == want


def test_kept_text_is_sent_once(spark, rows, monkeypatch):
    docs = _docs(spark, rows).withColumn("other", F.concat(F.lit("x"), "text"))
    seen = []
    own = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *a, **k: seen.append(self.columns) or own(self, *a, **k))
    labels = spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")
    for run in (language_net.identify, lambda d, **k: toxicity.score_toxicity(d, labels, **k)):
        for text_col, want in (("text", ["doc_id", "text", "kept_doc_id", "kept_other"]), ("doc_id", ["doc_id", "text", "kept_doc_id", "kept_text", "kept_other"])):
            out = run(docs, text_col=text_col, keep=("doc_id", "text", "other"))
            assert seen[-1] == want
            got = Counter((r.kept_doc_id, r.kept_text, r.kept_other) for r in out.collect())
            assert got == Counter((i, t, None if t is None else "x" + t) for i, t, *_ in rows)


def test_encoding_leaves_no_units():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": [" ".join(WORDS), None, WORDS[0]]})
    got = [x for b in piece_codec._encode(iter([batch]), piece_codec.MODEL) for x in b["ids"].to_pylist()]
    c = piece_codec.codec(piece_codec.MODEL)
    assert not c.known and not len(c.flat)
    assert len(got[0]) and got[1] == [] and len(got[2])
    assert [x for b in piece_codec._encode(iter([batch]), piece_codec.MODEL) for x in b["ids"].to_pylist()] == got


def test_language(spark):
    rnd = random.Random(3)
    make = lambda parts: " ".join("".join(rnd.choice(parts) for _ in range(3)) for _ in range(60))
    data = [(i, make(("th", "er", "ing")) if i % 2 else make(("sch", "ung", "ein")), "en" if i % 2 else "de", "s", 0, "x") for i in range(120)]
    data += [(500, None, "en", "s", 0, "x"), (501, "123 !!", None, "s", 0, "x")]
    got = {r.doc_id: r for r in language_net.identify(_docs(spark, data)).collect()}
    assert got[500].lang_pred == got[501].lang_pred == "und"
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(120))


@pytest.mark.parametrize("run", [ngram_join.jaccard_components, context_mixing.score_texts, source_mix.mix_sources, language_net.identify, token_counts.section_tokens, piece_codec.codec_report, lambda d: toxicity.score_toxicity(d, d.selectExpr("doc_id", "1 AS toxic"))])
def test_empty_tables(spark, run):
    assert run(_docs(spark, [])).count() == 0
