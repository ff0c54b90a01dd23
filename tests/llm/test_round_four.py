"""Phrase collocations, conversation repair and license scans against brute force, edge cases included."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genoweft.llm import collocations, context_mixing, conversation_repair, html_text, language_net, license_scan, projection_forest, source_mix, token_counts
from genoweft.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, phrase string, rank int, frag string"


# ---------------------------------------------------------------- collocations


def _phrases(docs, most=3, least=10, top=2000, inside=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) >= 2 and a >= least}
        rows = []
        for p, a in found.items():
            cuts = [((10**6 * a * a) // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            rows.append((score, a, " ".join(p), count[p[:k]], count[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(rows[:top])]
    return sorted(out)


def _phrase_docs(seed=3, n=60):
    rnd = random.Random(seed)
    words = ["ka", "Lo", "mi", "é", "ru", "ß", "te-x", "o"]
    texts = []
    for _ in range(n):
        t = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", "]) for _ in range(rnd.randrange(1, 80)))
        texts.append((t, rnd.choice(["en", "de", None])))
    return texts + [(None, "en"), ("", "de"), (" .,;\n", None), ("alone", "fr"), ("x y " * 3000, "en"), ("z" * 50_000 + " q ", "en")] + [("same words here again", "it")] * 40


@pytest.mark.parametrize(("most", "least", "top"), [(3, 10, 2000), (4, 3, 25), (2, 1, 10), (1, 1, 5)])
def test_collocations_brute_force(spark, most, least, top):
    docs = _phrase_docs()
    df = spark.createDataFrame([(None if i % 5 == 0 else i, t, g, "p", 1, "f") for i, (t, g) in enumerate(docs)], DOCS).repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(df, most, least, top).collect())
    assert got == _phrases(docs, most, least, top)


def test_collocations_whatever_the_layout(spark):
    docs = _phrase_docs(8, 120)
    df = spark.createDataFrame([(i, t, g, "p", 1, "f") for i, (t, g) in enumerate(docs)], DOCS)
    found = [sorted(tuple(r) for r in collocations.collocations(df.repartition(n)).collect()) for n in (1, 3, 13)]
    assert found[0] == found[1] == found[2] and found[0]


def test_link_tree_counts_end_positions():
    texts = ["a b a b c", "b c. b c", "a b c"]
    column = pa.array(texts)
    buf, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    words, levels = collocations.link_tree(buf, offs, np.zeros(len(column), np.int64), 3)
    names = [w.decode() for w in words.to_pylist()]
    told = [[(names[w],) for w in levels[0][1].tolist()]]
    for up, word, _ in levels[1:]:
        told.append([(names[w], *told[-1][u]) for u, w in zip(up.tolist(), word.tolist(), strict=True)])
    got = {p: c for t, (_, _, n) in zip(told, levels, strict=True) for p, c in zip(t, n.tolist(), strict=True)}
    want = Counter()
    for piece in ("a b a b c", "b c", " b c", "a b c"):
        w = piece.split()
        want.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got == dict(want)


def test_collocations_exact_beyond_64_bits(spark):
    a = 4_000_000_000_000
    row = spark.range(1).select(F.lit(a).alias("a")).select(F.expr("cast(cast(cast(a as decimal(15,0)) as decimal(38,0)) * cast(a as decimal(38,0)) * cast(1000000 as decimal(38,0)) div (cast(a + 1 as decimal(38,0)) * cast(a + 7 as decimal(38,0))) as bigint)")).first()[0]
    assert row == 10**6 * a * a // ((a + 1) * (a + 7)) == int(Fraction(10**6 * a * a, (a + 1) * (a + 7)))


def test_collocations_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        collocations.phrase_counts(spark.createDataFrame([], DOCS), 0)


# ---------------------------------------------------------------- conversations

CONV = "conv_id long, turn long, role string, text string, cost int, audit string"


def _damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d:
            text = "" if d == 1 else re.sub(r"[.!?]", "", text) if d == 2 else text
            out += [(c, t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def _cheapest(rows):
    """Least (cost, audit) and what it makes of (role, text, must go, truncated) by search over all edits."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, q, made = heapq.heappop(heap)
        if at == len(rows) and q in (0, 3):
            return cost, audit, made
        if (at, q) in done:
            continue
        done.add((at, q))
        role = "user" if q != 2 else "assistant"
        to = 2 if q != 2 else 3
        heapq.heappush(heap, (cost + 5, audit + "I", at, to, (*made, f"{role}:")))
        if at < len(rows):
            r, text, gone, cut = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, q, made))
            if not gone:
                more = 5 if cut else 0
                heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, to, (*made, f"{role}:{text}")))
                if r[:1] == "s" and q == 0:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, 1, (*made, f"{r}:{text}")))
                elif r[:1] == role[0]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, to, (*made, f"{r}:{text}")))


def _plain_repair(rows):
    by = {c: [] for c, *_ in rows}
    for c, t, role, text in _damaged(rows):
        by[c].append((t, role, text))
    out = {}
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()))
        seen, told, n = set(), [], Counter()
        for _, role, text in own:
            bare = text.rstrip("\t\n\x0b\x0c\r ")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            told.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, *_ in own if t is not None}
        first = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        cost, audit, made = _cheapest(told)
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def _talk(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randrange(1, 9)):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "sys"])
            rows.append((c, rnd.choice([t, t, t, t + 1, None]), role, rnd.choice(["Yes.", "Yes.", "no", "", " ", None, "Why? ", f"I am {rnd.random()}.", "cut of", "é!\n"])))
    return rows + [(None, 1, "user", "Hi."), (None, None, "assistant", "Hello!"), (None, 1, "user", "Hi.")]


def _repaired(df):
    return {r[0]: tuple(r)[1:] for r in conversation_repair.repair(conversation_repair.damage(df)).collect()}


def test_repair_brute_force(spark):
    rows = _talk(5)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONV).repartition(7)
    assert _repaired(df) == _plain_repair(rows)


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_lazy_determinisation"](spark, DATA).collect()}
    assert got == _plain_repair(rows)


def test_repair_of_one_large_conversation(spark, monkeypatch):
    """A conversation cut into many runs over many tasks, some of them of equal rows."""
    rnd = random.Random(9)
    rows = [(7, t // 3, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["Yes.", f"n {t}", f"m {t}."])) for t in range(1500)]
    rows += [(7, 40, "user", "Again.")] * 300 + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")]
    monkeypatch.setattr(conversation_repair._runs.__wrapped__, "__defaults__", (37,))
    assert _repaired(spark.createDataFrame([(*r, 1, "x") for r in rows], CONV).repartition(5)) == _plain_repair(rows)


def test_repair_empty_and_gone(spark):
    assert _repaired(spark.createDataFrame([], CONV)) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = _repaired(spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "x")], CONV))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_machine_has_few_states():
    machine = conversation_repair.Determinised()
    rnd = random.Random(1)
    rows = bytes(rnd.randrange(16) for _ in range(20_000))
    machine.scan(rows, machine.state(conversation_repair.STOP)[0])
    assert len(machine.vectors) < 200


# ---------------------------------------------------------------- licenses

LICENSED = "doc_id long, text string, label string, width int, s string"


def _licenses(text, templates=license_scan.TEMPLATES, threshold=0.9):
    between = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = lambda t: [w for w in re.split(between, t.translate(LOWER)) if w]
    w = cut(text or "")
    places, base, best, labels = [], set(), 0.0, set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for label, notice in templates:
        own = cut(notice)
        width = 2
        while width < 2 * len(own):
            width *= 2
        for i in range(0, max(1, len(w)), width // 2):
            share = len(set(w[i : i + width]) & set(own)) / len(set(own))
            if share >= threshold:
                labels.add(label)
                best = max(best, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else best)


def test_licenses_brute_force(spark):
    rnd = random.Random(2)
    junk = ["Ka", "lo", "ünder", "the", "License", "of", "free", "mit", "apache", "MIT License", "0", "version"]
    texts = [None, "", "---", "mit license", "MIT  License MIT-license", "general public licence", "K" * 20_000 + " Apache. License", "İ mit license ß", "Kmit license", "mit license " * 5000]
    for i in range(150):
        t = [rnd.choice(junk) for _ in range(rnd.randrange(60))]
        if i % 2:
            notice = rnd.choice(license_scan.TEMPLATES)[1].split()
            if i % 4 == 1 and len(notice) > 12:
                notice.pop(rnd.randrange(len(notice)))
            t[len(t) // 2 : len(t) // 2] = notice
        texts.append(rnd.choice([" ", "\n"]).join(t))
    texts += texts[:12]
    df = spark.createDataFrame([(None if i % 9 == 0 else i % 100, t, "x", 1, "s") for i, t in enumerate(texts)], LICENSED).repartition(5)
    got = sorted(((r["doc_id"], *tuple(r)[1:7], round(r["score"], 9)) for r in license_scan.scan_licenses(df).collect()), key=repr)
    want = sorted(((None if i % 9 == 0 else i % 100, *x[:6], round(x[6], 9)) for i, t in enumerate(texts) for x in [_licenses(t)]), key=repr)
    assert got == want
    assert {x for r in got for x in r[6].split(",")} >= {"bsd", "mpl", "isc", "cc-by-nc", "gpl"}


def test_licenses_empty(spark):
    assert license_scan.scan_licenses(spark.createDataFrame([], LICENSED)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan_licenses(spark.createDataFrame([], LICENSED), [("x", "--")])


@pytest.mark.parametrize(("name", "module"), [("op11_suffix_automata", collocations), ("op13_license_scan", license_scan)])
def test_sql(spark, name, module):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(module.SQL)
    columns = [d[0] for d in want.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in QUERIES[name](spark, DATA).collect()), key=repr)
    assert got == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)


# ---------------------------------------------------------------- models that must not hang on the layout


def test_language_scores_whatever_the_layout(spark):
    """Also held-out accuracy on rows that taught nothing."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = [{r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_net.identify(docs.repartition(n)).collect()} for n in (2, 9)]
    assert found[0].keys() == found[1].keys()
    assert all(a[0] == found[1][i][0] and abs(a[1] - found[1][i][1]) < 1e-9 for i, a in found[0].items())
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["lang"]]
    assert sum(found[0][r["doc_id"]][0] == r["lang"] for r in held) >= 0.9 * len(held)


def test_score_of_a_long_word_is_finite(spark):
    rows = [(i, f"some short text number {i} and again some text") for i in range(21)] + [(30, "short " + "q" * 60_000 + " end")]
    got = {r["doc_id"]: r["score"] for r in context_mixing.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(np.isfinite(v) and v < 0 for v in got.values()) and got[30] < got[0]


def test_mixing_scores_whatever_the_layout(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(400)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    found = [{r["doc_id"]: r["score"] for r in context_mixing.score_texts(docs.repartition(n)).collect()} for n in (1, 3, 13)]
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(math.isclose(s, other[i], rel_tol=1e-6) for i, s in found[0].items())


def test_summaries_keep_frequent_words():
    """Every word above its share is kept, in whatever order summaries of a skewed corpus are merged."""
    rng = np.random.default_rng(3)
    parts = [np.concatenate([rng.zipf(1.2, 3000) % 5000, rng.integers(10_000, 90_000, 2000), np.full(40 * (k % 2), 7_777)]) for k in range(9)]
    for order in (parts, parts[::-1]):
        words, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in order:
            w, c = context_mixing.lessened(*np.unique(part, return_counts=True), most=200)
            words, at = np.unique(np.concatenate([words, w]), return_inverse=True)
            words, n = context_mixing.lessened(words, np.bincount(at, np.concatenate([n, c])).astype(np.int64), most=200)
            assert len(words) <= 200
        every, true = np.unique(np.concatenate(parts), return_counts=True)
        assert set(every[true * 200 > true.sum()]) <= set(words.tolist())


# ---------------------------------------------------------------- embeddings in dense groups


def test_forest_loses_no_links_in_dense_groups(spark):
    """2,000 near copies of one vector among others, and 1,500 scaled copies of another."""
    rng = np.random.default_rng(5)
    near = rng.normal(size=16) + 0.03 * rng.normal(size=(2000, 16))
    scaled = np.outer(np.linspace(0.5, 2, 1500), rng.normal(size=16))
    v = np.concatenate([near, scaled, rng.normal(size=(500, 16))])
    label = np.repeat([0, 1, 0], [2000, 1500, 500])
    table = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in projection_forest.near_vectors(table).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.93) & (label[:, None] == label)).sum(1) - 1
    links = np.array([got[i].n_links for i in range(len(v))])
    assert (links <= want).all() and links.sum() >= 0.9 * want.sum()
    assert (links[2000:3500] == 1499).all() and all(got[i].component_id == 2000 for i in range(2000, 3500))


def test_mix_of_rows_without_ids(spark):
    """They draw by their texts: no bucket holds them all, and their source comes near its target."""
    n = 3 * source_mix.PER_BUCKET
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b "), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("source"))
    got = source_mix.mix_sources(docs).collect()
    assert len(got) == n and len({r["copies"] for r in got}) > 1
    for size in {r["source_size"] for r in got}:
        own = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3


# ---------------------------------------------------------------- pipeline with its own models


def test_pipeline_stages_keep_whole_rows(spark):
    """Every stage on an empty table; then on rows with a long text, repeats and nulls, by the real models."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*cp.COLUMNS)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).select(*cp.COLUMNS).count() == 0
    assert cp.encoding(spark, docs.limit(0), DATA).count() == 0
    base = [tuple(r) for r in docs.collect()]
    long = (None, " ".join(r[1] for r in base if r[1] and r[2] == "en") * 3, "en", None, None)
    rows = [*base, base[0], long, (5000, None, None, None, None), (5001, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, docs.schema)
    known = cp.language_id(spark, docs, DATA).select(*cp.COLUMNS)
    kept = Counter(map(tuple, known.collect()))
    assert not kept - Counter(rows) and kept[long] == 1 and kept[rows[-2]] == kept[rows[-1]] == 0
    assert kept[base[0]] in (0, 2) and sum(kept.values()) >= 0.8 * len(rows)
    clean = Counter(map(tuple, cp.toxicity(spark, docs, DATA).collect()))
    assert not clean - Counter(rows) and clean[rows[-2]] == clean[rows[-1]] == 1
    told = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    fine = [r for r in base if told.get(r[0]) == 0]
    share = sum(clean[r] > 0 for r in fine) / len(fine)
    assert share >= 0.7, share  # a model of 150 labelled rows, most of them clean
    once = cp.near_duplicates(spark, docs, DATA)
    assert max(Counter(map(tuple, once.collect())).values()) == 1
    mixed = Counter(map(tuple, cp.mixing(spark, once, DATA).collect()))
    assert not set(mixed) - set(rows)
    assert cp.encoding(spark, once, DATA).count() == once.count()


# ---------------------------------------------------------------- pages of hosts in parts


def test_parts_of_a_host_add_every_page():
    """A repeat on one page of a part in thousands still counts."""
    host, n = np.array([7], np.uint64), 2500
    suffix = [[10_000 + p, *([99] if p == 3 else [])] for p in range(n)]
    table = pa.table(
        {
            "host": pa.array([host.tobytes()], pa.binary()), "parts": pa.array([np.array([2], np.uint64).tobytes()], pa.binary()),
            "pages": pa.array([np.array([n], np.int32).tobytes()], pa.binary()), "name": pa.array([np.arange(n, dtype=np.uint64).tobytes()], pa.binary()),
            "size": pa.array([np.array([len(s) for s in suffix], np.int32).tobytes()], pa.binary()),
            "suffix": pa.array([b"".join(int(x).to_bytes(html_text.SUFFIX_BYTES, "little") for s in suffix for x in s)], pa.binary()),
        }
    )
    got = {r["suffix"]: r["support"] for r in html_text._supports(table, 3).to_pylist()}
    assert got[99] == 1 and len(got) == n + 1


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_by_brute_force(spark, tmp_path):
    """The whole query: edited texts, their hashes, both prints by votes, likeness to the next document and near counts."""
    rnd = random.Random(12)
    texts = [" ".join(rnd.choice(["ab", "c", "défg", "hij klm", "x" * 30]) for _ in range(rnd.randrange(1, 40))) for _ in range(60)]
    texts += [None, "", "  \t ", "one", "\U0001f600 two  three\n", texts[3], texts[3], "long " * 40_000]
    rows = [(7 * i, t) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("bucket", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    texts = [t or "" for t in texts]
    edited = [t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4] for i, t in enumerate(texts)]

    def terms(text):
        w = re.split("[ \t\n\x0b\f\r]+", text.strip(" \t\n\x0b\f\r"))
        return [(w[k], w[k + 1] if k + 1 < len(w) else None) for k in range(len(w))]

    every = sorted({t for x in (*texts, *edited) for t in terms(x)}, key=repr)
    hashes = dict(zip(every, [r.h & (2**64 - 1) for r in spark.createDataFrame(list(enumerate(every)), "i int, t struct<a string, b string>").select("i", F.xxhash64("t.a", "t.b").alias("h")).orderBy("i").collect()], strict=True))

    def fingerprint(text):
        votes = [0] * 64
        for t in terms(text):
            v = min(16, len(t[0]) + len(t[1] or ""))
            for bit in range(64):
                votes[bit] += v if hashes[t] >> bit & 1 else -v
        return sum(1 << bit for bit in range(64) if votes[bit] > 0)

    prints, after = [fingerprint(t) for t in texts], [fingerprint(t) for t in edited]
    like = lambda a, b: 1 - (a ^ b).bit_count() / 64
    got = {r["doc_id"]: r for r in QUERIES["op2_simhash"](spark, folder).collect()}
    assert len(got) == len(rows)
    for i, (doc, _) in enumerate(rows):
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{prints[i]:016x}", f"{after[i]:016x}")
        assert math.isclose(r["near_edited"], like(prints[i], after[i])) and math.isclose(r["near_next"], like(prints[i], prints[(i + 1) % len(prints)]))
        if doc % 50 == 0:
            assert r["n_near"] == sum((prints[i] ^ p).bit_count() <= 3 for p in prints) - 1
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{folder}/none/documents.parquet")
    assert QUERIES["op2_simhash"](spark, f"{folder}/none").count() == 0


# ---------------------------------------------------------------- token counts


def _brute_tokens(parts, rule):
    """Tokens and crossing tokens of each part of one text, a byte at a time."""
    enc, _ = token_counts.encoder(token_counts.VOCABULARY)
    data = [p.encode() for p in parts]
    of = [k for k, d in enumerate(data) for _ in d]
    n, crossing, at = [0.0] * len(parts), [0] * len(parts), 0
    for token in enc.encode_ordinary("".join(parts)):
        size = len(enc.decode_single_token_bytes(token))
        met = Counter(of[at : at + size])
        crossing[of[at]] += len(met) > 1
        if rule == "share":
            for k, c in met.items():
                n[k] += c / size
        else:
            n[of[at] if rule == "start" else min(met, key=lambda k: (-met[k], k))] += 1
        at += size
    return [(round(a, 9), b) for a, b in zip(n, crossing, strict=True)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_of_sections_and_fields(spark, rule):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["one ", "zwei\n", "\n\n\n", "  ", "\n ", "d\u00e9j\u00e0", "\U0001f600\n", "12345", "!!\n\n"]) for _ in range(rnd.randrange(1, 60))) for _ in range(50)]
    texts += [None, "", "\n", "word " * 30_000 + "\n\n end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("section", F.lit("x"))
    got: dict = {}
    for r in token_counts.section_tokens(docs, rule=rule).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append((round(r["n_tokens"], 9), r["n_crossing"], r["start_char"], r["end_char"]))
    for i, text in enumerate(texts):
        lines = re.findall("[^\n]*\n|[^\n]+$", text or "") or [""]
        edges = np.cumsum([0, *map(len, lines)]).tolist()
        assert got[i] == [(*x, a, b) for x, a, b in zip(_brute_tokens(lines, rule), edges, edges[1:], strict=False)]
    rows = [(i, texts[i], texts[(i * 7 + 1) % len(texts)], None if i % 3 else "\u00e9 end") for i in range(len(texts))]
    fields = ["a", "b", "c"]
    table = spark.createDataFrame(rows, "doc_id long, a string, b string, c string")
    got = {(r["doc_id"], r["field"]): (round(r["n_tokens"], 9), r["n_crossing"]) for r in token_counts.field_tokens(table, fields, rule=rule).collect()}
    for i, *parts in rows:
        parts = [(p or "") + "\n" * (k < 2) for k, p in enumerate(parts)]
        assert [got[i, f] for f in fields] == _brute_tokens(parts, rule)
    assert token_counts.field_tokens(table.limit(0), fields, rule=rule).count() == 0
