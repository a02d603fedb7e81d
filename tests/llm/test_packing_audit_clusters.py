"""Best-fit packing, the audit of sources and the clusters against plain Python and the registered SQL."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from docketry.llm import best_fit, bpe, centroids, divergence, queries

SF = "/root/testdata/sf0.001"
TEXTS = [
    (1, "one two three"), (2, None), (3, ""), (4, "one two three"), (4, "one two three"), (None, "by nobody at all"), (5, " \t "),
    (6, "word " * 700), (7, "été 日本語 naïve " * 40), (8, "x" * 5000), (9, "a<|endoftext|>b"), (10, "I'll don't 123 ½"), (11, "nul\0 byte"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "h", 7, 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, `length` int, part int").repartition(3)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_tokenizer(name):
    own = bpe.Bpe(queries.tokenizer_path(name))
    assert own.layout
    texts = [t or "" for _, t in TEXTS] + ["ΟΔΟΣ Σας İSTANBUL", "été", "tab\tand\r\n  new  lines ", "'s'S 'LL", "ԱԲ աբ", " ", " x y"]
    texts += [f"see {a} here" for a in own.added] + [a + a.upper() for a in own.added]
    pick = random.Random(3)
    texts += ["".join(pick.choice("ab c'1.é\n日İſ") for _ in range(pick.randrange(60))) for _ in range(400)]
    for text in texts:
        assert own.encode(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_whole_documents(spark, name):
    own = bpe.Bpe(queries.tokenizer_path(name))
    for row in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        text = row["text"] or ""
        assert own.encode(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_on_single_items(seed):
    pick = random.Random(seed)
    length = pick.choice([7, 16, 64, 1024])
    items = [pick.randint(1, length) if pick.random() < 0.7 else pick.choice([1, 2, length, max(1, length // 2)]) for _ in range(pick.randint(1, 300))]
    counts = Counter(items)
    rows = best_fit.plan(dict(counts), length)
    filled = {}
    for size, n in counts.items():
        mine = sorted(r for r in rows if r[0] == size)
        for rank in range(n):
            _, first, seq, each, base = [r for r in mine if r[1] <= rank][-1]
            filled.setdefault(seq + (rank - first) // each, []).append((base + (rank - first) % each * size, size))
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    rooms, used = [], 0
    for size in sorted(items, reverse=True):
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms.pop(at)
        else:
            room, used = length, used + 1
        if room > size:
            bisect.insort(rooms, room - size)
    assert len(filled) == used


def check_pieces(found, texts, length):
    own = bpe.Bpe(queries.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in texts:
        ids = np.array([*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == want
    inside = {}
    for r in found:
        inside.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in inside.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(inside), -(-sum(k[3] * n for k, n in want.items()) // length)


@pytest.mark.parametrize("length", [4, 64, 1024])
def test_packing(docs, length):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    found = best_fit.pack(docs, path, 2, length).collect()
    used, least = check_pieces(found, TEXTS, length)
    assert used <= least + 2
    assert best_fit.pack(docs.limit(0), path, 2, length).count() == 0


def test_sequences_hold_the_ids(docs):
    pieces = best_fit.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"), 2, 64, with_ids=True)
    for r in best_fit.sequences(pieces).collect():
        assert len(r["ids"]) == r["tokens"] <= 64


def test_packing_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    used, least = check_pieces(queries.QUERIES["op11_best_fit_packing"](spark, SF).collect(), [(r["doc_id"], r["text"]) for r in table.collect()], 1024)
    assert used <= 1.01 * least + 1


def test_pointers_in_order():
    pick = random.Random(1)
    words = ["".join(pick.choice("ab") for _ in range(pick.choice([1, 3, 8, 9, 16, 70, 130]))) for _ in range(900)] + ["é" * 90] * 3 + ["é" * 90 + "x"]
    pick.shuffle(words)
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = divergence.class_bounds(buf, np.array([0, len(buf)]), divergence._LETTERS)
    group = np.array([pick.randrange(3) for _ in s])
    order, new = divergence.sort_pointers(buf, s, e, group)
    got = [(group[i], buf[s[i] : e[i]].tobytes()) for i in order]
    assert sorted(order.tolist()) == list(range(len(s)))
    assert [g for g, first in zip(got, new, strict=True) if first] == sorted(set(got), key=got.index) and len(set(got)) == new.sum()
    assert [g for g, _ in got] == sorted(g for g, _ in got)


def brute_audit(rows, min_docs, top):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, groups = {}, {}, set()
    for k, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in word.findall((text or "").translate(low)):
            docs.setdefault((lang, t), set()).add(k)
            counts[lang, source, t] = counts.get((lang, source, t), 0) + 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (g, t), d in docs.items() if g == lang and len(d) >= min_docs]
        sources = [s for g, s in groups if g == lang]
        n = {s: {t: counts.get((lang, s, t), 0) for t in kept} for s in sources}
        whole = {t: sum(n[s][t] for s in sources) for t in kept}

        def share(c):
            return {t: 1 + 10**9 * (v + 1) // (sum(c.values()) + len(kept)) for t, v in c.items()}

        p, q = {s: share(n[s]) for s in sources}, share(whole)
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(ranked[:limit])]
    return sorted(out)


@pytest.mark.parametrize("tile,bucket", [(256, 200_000), (2, 40)])
def test_audit(spark, monkeypatch, tile, bucket):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    pick = random.Random(7)
    words = ["the", "Of", "éa", "zeta", "q" * 90, "q" * 90 + "r", "n1n", "日本", "x_y", "rare"]
    rows = [(pick.choice(["en", "fr", None, ""]), pick.choice(["a", "b", "c", "ü", None]), " ".join(pick.choice(words) for _ in range(pick.randrange(9)))) for _ in range(150)]
    rows += [("en", "hot", "the the zeta")] * 80 + [("de", "a", None), ("de", "b", "once"), ("es", "alone", ""), ("en", "a", "A\0B\0\0c" * 3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, term int, n string").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(df, top=3).collect())
    assert got == brute_audit(rows, 3, 3)
    assert divergence.audit(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_centroid_clusters"])
def test_same_as_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("kind", [np.int64, object])
def test_tree_finds_the_nearest(seed, kind):
    r = np.random.default_rng(seed)
    k, d, m = int(r.integers(1, 60)), int(r.integers(1, 8)), int(r.choice([2, 5, 300]))
    c, x = r.integers(-m, m, (k, d)), r.integers(-m, m, (300, d))
    square = ((x[:, None, :] - c[None]) ** 2).sum(-1)
    which, best, measured = centroids.Tree(c.astype(kind)).nearest(x.astype(kind))
    assert (which == square.argmin(1)).all() and (best == square.min(1)).all() and measured <= 300 * k


def brute_clusters(vectors, k, rounds):
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in vectors if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    hashed = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    means = [v for _, v in hashed[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        sums = {c: [sum(x) // of.count(c) for x in zip(*(v for (_, v), o in zip(kept, of, strict=True) if o == c), strict=True)] for c in set(of)}
        means = [sums.get(c, m) for c, m in enumerate(means)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    part = Counter()
    for _, c, d in found:
        part[c] += d
    def fit(n):  # null where 64 bits do not hold a number
        return n if n < 1 << 63 else None

    return sorted(((i, c, fit(d), fit(part[c]), fit(sum(part.values())), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, c, d in found), key=str)


@pytest.mark.parametrize("big", [1.0, 1e6])
def test_clusters(spark, big):
    r = np.random.default_rng(11)
    vectors = [(i, (r.normal(size=64) * (big if i % 9 == 0 else 1)).tolist()) for i in range(70)]
    vectors += [(5, vectors[5][1])] * 3 + [(None, vectors[6][1]), (100, None), (101, [1.0] * 63), (102, [float("nan")] * 64), (103, [None] * 64), (104, [float("inf")] + [0.0] * 63), (105, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<double>, cluster int, large string").repartition(3)
    got = [tuple(r) for r in centroids.cluster(df, k=7, rounds=3).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]
    assert sorted(got, key=str) == brute_clusters(vectors, 7, 3)
    assert centroids.cluster(df.where("vec_id between 100 and 104"), k=3).count() == 0
    assert len({r["cluster"] for r in centroids.cluster(df.where("vec_id < 3"), k=7, rounds=1).collect()}) == 3
