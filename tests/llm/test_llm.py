"""The ten operators against brute force on small tables, with nulls, empty texts, ties, repeated rows and other columns."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from docketry.llm import common, embedding_dedup, exact_dedup, minhash_dedup, packing, passages, quality, queries, sharding, suffix_dedup, toxicity, unigram

SF = "/root/testdata/sf0.001"
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))) + os.pathsep + os.environ.get("PYTHONPATH", "")
PARA = " ".join(f"word{i}x" for i in range(120))
TEXTS = [
    (1, "Alpha beta GAMMA " + PARA), (2, "alpha BETA gamma " + PARA), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, "one"), (7, "one"),
    (8, PARA + " tail of another kind"), (9, PARA.replace("word50x", "other")), (10, "é" * 300 + PARA), (11, "ü▁  x\x01\x02'" * 50),
    (None, PARA + " by nobody"), (12, "longer " * 40000), (13, "é" * 300 + PARA),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "h", 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `h` string, `node` int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_classes(docs, empty):
    got = exact_dedup.classes(docs, owner_rows=3, sender_bits=2).collect()
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(TEXTS)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == Counter(dict.fromkeys(by, 1))
    assert exact_dedup.classes(empty).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(by)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_round_trip(n):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values)) == values).all()


def test_sharding(docs, empty):
    placed = sharding.assign(docs.select("doc_id", "text"), ["doc_id"], [1.0] * 4)
    out = sharding.slots(placed, "shard", ["doc_id", "text"])
    for shard in range(4):
        slots = sorted(r["slot"] for r in out.where(f"shard = {shard}").collect())
        assert slots == list(range(len(slots)))
    assert out.count() == len(TEXTS) and sharding.slots(sharding.assign(empty, ["doc_id"], [1.0]), "shard", ["doc_id"]).count() == 0
    ids = docs.sparkSession.range(20000).toDF("doc_id")
    both = sharding.assign(sharding.assign(ids, ["doc_id"], [1.0, 2.0, 0.0, 1.0]), ["doc_id"], [1.0, 2.0, 0.0, 1.0, 1.0], "grown")
    assert both.where("grown <> shard and grown <> 4").count() == 0
    share = {r["shard"]: r["count"] / 20000 for r in both.groupBy("shard").count().collect()}
    assert 2 not in share and abs(share[1] - 0.5) < 0.02
    assert "Python" not in both._jdf.queryExecution().executedPlan().toString()


def brute_bytes(length, earlier):
    place = {}
    data = [(i, (t or "").encode()) for i, t in TEXTS]
    for k, (i, b) in enumerate(data):
        for s in range(len(b) - length + 1):
            place.setdefault(b[s : s + length], []).append((k, s))
    out = []
    for k, (i, b) in enumerate(data):
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if len(place[b[s : s + length]]) > 1:
                hit[s : s + length] = True
        out.append((i, len(b), int(hit.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_repeated_bytes(docs, empty, hot):
    got = suffix_dedup.repeats(docs, min_bytes=100, hot_runs=hot)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "kept_sha256") == brute_bytes(100, False)
    assert suffix_dedup.repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 1000])
def test_later_copies(spark, hot):
    base = "".join(chr(97 + k) for k in np.random.default_rng(5).integers(0, 26, 900))
    texts = [(1, "xx" + base), (2, base[100:700] + "é" * 5), (3, "qq" + base[:500] + "zz"), (4, "short"), (5, None)]
    df = spark.createDataFrame([(t, i, None) for i, t in texts], "text string, doc_id long, earlier string")
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.drop_later_copies(df, min_bytes=200, hot_runs=hot).collect()}
    assert out[1] == texts[0][1] and out[2] == "é" * 5 and out[3] == "qqzz" and out[4] == "short" and out[5] is None


def words_of(t, width):
    w = lower(t).encode().split()
    return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(docs, empty, width):
    sets = [(i, words_of(t, width)) for i, t in TEXTS]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(len(sets)):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 80 * len(sets[a][1] | sets[b][1]):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    heads = {}
    for (i, _), x in zip(sets, label, strict=True):
        heads[x] = min([h for h in (heads.get(x), i) if h is not None], default=None)
    want = sorted(((i, len(s), heads[x]) for (i, s), x in zip(sets, label, strict=True)), key=str)
    assert rows(minhash_dedup.classes(docs, width=width), "doc_id", "n_shingles", "component_id") == want
    assert minhash_dedup.classes(empty).count() == 0
    assert minhash_dedup.keep_one(docs, width=width).columns == docs.columns


def test_minhash_table(spark):
    got = queries.QUERIES["op10_minhash_bayes"](spark, SF).toPandas().set_index("doc_id")
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    sets = {i: words_of(t, 2) for i, t in texts.items()}
    ids = sorted(sets)
    head = {i: i for i in ids}
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and head[a] != head[b]:
                low, high = sorted((head[a], head[b]))
                head = {k: low if v == high else v for k, v in head.items()}
    assert got.component_id.to_dict() == head


def test_posterior_bound():
    m = minhash_dedup.min_matches(80, 96, 1e-6)
    assert 40 < m < 70 and minhash_dedup.min_matches(80, 24, 1e-6) < 24


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    out = packing.pack(docs, path, 2, length=64, range_bytes=100_000).toPandas()
    want = Counter()
    for i, t in TEXTS:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[(i, len(ids))] += 1
    got = Counter((None if np.isnan(i) else int(i), int(n)) for i, n in out.loc[out.start == 0, ["doc_id", "doc_tokens"]].itertuples(index=False))
    assert got == want
    for i, t in ((1, TEXTS[0][1]), (11, TEXTS[11][1])):
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        for r in out[out.doc_id == i].itertuples():
            assert zlib.crc32(ids[int(r.start) : int(r.start + r.length)].tobytes()) == r.ids_crc32
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 64 and list(s.offset) == list(np.cumsum([0, *s.length])[:-1])
    assert packing.pack(empty, path, 2).count() == 0


def test_hilbert_neighbours():
    side = np.array([(x, y) for x in range(16) for y in range(16)], np.uint64)
    path = side[np.argsort(packing.hilbert(side, 4))].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    table = [(i, (base[i % 12] + rng.normal(size=8) * 0.12).astype("float32").astype(float).tolist(), [0, 1, None][i % 3]) for i in range(300)]
    table += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] + [1.0] * 7, 0), (303, table[0][1], 0), (303, table[0][1], 0), (304, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(i, v, g, "c") for i, v, g in table], "vec_id long, embedding array<double>, label int, cell string")
    got = embedding_dedup.classes(df, words=3, block=16)
    n, label = [0] * len(table), list(range(len(table)))
    unit = [None if v is None or not np.isfinite(v).all() or not any(v) else np.array(v) / np.linalg.norm(v) for _, v, _ in table]
    for a in range(len(table)):
        for b in range(len(table)):
            if a != b and unit[a] is not None and unit[b] is not None and table[a][2] is not None and table[a][2] == table[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                n[a] += 1
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert sum(n) > 100
    assert rows(got, "vec_id", "n_links", "component_id") == sorted(((t[0], n[k], table[label[k]][0]) for k, t in enumerate(table)), key=str)
    assert embedding_dedup.classes(df.limit(0)).count() == 0


def test_compact_windows():
    v = np.random.default_rng(1).integers(1, 60, 200).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    row = np.repeat([0, 1, 2], [90, 5, 105])
    got = set(zip(*(x.tolist() for x in passages.compact_windows(v, row, 8)), strict=True))
    want = set()
    for c in range(200):
        lo, hi = c, c
        while lo > 0 and row[lo - 1] == row[c] and v[lo - 1] > v[c]:
            lo -= 1
        while hi < 199 and row[hi + 1] == row[c] and v[hi + 1] >= v[c]:
            hi += 1
        if hi - lo + 1 >= 8:
            want.add((lo, c, hi))
    assert got == want


def test_passages(spark, empty):
    shared = " ".join(f"p{i}" for i in range(70))
    edited = shared.replace("p35 ", "changed ")
    own = [" ".join(f"d{k}w{i}" for i in range(100)) for k in range(6)]
    texts = [(0, own[0] + " " + shared), (1, shared + " " + own[1]), (2, own[2] + " " + edited + " tail"), (3, own[3]), (4, None), (5, own[5]), (6, own[5].upper()), (7, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in passages.classes(df).collect()}
    assert [got[i]["component_id"] for i in range(8)] == [0, 0, 0, 3, 4, 5, 5, 7]
    assert got[0]["spans"][0]["first"] == 100 and got[1]["spans"][0]["last"] == 69 and not got[3]["spans"] and got[6]["spans"][0]["last"] == 99
    assert passages.classes(empty).count() == 0


def near(x, y):
    return 5 * len(set(x) & set(y)) >= 4 * len(set(x) | set(y))


def test_passages_against_all_windows():
    """Short token rows with edits at random places: a link is found if any two windows of at least 8 tokens are near."""
    rng = np.random.default_rng(3)
    links = 0
    for k in range(250):
        core = rng.integers(0, 1000 if k % 3 else 12, rng.integers(8, 15)).tolist()
        copy = list(core)
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(0, len(copy)))
            copy[at : at + int(rng.integers(0, 2))] = rng.integers(2000, 3000, rng.integers(0, 2)).tolist()
        ends = [rng.integers(4000 + 1000 * i, 5000 + 1000 * i, rng.integers(0, 5)).tolist() for i in range(4)]
        a, b = ends[0] + core + ends[1], ends[2] + copy + ends[3]
        got = passages.passages(np.array(a, np.uint64), np.array(b, np.uint64), 8, 80)
        every = [(p, q, s, t) for p in range(len(a)) for q in range(p + 7, len(a)) for s in range(len(b)) for t in range(s + 7, len(b)) if near(a[p : q + 1], b[s : t + 1])]
        assert bool(got) == bool(every)
        links += bool(every)
        for side, other, (i, j) in ((a, b, (0, 1)), (b, a, (2, 3))):
            inside = {x for w in every for x in range(w[i], w[j] + 1) if side[x] in other}
            assert inside <= {x for g in got for x in range(g[i], g[j] + 1)}
    assert 60 < links < 230


@pytest.mark.parametrize("n, changed", [(50, [1]), (50, [3]), (50, [48]), (52, [2, 51]), (60, [21, 51]), (60, [10, 31])])
def test_passages_edited_near_the_ends(n, changed):
    words = [f"w{i}" for i in range(1, n + 1)]
    edited = [f"other{i}" if i in changed else w for i, w in enumerate(words, 1)]
    parts = [" ".join([f"{x}{i}" for i in range(80)] + middle + [f"{x}x{i}" for i in range(80)]).encode() for x, middle in (("a", words), ("b", edited))]
    a, b = (passages.tokens(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 5)[0] for t in parts)
    assert passages.passages(a, b, 46, 80)


def test_passages_past_the_pivots(spark):
    """Texts that share a passage are linked though texts with smaller fingerprints quote parts of it."""
    core = [f"c{i}" for i in range(60)]

    def text(name, middle):
        return " ".join([f"{name}a{i}" for i in range(60)] + middle + [f"{name}b{i}" for i in range(60)])

    def prints(ts):
        data = "".join(ts).encode()
        offs = np.cumsum([0] + [len(t) for t in ts])
        return passages.tokens(np.frombuffer(data, np.uint8), offs, 5)[2].view(np.int64)

    full = [text(f"f{k}", core) for k in range(40)]
    parts = [text(f"p{k}", core[at : at + 15]) for k, at in enumerate(list(range(0, 46, 3)) * 40)]
    order = sorted(zip(prints(full).tolist(), full, strict=True))
    pair = [t for _, t in order[-2:]]  # the two with the largest fingerprints
    below = [t for v, t in zip(prints(parts).tolist(), parts, strict=True) if v < order[-2][0]]
    df = spark.createDataFrame(list(enumerate(pair + below)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in passages.classes(df).collect()}
    assert got[1]["component_id"] == 0 and got[0]["spans"][0]["first"] == 60 and got[0]["spans"][0]["last"] == 119
    assert all(got[i]["component_id"] == i for i in range(2, len(got)))


def test_pairs_without_windows_are_refused(monkeypatch):
    """No window search where two texts have too few tokens in common, however often they repeat them; near windows are never refused."""
    rng = np.random.default_rng(11)
    for k in range(200):
        core = rng.integers(0, 9 if k % 2 else 900, rng.integers(8, 14)).tolist()
        ends = [rng.integers(1000 * i, 1000 * i + 5, rng.integers(0, 6)).tolist() for i in range(1, 5)]
        a, b = ends[0] + core + ends[1], ends[2] + list(rng.permutation(core)) + ends[3]
        every = any(near(a[p:q], b[s:t]) for p in range(len(a)) for q in range(p + 8, len(a) + 1) for s in range(len(b)) for t in range(s + 8, len(b) + 1))
        assert passages._could_meet(np.array(a, np.uint64), np.array(b, np.uint64), 8, 80) or not every
    monkeypatch.setattr(passages, "_missed", None)
    line = list(range(20))
    a = np.array([x for k in range(50) for x in [*line, 100 + k]], np.uint64)
    b = np.array([*range(5000, 5060), *line, *range(6000, 6060)], np.uint64)
    assert passages.passages(a, b, 46, 80) == [] == passages.passages(b, a, 46, 80)


def test_a_text_crosses_the_network_once(spark):
    same = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(2, "a " + same, "x"), (1, same + " b", "y"), (None, None, None)], "id int, body string, found string")
    beside = suffix_dedup._with_intervals(df, "id", "body", 100, True, 1000)
    strings = [f.name for f in beside.schema["row"].dataType.fields if f.dataType.simpleString() == "string"]
    assert strings == ["c2"] and "Broadcast" not in beside._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r for r in suffix_dedup.drop_later_copies(df, "id", "body", 100).collect()}
    assert suffix_dedup.drop_later_copies(df, "id", "body", 100).columns == df.columns
    assert got[1]["body"].startswith(same[:90]) and len(got[2]["body"]) < 100 and got[2]["found"] == "x" and got[None]["body"] is None


def test_quality(spark, docs, empty):
    good = [(i, f"plain text number {i} with the usual words of the house", 1) for i in range(60)]
    bad = [(100 + i, f"$$$ !!{i}!! ### buy buy buy @@@", 0) for i in range(30)]
    table = spark.createDataFrame([(i, t, 5) for i, t, _ in good + bad], "doc_id long, text string, bucket int")
    labels = spark.createDataFrame([(i, q) for i, _, q in good[::2] + bad[::2]], "doc_id long, quality int")
    out = {r["doc_id"]: r["selected"] for r in quality.resample(table, labels).collect()}
    assert all(out[i] == bool(q) for i, _, q in good + bad)
    assert quality.keep_selected(table, labels).columns == table.columns and quality.keep_selected(table, labels).count() == 60
    none = labels.limit(0)
    assert quality.resample(docs, none).where("selected").count() == len(TEXTS) and quality.resample(empty, labels).count() == 0
    keys = spark.createDataFrame([(float(x % 50),) for x in range(1000)], "key double")
    assert quality.kth_largest(keys, 41) == 47.0


def test_field_marginals():
    rng = np.random.default_rng(0)
    emit, stay = rng.normal(size=300), rng.normal(size=(2, 2))
    field = toxicity.Field(np.zeros(0, np.uint64), emit, 0.0, stay, np.zeros(3))
    feats = np.stack([np.arange(300), np.zeros(300, int), np.zeros(300, int)], axis=1)
    field.emit = emit - 0.0
    limits = np.array([0, 4, 4, 300])
    got = toxicity.token_logits(field, feats, limits)
    e = field.emit[feats].sum(axis=1)
    total = np.zeros((4, 2))
    for path in range(16):
        y = [(path >> k) & 1 for k in range(4)]
        w = np.exp(sum(e[k] * y[k] for k in range(4)) + sum(stay[y[k], y[k + 1]] for k in range(3)))
        for k in range(4):
            total[k, y[k]] += w
    assert np.allclose(got[:4], np.log(total[:, 1] / total[:, 0]))
    long, _ = toxicity.marginals(e[4:][None, :], np.ones((1, 296), bool), 0.0, stay)
    assert np.allclose(got[4:], long[0], atol=1e-6)


def test_toxicity(spark, docs, empty):
    texts = [(i, f"some w{i} words about the{i % 7} weather" + (f" v{i} idiot u{i}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    table = spark.createDataFrame([(i, t, "x") for i, t, _ in texts], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts if i < 120], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(table, labels).collect()}
    assert all((out[i]["score"] >= 0.3) == bool(y) for i, _, y in texts)
    span = out[196]["spans"][0]
    assert texts[196][1][span["start"] : span["end"]] == "idiot"
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, labels).collect()) and toxicity.score(empty, labels).count() == 0
    assert {round(r["score"], 3) for r in toxicity.score(table, labels.limit(0)).collect()} == {0.05}


def test_unigram(docs, empty):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = unigram.Unigram(unigram.load(path))
    score = {p.encode(): s for i, (p, s) in enumerate(zip(model.v.pieces, model.v.scores, strict=True)) if i not in model.v.special}
    for text in ("hello  world", "naïve ▁ x\n\ty", "", " a", "日本 \U0001f600!", "don't-stop.html"):
        (ids,) = model.encode([text])
        assert model.decode(ids) == text.encode()
        if "▁" not in text:
            raw = ("▁" + text.replace(" ", "▁")).encode()
            best = [0.0] + [-np.inf] * len(raw)
            for i in range(len(raw)):
                if raw[i] & 0xC0 == 0x80:
                    continue
                n = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                best[i + n] = max(best[i + n], best[i] + model.unknown)
                for j in range(i + 1, min(len(raw), i + 60) + 1):
                    if raw[i:j] in score:
                        best[j] = max(best[j], best[i] + score[raw[i:j]])
            byte_ids = set(model.v.byte_ids.tolist())
            known = sum(model.v.scores[i] for i in ids if int(i) not in byte_ids)
            fallen = bytes(int(np.flatnonzero(model.v.byte_ids == i)[0]) for i in ids if int(i) in byte_ids)
            assert np.isclose(known + model.unknown * len(fallen.decode()), best[-1])
    back = unigram.decode(unigram.encode(docs, path), path)
    assert rows(back, "doc_id", "text") == sorted(((i, t or "") for i, t in TEXTS), key=str)
    assert unigram.digests(docs, path).where("not round_trip").count() == 0 and unigram.encode(empty, path).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)], "a long, b long")
    got = {r["node"]: r["comp"] for r in common.components(spark, edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


def test_pipeline(spark):
    """The stages keep what brute force over each stage's own input keeps."""
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.toPandas()
        docs = common.staged(stage(spark, docs, SF), "test")
        after = docs.toPandas()
        assert docs.columns == names
        if name == "exact dedup":
            want = before.assign(t=before.text.map(lower)).groupby("t").doc_id.max()
            assert sorted(after.doc_id) == sorted(want)
        elif name == "quality classifier":
            labels = duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").df().set_index("doc_id").quality
            known = before.doc_id[before.doc_id.isin(labels.index)]
            assert np.mean([(i in set(after.doc_id)) == bool(labels[i]) for i in known]) > 0.95
        elif name == "minhash near-dedup":
            sets = {r.doc_id: words_of(r.text, 5) for r in after.itertuples()}
            ids = sorted(sets)
            assert not [1 for n, a in enumerate(ids) for b in ids[:n] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        else:
            assert list(after.sort_values("doc_id").doc_id) == list(before.sort_values("doc_id").doc_id)
            size = corpus_pipeline.PASSAGE_BYTES
            first = {}
            for r in before.sort_values("doc_id").itertuples():
                b = r.text.encode()
                for s in range(len(b) - size + 1):
                    first.setdefault(b[s : s + size], (r.doc_id, s))
            for r in before.itertuples():
                b = r.text.encode()
                hit = np.zeros(len(b), bool)
                for s in range(len(b) - size + 1):
                    if first[b[s : s + size]] != (r.doc_id, s):
                        hit[s : s + size] = True
                lost = len(b) - len(after.text[after.doc_id == r.doc_id].iloc[0].encode())
                assert 0 <= hit.sum() - lost <= 6 * (1 + (np.diff(hit.astype(int)) == 1).sum())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.count()


def test_oracle_of_exact_dedup(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op2_exact_dedup"]).fetchall()
    got = rows(queries.QUERIES["op2_exact_dedup"](spark, SF), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want, key=str)
