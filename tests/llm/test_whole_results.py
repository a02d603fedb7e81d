"""Rows and links that earlier versions lost: repeated and null ids, clashing names, sums that cancel out, mixed vectors."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.llm import common, embedding_dedup, exact_dedup, minhash_dedup, packing, passages, queries, suffix_dedup
from docketry.session import tune

PARA = " ".join(f"word{i}x" for i in range(120))
NEAR = PARA.replace("word50x", "other")


def thue_morse(n, a, b):
    """Two strings whose sums of byte values times powers of any odd number agree modulo 2**64 from 2048 bytes on."""
    bits = np.array([bin(i).count("1") % 2 for i in range(n)])
    return "".join(np.where(bits, a, b)), "".join(np.where(bits, b, a))


def test_words_of_cancelling_sums_differ():
    one, two = thue_morse(4096, "a", "b")
    buf = np.frombuffer(f"{one} {two} {one} {one[:250]} {one[:250]}c".encode(), np.uint8)
    s, e, _ = common.word_bounds(buf, np.array([0, len(buf)]))
    h = common.word_prints(buf, s, e)
    assert h[0] == h[2] and len(set(h.tolist())) == 4


def test_unequal_single_words_do_not_link(spark):
    df = spark.createDataFrame(list(enumerate(thue_morse(4096, "a", "b"))), "doc_id long, text string")
    assert sorted(r["component_id"] for r in minhash_dedup.classes(df).collect()) == [0, 1]


def test_unequal_strings_of_cancelling_sums_stay(spark):
    one, two = thue_morse(4096, "a", "b")
    lead = "".join(chr(97 + k) for k in np.random.default_rng(5).integers(0, 26, 100))
    df = spark.createDataFrame([(0, lead + one), (1, "x" + lead + two)], "doc_id long, text string")
    want = {}
    texts = [lead + one, "x" + lead + two]
    for i, t in enumerate(texts):
        hit = np.zeros(len(t), bool)
        places = {}
        for j, u in enumerate(texts):
            for k in range(len(u) - 399):
                places.setdefault(u[k : k + 400], set()).add((j, k))
        for k in range(len(t) - 399):
            if len(places[t[k : k + 400]]) > 1:
                hit[k : k + 400] = True
        want[i] = int(hit.sum())
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeats(df, min_bytes=400).collect()} == want


def test_another_text_under_a_dropped_id_stays(spark):
    rows = [(1, PARA), (2, PARA), (2, "quite another text " * 9), (None, NEAR), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in minhash_dedup.keep_one(df).collect()), key=str)
    assert left == [(1, "word0x wo"), (2, "quite ano"), (3, ""), (3, "")]


@pytest.mark.parametrize("drop", [minhash_dedup.keep_one, exact_dedup.drop_copies, lambda d: suffix_dedup.drop_later_copies(d, min_bytes=200)])
def test_clashing_columns_come_back(spark, drop):
    names = ["fid", "fprint", "__id", "__found", "__text", "row", "found", "id", "sha", "kept", "node", "norm", "print", "gone_id", "lost_id", "a.b"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame([(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate([PARA, PARA, NEAR, None])], schema)
    left = drop(df)
    assert left.columns == df.columns
    for r in left.collect():
        assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]


def test_vectors_of_every_length_link(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for size in (1, 2, 3, 8, 64, 65):
        for _ in range(4):
            v = rng.normal(size=size)
            rows += [(n, v.tolist(), "a"), (n + 1, (v * 3 + 1e-4).tolist(), "a"), (n + 2, v.tolist(), "b")]
            n += 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for sample in (1000, 5):  # with a small sample some lengths have no codebook
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.classes(df, sample=sample).collect()}
        want = {}
        for i, v, label in rows:
            near = 0
            for j, w, other in rows:
                if i != j and label == other and len(v) == len(w):
                    near += float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) >= 0.98
            want[i] = near
        assert got == want


def test_ranges_hold_equal_bytes(spark):
    """Long texts lie together on the curve, and a third of all rows is one text; no range holds twice the mean."""
    rng = np.random.default_rng(4)
    word = lambda k: " ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(k))
    texts = [word(30) for _ in range(600)] + [word(600) for _ in range(60)] + ["the same text " * 8] * 330
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    total = sum(len(t) + 1 for t in texts)
    out = packing.pack(df, queries.tokenizer_path("word_bpe_49k.json"), 2, length=64, range_bytes=total // 10).toPandas()
    part = out["sequence_id"].to_numpy() >> 32
    size = {i: len(t) + 1 for i, t in enumerate(texts)}
    held = np.zeros(part.max() + 1)
    for p, d, start in zip(part, out["doc_id"], out["start"], strict=True):
        held[p] += size[d] if start == 0 else 0
    assert len(held) == 10 and held.max() <= 2 * total / 10 + max(size.values())
    tokens = out.groupby("doc_id")
    assert (tokens["length"].sum() == tokens["doc_tokens"].first()).all() and len(tokens) == len(texts)


def test_nodes_unlike_their_pivot_meet_by_differences(spark, monkeypatch):
    # 300 texts share buckets with one original that none of them reaches; every tenth has a twin of its own, edited alike
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = [base]
    for i in range(300):
        own = list(base)
        for k in rng.choice(120, 24, replace=False):
            own[k] = f"e{i}x{k}"
        texts.append(own)
        if i % 10 == 0:
            texts.append([*own[:-1], f"twin{i}"])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    counts, check = [], minhash_dedup._Links.check
    monkeypatch.setattr(minhash_dedup._Links, "check", lambda self, pairs: counts.append(pairs.count()) or check(self, pairs))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.classes(df, width=2).collect()}
    sets = [{*zip(t, t[1:], strict=False)} for t in texts]
    near = [[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets]
    want = list(range(len(sets)))
    for i, row in enumerate(near):  # texts stand beside their twins, so one pass reaches every link
        want[i] = min(want[j] for j, linked in enumerate(row[: i + 1]) if linked)
    assert got == dict(enumerate(want))
    assert len(set(want)) == 301
    assert sum(counts) <= 10 * len(texts), counts


def test_memory_of_runs_does_not_grow_with_the_text():
    """A text is read in pieces, in the run finder's tables as in the powers they use; pieces change no interval."""
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 3 << 20).astype(np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["doc_id", "print", "text"])
    tracemalloc.start()
    try:
        owned = [r for b in suffix_dedup._find(240, suffix_dedup.PIECE)(iter([batch])) for r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 << 20
    assert [a for a, _ in owned] == [0, *(b + 1 for _, b in owned[:-1])] and owned[-1][1] == len(text) - 240


def test_repeats_across_pieces(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = "".join(map(chr, rng.integers(97, 123, 2500)))
    df = spark.createDataFrame([(1, base + "tail"), (2, "head" + base[300:1900]), (3, base[1000:1200])], "doc_id long, text string")
    whole = sorted(map(tuple, suffix_dedup.repeats(df, min_bytes=240).collect()))
    assert [r[2] for r in whole] == [1600, 1600, 0]
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert sorted(map(tuple, suffix_dedup.repeats(df, min_bytes=240).collect())) == whole


def test_long_rows_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    rows = tune(spark).range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 8000).alias("text"))
    got = rows.mapInArrow(sizes, "size long, n long").collect()
    assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) < 6 << 20


def test_repeats_return_what_remains(spark):
    """The remaining text itself, not only its length and digest; a cut inside a character drops that character's rest."""
    base = "".join(chr(97 + k) for k in np.random.default_rng(8).integers(0, 26, 500))
    texts = {1: "ab" + base, 2: base + "ö!", 3: "é" + base[:450], 4: "Ã" + base[:450], 5: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.repeats(df, min_bytes=400).collect()}
    assert {i: r["kept_text"] for i, r in got.items()} == {1: "ab", 2: "ö!", 3: "é", 4: "Ã", 5: ""}
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got.values())
    # the second bytes of the two characters are equal, and so belong to the repeated string
    df = spark.createDataFrame([(1, "xé" + base), (2, "yĩ" + base)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.repeats(df, min_bytes=400).collect()}
    assert {i: (r["kept_text"], r["n_bytes"] - r["n_removed"]) for i, r in got.items()} == {1: ("x", 2), 2: ("y", 2)}


@pytest.mark.parametrize("met", [1, 1024])
def test_all_pairs_of_a_group_are_compared(spark, monkeypatch, met):
    """Texts that others connect already are compared too: every link counts, and passages that only two of them share are spans."""
    monkeypatch.setattr(passages, "MET", met)
    every = [f"p{i}" for i in range(60)]

    def text(k, *more):
        return " ".join([w for part in ([f"own{k}a{i}" for i in range(60)], every, [f"own{k}b{i}" for i in range(60)], *more) for w in part])

    def two(j, k):
        return [f"two{min(j, k)}{max(j, k)}w{i}" for i in range(55)] + [f"end{j}{k}x{i}" for i in range(60)]

    rows = [(k, text(k, *(two(k, j) for j in range(5) if j != k))) for k in range(5)]
    got = {r["doc_id"]: r for r in passages.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[k]["component_id"], got[k]["n_links"]) for k in range(5)] == [(0, 4)] * 5
    assert all([(s["first"], s["last"]) for s in got[k]["spans"]] == [(60, 119)] + [(180 + 115 * j, 234 + 115 * j) for j in range(4)] for k in range(5))
