"""Stored tables in buckets, stored segments, identities, and containment with long common starts."""

import json
import os
import random

from pyspark.sql import functions as F

from docketry.operators import blocks, sessions
from docketry.sources import buckets, logs


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_many_scopes_are_few_files(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(100_000).select(F.concat(F.lit("s"), "id").alias("scope"), F.lit("1").alias("id"), F.col("id").alias("n"))
    logs.write_log(rows, path)
    before = files_of(path)
    assert len(before) <= buckets.BUCKETS
    logs.write_log(spark.createDataFrame([("s7", "1", -1), ("s7", "2", -2)], "scope string, id string, n bigint"), path)
    assert len(before - files_of(path)) == 1  # the one bucket of the scope
    read = logs.read_log(spark, path, "scope string, id string, n bigint")
    assert read.count() == 100_001 and sorted(r.n for r in read.where("scope = 's7'").collect()) == [-2, -1]


def test_cleared_scopes_and_null_scopes(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "scope string, id string"
    logs.write_log(spark.createDataFrame([("a", "1"), (None, "2"), ("b", "3")], schema), path)
    only_a = spark.createDataFrame([("a",)], "scope string")
    logs.write_log(spark.createDataFrame([], schema), path, scopes=only_a)
    found = lambda: sorted((tuple(r) for r in logs.read_log(spark, path, schema).select("scope", "id").collect()), key=str)
    assert found() == [("b", "3"), (None, "2")]
    logs.write_log(spark.createDataFrame([(None, "9")], schema), path)
    assert found() == [("b", "3"), (None, "9")]


def test_segments_give_the_document_and_its_turns(spark):
    rows = [("u", "s", p, f"q{p}", f'a "{p}"\n', "done", "", "stop") for p in range(23)] + [("u", "t", 10**12, "q", "a", "done", "", "stop")]
    turns = spark.createDataFrame(rows, "scope string, session_id string, pos bigint, question string, answer string, status string, rag_note string, finish_reason string")
    titles = spark.createDataFrame([("u", "s", "S"), ("u", "t", "T")], "scope string, session_id string, title string")
    pages = sessions.session_segments(turns, 5)
    by_page = {(r.session_id, r.segment): r for r in pages.collect()}
    assert [by_page["s", k].first_turn for k in range(5)] == [0, 5, 10, 15, 20]
    whole = {r.session_id: r.payload for r in sessions.session_payloads(turns, titles).collect()}
    assert {r.session_id: r.payload for r in sessions.export_segments(pages, titles).collect()} == whole
    listed = whole["s"].split('"turns":[', 1)[1].encode()
    for k in range(5):
        page = by_page["s", k]
        assert listed[page.start :].startswith(page.body[1:-1].encode()) and len(json.loads(page.body)) == (5 if k < 4 else 3)
    back = {(r.session_id, r.pos): (r.question, r.answer) for r in sessions.restore_segments(pages).collect()}
    assert back == {("s", p): (f"q{p}", f'a "{p}"\n') for p in range(23)} | {("t", 0): ("q", "a")}


def test_fingerprints_keep_the_borders_of_values(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a|b", "c"), (None, ""), ("", None)], "x string, y string")
    got = [r[0] for r in df.select(sessions.fingerprint("x", "y")).collect()]
    assert got[0] == got[2] != got[1] and got[3] == got[4]


def test_changed_identities(spark):
    rows = [(1, "u", "e", "d", "n"), (2, " ", "x", "x", "x"), (3, "u", " e ", "d", "n"), (4, "u", "e", "d|n", ""), (5, "u", "e", "d", "|n")]
    log = spark.createDataFrame([("c", *r) for r in rows], "client string, seq int, user_id string, email string, display_name string, username string")
    assert sorted(r.seq for r in sessions.changed_identities(log, ["client"], "seq").collect()) == [1, 4, 5]


def test_containment_with_a_long_common_start(spark):
    """Needles of every length behind one start of 40 characters; texts hold the start alone, some needles, or none."""
    pick, start = random.Random(5), "a common start of forty characters, just"
    needles = {start + "".join(pick.choice("xyz") for _ in range(pick.randrange(25))) for _ in range(300)} | {"xy", "zzz", "start", "b" * 200}
    texts = {start, "no", "b" * 300} | {f"{pick.random()} {n} and {m}" for n, m in (pick.sample(sorted(needles), 2) for _ in range(40))}
    got = {
        tuple(r)
        for r in blocks.substring_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    }
    assert got == {(t, n) for t in texts for n in needles if n in t}


def test_rungs(spark):
    n = [1, 5, 6, 11, 12, 23, 24, 1000, 10**6]
    df = spark.createDataFrame([(x,) for x in n], "n int")
    want = []
    for x in n:
        k = 6
        while 2 * k <= x:
            k *= 2
        want.append(min(x, k) if x >= 6 else x)
    assert [r[0] for r in df.select(blocks._rung(F.col("n"), 6)).collect()] == want
