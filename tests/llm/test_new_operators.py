"""Language by rank-order profiles, conversation repair, vector codes."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from plumbline.llm import conversation_repair, rank_profiles, vector_codes
from plumbline.llm.common import table

from . import brute

REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


# -- languages


def test_languages_as_by_counting(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    want = brute.language_profiles(rows, rank_profiles.PROFILE)
    got = rank_profiles.op11_rank_profiles(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        held, lang, score = want[r.doc_id]
        assert (r.held_out, r.lang_pred) == (held, lang) and math.isclose(r.score, score, abs_tol=1e-12)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rank_profiles.identify(docs).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.99


def test_languages_odd_rows(spark, odd, none):
    assert {r.lang_pred for r in rank_profiles.identify(odd).collect()} == {"und"}  # nothing to learn from
    texts = ["der hund und die katze", "the dog and the cat", "ẞ Straße ǅ İstanbul", "日本語 한국어 𐐀𐐁", "ab", "", None, "12 !", "tie"]
    rows = [(i, texts[i % len(texts)], ["de", "en", None, "xx", ""][i % 5], "src") for i in range(90)] + [(None, "the dog", "en", "src"), (7, "ab", "en", "src"), (7, "ab", "en", "src")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, gram string")
    want = brute.language_profiles([r[:3] for r in rows if r[0] != 7], 5), brute.language_profiles([r[:3] for r in rows], 5)
    got = rank_profiles.identify(docs, 5).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.lang_pred, round(r.score, 9)) == (*want[1][r.doc_id][:2], round(want[1][r.doc_id][2], 9)) or r.doc_id == 7
    assert rank_profiles.identify(none).collect() == []
    long = spark.createDataFrame([(1, "the dog " * 100_000, "en"), (2, "der hund", "de"), (3, "the", "en"), (5, "hund", None)], "doc_id long, text string, lang string")
    assert all(r.lang_pred in ("en", "de") for r in rank_profiles.identify(long).collect())


def test_prediction_uses_text_alone(spark, sf):
    docs = table(spark, sf, "documents")
    held = {r.doc_id: r.lang_pred for r in rank_profiles.identify(docs).collect() if r.held_out}
    from pyspark.sql import functions as F

    blind = docs.withColumn("lang", F.when(~rank_profiles._held_out(docs), F.col("lang"))).withColumn("source", F.lit("x"))
    assert {r.doc_id: r.lang_pred for r in rank_profiles.identify(blind).collect() if r.held_out} == held


# -- conversations


def test_search_finds_the_first_of_the_cheapest(monkeypatch):
    rng = random.Random(5)
    for trial in range(3000):
        n = rng.randint(0, 40 if trial % 50 == 0 else 9)
        initials, kinds = "".join(rng.choices("uuaas ", k=n)), bytes(rng.choices([0, 1, 2], [6, 2, 2], k=n))
        monkeypatch.setattr(conversation_repair, "STEP", rng.choice([1, 3, 8, 128]))
        assert conversation_repair.repair(initials, kinds) == brute.cheapest_edits(initials, kinds)


def test_estimate_never_exceeds_and_is_consistent():
    rng = random.Random(6)
    for _ in range(500):
        n = rng.randint(1, 10)
        initials, kinds = "".join(rng.choices("uuaas ", k=n)), bytes(rng.choices([0, 1, 2], k=n))
        least = conversation_repair.least_costs(initials, kinds)
        assert least[0] <= brute.cheapest_edits(initials, kinds)[0]
        for i in range(n + 1):
            for state in range(4):
                for _, j, to, cost in conversation_repair._edits(initials, kinds, i, state):
                    assert least[4 * i + state] <= cost + least[4 * j + to]


def test_long_conversation():
    rng = random.Random(7)
    n = 3000
    initials, kinds = "".join("ua"[i % 2] if rng.random() > 0.1 else rng.choice("uas") for i in range(n)), bytes(rng.choices([0, 1, 2], [8, 1, 1], k=n))
    assert conversation_repair.repair(initials, kinds) == brute.cheapest_edits(initials, kinds)


def repaired(spark, rows, schema="conv_id long, turn long, role string, text string"):
    own = conversation_repair.damaged(spark.createDataFrame(rows, schema))
    return {r.conv_id: tuple(r[c] for c in REPORT) for r in conversation_repair.repaired(own, conversation_repair.audits(own)).collect()}


def test_query_as_by_search_of_all_edits(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = conversation_repair.op12_conversation_repair(spark, sf)
    assert {r.conv_id: tuple(r[c] for c in REPORT) for r in got.collect()} == brute.repaired_conversations(rows)


def test_odd_conversations(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "One.", "One.", "two", "Three!  \n", "\x0b?", "é…", "x" * 300_000 + "."]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, -7]), rng.choice([None, *range(12)]), rng.choice([None, "", "user", "assistant", "system", "tool", "user"]), rng.choice(texts)) for _ in range(150)]
    rows += [(77, t, "user", "gone") for t in range(400) if __import__("zlib").crc32(f"77:{t}".encode()) % 20 == 0][:3]  # a conversation of which no row stays
    assert repaired(spark, rows) == brute.repaired_conversations(rows)
    assert repaired(spark, rows)[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    wide = [(*r, "x", True, "K", 3) for r in rows]
    assert repaired(spark, wide, "conv_id long, turn long, role string, text string, digest string, dropped boolean, audit string, cost long") == repaired(spark, rows)
    assert repaired(spark, []) == {}


# -- vectors


def coded(spark, rows, schema="vec_id long, embedding array<double>, label int", **how):
    codes, books = vector_codes.compress(spark.createDataFrame(rows, schema), **how)
    return sorted((tuple(r) for r in vector_codes.with_label_errors(codes).select("vec_id", "code", "error", "label_error").collect()), key=str), books


def test_codes_as_by_every_distance(spark):
    rng = random.Random(9)
    for parts, width, n, entries, chunk, block in ((2, 2, 300, 8, 64, 8), (1, 3, 100, 64, 1000, 16), (4, 1, 50, 64, 7, 4)):
        vectors = [(i * 3 % 101, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(parts * width)], rng.choice([None, 1, 2])) for i in range(n)]
        want, want_books = brute.vector_codes(vectors, parts, entries, 2)
        got, books = coded(spark, vectors, parts=parts, entries=entries, chunk=chunk, block=block)
        assert got == sorted(want, key=str)
        assert [[tuple(e) for e in b] for b in books.tolist()] == want_books


def test_hilbert_neighbours():
    grid = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    walk = grid[np.argsort(vector_codes.hilbert_keys(grid))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # the curve steps from cell to neighbouring cell
    assert len(np.unique(vector_codes.hilbert_keys(grid))) == 512


def test_shortlists_keep_the_nearest(rng):
    draw = np.random.default_rng(3)
    points, entries = draw.integers(-200, 200, (50, 16, 4)), draw.integers(-200, 200, (64, 4))
    entries[9] = entries[4]
    found, alone = vector_codes.nearest(points, points.min(axis=1), points.max(axis=1), entries)
    apart = ((points[:, :, None, :] - entries) ** 2).sum(axis=3)
    assert (found == apart.argmin(axis=2)).all() and ((alone < 0) | (apart.argmin(axis=2) == alone[:, None]).all(axis=1)).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [1.0, nan], 1), (4, [inf, 1.0], 1), (5, [1.0, None], 1), (None, [0.5, 0.5], None), (6, [0.5, 0.25], 2), (6, [0.5, 0.25], 2), (6, [0.25, 0.5], None), (7, [1.0], 1), (8, [-0.001, 3.0], 1)]
    want, want_books = brute.vector_codes(rows, 2, 64, 2)
    got, books = coded(spark, rows, parts=2)
    assert got == sorted(want, key=str) and [[tuple(e) for e in b] for b in books.tolist()] == want_books
    wide = [(*r, 1, 2.0, "x") for r in rows]
    assert coded(spark, wide, "vec_id long, embedding array<double>, label int, part long, error double, code string", parts=2)[0] == got
    assert coded(spark, rows[:5], parts=2)[0] == []
    with pytest.raises(ValueError):
        coded(spark, [(1, [1.0, 2.0, 3.0], 1)], parts=2)
    with pytest.raises(Exception, match="in size"):
        coded(spark, [(1, [1e9, 2.0], 1)], parts=2)


@pytest.mark.parametrize("query, sql, name", [
    (rank_profiles.op11_rank_profiles, rank_profiles.ORACLE, "documents"), (conversation_repair.op12_conversation_repair, conversation_repair.ORACLE, "conversations"), (vector_codes.op13_vector_codes, vector_codes.ORACLE, "embeddings"),
])
def test_query_as_sql(spark, sf, query, sql, name):
    duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    want = duckdb.sql(sql)
    assert sorted(tuple(r) for r in query(spark, sf).select(*want.columns).collect()) == sorted(want.fetchall())


def test_sql_of_odd_conversations(spark):
    rng = random.Random(12)
    texts = [None, "", " \t\n", "One.", "One.", "two", "Three!  \n", "\x0b?", "é…", "x" * 3000 + "."]
    for trial in range(3):
        rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, -7]), rng.choice([None, *range(12)]), rng.choice([None, "", "user", "assistant", "system", "tool", "user"]), rng.choice(texts)) for _ in range(30 + 60 * trial)]
        own = duckdb.connect()
        own.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        own.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        want = own.sql(f"SELECT conv_id, {', '.join(REPORT)} FROM ({conversation_repair.ORACLE})").fetchall()
        assert {r[0]: r[1:] for r in want} == repaired(spark, rows)
