"""Fertility, encoding, token counts, language model."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import fertility, group_keys, katz, piece_bpe, token_counts

from . import brute


def test_base_counts(spark, sf, corpus):
    got = {r.doc_id: r for r in fertility.op4_fertility(spark, sf).collect()}
    assert len(got) == len(corpus)
    for d, text in corpus:
        r, want = got[d], brute.base_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_fertility_measures(spark, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL))
    docs = spark.createDataFrame([*corpus[:40], (10**6, "日本語" * 30)], "doc_id long, text string")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in fertility.measures(docs).collect():
        ids = library.encode(text[r.doc_id])
        p = np.unique(ids, return_counts=True)[1] / len(ids)
        assert r.n_tokens == len(ids) and np.isclose(r.chars_per_token, len(text[r.doc_id]) / len(ids))
        assert np.isclose(r.byte_share, np.mean([library.is_byte(i) for i in ids]))
        assert np.isclose(r.entropy_share, -(p * np.log2(p)).sum() / np.log2(max(2, len(ids))))
        assert r.band_group == ("script:cjk" if r.doc_id == 10**6 else "script:latin")


def encoders():
    """Ids, byte tokens and size of each vocabulary by its library."""
    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL))
    with open(public_tokenizers.path(fertility.SECOND), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    merges = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def partial(i):
        return not merges.decode_single_token_bytes(i).decode("utf-8", "ignore")

    def first(text):
        ids = pieces.encode(text)
        return ids, sum(map(pieces.is_byte, ids)), pieces.get_piece_size()

    def second(text):
        ids = merges.encode_ordinary(text)
        return ids, sum(map(partial, ids)), max(ranks.values()) + 1

    return first, second


def test_quality_verdicts(spark, sf):
    """``kept`` of every document is that of the plain version; of labelled documents no good one that passes the base goes, and bad ones do."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in fertility.op4_fertility(spark, sf).collect()}
    want = brute.fertility_kept(rows, encoders())
    assert {d: r.kept for d, r in got.items()} == want
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got and not got[r.doc_id].base_failed}
    assert all(got[d].kept for d, q in quality.items() if q == 1)
    assert {d for d, k in want.items() if not k} > {d for d, r in got.items() if r.base_failed}


def test_second_vocabulary(corpus):
    own, (_, second) = fertility.byte_merges(public_tokenizers.path(fertility.SECOND)), encoders()
    texts = [t for _, t in corpus[:60]] + ["", "日本", "a" + "\n " * 400 + "b"]
    offsets, ids = own.encode(texts)
    for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        want, n_bytes, _ = second(t)
        assert ids[a:b].tolist() == want and own.is_byte[ids[a:b]].sum() == n_bytes
    assert own.encode([" " * 200_000 + "x"])[0][1] > 0  # a run that the library itself cannot take


def test_bands_reject_what_is_far_off(spark, rng):
    words = ["the", "of", "and", "house", "water", "some", "other", "people", "might", "know"]
    plain = [(i, " ".join(rng.choice(words) + rng.choice(words) for _ in range(120)), "en") for i in range(60)]
    far = [(100, " ".join("".join(rng.choice("0123456789+/=") for _ in range(9)) for _ in range(120)), "en"), (101, " ".join(chr(0x1200 + rng.randrange(80)) for _ in range(120)), "en")]
    got = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(plain + far, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i, *_ in plain)
    assert not got[100].kept and "chars_per_token" in got[100].out_of_band and not got[101].kept and "byte_share" in got[101].out_of_band


@pytest.fixture(scope="module")
def strange(spark):
    import random

    r = random.Random(1)
    parts = ["a", "e", "t", "h", " ", "  ", "\n", "▁", "é", "日本", "😀", "the", "ing", "0", "</s>", "<s>", "<0x0A>", "<unk>", "\t", "\x00", "xx", "==", "    ", "\r\n", "aaaa", "<|endoftext|>", "中", "   \n", "'s", "\u0558", "\u3000"]
    made = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    made += [" " * n + "the" for n in range(70)] + ["a" * n for n in range(60)] + ["x" + " " * n for n in range(70)] + ["=" * n for n in range(100)] + ["ab" * n for n in range(40)]
    made += [chr(r.randint(1, 0xD7FF)) * r.randint(1, 3) + chr(r.randint(0x10000, 0x10FFFF)) for _ in range(2000)]
    return made


def test_encoding_is_the_librarys(strange, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL))
    texts = [*strange, *(t for _, t in corpus)]
    own = piece_bpe.model(public_tokenizers.path(piece_bpe.MODEL))
    offsets, ids = own.encode(texts)
    want = library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want
    assert own.decode(offsets, ids) == [library.decode(x) for x in want]


def test_encoding_of_odd_documents(spark, odd, none):
    got = {(r.doc_id, r.n_tokens) for r in piece_bpe.digests(piece_bpe.decode(piece_bpe.encode(odd))).collect()}
    assert {(1, 0), (2, 0)} <= got and len([d for d, _ in got if d == 5]) == 1
    assert piece_bpe.decode(piece_bpe.encode(none)).count() == 0


def test_digests(spark, sf, corpus):
    row = next(r for r in piece_bpe.op7_piece_bpe(spark, sf).collect() if r.doc_id == corpus[0][0])
    offsets, ids = piece_bpe.model(public_tokenizers.path(piece_bpe.MODEL)).encode([corpus[0][1]])
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(corpus[0][1].encode()).hexdigest()


def test_token_counts_are_the_librarys(spark, strange, corpus, odd, none):
    library = token_counts._tokenizer(public_tokenizers.path(token_counts.MODEL))
    rows = [*corpus, *((10_000 + i, t) for i, t in enumerate(strange[:1500])), (1 << 40, "far id")]
    got = {r.doc_id: r for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[d].n_tokens, got[d].n_bytes, got[d].over_limit) == (n, len(t.encode()), n > 1024)
    texts = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = sorted((str(r.doc_id), len(r.text.encode()), len(library.encode(r.text, add_special_tokens=False).ids)) for r in texts)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd).collect()) == want
    assert token_counts.count_tokens(none).count() == 0


def test_token_counts_of_repeated_ids_in_parts(spark, rng, monkeypatch):
    """Rows under one id, or without one, each have their own count, whatever is held at a time and however frequent a pre-token is."""
    for name, value in (("GATHER", 30_000), ("ROWS", 7), ("TIMES", 5), ("WRITE", 3), ("MANY", 3), ("SHARE", 0)):
        monkeypatch.setattr(token_counts, name, value)
    library = token_counts._tokenizer(public_tokenizers.path(token_counts.MODEL))
    rows = [(rng.choice((1, 2, None)), " ".join(rng.choice(("the", "of", "Xylem", "q" * 9, "12345")) for _ in range(rng.randint(0, 700)))) for _ in range(60)]
    rows += rows[:5]
    docs = spark.createDataFrame([(d, t, "p", 1) for d, t in rows], "doc_id long, text string, piece string, first long")
    want = sorted((str(d), len(t), n, n > 1024) for d, t in rows for n in [len(library.encode(t, add_special_tokens=False).ids)])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect()) == want


def test_plain_characters_split_as_the_librarys():
    path = public_tokenizers.path(token_counts.MODEL)
    split, before = token_counts.splitter(path), token_counts._tokenizer(path).pre_tokenizer
    for c in range(0, 0x20000, 1):
        if 0xD800 <= c < 0xE000:
            continue
        s = "a" + chr(c) + "1" + chr(c) + chr(c) + "!"
        assert split(s) == [s[a:b] for _, (a, b) in before.pre_tokenize_str(s)]


def close(got, want):
    return got[:4] == want[:4] and abs(got[4] - want[4]) <= 1e-9 * abs(want[4]) and abs(got[5] - want[5]) <= 1e-9 * abs(want[5])


def test_katz(spark, sf, corpus, rng, monkeypatch):
    words = ["a", "b", "c", "D", "the", "of", *(f"w{i}" for i in range(60))]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(3, 66)]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000 + i, "x y z q x y z q") for i in range(40)] + [(2000, None), (None, "The of"), (2001, "unseen words here")]
    monkeypatch.setattr(group_keys, "GROUP_BYTES", 4000)
    monkeypatch.setattr(group_keys, "ROW_BYTES", 16)
    for case in (rows, corpus):
        got = {r[0]: tuple(r)[1:] for r in katz.score(spark.createDataFrame(case, "doc_id long, text string")).collect()}
        want = brute.katz(case)
        assert len(got) == len(want) and all(close(got[d], want[d]) for d in want)


def test_katz_odd(odd, none):
    got = katz.score(odd).collect()
    assert len(got) == 10 and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1} and all(np.isfinite(r.score) for r in got)
    assert katz.score(none).count() == 0


def test_packing(rng):
    for n in (0, 1, 7, 1000):
        a = np.unique(np.array([rng.getrandbits(56) for _ in range(n)], np.uint64))
        blob = group_keys.pack_keys(a) + group_keys.pack(a % np.uint64(300))
        keys, at = group_keys.unpack_keys(blob)
        assert (keys == a).all() and (group_keys.unpack(blob, at)[0] == a % np.uint64(300)).all()


def test_query_covers_every_document(spark, sf, corpus):
    got = katz.op9_katz(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"), F.max("train_tokens").alias("t")).first()
    assert got.n == got.d == len(corpus) and got.t > 0
