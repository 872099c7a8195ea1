"""Each stage of the pipeline on its own input, against plain versions."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from plumbline.llm import decontaminate, piece_bpe

from . import brute
from .test_text_operators import encoders


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = corpus_pipeline.cut(stage(spark, docs, sf))
        out[name] = (docs, result)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == docs.columns
        docs = result
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "substring dedup", "decontamination", "encoding"]


def test_quality(stages):
    before, after = stages["quality rules"]
    want = brute.fertility_kept([(r.doc_id, r.text, r.lang) for r in before.collect()], encoders())
    assert texts(after) == {d: t for d, t in texts(before).items() if want[d]}


def test_near(stages):
    before, after = map(texts, stages["near-dedup"])
    classes = brute.near_classes(sorted(before.items()))
    assert set(after) == set(classes.values()) and all(before[d] == t for d, t in after.items())


def test_substrings(stages):
    before, after = map(texts, stages["substring dedup"])
    assert after == dict(brute.texts_without_repeats(sorted(before.items()), corpus_pipeline.REPEAT_BYTES)) != before
    lengths = {r.doc_id: r.n_chars for r in stages["substring dedup"][1].collect()}
    assert all(lengths[d] == len(t) for d, t in after.items())


def words(rng, n, letters="abcdefghé日"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_substrings_of_odd_texts(spark, sf, rng):
    """Own replacement characters stay, cut characters go, and nothing else does."""
    p = words(rng, 120)
    rows = [(1, f"keep � this {p} and �"), (2, "日本" + p[3:] + "日"), (3, "旦" + p[3:] + "旦"), (None, p), (None, "x" + p), (4, None), (5, ""), (5, words(rng, 90)), (5, p + p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.substring_dedup(spark, docs, sf).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.texts_without_repeats(rows, corpus_pipeline.REPEAT_BYTES)))
    assert "keep � this " in {r.text[:12] for r in got} or any(r.text.startswith("keep � this ") and r.text.endswith(" and �") for r in got)


def test_clashing_and_missing_ids(spark, sf, rng):
    """Texts under one id, or without one, are judged one by one; of equal rows one stays."""
    good = [words(rng, 200, "abcdefghijklmnopqrstuvwxyz") for _ in range(4)]
    item = words(rng, 40)
    rows = [(1, good[0]), (1, good[1]), (1, "too short"), (None, good[2]), (None, "short too"), (None, good[3] + " " + item), (2, good[0] + " end"), (3, good[3] + " " + item), (1, good[1]), (4, good[1])]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, a int")
    kept = corpus_pipeline._without(docs, docs.filter("text like '%short%'").select(corpus_pipeline.row_key().alias("doc_id")))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str(x) for x in rows if "short" not in x[1])
    ruled = corpus_pipeline.quality_rules(spark, docs, sf)
    assert ruled.columns == docs.columns and {r.text for r in ruled.collect()} == {t for _, t in rows if "short" not in t}
    near = sorted(map(str, ((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, ruled, sf).collect())))
    assert near == sorted(map(str, [(1, good[0]), (1, good[1]), (None, good[2]), (3, good[3] + " " + item)]))
    # Decontamination finds items in rows without an id too.
    parquet = spark.createDataFrame([(1, item)], "item_id long, text string")
    gone = decontaminate.matches(corpus_pipeline._keyed(docs), parquet)
    left = corpus_pipeline._without(docs, gone).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in left))) == sorted(str(x) for x in rows if item not in x[1])


def test_decontamination(spark, sf, stages):
    before, after = map(texts, stages["decontamination"])
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, t in before.items() if any(i in decontaminate.normal(t) for i in items)}
    assert not leaked & set(after)
    for d in set(before) - set(after) - leaked:
        text = decontaminate.normal(before[d])
        assert any(decontaminate.find(((0, i),), text) for i in items)


def test_encoding(stages):
    before, rows = texts(stages["encoding"][0]), stages["encoding"][1].collect()
    assert {r.doc_id for r in rows} == set(before)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL))
    for r in rows:
        ids = library.encode(before[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_documents(spark, sf, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.cut(stage(spark, docs, sf))
    assert docs.count() == 0
