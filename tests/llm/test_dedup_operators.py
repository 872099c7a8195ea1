"""Decontamination, passages, repeated substrings, near copies, chat trees, URL rules."""

import hashlib
import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chained_seeds, chat_trees, decontaminate, substring_ranks, url_rules, weighted_minhash

from . import brute


def words(rng, n, letters="abcdefghij"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def removed(df):
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", n, F.size("removed"), F.sha2("kept", 256)).collect()), key=str)


def test_repeated_substrings(spark, rng, corpus):
    passages = [" ".join(words(rng, 150)) for _ in range(4)]
    rows = []
    for i in range(90):
        k, p = rng.random(), rng.choice(passages)
        if k < 0.3:
            t = " ".join(words(rng, rng.randint(0, 300), "abcdeéf"))
        elif k < 0.5:
            a = rng.randint(0, len(p) // 2)
            t = " ".join(words(rng, 30)) + p[a : a + rng.randint(300, 700)] + " ".join(words(rng, 30))
        elif k < 0.6:
            t = p
        elif k < 0.7:
            t = "ab" * rng.randint(150, 400)
        elif k < 0.8:
            t = "x" * rng.randint(395, 900)
        else:
            c = list(p + rng.choice(passages))
            c[rng.randrange(len(c))] = "Z"
            t = "".join(c)
        rows.append((i, t))
    p = passages[0]
    rows += [(500, None), (501, ""), (None, p), (7, passages[1]), (7, passages[1]), (600, p[:400]), (601, p[1:401]), (602, p[:399])]
    for case in (rows, corpus[:120]):
        assert removed(substring_ranks.remove_repeats(spark.createDataFrame(case, "doc_id long, text string"))) == brute.repeated_substrings(case, 400)


def test_repeated_substrings_in_parts(monkeypatch, rng):
    monkeypatch.setattr(substring_ranks, "PART", 1000)
    text = " ".join(words(rng, 2000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    few = substring_ranks.blocks(offsets, data, 37)
    monkeypatch.undo()
    whole = substring_ranks.blocks(offsets, data, 37)
    assert all((few[k] == whole[k]).all() for k in whole)


def test_repeated_substrings_odd(odd, none):
    got = substring_ranks.remove_repeats(odd, carry=("lang", "key", "text"))
    assert got.count() == 10 and got.filter("carried.key = 'k'").count() == 10
    assert substring_ranks.remove_repeats(none).count() == 0


def test_passages_of_over_50_words(spark, rng, tmp_path):
    """The query's bound is 400 bytes, not words; n_bytes is the text's size, whatever is found in it."""
    short, long = (" ".join("".join(rng.choice("abcdefghij") for _ in range(k)) for _ in range(60)) for k in (5, 7))
    assert len(short) < 400 <= len(long)
    rows = [(i, " ".join([*words(rng, 40), *p, *words(rng, 40)])) for i, p in enumerate(([short], [short], [long], [long], [short, long], []))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = substring_ranks.op6_repeated_substrings(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == brute.repeated_substrings(rows, 400)
    assert {r.doc_id for r in got.filter("n_removed >= 400").collect()} == {2, 3, 4} and got.filter("n_removed > 0").count() == 3
    assert {r.doc_id: r.n_bytes for r in got.collect()} == {i: len(t.encode()) for i, t in rows}


def test_myers(rng):
    items = ["".join(rng.choice("abcd ") for _ in range(rng.randint(20, 200))).strip() for _ in range(60)]
    for y in items:
        z = list(y)
        for _ in range(rng.randint(0, len(y) // 20 + 4)):
            k, o = rng.randrange(len(z)), rng.random()
            if o < 0.34:
                z[k] = "q"
            elif o < 0.67:
                z.insert(k, "q")
            else:
                z.pop(k)
        x = "x y " * rng.randint(0, 10) + "".join(z) + " zz" * 5
        best, got = brute.best_within(y, x), decontaminate.find(((0, y),), x)
        assert bool(got) == (best <= len(y) // 20)
        if got:
            _, n, a, b = got[0]
            assert n == best == brute.edit_distance(y, x[a:b])


def test_edited_item_with_repeated_pieces():
    p, q = "abcdefghijklm", "nopqrstuvwxyA"
    x = "k" * 50 + p[:5] + "?" + p[6:] + q[:5] + "?" + q[6:] + p + "z" + "k" * 50
    assert decontaminate.find(((0, p + q + p + "z"),), x) == [(0, 2, 50, 90)]


def test_items_with_repeated_pieces(rng):
    """An intact later piece that equals an edited earlier one does not hide the item; the place is the first of the least distance."""
    for _ in range(400):
        few = ["".join(rng.choice("abcdef") for _ in range(rng.randint(5, 14))) for _ in range(2)]
        y = "".join(rng.choice(few) for _ in range(rng.randint(3, 9))) + rng.choice(("", "z"))
        z = list(y)
        for k in rng.sample(range(len(y)), min(len(y), rng.randint(0, len(y) // 20 + 1))):
            z[k] = "q"
        x = "k" * rng.randint(0, 90) + rng.choice(("", few[0])) + "".join(z) + rng.choice(("", few[1], y[1:])) + "k" * rng.randint(0, 90)
        best, got = brute.best_within(y, x), decontaminate.find(((0, y),), x)
        assert bool(got) == (best <= len(y) // 20)
        if got:
            _, n, a, b = got[0]
            assert n == best == brute.edit_distance(y, x[a:b]) and brute.best_within(y, x[: b - 1]) > best


def test_decontaminate(spark, sf, corpus, odd, none):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.op2_decontaminate(spark, sf).collect()}
    want = {}
    for d, t in corpus:
        text = decontaminate.normal(t)
        for i, y in items:
            y = decontaminate.normal(y)
            n, end = decontaminate.myers(y, text, len(y) // 20)  # over the whole text, without pieces
            if n >= 0:
                want[d, i] = n, end
    assert {k: (r.distance, r.end) for k, r in got.items()} == want
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "Same TEXT of a few  words"), (4, "same text of a few words"), (None, "no id")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(odd, bench).collect()} == {(5, 3), (5, 4), (6, 3), (6, 4), (None, None)}
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(odd, bench.limit(0)).count() == 0


def test_decontaminate_in_blocks(spark, monkeypatch, rng):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    items = [(i, " ".join(words(rng, 90 if i == 5 else 15))) for i in range(12)]  # one longer than a block
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in items], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()} == {(i, i) for i, _ in items}


def test_word_distance(rng):
    for _ in range(200):
        a = [rng.randint(0, 9) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            k, o = rng.randrange(len(b) + 1), rng.random()
            if o < 0.4 and k < len(b):
                b[k] = rng.randint(0, 9)
            elif o < 0.7:
                b.insert(k, rng.randint(0, 9))
            elif k < len(b):
                b.pop(k)
        most, want = len(a) // 5, brute.edit_distance(a, b)
        got = chained_seeds.distance(np.array(a), np.array(b), most)
        assert want <= got <= most if want <= most else got > most


def test_chains_are_best(rng):
    """The best chain's score is that of the plain quadratic recursion."""
    for _ in range(50):
        pts = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(25)})
        x, y = [p[0] for p in pts], [p[1] for p in pts]
        score = []
        for i in range(len(pts)):
            before = [score[j] - chained_seeds.GAP * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            score.append(chained_seeds.MATCH + max([0, *before]))
        end = max(range(len(pts)), key=lambda i: score[i])
        got = chained_seeds.chains(x, y)
        assert not got or (x[end] + chained_seeds.K, y[end] + chained_seeds.K) in [(b, d) for _, b, _, d in got]


def test_passages(spark, rng, odd, none):
    planted, rows, having = [words(rng, 70) for _ in range(6)], [], set()
    for i in range(150):
        w = words(rng, rng.randint(0, 300))
        if rng.random() < 0.4:
            q = list(rng.choice(planted))
            for _ in range(rng.randint(0, 6)):
                q[rng.randrange(70)] = f"zz{rng.randint(0, 99)}"
            k = rng.randint(0, len(w))
            w, _ = w[:k] + q + w[k:], having.add(i)
        rows.append((i, " ".join(w)))
    rows += [(903, " ".join(planted[0] + words(rng, 5) + planted[0])), (904, None)]
    found = chained_seeds.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {r.doc_id for r in found} | {r.other_doc_id for r in found}
    assert having | {903} == ids
    for r in found:
        assert min(r.end - r.start, r.other_end - r.other_start) >= 50 and r.identity >= 0.8
    text = {d: (t or "").split() for d, t in rows}
    for r in found[:30]:
        a, b = text[r.doc_id][r.start : r.end], text[r.other_doc_id][r.other_start : r.other_end]
        assert brute.edit_distance(a, b) <= r.edits
    chained_seeds.passages(odd).collect()
    assert chained_seeds.passages(none).count() == 0


def test_alignment(rng, monkeypatch):
    for held in (1 << 27, 64):
        monkeypatch.setattr(chained_seeds, "HELD_BITS", held)
        for _ in range(100):
            a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 40))] for _ in range(2))
            steps = chained_seeds.alignment(a, b).decode()
            i = j = 0
            for s in steps:
                assert s not in "=x" or (a[i] == b[j]) == (s == "=")
                i, j = i + (s != "b"), j + (s != "a")
            assert (i, j) == (len(a), len(b)) and len(steps) - steps.count("=") == brute.edit_distance(a, b)


def test_passages_are_split(rng):
    """Along an alignment, every word that lies in some passage is in one that is found (by all pairs of steps)."""
    for _ in range(60):
        a, b = [], []
        for _ in range(rng.randint(1, 4)):
            p = [rng.randint(0, 10**6) for _ in range(rng.randint(20, 90))]
            q = [w for w in p if rng.random() > 0.08]
            q = [rng.randint(0, 10**6) if rng.random() < rng.choice((0, 0.1)) else w for w in q]
            a, b = a + p + [rng.randint(0, 10**6) for _ in range(rng.randint(0, 60))], b + q + [rng.randint(0, 10**6) for _ in range(rng.randint(0, 60))]
        steps = chained_seeds.alignment(a, b)
        x, y, n = (np.cumsum([0, *(c not in no for c in steps)]) for no in (b"b", b"a", b"="))
        want = set()
        for s in range(len(steps)):
            for e in range(s + 50, len(steps) + 1):
                dx, dy = x[e] - x[s], y[e] - y[s]
                if steps[s] == steps[e - 1] == ord("=") and min(dx, dy) >= 50 and 5 * (n[e] - n[s]) <= max(dx, dy):
                    want.update(i for i in range(s, e) if steps[i] == ord("="))
        got = chained_seeds.split(np.array(a), np.array(b))
        for x0, x1, y0, y1, edits in got:
            assert min(x1 - x0, y1 - y0) >= 50 and edits <= 0.2 * max(x1 - x0, y1 - y0)
            assert brute.edit_distance(a[x0:x1], b[y0:y1]) <= edits
        assert {int(x[i]) for i in want} <= {w for x0, x1, *_ in got for w in range(x0, x1)}


def test_passages_with_others_between(spark, rng):
    """Pairs of documents with several passages or a stray shared phrase, and unlike words of unlike number between them."""
    rows, want = [], []
    for i in range(0, 40, 2):
        parts = [words(rng, 60) for _ in range(rng.randint(1, 3))] + [words(rng, 8)]
        for d in (i, i + 1):
            w = words(rng, rng.randint(0, 20))
            for p in parts:
                if len(p) == 60:
                    want.append((d, len(w)))
                w = w + p + words(rng, rng.randint(31, 120))
            rows.append((d, " ".join(w)))
    found = chained_seeds.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    spans = [s for r in found for s in ((r.doc_id, r.start, r.end), (r.other_doc_id, r.other_start, r.other_end))]
    assert all(any(e == d and a <= at and at + 60 <= b for e, a, b in spans) for d, at in want)
    for r in found:
        a, b = text[r.doc_id].split()[r.start : r.end], text[r.other_doc_id].split()[r.other_start : r.other_end]
        assert min(len(a), len(b)) >= 50 and brute.edit_distance(a, b) <= r.edits <= 0.2 * max(len(a), len(b)) and {r.doc_id // 2} == {r.other_doc_id // 2}


def found_pairs(spark, rows):
    found = chained_seeds.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return found, {frozenset((r.doc_id, r.other_doc_id)) for r in found}


def test_passage_among_quotations(spark, rng):
    """Two texts share a passage whose every part stands in many others, each too short to be a passage itself."""
    whole, sixty = words(rng, 200), words(rng, 60)
    rows = [(0, words(rng, 40) + whole), (1, whole + words(rng, 30)), (2, words(rng, 30) + sixty + words(rng, 9)), (3, words(rng, 12) + sixty)]
    for i in range(400):
        n, p = (rng.randint(12, 44), whole) if i < 300 else (15, sixty)
        a = rng.randint(0, len(p) - n) if i < 300 else i % 4 * 15
        rows.append((10 + i, words(rng, 30) + p[a : a + n] + words(rng, 30)))
    found, pairs = found_pairs(spark, [(i, " ".join(w)) for i, w in rows])
    assert {frozenset((0, 1)), frozenset((2, 3))} <= pairs
    assert max(r.end - r.start for r in found if {r.doc_id, r.other_doc_id} == {0, 1}) >= 200
    assert max(r.end - r.start for r in found if {r.doc_id, r.other_doc_id} == {2, 3}) >= 60
    assert all(min(x, y) < 10 for x, y in map(sorted, pairs)) or len(pairs) < 40


def test_passage_in_very_many_texts(spark, rng):
    """Every text with a frequent passage is linked, by fewer rows than pairs."""
    p = words(rng, 60)
    rows = [(i, " ".join(words(rng, 20) + p + words(rng, 20))) for i in range(120)]
    found, pairs = found_pairs(spark, rows)
    linked, todo = set(), [0]
    while todo:
        x = todo.pop()
        if x not in linked:
            linked.add(x)
            todo += [y for q in pairs if x in q for y in q]
    assert len(linked) == 120 and len(pairs) < 1200 and len(found) < 2000


def test_copies_are_members(spark, rng):
    """Of equal texts one stands for all in the passages, and each of the others is a row with it."""
    p = words(rng, 60)
    same, other = " ".join(words(rng, 20) + p), " ".join(p + words(rng, 30))
    rows = [(5, same), (3, same), (3, same), (None, same), (8, other), (3, "short"), (4, "short")]
    found, pairs = found_pairs(spark, rows)
    assert sorted((str(r.doc_id), r.start, r.end, r.other_doc_id) for r in found if r.start == r.other_start == 0 and r.end == 80) == [("5", 0, 80, 3), ("None", 0, 80, 3)]
    assert frozenset((3, 8)) in pairs and len(found) == 3


def test_recall_of_edited_passages(spark, rng):
    """Passages of 60 to 120 words with up to 15 words in a hundred changed, in pairs of texts: nine in ten at least are found."""
    rows, want = [], set()
    for i in range(0, 160, 2):
        p = words(rng, rng.randint(60, 120))
        q = [f"q{rng.randint(0, 999)}" if rng.random() < rng.choice((0.05, 0.1, 0.15)) else w for w in p]
        if brute.edit_distance(p, q) <= 0.17 * len(p):
            want.add(frozenset((i, i + 1)))
        rows += [(i, " ".join(words(rng, 50) + p + words(rng, 50))), (i + 1, " ".join(words(rng, 70) + q + words(rng, 20)))]
    _, pairs = found_pairs(spark, rows)
    assert len(want & pairs) >= 0.9 * len(want) and pairs <= {frozenset((i, i + 1)) for i in range(0, 160, 2)}


def test_near_copies(spark, rng, odd, none):
    rows = []
    for c in range(12):
        base = words(rng, rng.randint(3, 120))
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 9)}"
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(words(rng, 30) + base[:10])))
    rows += [(500, None), (501, ""), (502, " ")]
    got = {r.doc_id: r.class_id for r in weighted_minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_classes(rows)
    few = weighted_minhash.near_copies(odd).collect()
    assert len(few) == 10 and {r.class_id for r in few if r.doc_id in (5, 6)} == {5}
    assert weighted_minhash.near_copies(none).count() == 0


@pytest.mark.parametrize("block", [256, 40])
def test_near_copies_in_large_groups(spark, rng, monkeypatch, block):
    """Pairs of twins among hundreds of texts that share most words: each is a near copy of its twin only."""
    monkeypatch.setattr(weighted_minhash, "BLOCK", block)
    core, rows = words(rng, 804), []
    for _ in range(120):
        twin = words(rng, 8)
        rows += [(len(rows) + i, " ".join(core + twin + words(rng, 14))) for i in range(2)]
    rng.shuffle(rows)
    want = brute.near_classes(rows)
    assert len(set(want.values())) == 120
    assert {r.doc_id: r.class_id for r in weighted_minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_near_copies_of_the_corpus(spark, sf, corpus):
    got = {r.doc_id: r.class_id for r in weighted_minhash.op8_weighted_minhash(spark, sf).collect()}
    assert got == brute.near_classes(corpus)


def test_samples_estimate_similarity():
    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 1 << 56, 400, dtype=np.uint64))
    a, b = rng.uniform(1, 5, 400), rng.uniform(1, 5, 400)
    two = weighted_minhash.samples(np.r_[key, key], np.r_[a, b], np.array([0, 400]), 3000)
    assert abs((two[0] == two[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_components(spark):
    edges = spark.createDataFrame([*((i, i + 1) for i in range(20)), (100, 101), (101, 102), (100, 102)], "a long, b long")
    got = {r.node: r.component for r in weighted_minhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100, 102: 100}


def test_chat_round_trip(spark, sf):
    texts = ["", "plain", "\\", "\\\\<|im_end|>", "<\\|im_end|>", "</s>[INST] ok [/INST]", "<|im_start|>user<|im_sep|>x<|im_end|>\n", "日本😀\n", None, "a\\", "<<SYS>><</SYS>>"]
    rows = [(c, i, ("user", "assistant")[i % 2], t) for c, order in enumerate((texts, texts[::-1])) for i, t in enumerate(order)] + [(None, 0, None, "x"), (9, None, "tool\n<s>", "y"), (9, 1, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat_trees.format_paths(chat_trees.reply_paths(chat_trees.linear_tree(turns)))
    got = {r.conv_id: r for r in chat_trees.read_back(formatted).collect()}
    for c in (0, 1, 9, None):
        want = sorted((r for r in rows if r[0] == c), key=lambda r: -1 if r[1] is None else r[1])
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in want]
        assert got[c].loss_text == "".join(r[3] or "" for r in want if r[2] == "assistant")
    assert all(c not in got[1].formatted.replace("<|im_start|>", "").replace("<|im_sep|>", "").replace("<|im_end|>", "") for c in chat_trees.CONTROL)
    assert chat_trees.read_back(chat_trees.format_paths(chat_trees.reply_paths(chat_trees.linear_tree(turns.limit(0))))).count() == 0


def test_chat_of_repeated_rows(spark):
    """Repeated rows are messages of their own, extra columns change nothing, and a long text comes back whole."""
    long = "</s> word " * 50_000
    rows = [(1, 0, "user", "a", "x", 5), (1, 0, "user", "a", "x", 5), (1, 1, "assistant", long, None, 6), (2, None, None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, depth long")
    got = {r.conv_id: r for r in chat_trees.read_back(chat_trees.format_paths(chat_trees.reply_paths(chat_trees.linear_tree(turns)))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "a"), ("user", "a"), ("assistant", long)] and got[1].loss_text == long
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")] and len(got) == 2


def test_branches_are_ranked(spark):
    #      1 -> 2 -> 4 (score 5), 1 -> 3 -> 5 -> 6 (scores 1 + 1 + 9); 7 hangs from nothing; 8 and 9 are a cycle
    rows = [(1, 1, None, 0.0), (1, 2, 1, 2.0), (1, 3, 1, 1.0), (1, 4, 2, 5.0), (1, 5, 3, 1.0), (1, 6, 5, 9.0), (1, 7, 99, 1.0), (1, 8, 9, 9.0), (1, 9, 8, 9.0)]
    messages = spark.createDataFrame([(c, m, p, "user", f"m{m}", s) for c, m, p, s in rows], "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    paths = chat_trees.reply_paths(messages, top=3).orderBy("path_rank", "depth").collect()
    by = {}
    for r in paths:
        by.setdefault(r.path_rank, []).append(r.text)
    assert by == {1: ["m1", "m3", "m5", "m6"], 2: ["m1", "m2", "m4"], 3: ["m7"]}


def test_deep_thread(spark):
    turns = spark.range(1000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat_trees.read_back(chat_trees.format_paths(chat_trees.reply_paths(chat_trees.linear_tree(turns)))).first()
    assert [int(t.text) for t in got.turns] == list(range(1000))


def judge_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None)))


@pytest.mark.parametrize("most", [1000, 2])
def test_url_parts_and_rules(spark, monkeypatch, most):
    monkeypatch.setattr(url_rules, "MOST_RULES", most)  # beyond it, rules are joined
    urls = [None, "", "no scheme", "http://", "://Example.ORG/en/12?x#y", "https://A.example.org/es/1", "http://org/", "http://xorg/de/", "http://x.com/fr/a/de/", "http://x.com/de/", "http://x.com?q=/de/", "http://x.com#/de/", "http://EXAMPLE.org/en/1?x", "http://a://b/c", "http://ÀB.com/fr/\n1"]
    pages = spark.createDataFrame([(i, u, "", 1) for i, u in enumerate(urls)] + [(1, "http://x.com/de/", "", 1)], "page_id long, url string, html string, tokens int")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, labels).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        if r.page_id != 1:
            host, path, rule, verdict = judge_url(urls[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    assert url_rules.judge(pages.limit(0), labels).count() == 0 and url_rules.judge(pages, labels.limit(0)).filter("rule is null and verdict != 'allow'").count() == 0


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_url_rules_as_sql(spark, size):
    at, own = f"/root/testdata/sf{size}", duckdb.connect()
    for t in ("pages", "labels"):
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet')")
    want = own.sql(url_rules.ORACLE)
    assert sorted(map(str, url_rules.op5_url_rules(spark, at).select(*want.columns).collect())) == sorted(f"Row({', '.join(f'{c}={v!r}' for c, v in zip(want.columns, r, strict=True))})" for r in want.fetchall())


def test_url_sql_of_odd_pages(spark, rng):
    odd = [None, "", "no scheme", "http://", "://Example.ORG/en/12?x#y", "http://x.com/de/?a=1&b&=c&a=2#f", "ftp://ÀB.com/fr/x.html", "http://a..b/c//d.tar.gz?#"]
    pages = [(i, odd[i] if i < len(odd) else f"http://{rng.choice('ab')}.{rng.choice(['spam', 'site'])}.net/{rng.choice('abc')}/{rng.randint(0, 3)}.{rng.choice(['html', 'php'])}?{rng.choice('xy')}={i}") for i in range(90)]
    pages += pages[3:12]
    labels = [(i, rng.choice([0, 1, 1, None]), int(pages[i][1] is not None and "spam" in pages[i][1] and rng.random() < 0.9)) for i in range(90)] + [(20, 0, 0), (20, 0, 0), (None, 1, 1), (5000, 1, 1)]
    own = duckdb.connect()
    own.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    own.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    own.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    own.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    columns = ["page_id", "host", "path", "rule", "verdict"]
    got = url_rules.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select(*columns).collect()
    want = own.sql(f"SELECT {', '.join(columns)} FROM ({url_rules.ORACLE})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(r.rule is None and r.verdict == "block" for r in got)


def test_mined_rules(spark, rng):
    urls = [(i, f"http://{'casino' if i % 4 == 0 else 'news'}{rng.randint(0, 9)}.{'spam' if i % 4 == 0 else 'site'}.net/{rng.choice('abc')}/{i}") for i in range(200)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, labels).collect()
    assert all((r.verdict == "block") == (r.page_id % 4 == 0) for r in got)
    parts = url_rules.with_parts(pages).withColumn("tokens", url_rules.tokens())
    known = labels.select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("bad"))
    rules = url_rules.mine(parts.join(known, "page_id").select("tokens", "bad"))
    found = {r.url: r.mined for r in url_rules.match(parts, rules).collect()}
    table = [(set(r.antecedent), r) for r in rules.collect()]
    for r in parts.collect():
        fits = [x for need, x in table if need <= set(r.tokens)]
        assert (r.url in found) == bool(fits)
        if fits:
            assert found[r.url].confidence == max(x.confidence for x in fits)


def test_rules_are_those_of_brute_force(spark, rng):
    """FP-growth's rules against all subsets of the tokens that are left, and the pruning of tokens and rare rules."""
    rows = []
    for i in range(120):
        tokens = {"scheme:http", *(f"t{k}" for k in range(7) if rng.random() < 0.5), f"own{i}"}
        tokens |= {"twin1", "twin2"} if i % 3 == 0 else set()
        rows.append((sorted(tokens), rng.random() < (0.8 if "t1" in tokens and "t2" in tokens else 0.3)))
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    got = {(tuple(r.antecedent), r.verdict): (r.confidence, r.support, r.anchor) for r in url_rules.mine(labelled, 0.05, 0.6, 1.2).collect()}
    useful = [f"t{k}" for k in range(7)] + ["twin1"]
    freq = {t: sum(t in x for x, _ in rows) for t in useful}
    want = {}
    for n in range(1, len(useful) + 1):
        for of in itertools.combinations(useful, n):
            here = [bad for x, bad in rows if set(of) <= set(x)]
            for name, bad in (("block", True), ("allow", False)):
                both, share = here.count(bad), sum(b == bad for _, b in rows) / len(rows)
                if both >= 6 and both / len(here) >= 0.6 and both / len(here) / share >= 1.2:
                    want[of, name] = both / len(here), both / len(rows), min((freq[t], t) for t in of)[1]
    assert got.keys() == want.keys() and len(want) > 10
    assert all(np.allclose(got[k][:2], want[k][:2]) and got[k][2] == want[k][2] for k in want)
    # A share of a few pages is not enough.
    assert url_rules.mine(labelled.limit(30), 0.01, 0.5, 1.1).filter("support * 30 < 4.5").count() == 0


@pytest.mark.parametrize("text", ["", "x"])
def test_sha_of_kept(spark, text):
    row = substring_ranks.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert hashlib.sha256(row.kept).hexdigest() == hashlib.sha256(text.encode()).hexdigest() and row.removed == []


def test_query_as_by_all_pairs(spark, sf, corpus):
    """Every passage found is one, and texts that share an exact run of 50 words, or are as a whole within the limit of edits, hang together."""
    found = chained_seeds.op3_chained_seeds(spark, sf).collect()
    text = {d: (t or "").split() for d, t in corpus}
    assert len(text) == len(corpus)
    for r in found:
        a, b = text[r.doc_id][r.start : r.end], text[r.other_doc_id][r.other_start : r.other_end]
        assert min(len(a), len(b)) >= 50 and r.identity >= 0.8
        assert a == b or brute.edit_distance(a, b) <= r.edits
    runs, linked = {}, set()
    for d, w in text.items():
        for i in range(len(w) - 49):
            runs.setdefault(tuple(w[i : i + 50]), set()).add(d)
    for having in runs.values():
        linked |= set(itertools.pairwise(sorted(having)))
    grams = {d: [tuple(w[i : i + 4]) for i in range(len(w) - 3)] for d, w in text.items()}
    held = {d: set(g) for d, g in grams.items()}
    for a, b in itertools.combinations([d for d, w in text.items() if len(w) >= 50], 2):
        most = max(len(text[a]), len(text[b]))
        if abs(len(text[a]) - len(text[b])) > 0.2 * most or sum(g in held[b] for g in grams[a]) < len(grams[a]) - 4 * (0.2 * most):
            continue  # so many edits would leave more four-word strings
        if (a, b) not in linked and brute.edit_distance(text[a], text[b]) <= 0.2 * most:
            linked.add((a, b))
    assert len(linked) > 20
    parent = {d: d for d in text}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[root(r.doc_id)] = root(r.other_doc_id)
    assert [p for p in sorted(linked) if root(p[0]) != root(p[1])] == []


@pytest.mark.parametrize(("copies", "edits"), [(30, 0.1), (100, 0.08)])
def test_copies_of_a_passage_hang_together(spark, rng, copies, edits):
    """Each copy is edited on its own, so every seed has some of the copies and no copy has all the seeds."""
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5000)]
    rows, cluster = [], {}
    for g in range(2):
        passage = rng.choices(words, k=60)
        for _ in range(copies):
            own = list(passage)
            for j in rng.sample(range(60), round(60 * edits)):
                own[j] = rng.choice(words)
            cluster[len(rows)] = g
            rows.append((len(rows), " ".join([*rng.choices(words, k=60), *own, *rng.choices(words, k=60)])))
    found = chained_seeds.passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "other_doc_id").distinct().collect()
    assert all(cluster[r.doc_id] == cluster[r.other_doc_id] for r in found)
    parent = {d: d for d in cluster}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[root(r.doc_id)] = root(r.other_doc_id)
    # Over both clusters, as the README's figures are: a cluster of 30 can have a text that hangs apart (0.93 of its pairs).
    sizes = [sum(root(d) == top for d in cluster) for top in {root(d) for d in cluster}]
    assert sum(n * (n - 1) for n in sizes) >= 0.95 * 2 * copies * (copies - 1)
