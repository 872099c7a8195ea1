"""Plain versions of the operators, for small inputs."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_bytes(rows, length):
    """(id, bytes, 1 for each byte that goes) of every row."""
    seen, texts = Counter(), [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] += 1
    for d, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        yield d, b, gone


def repeated_substrings(rows, length):
    out = []
    for d, b, gone in repeated_bytes(rows, length):
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(b, gone, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def texts_without_repeats(rows, length):
    """(id, text) with the characters of which no byte goes."""
    out = []
    for d, b, gone in repeated_bytes(rows, length):
        at, left = 0, []
        for c in b.decode():
            n = len(c.encode())
            if not any(gone[at : at + n]):
                left.append(c)
            at += n
        out.append((d, "".join(left)))
    return out


def base_counts(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams, marked = Counter(zip(words, words[1:], words[2:], strict=False)), set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def fertility_kept(rows, encoders, width=3.0, short=200):
    """id -> kept, by the libraries' ids: ``encoders`` are functions from a text to (ids, how many are bytes alone, size of the vocabulary)."""
    least, measured = (("chars", 100, 0.2, 1, 1), ("bytes", 1000, 0.1, 0, 1), ("entropy", 1000, 0.15, 1, 0)), {}
    for d, text, lang in rows:
        n_words, _, _, _, repeated = base_counts(text)
        if n_words < 50 or 100 * repeated > 50 * n_words:
            continue
        values, n_tokens = [], None
        for encode in encoders:
            ids, n_bytes, size = encode(text)
            n = len(ids)
            n_tokens = n if n_tokens is None else n_tokens
            p = [c / n for c in Counter(ids).values()]
            values += [len(text) / n, n_bytes / n, -sum(x * math.log2(x) for x in p) / math.log2(min(max(n, 2), size))]
        measured[d] = (lang, n_tokens, values)
    kept = dict.fromkeys((d for d, _, _ in rows), False)
    for lang in {x[0] for x in measured.values()}:
        own, edges = {d: x for d, x in measured.items() if x[0] == lang}, []
        for i in range(3 * len(encoders)):
            _, bins, apart, low, high = least[i % 3]
            at = sorted(math.floor(x[2][i] * bins) for x in own.values())
            q1, q3 = (at[math.ceil(q * len(at)) - 1] for q in (0.25, 0.75))
            q1, q3 = q1 / bins, (q3 + 1) / bins
            edges.append((q1, q3, max(width * (q3 - q1), apart), low, high))
        for d, (_, n, values) in own.items():
            far = 1 + short / max(n, 1)
            kept[d] = not any(low and v < q1 - a * far or high and v > q3 + a * far for v, (q1, q3, a, low, high) in zip(values, edges, strict=True))
    return kept


def shingle_weights(rows):
    counts, df = {}, Counter()
    for d, t in rows:
        w = WORD.findall(t or "")
        counts[d] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        df.update(counts[d].keys())
    n = len(rows)
    return {d: {g: k * (math.log((1 + n) / (1 + df[g])) + 1) for g, k in c.items()} for d, c in counts.items()}


def near_classes(rows, threshold=0.8):
    weights, text = shingle_weights(rows), dict(rows)
    parent = {d: d for d in weights}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(weights)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = weights[a], weights[b]
            both = sum(min(v, y[g]) for g, v in x.items() if g in y)
            total = sum(x.values()) + sum(y.values()) - both
            if (text[a] or "") == (text[b] or "") or total and both / total >= threshold:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: root(d) for d in ids}


def katz(rows):
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = []
    for d, t in rows:
        w = [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]
        docs.append((d, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0, w))
    words, pairs, histories = Counter(), Counter(), Counter()
    for _, held, w in docs:
        if not held:
            before = ["<start>", *w[:-1]]
            words.update(w)
            pairs.update(zip(before, w, strict=True))
            histories.update(before)
    n, v = sum(words.values()), len(words)

    def discount(counts):
        of, d = Counter(counts.values()), {}
        tail = 6 * of[6] / of[1] if of[1] else 9
        for r in range(1, 6):
            if of[1] and tail < 1 and of[r] and of[r + 1]:
                x = ((r + 1) * of[r + 1] / (r * of[r]) - tail) / (1 - tail)
                d[r] = x if 0 < x <= 1 else 1.0
        return lambda r: d.get(r, 1.0)

    dw, dp = discount(words), discount(pairs)
    lost = sum((1 - dw(c)) * c for c in words.values()) / n
    unknown = max(lost, 1 / (n + 1))
    scale = (1 - unknown) / (1 - lost)
    p1 = lambda w: scale * dw(words[w]) * words[w] / n if words[w] else unknown
    kept, mass = defaultdict(float), defaultdict(float)
    for (h, w), c in pairs.items():
        kept[h] += dp(c) * c
        mass[h] += p1(w)
    by = {h: c if kept[h] < c * (1 - 1e-9) else c + 1 for h, c in histories.items()}
    back = {h: (1 - kept[h] / by[h]) / (1 - mass[h]) for h in histories}
    for h in histories:  # exactly normalised, the unknown word included
        assert abs(kept[h] / by[h] + back[h] * (1 - mass[h]) - 1) < 1e-9
    assert abs(sum(p1(w) for w in words) + unknown - 1) < 1e-9
    out = {}
    for d, held, w in docs:
        base = score = 0.0
        for h, x in zip(["<start>", *w[:-1]], w, strict=True):
            base += math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1)))
            c = pairs[h, x]
            score += math.log10(dp(c) * c / by[h] if c else back.get(h, 1.0) * p1(x))
        out[d] = (held, len(w), sum(words[x] > 0 for x in w), n, base, score)
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def best_within(pattern, text):
    """Least edit distance of the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def language_profiles(rows, size):
    """(id, text, lang) -> id -> (held_out, lang, score), by counting n-grams word by word."""

    def grams(text):
        # A character whose lower case is several stays as it is; grams of a run of letters between blanks.
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        runs = "".join(y if x.isalpha() else " " for x, y in zip(text, low, strict=True)).split()
        padded = [f" {w} " for w in runs]
        got = Counter(c for w in runs for c in w)
        for n in (2, 3):
            got.update(p[i : i + n] for p in padded for i in range(len(p) - n + 1))
        return got

    def ranked(counts):
        return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], [*map(ord, g), 0, 0][:3]))[:size])}

    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0 for d, _, _ in rows}
    totals = defaultdict(Counter)
    for d, t, lang in rows:
        if not held[d] and lang is not None and t is not None:
            totals[lang].update(grams(t))
    profiles, out = {lang: ranked(c) for lang, c in totals.items() if c}, {}
    for d, t, _ in rows:
        own = ranked(grams(t or ""))
        apart = {lang: sum(abs(p[g] - r) if g in p else size for g, r in own.items()) for lang, p in profiles.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang)) if own and apart else None
        out[d] = (held[d], "und", 0.0) if best is None else (held[d], best, 1 - apart[best] / (size * len(own)))
    return out


_LEADS, _FITTING = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))


def cheapest_edits(initials, kinds):
    """(cost, letters) by Dijkstra over places and states, ties by letters; kinds: 0 sound, 1 truncated, 2 to be deleted."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, letters, i, q = heapq.heappop(heap)
        if i == len(initials) and q in (0, 3):
            return cost, letters
        if (i, q) in done:
            continue
        done.add((i, q))
        heapq.heappush(heap, (cost + 2, letters + "I", i, _FITTING[q][1]))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, q))
            if kinds[i] != 2:
                if initials[i] in _LEADS[q]:
                    heapq.heappush(heap, (cost + kinds[i], letters + "K", i + 1, _LEADS[q][initials[i]]))
                heapq.heappush(heap, (cost + 2 + kinds[i], letters + "R", i + 1, _FITTING[q][1]))


def repaired_conversations(rows):
    """(conv_id, turn, role, text) -> conv_id -> the columns of the report."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        own, role, text = by[conv], " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        own += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    out = {}
    for conv, own in by.items():
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
        own, seen, faults = sorted(own, key=key), set(), []
        for _, role, text in own:
            words = WORD.findall(text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        initials = "".join(r[:1] or " " for _, r, _ in own)
        cost, letters = cheapest_edits(initials, [{"": 0, "truncated": 1}.get(f, 2) for f in faults])
        left, lines, q = iter(own), [], 0
        for x in letters:
            _, role, text = next(left) if x != "I" else (None, None, "")
            if x != "D":
                role, q = (role, _LEADS[q][role[0]]) if x == "K" else _FITTING[q]
                lines.append(f"{role}:{text}")
        count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def vector_codes(rows, parts, entries, rounds):
    """(vec_id, vector, label) -> ([(vec_id, code, error, label_error)], codebooks) of valid rows, measuring every part against every entry."""
    own = sorted(((i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    own = [r for r in own if len(r[1]) == len(own[0][1])]
    if not own:
        return [], []
    width = len(own[0][1]) // parts
    cut = [[tuple(math.floor(256 * x) for x in v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in own]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = defaultdict(list)
            for c in cut:
                at[near(c[p], books[p])[1]].append(c[p])
            for k, xs in at.items():
                books[p][k] = tuple(sum(column) // len(xs) for column in zip(*xs, strict=True))
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = Counter()
    for (_, _, label), e in zip(own, errors, strict=True):
        by[label] += e
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by[label]) for (i, _, label), f, e in zip(own, found, errors, strict=True)], books
