"""Line dedup, phrase collocations and spelling variants against plain programs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidentia.llm import collocations, line_dedup, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- line dedup ------------------------------------------------------------------


def brute_lines(rows, host=False, min_documents=3, min_chars=20):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    place = lambda r: (r[2] if len(r) > 2 else "s") if host else ""
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[place(r), key(line)].add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = []
        for line in lines:
            ids = holders.get((place(r), key(line)), ())
            largest = max((i for i in ids if i is not None), default=None)
            if len(ids) < min_documents or r[0] == largest:
                kept.append(line)
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def lines_of(frame, **how):
    got = line_dedup.without_repeated_lines(frame, **how).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str)


LONG = "A line that is long enough to count"
ODD_LINES = [
    (9000, None), (9001, ""), (9002, "\n\n"), (9003, LONG), (9004, f"\t{LONG.upper()} \r\nown\n{LONG}"), (9005, f"x\n{LONG}"),
    (9006, "é" * 19), (9007, "é" * 19), (9008, "é" * 19), (9009, "É" * 20), (9010, "é" * 20), (9011, "É" * 20), (9012, "É" * 20),
    (None, LONG), (None, "Only null documents hold this line"), (None, "Only null documents hold this line"),
    (9013, "Two rows of one document hold this"), (9013, "Two rows of one document hold this"), (9014, "Two rows of one document hold this"),
    (9015, f"{LONG}\n{LONG}"), (9016, "\x1c" + "a" * 19), (9017, "\x1c" + "a" * 19), (9018, "a" * 19 + "\xa0"), (9019, "w " * 60_000),
    (9015, "same id, other text"),
]


def test_line_dedup_equals_brute_force(make, some_documents):
    rows = [r[:2] for r in some_documents] + ODD_LINES
    assert lines_of(make(rows)) == brute_lines(rows)
    small = [(i % 40, "\n".join(random.Random(i).choices(["aa", "AA ", "b", "", "c d", "\te"], k=6)), f"s{i % 3}") for i in range(120)]
    for how in ({"min_documents": 2, "min_chars": 1}, {"min_documents": 5, "min_chars": 2}):
        assert lines_of(make(small), **how) == brute_lines(small, **how)
        assert lines_of(make(small), host="source", **how) == brute_lines(small, host=True, **how)
    assert line_dedup.without_repeated_lines(make([])).count() == 0


# ---- phrase collocations ---------------------------------------------------------


def brute_phrases(rows, min_count, top, max_words=5):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, max_words + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= min_count and len(p) > 1}
        inside = set()
        for p, a in frequent.items():
            for m in range(2, len(p)):
                inside |= {q for i in range(len(p) - m + 1) if 100 * a >= 100 * f[q := p[i : i + m]]}
        ranked = []
        for p, a in frequent.items():
            if p not in inside:
                cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found_phrases(frame, **how):
    return sorted(map(tuple, collocations.collocations(frame, **how).collect()))


def test_collocations_equal_brute_force(spark, some_documents):
    kept = [("en" if i % 3 else "de", t) for i, t, _ in some_documents]
    odd = [
        (None, "x x x x x x. x x X x"), ("und", "x\tx  x,x"), ("en", None), ("en", ""), ("fr", "\n\n. , !"), ("fr", "allein"),
        ("el", "Ü ü ü Ü ü\x1cü ü\xa0ü ü ü"), ("pl", "ab cd " * 30_000), ("en", "w" * 100_000 + " is long"),
    ]
    rows = kept + odd + odd
    frame = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "'x' AS block", "1 AS n", "2 AS id", "'y' AS word")
    for how in ({"min_count": 20, "top": 2000}, {"min_count": 4, "top": 25}, {"min_count": 8, "top": 40, "max_words": 3}):
        # Small blocks: a phrase is counted in many of them.
        assert found_phrases(frame.repartition(3), block=3000, **how) == brute_phrases(rows, **how)
    assert found_phrases(frame.limit(0)) == []


def test_score_is_exact_beyond_64_bits(spark):
    n, a = 2**44 + 12345, 2**40 + 7
    cases = [(a, n, [a + 3, a], [a + 1, a]), (100, n, [100, 100], [100, 100]), (a, n, [2**43, a + 1, a], [2**42 + 9, a + 2, a])]
    frame = spark.createDataFrame(
        [(["w"] * len(x), *case[:2], x, y) for case in cases for x, y in [case[2:]]],
        "words array<string>, a long, total long, firsts array<long>, lasts array<long>",
    )
    got = frame.select(collocations._weakest_cut(5).alias("cut"), "firsts").collect()
    for (a, n, x, y), row in zip(cases, got, strict=True):
        m = len(x)
        want = min((1000 * a * n // (x[k - 1] * y[m - k - 1]), k, x[k - 1], y[m - k - 1]) for k in range(1, m))
        assert tuple(row.cut) == want


def test_tiles_count_as_a_plain_count_does(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(collocations, "SIDE", 8)
    monkeypatch.setattr(collocations, "FULL", 40)
    for size in (1, 7, 8, 9, 100):
        x, y = (np.minimum(rng.geometric(0.15, 3000) - 1, size - 1).astype(np.int32) for _ in range(2))
        want = Counter(zip(x.tolist(), y.tolist(), strict=True))
        a, b, n = collocations.count_pairs(x, y, size)
        assert len(n) == len(want)
        assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == want


# ---- spelling variants -----------------------------------------------------------


def single_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute_variants(n):
    by_hole, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by_hole[w[:i], w[i + 1 :]].add(w)
    for w in n:
        for i in range(len(w)):
            hole = w[:i], w[i + 1 :]
            near[w] |= by_hole[hole] - {w}
            if (short := "".join(hole)) in n:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def test_brute_force_knows_single_edits():
    n = {"".join(random.Random(i).choices("abé", k=random.Random(-i).randint(1, 6))): i for i in range(1, 300)}
    want = {w: sum(single_edit(w, x) for x in n) for w in n}
    assert {r[0]: r[4] for r in brute_variants(n)} == want


def variants_of(spark, n, **how):
    words = spark.createDataFrame(list(n.items()) or [], "word string, n long").repartition(3)
    return sorted(map(tuple, spelling.variants(words, **how).collect()))


def test_spelling_variants_equal_brute_force(spark, make, some_documents):
    rows = some_documents + [(9000, None), (9001, ""), (None, "Zürich zurich Zürichs " * 4), (9002, "ÀÉÈ÷× éèàé÷× " * 5), (9003, "y" * 100_000), (9004, "y" * 99_999)]
    rows += [(k, "y" * 100_000 + " " + "y" * 99_999) for k in (9005, 9006, 9007)]
    counts = {r.word: r.n for r in spelling.word_counts(make(rows)).collect()}
    assert counts == brute_counts(rows)
    assert variants_of(spark, counts) == brute_variants(counts)
    assert spelling.word_counts(make([])).count() == 0
    assert variants_of(spark, {}) == []


@pytest.mark.parametrize("limit", [2048, 3])
def test_variants_in_dense_groups_and_split_groups(spark, monkeypatch, limit):
    """Few letters, so that every key is shared; a low limit splits windows down to one letter."""
    monkeypatch.setattr(spelling, "BLOCK", 16)
    rng = random.Random(limit)
    n = {"".join(rng.choices("aab", k=rng.randint(1, 9))): rng.randint(1, 60) for _ in range(500)}
    n |= {"same" * 5 + "".join(rng.choices("abcdé", k=4)) + "end" * 6: rng.randint(1, 9) for _ in range(200)}
    n |= {"aaaaaaaa": 2**60, "aaaaaaa": 2**59, "aaaaaa": 2**58}
    assert variants_of(spark, n, limit=limit) == brute_variants(n)


def test_a_key_of_most_words_is_split(spark):
    """Half of all words share all but their middle: keys stay within the limit or one letter."""
    rng = random.Random(1)
    n = {f"common{''.join(rng.choices('abcdefgh', k=6))}ending": 1 for _ in range(1500)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    keys = spelling.bounded_keys(words, 50)
    sizes = keys.groupBy(*spelling.KEY).count().where("`count` > 50 AND j - i > 1")
    assert sizes.isEmpty()
    assert variants_of(spark, n, limit=50) == brute_variants(n)
