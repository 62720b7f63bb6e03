from __future__ import annotations

import itertools
import random

import corpus_pipeline

from evidentia.llm import near_copies, simhash_dedup


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_survivors(rows):
    """Smallest doc_id of each group linked by two bits, or by a similarity of 0.8."""
    sets = [brute_shingles(t) for _, t, *_ in rows]
    prints = [simhash_dedup.fingerprint((t or "").encode()) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        x, y = sets[i], sets[j]
        if (prints[i] ^ prints[j]).bit_count() <= 2 or x and y and 5 * len(x & y) >= 4 * len(x | y):
            group[root(i)] = root(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(least.values())


def test_stage_drops_similar_documents_of_many_differing_bits(spark, make, folder, some_documents):
    rng = random.Random(5)
    rows = list(some_documents)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    for k in range(20):  # pairs on both sides of the limit
        words = [word() for _ in range(100)]
        other = words.copy()
        for at in rng.sample(range(100), k % 5 + 1):
            other[at] = word()
        rows += [(2000 + 2 * k, " ".join(words)), (2001 + 2 * k, " ".join(other))]
    base = [word() for _ in range(60)]
    for k in range(60):  # one large bucket
        rows.append((3000 + k, " ".join([*base, word(), word(), word()])))
    rows += [(4000, "one two"), (4001, "One  two"), (4002, "one two three four five"), (4003, None), (4004, "")]
    kept = sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, make(rows), folder).collect())
    assert kept == brute_survivors(rows)
    # Similarities of 0.83, but 11 and 7 differing bits.
    assert not {177, 145} & set(kept)


def test_large_buckets_compare_unlinked_members(spark):
    """Two similar documents are linked where the smallest of their bucket is like neither."""
    sets = {1: list(range(100)), 2: list(range(50, 150)), 3: list(range(52, 152))}
    texts = spark.createDataFrame([(v, " ".join(f"w{x}" for x in s)) for v, s in sets.items()], "row long, text string")
    vertices = spark.createDataFrame([(v, 96, v, [7] * near_copies.BANDS) for v in sets], "v long, size long, row long, keys array<long>")
    assert [tuple(r) for r in near_copies.set_links(vertices, texts).collect()] == [(2, 3)]


def test_no_pair_of_a_large_bucket_is_lost(spark):
    """60 documents of one bucket, similar in pairs only: more than any leaders can meet."""
    sets = {}
    for k in range(30):
        start = 1000 * k
        sets[2 * k + 1], sets[2 * k + 2] = list(range(start, start + 100)), list(range(start + 2, start + 102))
    texts = spark.createDataFrame([(v, " ".join(f"w{x}" for x in s)) for v, s in sets.items()], "row long, text string")
    vertices = spark.createDataFrame([(v, 96, v, [7] * near_copies.BANDS) for v in sets], "v long, size long, row long, keys array<long>")
    found = {tuple(r) for r in near_copies.set_links(vertices, texts).collect()}
    assert found == {(2 * k + 1, 2 * k + 2) for k in range(30)}


def left_apart(spark, sets):
    """The candidates of the exact step for sets that are all apart, in one bucket."""
    rows = [(v, len(s), v, sorted(s)) for v, s in sets.items()]
    frame = spark.createDataFrame(rows, "v long, size long, root long, set array<long>")
    found = near_copies.by_rare_shingles(frame.select("v", "size", "root"), frame.select("v", "set")).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def test_members_that_share_too_little_do_not_meet(spark):
    """200 sets with a common core of 80 % of each are no copies, and none of their pairs is formed."""
    sets = {k: {*range(80), *range(1000 * k, 1000 * k + 20)} for k in range(1, 201)}
    assert left_apart(spark, sets) == set()


def test_rare_shingles_meet_every_similar_pair(spark):
    """Copies of a core on both sides of the limit, of many sizes, against brute force."""
    rng = random.Random(9)
    sets = {}
    for k in range(300):
        core = range(rng.choice([4, 5, 9, 10, 40, 45, 50]))
        own = rng.randrange(len(core) // 6 + 2)
        sets[k] = {*rng.sample(core, len(core) - rng.randrange(len(core) // 8 + 2)), *(100 * k + 1000 + x for x in range(own))}
    similar = {(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    found = left_apart(spark, sets)
    assert len(similar) > 500
    assert similar <= found
    assert all(a < b for a, b in found)
