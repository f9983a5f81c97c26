import random

import numpy as np

from corvina.llm.lookalike import words
from corvina.llm.neardup import circulant_signature, links_within, near_duplicate_groups, similar_pairs


def brute(texts, threshold=0.7, least=10):
    sets = {i: frozenset(words(t)) for i, t in texts.items()}
    ids = [i for i, s in sets.items() if len(s) >= least]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def made(n, seed=1):
    rnd, texts, i = random.Random(seed), {}, 0
    vocabulary = [f"w{k}" for k in range(400)]
    while i < n:
        base = rnd.sample(vocabulary, 24)
        for _ in range(rnd.choice([1, 1, 1, 2, 4])):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rnd.shuffle(w)
            texts[i] = " ".join(w)
            i += 1
    return texts


def test_signature_estimates_jaccard():
    a, b = np.arange(0, 80), np.arange(20, 100)  # 60 of 100
    flat = np.concatenate([a, b]).astype(np.int64) * 2654435761 % 2**32
    s = circulant_signature(flat.astype(np.uint32), np.array([0, 80]), 2000)
    assert abs((s[:, 0] == s[:, 1]).mean() - 0.6) < 0.06


def test_groups_as_by_brute_force(spark):
    texts = made(300)
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    want = brute(texts)
    for bands, rows in ((90, 8), (40, 3)):  # few rows: many members of a bucket are not alike
        got = {r.id: r.group_id for r in near_duplicate_groups(df, "id", "t", bands=bands, rows=rows).collect()}
        assert got == want


def test_ties_hold_every_bucket_together(spark, monkeypatch):
    from corvina.llm import neardup

    monkeypatch.setattr(neardup, "PACKED", 500)  # many parts
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # buckets over many batches
    try:
        sets = spark.createDataFrame([(i, [3, 4] if i % 3 else [100 + i]) for i in range(600)], "id long, words array<long>")
        ties = [(r.bucket, r.pivot, r.id) for r in neardup.shared_buckets(sets, 3, 2).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    alike = {i for i in range(600) if i % 3}
    assert len(ties) == len(set(ties)) == 3 * (len(alike) - 1) and len({b for b, _, _ in ties}) == 3
    for bucket in {b for b, _, _ in ties}:
        reached = {1}
        for _ in range(3):
            reached |= {i for b, p, i in ties if b == bucket and p in reached}
        assert reached == alike


def test_recall_near_the_threshold(spark):
    """Pairs whose similarity is just above the threshold, by brute force 1,200 of them: how many are found as a link of their own."""
    rnd, sets = random.Random(9), []
    while len(sets) < 2400:
        n, common = rnd.choice([(20, 17), (40, 34), (60, 50), (27, 23), (34, 28)])  # 17 of 23 and the like: 0.70 to 0.74
        words_ = [rnd.getrandbits(62) for _ in range(2 * n - common)]
        a, b = words_[:n], words_[n - common :]
        assert 0.7 <= common / (2 * n - common) < 0.75
        sets += [(len(sets), sorted(a)), (len(sets) + 1, sorted(b))]
    got = {(r.a, r.b) for r in similar_pairs(spark.createDataFrame(sets, "id long, words array<long>")).collect()}
    recall = sum((2 * k, 2 * k + 1) in got for k in range(1200)) / 1200
    print(f"recall at 0.70 to 0.75: {recall:.4f}")
    assert recall >= 0.98 and len(got) <= 1200


def test_hot_group_is_not_compared_pairwise(spark):
    base = [f"h{k}" for k in range(30)]
    rnd = random.Random(3)
    texts = {i: " ".join([*rnd.sample(base, 28), f"x{i}"]) for i in range(150)} | {1000 + i: t for i, t in made(60, 5).items()}
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    got = {r.id: r.group_id for r in near_duplicate_groups(df, "id", "t").collect()}
    assert got == brute(texts)


def test_links_as_by_brute_force(spark):
    base, rnd = [f"h{k}" for k in range(30)], random.Random(3)
    texts = {i: " ".join([*rnd.sample(base, rnd.choice([24, 28])), f"x{i}"]) for i in range(80)} | {1000 + i: t for i, t in made(40, 5).items()}
    texts[500] = texts[0].upper()
    sets = {i: frozenset(words(t)) for i, t in texts.items()}
    distinct, group = set(sets.values()), brute(texts)
    want = {i: sum(len(s & o) / len(s | o) >= 0.7 for o in distinct - {s}) + sum(o == s for o in sets.values()) - 1 for i, s in sets.items()}
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    got = {r.id: (r.group_id, r.links) for r in near_duplicate_groups(df, "id", "t").collect()}
    assert got == {i: (group[i], want[i]) for i in texts}
    member = spark.createDataFrame([(0, k, [hash(w) % 2**31 for w in sorted(s)]) for k, s in enumerate(distinct)], "group_id long, same long, words array<int>")
    few = {r.same: r.links for r in links_within(member, part=7).collect()}  # in many parts each pair still counts once
    assert few == {r.same: r.links for r in links_within(member).collect()} and max(few.values()) > 7


def test_cases(spark):
    ten = "a b c d e f g h i j"
    rows = [(1, ten, 9), (2, ten.upper() + "!!", 9), (3, "a b c", 9), (4, None, 9), (5, "", 9), (None, ten, 9), (1, ten, 9), (7, " ".join(f"u{i}" for i in range(50000)), 9)]
    df = spark.createDataFrame(rows, "id long, t string, group_id int").withColumnRenamed("group_id", "words")
    got = sorted((r.id, r.group_id, r.links) for r in near_duplicate_groups(df, "id", "t").collect())
    assert got == [(1, 1, 1), (2, 1, 1), (7, 7, 0)]
    assert near_duplicate_groups(df.limit(0), "id", "t").count() == 0


def test_pairs_are_verified(spark):
    sets = spark.createDataFrame([(1, list(range(20))), (2, list(range(1, 21))), (3, list(range(100, 120)))], "id long, words array<int>")
    got = similar_pairs(sets).collect()
    assert [(r.a, r.b, round(r.jaccard, 3)) for r in got] == [(1, 2, round(19 / 21, 3))]
