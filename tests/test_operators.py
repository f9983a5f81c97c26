import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from corvina.functions.normalize import normalized
from corvina.operators.compare import changed, count_delta, fingerprint, same_rows, stale
from corvina.operators.grouping import linked_groups
from corvina.operators.keep import best_merged, collapse, distinct_in_order, job_merge, keep_best, keep_first, top_n
from corvina.operators.latest import latest_per_key
from corvina.operators.merge import assign_ids, ignoring, new_if_given, ordered_pairs, remap, replace_children, sticky, upsert
from corvina.operators.orphans import OrphanState, advance, apply_deltas, existence_delta, orphan_keys, orphan_rows, reaching_keys, redirect_delta, reference_delta, snapshot_delta
from corvina.operators.pairs import match_faults, nearest_captions, one_to_one, similar_products


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, None, "d"), (2, 1, "e"), (None, 1, "f"), (1, 7, "c")], "id int, at int, v string")
    assert rows(latest_per_key(df, ["id"], ["at"], ["v"])) == [(1, "c"), (2, "e"), (None, "f")]
    assert latest_per_key(df.limit(0), ["id"], ["at"], ["v"]).count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([(1, "verified", "in", 5), (2, "review", "out", 6), (None, "review", "x", 7)], "id int, status string, stock string, seen int")
    new = spark.createDataFrame([(1, "review", "unknown", None), (3, "review", "in", 9), (None, "new", "y", 1)], "id int, status string, stock string, seen int")
    got = upsert(old, new, ["id"], {"status": sticky("verified"), "stock": ignoring("unknown"), "seen": new_if_given}, action="what")
    assert rows(got) == [(1, "verified", "in", 5, "updated"), (2, "review", "out", 6, "kept"), (3, "review", "in", 9, "inserted"), (None, "new", "y", 1, "inserted"), (None, "review", "x", 7, "kept")]
    again = upsert(got.drop("what").where("id is not null"), new.where("id is not null"), ["id"], {"status": sticky("verified"), "stock": ignoring("unknown"), "seen": new_if_given})
    assert same_rows(again, got.drop("what").where("id is not null"))
    assert rows(upsert(old.drop("seen"), new.drop("stock"), ["id"]).where("id = 1")) == [(1, "review", "in", None)]


def test_replace_and_ids(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "p int, v string")
    new = spark.createDataFrame([(1, "z")], "p int, v string")
    assert rows(replace_children(old, new, ["p"])) == [(1, "z"), (2, "c"), (3, "d")]
    assert rows(replace_children(old, new, ["p"], spark.createDataFrame([(1,), (3,)], "p int"))) == [(1, "z"), (2, "c")]
    names = [f"n{i:04}" for i in range(500)]
    shuffled = names[:]
    random.Random(1).shuffle(shuffled)
    got = assign_ids(spark.createDataFrame([(n,) for n in shuffled], "n string").repartition(7), "id", ["n"], 100)
    assert rows(got, "n", "id") == [(n, 101 + i) for i, n in enumerate(names)]
    pairs = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (None, 1)], "a int, b int")
    assert rows(ordered_pairs(pairs, "a", "b")) == [(1, 2), (1, 2)]
    m = spark.createDataFrame([(1, 10)], "o int, n int")
    assert rows(remap(old, "p", m, "o", "n")) == [(2, "c"), (3, "d"), (10, "a"), (10, "b")]
    assert rows(remap(old, "p", m, "o", "n", drop_unmapped=True)) == [(10, "a"), (10, "b")]


def test_keepers(spark):
    df = spark.createDataFrame([("k", 1, 0.5, "x"), ("k", 2, 0.9, None), ("k", 3, 0.9, "y"), ("l", 4, None, "z"), ("k", 5, 0.7, "w")], "k string, pos int, score double, v string")
    assert rows(keep_first(df, ["k"], "pos"), "k", "pos") == [("k", 1), ("l", 4)]
    assert rows(keep_best(df, ["k"], [F.col("score")], "pos"), "k", "pos") == [("k", 2), ("l", 4)]
    assert rows(collapse(df, ["k"], [F.col("score")], "pos"), "k", "pos", "score") == [("k", 1, 0.9), ("l", 4, None)]
    assert rows(best_merged(df, ["k"], "score", "pos"), "k", "pos", "score", "v") == [("k", 3, 0.9, "y"), ("l", 4, None, "z")]
    assert rows(best_merged(df.where("pos < 3"), ["k"], "score", "pos"), "k", "pos", "v") == [("k", 2, "x")]
    assert rows(distinct_in_order(df, F.lit(1), "pos"), "pos") == [(1,)]
    assert rows(top_n(df, ["k"], [F.desc("pos")], 2), "pos") == [(3,), (4,), (5,)]
    pending = spark.createDataFrame([("a", 1, "old", 2)], "code string, pos int, window string, attempts int")
    fresh = spark.createDataFrame([("a", 1, "new"), ("b", 2, "new"), ("b", 3, "newer")], "code string, pos int, window string")
    assert rows(job_merge(pending, fresh, "code", "pos"), "code", "window", "attempts") == [("a", "old", 2), ("b", "new", None)]


def test_linked_groups(spark):
    e = spark.createDataFrame([(9, 8), (8, 7), (1, 2), (5, 5), (None, 3), (20, 21), (21, 22), (22, 23), (23, 20)], "a long, b long")
    assert rows(linked_groups(e, "a", "b")) == [(1, 1), (2, 1), (5, 5), (7, 7), (8, 7), (9, 7), (20, 20), (21, 20), (22, 20), (23, 20)]
    assert linked_groups(e.limit(0), "a", "b").count() == 0


def test_compare(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    b = spark.createDataFrame([(2, None), (1, "y")], "id int, v string")
    assert rows(changed(a, b, ["id"], ["v"])) == [(1,)]
    assert fingerprint(a).first() == fingerprint(a.orderBy(F.desc("id"))).first() != fingerprint(b).first()
    assert fingerprint(a.limit(0)).first().rows == 0
    assert same_rows(a, a.repartition(3)) and not same_rows(a, a.union(a))
    assert rows(count_delta(spark.createDataFrame([("p", 2)], "k string, n int"), spark.createDataFrame([("q", 3)], "k string, n int"), "k", "n")) == [("p", 2, 0, -2), ("q", 0, 3, 3)]
    assert rows(stale(a, spark.createDataFrame([(1, "x"), (1, "z"), (3, "x")], "id int, v string"), ["id", "v"])) == [(1, "z"), (3, "x")]


def test_orphans(spark):
    refs = spark.createDataFrame([(1, 10), (2, 11), (3, 11), (4, 12), (5, None)], "row int, ref long")
    have = spark.createDataFrame([(10,), (None,)], "id long")
    state = apply_deltas(None, reference_delta(refs, F.col("ref")), existence_delta(have, F.col("id")))
    assert rows(orphan_keys(state)) == [(11, 2), (12, 1)]
    assert rows(orphan_rows(refs.withColumnRenamed("ref", "key"), orphan_keys(state)), "row") == [(2,), (3,), (4,)]
    # a late record heals, a deletion makes orphans, a withdrawn reference ends them; the order does not matter
    late, gone, less = existence_delta(spark.createDataFrame([(11,)], "id long"), F.col("id")), existence_delta(have, F.col("id"), -1), reference_delta(refs.where("row = 4"), F.col("ref"), -1)
    for order in ((late, gone, less), (less, late, gone)):
        s = state
        for delta in order:
            s = apply_deltas(s, delta)
        assert rows(orphan_keys(s)) == [(10, 1)]
    assert rows(apply_deltas(state, snapshot_delta(state, s))) == rows(s)
    assert apply_deltas(None, reference_delta(refs.limit(0), F.col("ref"))).count() == 0


def test_redirects(spark):
    r = spark.createDataFrame([(1, 2), (2, 3), (3, 100), (5, 6), (6, 5), (7, 7), (8, 9), (None, 100), (4, None), (11, 12), (11, 100), (1, 2)], "o long, n long")
    have = spark.createDataFrame([(100,)], "key long")
    assert rows(reaching_keys(r, have, "o", "n")) == [(1,), (2,), (3,), (11,)]
    assert reaching_keys(r.limit(0), have, "o", "n").count() == 0
    assert reaching_keys(r, have.limit(0), "o", "n").count() == 0


def test_state_moved_by_deltas_equals_a_recount(spark, tmp_path):
    import random

    from corvina.store import Store

    rnd, store = random.Random(5), Store(spark, str(tmp_path))
    edge = lambda: (rnd.randrange(1, 40), rnd.randrange(1, 50))
    have, ways = set(rnd.sample(range(30, 50), 6)), [edge() for _ in range(40)]
    refs = spark.createDataFrame([(i,) for i in range(1, 50)], "key long")
    keys = lambda s: spark.createDataFrame([(k,) for k in s], "key long")
    pairs = lambda s: spark.createDataFrame(list(s), "o long, n long")
    state = advance(None, [existence_delta(keys(have), F.col("key")), reference_delta(refs, F.col("key"))], redirect_delta(pairs(ways), "o", "n"))
    for step in range(3):
        gone, come = set(rnd.sample(sorted(have), 2)), {rnd.randrange(1, 50)} - have
        less, more = rnd.sample(ways, 8), [edge() for _ in range(5)]
        have = have - gone | come
        for w in less:
            ways.remove(w)
        ways += more
        store.write(state.tables())
        state = OrphanState(*[store.read(n) for n in state.tables()])
        deltas = [existence_delta(keys(gone), F.col("key"), -1), existence_delta(keys(come), F.col("key"))]
        state = advance(state, deltas, redirect_delta(pairs(less), "o", "n", -1).unionByName(redirect_delta(pairs(more), "o", "n")))
        good = set(have)
        while more := {a for a, b in ways if b in good} - good:
            good |= more
        assert {k for (k,) in rows(state.orphans(), "key")} == set(range(1, 50)) - good, step
    # nothing new changes nothing; an exit that goes takes its circle along
    same = advance(state, [])
    assert rows(same.orphans()) == rows(state.orphans())
    ring = advance(None, [existence_delta(keys([9]), F.col("key")), reference_delta(keys([1]), F.col("key"))], redirect_delta(pairs([(1, 2), (2, 3), (3, 1), (3, 9)]), "o", "n"))
    assert rows(ring.orphans()) == [] and rows(advance(ring, [existence_delta(keys([9]), F.col("key"), -1)]).orphans()) == [(1, 1)]
    assert advance(None, [existence_delta(keys([]), F.col("key"))]).orphans().count() == 0


def best_by_hand(left, right, threshold=0.86, days=3):
    out = {}
    for i, bl, t, d in left:
        a, options = normalized(t, "caption"), []
        for j, br, u, e in right:
            b = normalized(u, "caption")
            if bl != br or not a or not b:
                continue
            s = 1.0 if a == b else SequenceMatcher(None, a, b).ratio()
            apart = abs((d - e).days) if d and e else None
            if s == 1 or (s >= threshold and (apart is None or apart <= days)):
                options.append((-s, 999 if apart is None else apart, j))
        if options:
            out[i] = min(options)[2]
    return out


def test_nearest_captions(spark):
    from datetime import date, timedelta

    rnd, words = random.Random(4), [f"w{i}" for i in range(60)]
    base = [" ".join(rnd.choices(words, k=12)) for _ in range(25)]

    def make(n, start):
        out = []
        for i in range(n):
            w = rnd.choice(base).split()
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(12)] = rnd.choice(words)
            out.append((start + i, rnd.choice("ab"), rnd.choice([" ".join(w), " ".join(w).upper() + " #tag", ""]), rnd.choice([None, date(2026, 1, 1) + timedelta(rnd.randrange(12))])))
        return out

    left, right = make(60, 0), make(60, 1000)
    schema = "id long, who string, caption string, day date"
    got = nearest_captions(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "who")
    assert {r.left_id: r.right_id for r in got.collect()} == best_by_hand(left, right)
    single = one_to_one(got)
    assert single.select("right_id").distinct().count() == single.count()


def test_cross_posts_keep_every_left_post(spark, tmp_path):
    from corvina.plans.catalog import POST
    from corvina.queries_catalog import QUERIES

    texts = [(1, "instagram", 7, "Stock caption"), (2, "instagram", 7, "stock  caption"), (3, "instagram", 7, "something else"), (4, "instagram", 8, "stock caption"), (11, "tiktok", 7, "stock caption")]
    posts = spark.createDataFrame(texts, "id long, platform string, influencer_id long, caption string").withColumns({"published_at": F.lit("2026-01-01"), "updated_at": F.lit("2026-01-01 00:00:00").cast("timestamp")})
    posts.withColumns({c: F.lit(None).cast("string") for c in POST if c not in posts.columns}).write.parquet(str(tmp_path / "social_posts.parquet"))
    assert rows(QUERIES["d15_cross_posts"](spark, str(tmp_path)), "left_id", "right_id", "match_type") == [(1, 11, "exact"), (2, 11, "exact")]
    assert rows(QUERIES["f11_cross_post_faults"](spark, str(tmp_path))) == [(1, 11, "right used again"), (2, 11, "right used again")]


def test_match_faults(spark):
    good = [(1, 11, "exact", 1.0, 0), (2, 12, " Near", None, None)]
    bad = [(3, None, "near", 0.9, 1), (4, 14, "close", 0.9, 1), (5, 15, "near", 1.1, 1), (6, 16, "near", float("nan"), -1), (7, 17, "near", 0.9, 1), (7, 18, "near", 0.9, 1), (8, 18, None, 0.9, 1)]
    got = match_faults(spark.createDataFrame(good + bad, "left_id long, right_id long, match_type string, similarity double, date_distance_days int"))
    assert rows(got) == [(3, None, "no id"), (4, 14, "match type"), (5, 15, "similarity"), (6, 16, "days"), (6, 16, "similarity"), (7, 17, "left used again"), (7, 18, "left used again"), (7, 18, "right used again"), (8, 18, "match type"), (8, 18, "right used again")]
    assert match_faults(got.limit(0).selectExpr("left_id", "right_id", "fault as match_type", "0.5D as similarity", "0 as date_distance_days")).count() == 0


def test_similar_products(spark):
    df = spark.createDataFrame([(1, "L'Oréal", "Krem SPF 50", "skincare"), (2, "Loreal Paris", "spf 50 krem", "skincare"), (3, "loreal", "Krem SPF 30", "skincare"), (4, "loreal", "krem spf 50", "makeup"), (5, "other", "Krem SPF 50", "skincare"), (6, "loreal", "Bambaşka", None), (7, None, "Krem", None), (8, "loreal", None, None)], "id int, brand string, product_name string, category string")
    got = {(r.id_a, r.id_b): (r.decision, r.reason) for r in similar_products(df).collect()}
    assert got[(2, 3)] == ("review", "variant_or_strength_conflict") and got[(2, 4)] == ("review", "category_conflict") and (5, 1) not in got and not any(6 in k or 7 in k or 8 in k for k in got)
    assert got[(3, 4)][1] == "category_conflict"


def test_similar_products_against_all_pairs(spark, monkeypatch):
    """Blocks of three forms, forms of several products with ids that interleave, long texts, both orders of two texts."""
    import random
    from decimal import ROUND_HALF_UP, Decimal

    from corvina.functions.similarity import ratio
    from corvina.operators import pairs

    for name, n in (("FORMS_A_BLOCK", 3), ("ROWS_A_GROUP", 10), ("ROWS_AT_ONCE", 2), ("PAIRS_AT_ONCE", 4)):
        monkeypatch.setattr(pairs, name, n)
    rnd = random.Random(6)
    words = ["krem", "kremi", "serum", "spf", "50", "30", "ml", "lomi", "lomu", "mat", "bakim", "x" * 70, "abc " * 60]
    some = [(rnd.choice(["kozen", "Kozen", "bemir"]), " ".join(rnd.choices(words, k=rnd.randint(1, 5))), rnd.choice(["skincare", "makeup", "other", None])) for _ in range(45)]
    rows_ = [(i, *x) for i, x in enumerate([*some, *some[:15], ("tek", "krem", None), ("kozen", "the", None)])]
    want = set()
    for a in rows_:
        for b in rows_:
            x, y = a[2].split(), b[2].split()
            if a[0] < b[0] and a[1].lower() == b[1].lower() and set(x) & set(y) - {"the"}:
                best = max(ratio(" ".join(x), " ".join(y)), ratio(" ".join(sorted(x)), " ".join(sorted(y))))
                score = float(Decimal(repr(100 * best)).quantize(Decimal("0.1"), ROUND_HALF_UP))
                clash = a[3] != b[3] and not {a[3], b[3]} & {"other", None}
                if score >= 67:
                    want.add((a[0], b[0], "safe" if sorted(x) == sorted(y) and not clash else "review", score))
    got = similar_products(spark.createDataFrame(rows_, "id int, brand string, product_name string, category string")).select("id_a", "id_b", "decision", "score").collect()
    assert len(got) == len(want) > 50 and {tuple(r) for r in got} == want


def test_a_brand_with_thousands_of_products_makes_no_pairs_but_its_result(spark):
    import random
    import time

    rnd = random.Random(8)
    names = ["".join(rnd.choices("abcdefghijklmnoprstuvyz", k=12)) + " " + "".join(rnd.choices("abcdefghijklmnoprstuvyz", k=14)) + f" {n} ml" for n in range(3000)]
    df = spark.createDataFrame([(i, "kozen", n, "skincare") for i, n in enumerate([*names, names[7] + " x"])], "id int, brand string, product_name string, category string")
    began = time.monotonic()
    got = {(r.id_a, r.id_b) for r in similar_products(df).collect()}
    # 4.5 million pairs share the word ml
    assert (7, 3000) in got and len(got) < 3000 and time.monotonic() - began < 90


def test_plain_texts_are_compared_as_one_by_one():
    import random

    import numpy as np

    from corvina.functions.similarity import PlainTexts, common_letters, ratio

    rnd = random.Random(3)
    texts = ["", *("".join(rnd.choices(rnd.choice(["a", "ab", " abc", "abcdefghij 0123"]), k=rnd.choice([1, 2, 20, 63, 64, 65, 128, 129, 199, 200, 260]))) for _ in range(150))]
    a, b = (np.array(rnd.choices(range(len(texts)), k=1500)) for _ in "ab")
    t = PlainTexts(texts)
    assert t.common(a, b).tolist() == [common_letters(texts[i], texts[j]) for i, j in zip(a, b)]
    assert t.ratios(a, b).tolist() == [ratio(texts[i], texts[j]) for i, j in zip(a, b)]
    assert PlainTexts([]).ratios(a[:0], b[:0]).tolist() == []
