import random

from corvina.llm.components import connected_components


def brute(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def run(spark, pairs, **kw):
    return {r.id: r.group_id for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), **kw).collect()}


def test_random_graph_with_a_giant(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(90)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(110)]
    pairs += [(b, a) for a, b in pairs[:20]] + [(500, 500), (501, None), (None, 502), (None, None)]
    assert run(spark, pairs) == brute(pairs)


def test_long_chain_with_shuffled_ids(spark):
    ids = list(range(300))
    random.Random(2).shuffle(ids)
    pairs = list(zip(ids, ids[1:]))
    assert set(run(spark, pairs, peel_rounds=2).values()) == {0}


def test_star_and_smaller_vertex_outside_the_peeled_part(spark):
    pairs = [(100, x) for x in range(101, 140)] + [(139, 150), (150, 160), (160, 1)]
    assert set(run(spark, pairs, peel_rounds=1).values()) == {1}


def test_cases(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, 1)]) == {}
    assert run(spark, [(5, 5)]) == {5: 5}
    assert run(spark, [(5, 5), (7, 9), (9, 7), (7, 9)]) == {5: 5, 7: 7, 9: 7}
    df = spark.createDataFrame([(1, 2, "x", 3)], "a long, b long, group_id string, u int")
    assert sorted((r.id, r.group_id) for r in connected_components(df).collect()) == [(1, 1), (2, 1)]
