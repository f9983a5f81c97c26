import random

import pytest

from corvina.llm.mixing import count_tokens, counted_documents, mix, mix_report, pfair_period, slots_of


@pytest.mark.parametrize("seed", range(40))
def test_less_than_a_block_off(seed):
    rnd = random.Random(seed)
    counts = slots_of({f"s{i}": rnd.random() ** 2 + 0.004 for i in range(rnd.randint(1, 9))}, rnd.choice([20, 97, 250]))
    n, got = sum(counts.values()), dict.fromkeys(counts, 0)
    for t, s in enumerate(pfair_period(counts), 1):
        got[s] += 1
        assert all(abs(t * c / n - got[x]) < 1 for x, c in counts.items())
    assert got == counts


def test_slots_sum_up():
    assert sum(slots_of({"a": 0.3, "b": 0.3, "c": 0.4000001}, 7).values()) == 7
    assert slots_of({"a": 1e-9, "b": 1}, 10) == {"a": 1, "b": 9}
    assert slots_of({"a": 0.03, "b": 0.97}) == {"a": 3, "b": 97} and slots_of({"a": 0.5, "b": 0.25, "c": 0.15}) == {"a": 10, "b": 5, "c": 3}
    assert sum(slots_of({"a": 0.123456789, "b": 0.9}).values()) == 10_000


def rows():
    rnd, out = random.Random(1), []
    for source, n in (("big", 300), ("mid", 120), ("small", 25), ("other", 40)):
        out += [(len(out) + i, source, " ".join(rnd.choice(["one", "two", "three", "güneş"]) for _ in range(rnd.randint(5, 60))), "x") for i in range(n)]
    return out + [(9001, None, "text", "x"), (9002, "big", None, "x"), (9003, "big", "", "x"), (9004, "mid", "word " * 3000, "x")]


def test_mix(spark):
    df = spark.createDataFrame(rows(), "doc_id long, source string, text string, key string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.25, 2), ("small", 0.15, 3), ("gone", 0.1, 2), ("off", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mix(df, "doc_id", "source", "text", targets, block_tokens=64, slots=100)
    got = m.toPandas()
    share = got.groupby("source").tokens.sum() / got.tokens.sum()
    for s, w in (("big", 0.5), ("mid", 0.25), ("small", 0.15)):
        assert abs(share[s] - w / 0.9) < 0.12
    assert got.groupby(["source", "doc_id"]).size().groupby("source").max().to_dict()["small"] <= 3
    assert set(got.source) == {"big", "mid", "small"} and not set(got.doc_id) & {9001, 9002, 9003}
    # no document is skipped inside a repetition
    for s, g in got.groupby("source"):
        g = g.sort_values("place")
        assert (g.place.iloc[1:].values == (g.place + g.tokens).iloc[:-1].values).all()
    # after every slot each source is less than a block off its weight
    counts, at = slots_of({"big": 0.5, "mid": 0.25, "small": 0.15}, 100), {}
    order = got[["slot", "source", "block"]].drop_duplicates().sort_values("slot")
    assert not order.slot.duplicated().any()
    for s, g in order.groupby("source"):
        for slot, block in zip(g.slot, g.block):
            w = counts[s] / 100
            assert w * slot - block < 1 and block + 1 - w * (slot + 1) < 1
    exact = mix(df, "doc_id", "source", "text", targets, block_tokens=64)
    full = {r.source: r for r in mix_report(exact, "source", targets, counted_documents(df, "doc_id", "source", "text")).collect()}
    assert all(r.furthest_off < 1 for r in full.values() if r.tokens) and full["gone"].furthest_off is None
    assert full["big"].source_tokens - full["big"].tokens_not_taken == full["big"].tokens and full["small"].documents_not_taken == 0
    report = {r.source: r for r in mix_report(m, "source", targets).collect()}
    assert report["gone"].tokens == 0 and report["gone"].actual_share == 0 and report["big"].documents == (got.source == "big").sum()


def test_cases(spark):
    df = spark.createDataFrame(rows(), "doc_id long, source string, text string, key string")
    targets = spark.createDataFrame([("nowhere", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix(df, "doc_id", "source", "text", targets).count() == 0
    assert mix(df.limit(0), "doc_id", "source", "text", targets).count() == 0
    same = spark.createDataFrame([(1, "a", "x y z"), (1, "a", "x y z"), (2, "a", "x")], "doc_id long, source string, text string")
    one = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert sorted(r.doc_id for r in mix(same, "doc_id", "source", "text", one).collect()) == [1, 1, 1, 1, 2, 2]
    tokens = {r.doc_id: r.tokens for r in count_tokens(spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "ab" * 50000)], "doc_id long, t string"), ["doc_id"], "t").collect()}
    assert tokens[1] == tokens[2] == 0 and tokens[3] == 2 and tokens[4] > 1000
