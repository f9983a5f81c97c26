import random

from corvina.llm.leakage import ItemIndex, _codes, find_leaks, terms_of
from corvina.llm.lookalike import words


def texts(n, size, seed):
    rnd = random.Random(seed)
    common = [f"the{k}" for k in range(30)]
    return [" ".join(rnd.choice(common) if rnd.random() < 0.7 else f"w{rnd.randrange(3000)}" for _ in range(size)) for _ in range(n)]


def test_same_as_brute_force():
    items = list(enumerate(texts(120, 40, 1)))
    index, rnd = ItemIndex(items), random.Random(2)
    for doc in texts(60, 150, 3):
        ws = doc.split()
        for _ in range(2):
            i = rnd.randrange(len(items))
            run = items[i][1].split()
            a, n = rnd.randrange(25), rnd.choice([8, 9, 10, 14])
            at = rnd.randrange(len(ws))
            ws[at:at] = run[a : a + n]
        text = " ".join(ws)
        flat = " " + " ".join(words(text)) + " "
        want = [i for i, t in items if any(" " + " ".join(words(t)[k : k + 10]) + " " in flat for k in range(len(words(t)) - 9))]
        assert index.leaked(text) == want
    # every query retrieves what a full scoring retrieves
    (part,) = index.parts
    for doc in texts(40, 64, 5) + [t for _, t in items[:20]]:
        q = set(terms_of(_codes("".join(words(doc))), part.gram, part.span)[1].tolist())
        full = [k for k in range(len(part.ids)) if sum(dict(zip(*part.lists[w][:2])).get(k, 0) for w in q if w in part.lists) >= 1 - 1e-9]
        assert part.retrieve(q) == full


def test_blanks_do_not_matter():
    rnd = random.Random(4)
    items = list(enumerate(texts(60, 30, 1)))
    index = ItemIndex(items)
    for i, t in items:
        ws = t.split()
        a = rnd.randrange(20)
        letters = "".join(ws[a : a + 10])
        cuts = sorted(rnd.sample(range(1, len(letters)), 6))
        torn = " ".join(letters[x:y] for x, y in zip([0, *cuts], [*cuts, len(letters)]))
        for form in (letters, torn, f"{ws[a]}-{''.join(ws[a + 1 : a + 3])} {' '.join(ws[a + 3 : a + 10])}", "pre fix " * 200 + torn + " after" * 300):
            assert i in index.leaked(form)
        short = "".join(ws[a + 1 : a + 10])
        assert i not in index.leaked(short)


def test_short_items_have_their_own_terms():
    index = ItemIndex([(1, "ab"), (2, "no"), (3, " ".join(f"word{i}" for i in range(12)))])
    assert index.leaked("a b c") == [1] and index.leaked("xy") == [] and index.leaked("word0 " + " ".join(f"word{i}" for i in range(12))) == [3]


def test_spelling_does_not_hide_a_passage():
    item = "Editör notunda Melfu ürününün güneşte bekletilmemesi ve rafında saklanması hatırlatılıyor efendim"
    index = ItemIndex([(7, item)])
    assert index.leaked("ön söz. EDİTÖR NOTUNDA melfu, urununun   gunes​te\nbekletilmemesi; ve rafinda saklanması hatirlatiliyor… son") == [7]
    assert index.leaked(" ".join(item.split()[:9])) == []


def test_operator_cases(spark):
    item = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, None, "x"), (3, "", "x"), (None, item, "x"), (4, "only four short words", "x")], "item_id long, text string, suite string")
    long = "z " * 50000 + item
    docs = spark.createDataFrame([(1, None), (2, ""), (3, f"a {item} b"), (3, f"a {item} b"), (4, long), (5, "these only four short words here"), (None, item)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.item_id) for r in find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect())
    assert got == [(0, 1), (3, 1), (3, 1), (4, 1), (5, 4)]
    assert sorted(((r.doc_id or 0), r.item_id) for r in find_leaks(docs, "doc_id", "text", items, "item_id", "text", max_items=1).collect()) == got
    assert find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
