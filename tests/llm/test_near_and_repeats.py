import random


from martloom.llm import repeats as module
from martloom.llm.components import components
from martloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from martloom.llm.repeats import repeats
from tests.llm import plain


def test_near_groups_as_brute_force(docs, texts):
    rows = near_duplicates(docs).collect()
    groups = plain.near_groups(texts)
    assert {r.doc_id: r.component_id for r in rows} == groups
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(plain.shingles(t)) for i, t in texts.items()}
    assert {r.doc_id for r in rows if r.kept} == set(groups.values())


def test_near_group_of_many_edited_copies(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(160):
        own = base[:]
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        texts[i * 3 + 1] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    rows = near_duplicates(df).collect()
    assert {r.doc_id: r.component_id for r in rows} == plain.near_groups(texts)


def test_near_groups_of_odd_rows(odd, empty):
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(odd).collect())
    assert rows == [
        (0, 0, 0, True), (0, 9, 0, True), (1, 9, 1, True), (1, 9, 1, True), (2, 3, 2, True), (2, 9, 1, False),
        (5, 0, 5, True), (6, 0, 6, True), (7, 2, 7, True), (8, 1, 8, True),
    ]
    assert drop_near_duplicates(odd).columns == odd.columns
    assert near_duplicates(empty).count() == drop_near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 299)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 60)} | {300: 299}


def test_repeats_as_brute_force(docs, texts):
    rows = repeats(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == plain.without_repeats(texts)


def test_long_texts_are_cut_without_loss(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(module, "SLICE", 500)
    text = b"".join(b"%d " % i for i in range(2000))
    batch = pa.RecordBatch.from_pydict({"id": [1], "t": [0], "text": [text]})
    seen = set()
    for data, ends, _, _, base in module.pieces_of([batch], 100):
        ranks = module.Ranks(data)
        _, lo, hi = module.blocks(data, ends, ranks, 100)
        assert bytes(data) == text[base[0] : base[0] + len(data)]
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            windows = set(range(base[0] + a, base[0] + b + 1))
            assert not windows & seen
            seen |= windows
    assert seen == set(range(len(text) - 99))


def test_random_repeats(spark):
    rng = random.Random(9)
    base = "".join(rng.choices("abcdé ", k=2500))
    texts = {1: base, 2: "a" * 700, 3: "ab" * 200, 4: base[:99], 5: base[7:107], 6: "z" + base[7:107] + "q"}
    for i in range(40):
        a = rng.randrange(2000)
        texts[10 + i] = base[a : a + rng.randrange(90, 300)] + "-" * (i % 3) + base[: rng.randrange(150)]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    rows = repeats(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == plain.without_repeats(texts)


def test_repeats_of_odd_rows(spark, odd, empty):
    rows = repeats(odd).collect()
    assert len(rows) == odd.count() and sum(r.n_removed for r in rows) == 0
    long = "0123456789" * 5 + "abcdefghij" * 6
    df = spark.createDataFrame([(1, long), (1, long), (2, long), (None, long)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in repeats(df).collect()) == [(0, 0), (1, 0), (1, 0), (2, 110)]
    assert repeats(empty).count() == 0
