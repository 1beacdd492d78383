import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from martloom.llm import language, pii
from martloom.llm.fingerprints import Fingerprinter, fingerprints, lexicon, likeness, with_edits
from martloom.llm.frames import packed
from martloom.llm.language import identify, train
from martloom.llm.topk import search
from tests.llm import plain

SYLLABLES = {"en": "the and ing thi ou ed", "fr": "é eau les oi que ai", "de": "ung sch ein der zu ß", "zz": "qu xa zo vi kr py"}


def speech(lang: str, n: int, rng: random.Random) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(2)
    rows = [(i, speech(lang, rng.randint(5, 60), rng), lang) for i, lang in enumerate(rng.choices(["en", "fr", "de"], k=600))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).cache()


def test_languages_held_out(spoken):
    rows = identify(spoken).withColumn("held_out", language.held_out(F.col("id"))).collect()
    truth = {r.doc_id: r.lang for r in spoken.collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert len(held) > 100 and sum(r.lang_pred == truth[r.id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and not any(r.rejected for r in rows)


def test_scores_as_brute_force(spark, texts):
    """A model's scores, byte by byte: the mean logit of all n-grams, then the softmax."""
    rng = np.random.default_rng(3)
    model = language.LanguageModel(["aa", "bb"], rng.normal(0, 5, (1 << language.BITS, 2)).astype(np.float32), 0.7, 0.6)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "id long, text string").withColumn("text", F.col("text").cast("binary"))
    for r in language.predicted(df, model).collect():
        data = bytes(r.text).lower()
        total, n = np.zeros(2), 0
        for size in language.GRAMS:
            for start in range(len(data) - size + 1):
                code = int.from_bytes(data[start : start + size], "big") & 0xFFFFFFFF
                code = (code ^ (code >> 15) ^ (size * 0x2545F491 & 0xFFFFFFFF)) * 0x9E3779B1 & 0xFFFFFFFF
                total += model.logits[code >> (32 - language.BITS)]
                n += 1
        p = language.softmax((total / max(n, 1) / model.temperature)[None])[0]
        letters = any(c.isalpha() for c in bytes(r.text).decode())
        assert r.score == pytest.approx(p.max() if letters else 0.0, abs=1e-6)
        assert r.lang_pred == (model.languages[int(p.argmax())] if letters else "und")
        assert r.rejected == (not letters or r.score < 0.6)


def test_held_out_labels_teach_nothing(spoken):
    wrong = spoken.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "en").otherwise(F.col("lang")))
    left, right = ({r.id: (r.lang_pred, r.score) for r in identify(df).collect()} for df in (spoken, wrong))
    assert left == right


def test_calibration_rejects_what_is_no_language(spark, spoken):
    rng = random.Random(6)
    known = spoken.where("doc_id >= 0").withColumn("odd", F.lit(False))
    other = spark.createDataFrame([(-i - 1, speech("zz", 40, rng), None, True) for i in range(40)], known.schema)
    rows = identify(known.unionByName(other)).select("id", "rejected", "score").collect()
    good = [r.score for r in rows if r.id >= 0]
    odd = [r.score for r in rows if r.id < 0]
    assert np.mean(odd) < np.mean(good)


def test_language_of_odd_rows(spark, odd, empty):
    extra = spark.createDataFrame([(20, "123 456 !!!", None), (21, "x" * 200_000, "en")], "doc_id long, text string, lang string")
    rows = identify(odd.select("doc_id", "text", "lang").unionByName(extra)).collect()
    by = {(r.id, r.text if r.text is None else bytes(r.text)[:5]): r for r in rows}
    for key in ((5, None), (6, b""), (20, b"123 4"), (None, None)):
        assert (by[key].lang_pred, by[key].score, by[key].rejected) == ("und", 0.0, True)
    assert by[21, b"xxxxx"].lang_pred in ("en", "fr")
    assert identify(empty).count() == 0
    none = identify(empty.unionByName(odd.select(*empty.columns).withColumn("lang", F.lit(None).cast("string"))))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_training_is_the_same_every_time():
    rng = random.Random(1)
    labels = [rng.choice(["en", "fr"]) for _ in range(80)]
    counts = [language.text_counts(speech(lang, 20, rng).encode()) for lang in labels]
    a, b = (train(counts, labels, 3, 7) for _ in range(2))
    assert a.temperature == b.temperature and np.array_equal(a.logits, b.logits)


@pytest.fixture(scope="module")
def persons(spark):
    rng, rows = random.Random(12), []
    for i in range(300):
        card = "".join(rng.choices("0123456789", k=15))
        card += next(c for c in "0123456789" if plain.luhn(card + c))
        own = rng.choice([
            f"joe{i}@mail.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.{i % 256}.7", card, f"+1 ({200 + i}) 555-{1000 + i}",
            f"{rng.randrange(300, 999)}.1.1.1", "".join(rng.choices("0123456789", k=16)), f"token {rng.randrange(10**9)}", "é.x@y.z",
        ])
        rows.append((i, f"{speech('fr', 6, rng)} {own} {speech('en', 4, rng)}\n{own}, end"))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def spans_of(row, name):
    return [(pii.KINDS[s.kind], s.start, s.end) for s in row[name]]


def test_base_spans_as_brute_force(docs, persons):
    for df in (persons, docs):
        for r in pii.find(df).collect():
            assert spans_of(r, "pii_base") == plain.personal(r.text)
            assert set(spans_of(r, "pii_base")) <= set(spans_of(r, "pii_spans"))


def test_trees_learn_from_every_document(spark, monkeypatch):
    """Also of many more than a few thousand."""
    asked = []

    def counted(df, name):
        asked.append((name, df.count()))
        raise InterruptedError

    monkeypatch.setattr(pii, "cut", counted)
    many = spark.range(45_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    with pytest.raises(InterruptedError):
        pii.fit(many, "doc_id", F.col("text"))
    assert asked == [("found", 45_000)]


def test_training_rows_are_made_by_one_plan(spark):
    """A table per rewritten copy held more of the driver than there is; the copies are as many as before."""
    found = "struct<kind:int,start:int,end:int,match:string,before:string,after:string>"
    texts = ["joe@mail.example.com", "10.0.0.1", "4111111111111111", "+1 (212) 555-1234"]
    rows = [([(k, 0, len(t), t, "", "")], [(k, 0, len(t))], k / 8) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"pii_found array<{found}>, pii_base array<{pii.SPAN}>, draw double")
    out = pii.training_rows(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 3
    copies = {}
    for r in out.collect():
        copies.setdefault(pii.KINDS[r.kind], []).append((r.match, r.before, r.label))
    assert sorted(copies["email"]) == [("joe [at] mail [dot] example [dot] com", "", 1.0), ("joe at mail.example.com", "", 0.0), ("joe@mail.example.com", "", 1.0)]
    assert sorted(copies["ip"]) == [("10.0.0.1", "", 1.0), ("10.0.0.1.1", "", 0.0), ("999.0.0.1", "", 0.0)]
    assert {("4111111111111111", "", 1.0), ("4111 1111 1111 1111", "", 1.0), ("4111111111111112", "", 0.0)} <= set(copies["card"])
    phones = [("+1 (212) 555-1234", "", 1.0), ("(212) 555-1234", "", 1.0), ("212-555-1234", "", 1.0),
              ("12125551234", "phone ", 1.0), ("12125551234", "", 0.0)]
    assert set(phones) <= set(copies["phone"])
    # Beside other numbers a number is right once for each known one.
    beside = out.where("label = 1").count()
    assert beside == 4 + 3 + 1 + 1 + 2


def test_plans_of_the_training_stay_small(spark, persons, monkeypatch):
    written, write = {}, pii.cut

    def sized(df, name):
        # As the driver plans it: a filter pushed below the steps that make its column repeats all of them.
        written[name] = len(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(pii, "cut", sized)
    assert pii.fit(persons, "doc_id", F.coalesce("text", F.lit(""))) is not None
    assert max(written.values()) < 50_000, written


def test_added_spans_touch_no_base_span_and_need_a_reason(spark, persons):
    text = F.coalesce("text", F.lit(""))
    trees = pii.fit(persons, "doc_id", text)
    clean = "In 2021-01-02 10 we met version 2.0.1 of 1234567 things, chapter 12, page 1,234."
    df = spark.createDataFrame([(1, "ring (834) 555-4560 now"), (2, clean), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.with_spans(df, text, trees).collect()}
    assert spans_of(out[1], "pii_spans") == [("phone", 5, 19)] and out[1].pii_base == []
    assert out[2].pii_spans == out[3].pii_spans == []


BESIDE_OTHERS = {
    "card 4111 1111 1111 1111 12/27": [("card", "4111 1111 1111 1111")],
    "card 4111 1111 1111 1111 123 4": [("card", "4111 1111 1111 1111")],
    "4111 1111 1111 1111 5500 0000 0000 0004": [("card", "4111 1111 1111 1111"), ("card", "5500 0000 0000 0004")],
    "tel 555-123-4567 555-987-6543": [("phone", "555-123-4567"), ("phone", "555-987-6543")],
    "555-123-4567 2024-01-01": [("phone", "555-123-4567")],
}


def test_a_stray_digit_changes_no_proposal(spark, persons):
    texts = [
        "mail joe at example.com", "joe at example [dot] com", "joe[at]example.com", "joe (at) example dot org", "joe@example.com",
        "write to joe (at] example (dot) com",
    ]
    df = spark.createDataFrame([(t + end,) for t in texts for end in ("", " or 5")], "text string")
    trees = pii.fit(persons, "doc_id", F.coalesce("text", F.lit("")))
    found = {r.text: [(c.kind, c.match) for c in r.pii_found] for r in pii.with_proposals(pii.with_base(df, F.col("text"))).collect()}
    spans = {r.text: spans_of(r, "pii_spans") for r in pii.with_spans(df, F.col("text"), trees).collect()}
    for t in texts:
        assert found[t] == found[f"{t} or 5"] and spans[t] == spans[f"{t} or 5"]
        assert found[t] or spans[t]


def test_numbers_beside_numbers_are_proposed_and_chosen(spark, persons):
    trees = pii.fit(persons, "doc_id", F.coalesce("text", F.lit("")))
    df = spark.createDataFrame([(t,) for t in BESIDE_OTHERS], "text string")
    found = pii.with_proposals(pii.with_base(df, F.col("text")))
    for r in found.collect():
        assert set(BESIDE_OTHERS[r.text]) <= {(pii.KINDS[c.kind], c.match) for c in r.pii_found}
        assert all(r.text[c.start : c.end] == c.match for c in r.pii_found)
    for r in pii.with_spans(df, F.col("text"), trees).collect():
        assert [(k, r.text[a:b]) for k, a, b in spans_of(r, "pii_spans")] == BESIDE_OTHERS[r.text]


def test_number_proposals_as_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(["1", "23", "4567", "89012345", " ", "-", ".", "(", ")", "+", "x", "é", "😀", "\n"], k=60)) for _ in range(40)]
    sizes = {"card": (r"[0-9](?:[ .-]{0,2}[0-9])*", 13, 19), "phone": (r"[+(]?[0-9](?:[ ().-]{0,3}[0-9])*", 7, 15)}
    df = spark.createDataFrame([(t,) for t in texts], "pii_text string").withColumn("pii_any", F.lit(True))
    for r in pii.with_numbers(df, "found").collect():
        t, expected = r.pii_text, set()
        for kind, (pattern, low, high) in sizes.items():
            edge = "[0-9]" if kind == "card" else "[0-9A-Za-z]"
            for m in re.finditer("(?<![0-9])[0-9]", t):
                a = m.start()
                if kind == "phone" and re.search(r"(?<![0-9A-Za-z])[+(]\Z", t[:a]):
                    a -= 1
                if kind == "phone" and re.search(r"[0-9A-Za-z]\Z", t[:a]):
                    continue
                for b in range(a + 1, min(len(t), a + 80) + 1):
                    n = len(re.sub("[^0-9]", "", t[a:b]))
                    if low <= n <= high and re.fullmatch(pattern, t[a:b]) and not re.match(edge, t[b:]):
                        expected.add((kind, a, b, t[a:b], t[max(0, m.start() - 24) : a], t[b : b + 1]))
        # The text is read behind a line break, which stands in front of the first characters.
        seen = {(pii.KINDS[c.kind], c.start, c.end, c.match, c.before.lstrip("\n"), c.after) for c in r.found}
        assert seen == {(k, a, b, m, x.lstrip("\n"), y) for k, a, b, m, x, y in expected}


def test_positions_in_long_texts(spark):
    text = "é1.1.1.1 " * 3000 + "x" * 50_000 + "1" * 20_000 + " end a@b.c"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.with_spans(df, F.col("text"), None).first()
    assert spans_of(row, "pii_base") == plain.personal(text)


def test_redaction(spark, odd, empty):
    df = spark.createDataFrame([(1, "a@b.c é 1.2.3.4!"), (2, "nothing"), (3, None), (4, "card 4111 1111 1111 1111, a@1.2.3.4")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[1] == "[EMAIL] é [IP]!" and out[2] == "nothing" and out[3] is None
    assert out[4] == "card [CARD], [EMAIL]"
    redacted = pii.redact(odd)
    assert redacted.columns == odd.columns and redacted.count() == odd.count()
    assert pii.redact(empty).count() == pii.find(empty).count() == 0


def test_trees_as_sql_give_the_probability_of_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(3)
    rows = [(a := rng.random(), b := rng.random(), float(a + b * b > 0.8)) for _ in range(400)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, label double"))
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(df)
    both = model.transform(df).select("probability", F.expr(pii.as_sql(model, ["a", "b"])).alias("own")).collect()
    assert all(abs(r.probability[1] - r.own) < 1e-9 for r in both)


def test_top_k_as_brute_force(spark):
    rng = random.Random(7)
    vectors = {i: [rng.choice([-0.3, -0.02, 0.0, 0.01, 0.2, 0.5]) for _ in range(8)] for i in range(700)}
    vectors |= {20: vectors[0], 21: vectors[0], 40: [1e6] * 8, 60: [0.0] * 8}
    rows = list(vectors.items()) + [(5000, None), (5020, [float("nan")] * 8), (5040, [None] * 8), (5060, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "score": F.lit(2), "shard": F.lit(3)})
    out = sorted(tuple(r) for r in search(df.repartition(5), F.col("id") % 20 == 0, 20).collect())
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors.items()}
    assert out == sorted(plain.top(whole, [i for i in vectors if i % 20 == 0], 20))


def test_top_k_of_few_rows_huge_numbers_and_nothing(spark):
    kind = "vec_id long, embedding array<double>"
    few = [(0, [1.0, 2.0]), (1, [1e12, -3.0]), (20, [2e9, 1.0]), (20, [2e9, 1.0])]
    out = sorted(tuple(r) for r in search(spark.createDataFrame(few, kind), F.col("id") % 20 == 0, 5).collect())
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in few}
    expected = [(q, r, i, min(s, 2**63 - 1)) for q, r, i, s in plain.top(whole, [0, 20], 5)]
    assert out == sorted(expected)
    assert search(spark.createDataFrame([], kind), F.col("id") % 20 == 0, 5).count() == 0


def test_edited_texts(docs, texts):
    rows = {r.doc_id: r for r in with_edits(docs).collect()}
    order = sorted(texts)
    assert sorted(rows) == order
    for i, after in zip(order, [*order[1:], order[0]], strict=True):
        text, half = texts[i], len(texts[i]) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == text:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
        assert (r.fingerprint == rows[after].fingerprint) <= (set(plain.words(text)) == set(plain.words(texts[after])))
    prints = {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}
    assert prints == {i: r.fingerprint for i, r in rows.items()}


def test_fingerprints_of_odd_rows(spark, odd, empty):
    rows = with_edits(odd).collect()
    assert len(rows) == odd.count()
    assert with_edits(empty).count() == fingerprints(empty).count() == 0
    one = with_edits(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1


def test_likeness_follows_common_terms(spark):
    rng = random.Random(4)
    terms = [f"t{i}".encode() for i in range(4000)]
    from martloom.llm.fingerprints import term_hash

    of = Fingerprinter(np.sort(np.array([term_hash(t) for t in terms], dtype=np.uint64)))
    shares = []
    for changed in (0, 30, 150, 300):
        values = []
        for _ in range(20):
            own = rng.sample(terms, 600)
            a, b = of([b" ".join(own[:300]), b" ".join(own[changed : 300 + changed])])
            values.append(likeness(a[None], b[None])[0])
        shares.append(np.mean(values))
    assert shares[0] == 1 and shares[0] > shares[1] > shares[2] > shares[3] and shares[3] < 0.05


def test_lexicon_is_a_band(spark):
    rows = [(i, " ".join(["all", f"mid{i % 10}", f"rare{i}"])) for i in range(2000)]
    df = packed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(lexicon(df)) == 10
    assert len(lexicon(df, low=0.0, bound=100)) <= 100
