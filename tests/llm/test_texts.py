import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import leakage, lookalikes, packing
from tallyloom.llm.lookalikes import DEFAULT_SHAPES, Scorer, canonical_text, count_bigrams, icu_shapes, same_look_pairs

ALTERNATIVES, PROTOTYPE = DEFAULT_SHAPES.alternatives, DEFAULT_SHAPES.prototype

DOCS = "doc_id long, text string, raw string, look string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "r", "l") for i, t in enumerate(texts)], DOCS)


def test_same_look(spark):
    texts = ["The cat sat", "Τhe cat sat", "The cat​ sat", "Ｔｈｅ　ｃａｔ　ｓａｔ", "the cat sat", "The cat sat", "Señor ﬁne", "Señor fine", "Senor fine", None, "", "​", "x" * 100_000 + "а", "x" * 100_000 + "a", "x²", "x2"]
    got = sorted((r.doc_id_a, r.doc_id_b) for r in same_look_pairs(docs(spark, texts)).collect())
    same = [{0, 1, 2, 3, 5}, {6, 7}, {12, 13}]
    want = sorted((a, b) for s in same for a in s for b in s if a < b and texts[a] != texts[b])
    assert got == want
    assert same_look_pairs(docs(spark, [])).count() == 0 and same_look_pairs(docs(spark, [None, ""])).count() == 0


def test_canonical_column(spark):
    df = docs(spark, ["Αnna", None]).withColumnRenamed("look", "canonical")
    assert [r.canonical for r in canonical_text(df, Scorer()).orderBy("doc_id").collect()] == ["Anna", None]


@settings(max_examples=60, deadline=None)
@given(st.text("".join(ALTERNATIVES) + "mnrt zЖñΩ", max_size=25), st.randoms(use_true_random=False))
def test_form_depends_on_shape_only(text, rng):
    other = "".join(rng.choice([c, *(ALTERNATIVES.get(c) or {"": c}).values()]) for c in text)
    counts = count_bigrams(["она сор рос вера " * 9, "case notes on a person"])
    for s in (Scorer(), Scorer(dict(counts))):
        assert s.canonical(text) == s.canonical(other)
        assert "".join(PROTOTYPE.get(c, c) for c in s.canonical(text)) == "".join(PROTOTYPE.get(c, c) for c in text)


def test_a_script_of_its_own_is_kept():
    s = Scorer(dict(count_bigrams(["сор росу осе рассор жук вода " * 50, "cop"])))
    assert s.canonical("вода") == "вода" and s.canonical("росу") == "росу" and s.canonical("pocy") == "росу"


def test_plain_words_are_searched_once():
    s = Scorer(dict(count_bigrams(["сор росу осе рассор жук вода " * 50, "cop"])))
    searched: list[str] = []
    own, text = s.changed.form, "the notes, of (pocy) a\u3000pocy\nocean-cop "
    s.changed.form = lambda w: (searched.append(w), own(w))[1]
    assert s.canonical(text * 40) == s._own(text.replace("\u3000", " ").replace("\n", " ") * 40) and "росу" in s.canonical(text)
    assert len(searched) == len(set(searched)) and s.canonical("the notes " * 40) == "the notes " * 40


def test_tokens_that_mix_scripts_and_more_scripts(spark):
    s = Scorer()
    assert s.canonical("Жaop") == s.canonical("Жаор") and s.canonical("Жaop x") != s.canonical("Жaor x")
    shapes = icu_shapes(spark)
    own = Scorer(shapes=shapes)
    assert {own.canonical(x) for x in ("ѵery", "very", "ᴠery")} == {"very"} and own.canonical("ꓮtlas") == own.canonical("Ꭺtlas") == "Atlas" and own.canonical("ⲟne") == "one"
    assert own.canonical("σοφ") != own.canonical("οσφ") and len(shapes.prototype) > len(PROTOTYPE)
    texts = ["ѵery nice", "very nice", "Ꭺ man", "A man", "Жaop", "Жаор"]
    assert sorted(tuple(r) for r in same_look_pairs(docs(spark, texts)).collect()) == [(0, 1), (2, 3), (4, 5)]


def plain_leaks(items, texts, n):
    s, out = Scorer(), set()
    for d, t in texts:
        w = leakage.words(t, s)
        for i, x in items:
            v = leakage.words(x, s)
            runs = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            if any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)):
                out.add((i, d))
    return out


def test_leaks_against_plain(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)] + ["Año", "ТEST"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for i in range(30)] + [(30, None), (31, ""), (32, "a a a a a a")]
    texts = [(d, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for d in range(60)] + [(60, None), (61, ""), (62, "a, A. a; (a) а a a"), (63, " ".join(vocabulary) * 3000)]
    for i in range(0, 30, 3):
        texts.append((100 + i, f"before {items[i][1].upper()} after"))
    for n in (1, 4):
        a = spark.createDataFrame(items, "item_id long, text string")
        b = spark.createDataFrame(texts, "doc_id long, text string")
        for blocks in (4_000_000, 1200) if n == 4 else (4_000_000,):
            got = {(r.item_id, r.doc_id) for r in leakage.leaked(a, b, n, block_chars=blocks).collect()}
            assert got == plain_leaks(items, texts, n), n
    none = spark.createDataFrame([], "doc_id long, text string")
    assert leakage.leaked(a, none).count() == 0 and leakage.leaked(a.limit(0), b).count() == 0


def test_nearby_against_plain_and_a_stored_index(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 14)))) for i in range(12)] + [(30, None)]
    texts = [(d, " ".join(rng.choices(vocabulary, k=rng.randint(0, 50)))) for d in range(40)] + [(60, None), (61, "")]
    texts += [(100 + i, "x " + " ".join(rng.sample(t.split(), len(t.split()))) + " y") for i, t in items if t]
    n, least, span, want = 6, 4, 7, set()
    for i, t in items:
        ws = (t or "").split()
        for k in range(max(1, len(ws) - n + 1)):
            own = set(ws[k : k + n])
            want |= {(i, d) for d, x in texts if x and len(own) >= least and any(len(own & set(x.split()[q : q + span])) >= least for q in range(len(x.split())))}
    a, b = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r.item_id, r.doc_id) for r in leakage.nearby(a, b, n, least, span).collect()} == want
    path = f"file://{tmp_path}/index"
    leakage.build_index(b.where("doc_id < 100"), path=path)
    leakage.build_index(b.where("doc_id >= 100"), path=path)
    assert {(r.item_id, r.doc_id) for r in leakage.nearby(a, b, n, least, span, index=spark.read.parquet(path)).collect()} == want
    assert leakage.nearby(a, b.limit(0), n, least, span).count() == 0


def test_packing(spark):
    rng = random.Random(3)
    texts = [" ".join(["word"] * rng.choice([0, 1, 5, 40, 200, 3000])) for _ in range(300)] + [None, "", "x" * 50_000]
    df = docs(spark, texts)
    limits = packing.Limits(tokens=256, documents=9, attention=200 * 200)
    rows = packing.pack(df, limits, group_items=100).collect()
    count = packing.token_counter(packing.default_tokenizer())
    sizes = {i: count(t) if t else 0 for i, t in enumerate(texts)}
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        if r.container_id is None:
            assert sizes[r.doc_id] == 0
        else:
            bins.setdefault(r.container_id, []).append(r)
    assert set(pieces) == set(sizes)
    for i, ps in pieces.items():
        ps.sort(key=lambda r: r.piece_no)
        assert sum(r.n_tokens for r in ps) == sizes[i] and len(ps) == max(1, -(-sizes[i] // limits.piece))
        assert [r.token_start for r in ps] == [k * limits.piece for k in range(len(ps))]
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= 256 and len(b) <= 9 and sum(r.n_tokens**2 for r in b) <= 200 * 200
        b.sort(key=lambda r: r.place)
        assert [r.place for r in b] == [sum(x.n_tokens for x in b[:k]) for k in range(len(b))]
    assert packing.pack(df.limit(0), limits).count() == 0
