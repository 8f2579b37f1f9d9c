import itertools
import random
import uuid

from pyspark.sql import functions as F

from tallyloom.llm.history import Bloom, FingerprintStore, fingerprints, may_meet, prepared, repeated_persons, traits, winnow
from tallyloom.llm.linkage import FEATURES, band_keys, blocks, Blocking, link, matches, train
from tallyloom.llm.persons import Name, births_agree, births_near, compare_names, contact_key, forms, parse_birth
from tallyloom.llm.variants import FIELDS, may_agree, name_variants

COLUMNS = ["internal_uuid", "norm_last_name", "norm_first_name", "norm_middle_name", "norm_extension_name", "birthdate_iso", "contact_no_norm", "barangay_code", "sex"]
PERSON = ", ".join(f"{c} string" for c in COLUMNS)


def ids(n, seed=0):
    rng = random.Random(seed)
    return sorted(str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(n))


A = ("1980-01-02", "09171234567", "0101010001", "M")
B = ("1975-05-06", "09179876543", "0101010002", "F")
VARIANTS = [
    ("CRUZ", "EDUARDO", "LOPEZ", None), ("CRUZ", "EDDIE", "LOPEZ", None), ("EDUARDO", "CRUZ", "LOPEZ", ""), ("CRUZ, EDUARDO", ".", "L.", None), ("CURZ", "EDURADO", "LOPEZ", None), ("CRUZ-LOPEZ", "EDUARDO", None, None), ("CRUZ", "E.", "LOPEZ", None),
]


def test_name_rules():
    names = [Name(*v) for v in VARIANTS]
    for a, b in itertools.combinations(names, 2):
        same, typo, initial, contradiction = compare_names(a, b)
        assert not contradiction and same + typo + initial >= 2, (a.words, b.words)
        assert {*forms(a)} & {*forms(b)}
    twin = Name("CRUZ", "RICARDO", "LOPEZ", None)
    assert compare_names(names[0], twin)[3]
    assert compare_names(Name("CRUZ", "JUAN", None, "JR"), Name("CRUZ", "JUAN", None, "SR."))[3]
    assert compare_names(Name("CRUZ", "JUAN", None, "JR"), Name("CRUZ JUNIOR", "JUAN", None, None))[3] is False
    assert Name(None, None, None, None).words == [] and forms(Name("", "", "", "")) == []
    assert len(Name("X" * 50_000, "Y", None, None).words[0]) == 50_000


def test_births_and_contacts():
    p = parse_birth
    assert births_agree(p("1980-01-02"), p("1980-01-02")) == 2 and births_agree(p("1980-01-02"), p("1980-02-01")) == 1 and births_agree(p("1980-01-02"), p("1/2/1980")) == 2
    assert births_agree(p("1980-01-02"), None) == 0 and births_agree(p("1980-01-02"), p("1940-07-19")) == -2 and births_agree(p("1980"), p("1980-01-02")) == 1
    assert p("") is None and p("1900-01-01") is None and p("soon") is None and contact_key("+63 917-123-4567") == "9171234567" and contact_key("0000000000") == "" and contact_key(None) == ""


def test_near_births():
    near = lambda a, b: births_near(parse_birth(a), parse_birth(b))
    assert near("1980-01-02", "1981-01-02") and near("1980-01-02", "1980-02-01") and near("1980-01-02", "1980-01-12")
    assert not near("1995-05-15", "1963-05-15") and not near("2003-08-11", "1971-08-11") and not near("1987-07-21", "1987-08-31") and not near("1980-01-02", "1980-01-02") and not near("", None)


def people(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], PERSON + ", id string")


def test_name_variants(spark):
    u = ids(len(VARIANTS) + 7)
    rows = [(u[i], *v, *A) for i, v in enumerate(VARIANTS)]
    k = len(VARIANTS)
    rows += [(u[k], *VARIANTS[0], *A), (u[k + 1], "CRUZ", "RICARDO", "LOPEZ", None, *A), (u[k + 2], "CRUZ", "EDUARDO", "LOPEZ", None, *B), (u[k + 3], None, None, None, None, *A), (u[k + 4], "CRUZ", "EDUARDO", None, None, None, None, None, None), (None, "CRUZ", "E", None, None, *A)]
    rows += [(u[k + 5], "CRUZ", "EDUARDO", "LOPEZ", None, "1900-01-01", "09171234567", "0101010001", "F")]
    got = {(r.uuid_a, r.uuid_b) for r in name_variants(people(spark, rows), min_rarity=0.0).select("uuid_a", "uuid_b").collect()}
    one = [(u[i], tuple(x or "" for x in v)) for i, v in enumerate([*VARIANTS, VARIANTS[0]])]
    assert got == {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(one, 2) if x != y}
    assert name_variants(people(spark, [])).count() == 0


def test_variants_that_share_a_common_word_only(spark):
    u = ids(42, 8)
    rows = [(u[i], f"FAMILY{'ABCDEFGH'[i % 8]}{'JKLMN'[i // 8]}", "MARIA", None, None, f"19{40 + i}-03-04", f"0918{i:07d}", f"02020200{i:02d}", "F") for i in range(40)]
    rows += [(u[40], "VICASRESMA", "ROSARIO MARIA", None, None, *B), (u[41], "VICASRSMA", "MARIA", None, None, *B)]
    got = name_variants(people(spark, rows)).collect()
    assert [(r.uuid_a, r.uuid_b) for r in got] == [(u[40], u[41])] and got[0].rarity < 0.1


def test_variants_with_one_mistyped_attribute(spark):
    u = ids(4, 12)
    rows = [(u[0], "CRUZ", "EDUARDO", "LOPEZ", None, *A), (u[1], "CRUZ", "EDDIE", "LOPEZ", None, A[0], "09171234576", "0909090009", "M")]
    rows += [(u[2], "CRUZ", "EDUARDO", None, None, "1981-01-02", None, A[2], "M"), (u[3], "REYES", "EDUARDO", "LIM", None, "1981-01-02", None, A[2], "M")]
    got = {(r.uuid_a, r.uuid_b) for r in name_variants(people(spark, rows)).collect()}
    assert got == {(u[0], u[1]), (u[0], u[2])}


def test_pairs_that_names_cannot_save_stay_out_of_python(spark):
    base = ("1980-01-02", "9171234567", "0101010001", "M")
    others = [
        (base, True), (("1980-01-02", "9171234567", "", ""), True), (("1980-01-12", "", "0101010001", "M"), True), (("1980-02-01", "", "0101010001", "M"), True), (("", "9171234576", "0101010001", "M"), True),
        (("1/2/1980", "9180000000", "0202020002", "M"), True), (base[:3] + ("F",), False), (("1980-05-17", "", "0101010001", "M"), False), (("1980-01-02", "9180000000", "0202020002", "M"), False), (("1980-01-03", "9171234566", "", "M"), False), (("", "", "", ""), False),
    ]
    columns = [f"{c}_{x}" for x in "ab" for c in ("birth", "contact", "place", "sex")]
    df = spark.createDataFrame([(i, *base, *o) for i, (o, _) in enumerate(others)], ["i", *columns])
    assert {r.i for r in df.where(may_agree("{}_a", "{}_b")).collect()} == {i for i, (_, want) in enumerate(others) if want}


def test_bloom_and_winnowing():
    rng = random.Random(5)
    import numpy as np

    bloom, kept = Bloom(None, 80_000), np.array([rng.getrandbits(63) for _ in range(5000)], np.int64)
    bloom.add(kept)
    assert bloom.might_hold(kept).all() and Bloom(bloom.table.tobytes(), 0).might_hold(kept).all()
    assert bloom.might_hold(np.array([rng.getrandbits(63) for _ in range(5000)], np.int64)).mean() < 0.02
    a, b, c = winnow(["1980-01-020101010001", "1980-01-020101010001", "x"], 1, 16, 3)
    assert (a == b).all() and len(c) == 1 and not set(a) & set(c)
    d, e = winnow(["0123456789", "0123456789abcdef"], 1, -2, 1)
    assert len(d) == len(e) == 3


def test_repeated_persons(spark):
    u = ids(40, 3)
    history = [(u[0], *VARIANTS[0], *A), (u[1], "REYES", "ANA", None, None, *B)]
    new = [
        (1, 1, u[2], "CRUZ", "EDDIE", "LOPEZ", None, *A),  # in the history
        (1, 2, u[3], "SANTOS", "MARIA", "GOMEZ", None, "1990-01-01", "09170000001", "0101010003", "F"),  # new
        (1, 3, u[4], "SANTOS", "MARIA", "G.", None, "1990-01-01", "09170000001", "0101010003", "F"),  # earlier row of the batch
        (2, 1, u[5], "SANTOS", "MA.", "GOMEZ", None, "1990-01-01", None, "0101010003", "F"),  # earlier batch
        (2, 2, u[6], "CRUZ", "RICARDO", "LOPEZ", None, *A),  # a brother
        (2, 3, u[7], None, None, None, None, None, None, None, None),
        (None, None, u[8], "REYES", "ANA", None, None, *B),
        (2, 4, None, "REYES", "ANA", None, None, *B),
    ]
    batches = spark.createDataFrame(new, "batch_no long, row_no long, " + PERSON)
    got = sorted((r.uuid_a, r.uuid_b) for r in repeated_persons(people(spark, history), batches).collect())
    assert got == sorted(tuple(sorted(x)) for x in ((u[2], u[0]), (u[4], u[3]), (u[5], u[3]), (u[8], u[1])))
    assert repeated_persons(people(spark, history), batches.limit(0)).count() == 0
    assert sorted((r.uuid_a, r.uuid_b) for r in repeated_persons(people(spark, []), batches).collect()) == sorted(tuple(sorted(x)) for x in ((u[4], u[3]), (u[5], u[3])))


def test_store_is_opened_again_and_read_in_part(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPRSTUVZ", k=9))
    one = lambda u: (u, word(), word(), word(), None, f"19{rng.randint(40, 99)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"09{rng.randint(10**8, 10**9 - 1)}", f"01010{rng.randint(10000, 99999)}", rng.choice("MF"))
    u = ids(1010, 22)
    history, path = [one(x) for x in u[:1000]], f"file://{tmp_path}/store"
    FingerprintStore(spark, path, partition_rows=100, least_partitions=64).accept(people(spark, history), F.lit(0))
    again = FingerprintStore(spark, path)
    assert again.batches == 1 and len(again.segments) == 1 and again.segments[0].fingerprints > 4000
    # A batch of one known and one new row reads the partitions of its positives only; a new segment takes what is too much for the old one.
    part = lambda name: {f"{r[0]}" for r in spark.read.parquet(f"{path}/{name}").select("part").distinct().collect()}
    read: list[int] = []
    table = FingerprintStore._table
    FingerprintStore._table = lambda self, name, schema, parts=None: (read.append(len(parts)) if parts is not None else None, table(self, name, schema, parts))[1]
    try:
        batch = spark.createDataFrame([(1, 1, u[1000], *history[7][1:]), (1, 2, *one(u[1001]))], "batch_no long, row_no long, " + PERSON)
        got = [tuple(r) for r in repeated_persons(people(spark, []), batch, store=again).collect()]
    finally:
        FingerprintStore._table = table
    assert got == [tuple(sorted((u[1000], u[7])))]
    assert max(read) < len(part("fingerprints")) / 4
    third = FingerprintStore(spark, path)
    assert third.batches == 2 and third.order == 1
    batch = spark.createDataFrame([(9, 1, u[1002], *history[7][1:]), (9, 2, *[*batch.collect()[1][2:]])], "batch_no long, row_no long, " + PERSON)
    got = {tuple(r) for r in repeated_persons(people(spark, []), batch, store=third).collect()}
    assert (u[7], u[1002]) in got or (u[1002], u[7]) in got


def test_batches_search_the_store_once_and_settle_in_turn(spark):
    u = ids(8, 25)
    history = people(spark, [(u[0], "REYES", "ANA", None, None, *B)])
    cruz = ("CRUZ", "EDUARDO", "LOPEZ", None)
    # 1 and 2 share too little with each other, 3 is one person with both: 1 stays the first, and 2 stays a first record of its own.
    new = [
        (1, 1, u[1], *cruz, A[0], "09170000001", None, "M"),
        (1, 2, u[2], *cruz, None, "09180000002", A[2], "M"),
        (2, 1, u[3], *cruz, A[0], "09170000001", A[2], "M"),
        (2, 2, u[4], *cruz, None, "09180000002", A[2], "M"),
        (3, 1, u[5], *cruz, A[0], None, A[2], "M"),
        (3, 2, u[6], "REYES", "ANA", None, None, *B),
    ]
    batches = spark.createDataFrame(new, "batch_no long, row_no long, " + PERSON)
    read: list[str] = []
    table = FingerprintStore._table
    FingerprintStore._table = lambda self, name, schema, parts=None: (read.append(name), table(self, name, schema, parts))[1]
    try:
        store = FingerprintStore(spark)
        store.accept(history, F.lit(0))
        together = {(r.uuid_a, r.uuid_b) for r in repeated_persons(history, batches, store=store).collect()}
    finally:
        FingerprintStore._table = table
    assert read.count("fingerprints") == 1
    one_by_one, store = set(), FingerprintStore(spark)
    store.accept(history, F.lit(0))
    for n in (1, 2, 3):
        one_by_one |= {(r.uuid_a, r.uuid_b) for r in repeated_persons(history, batches.where(F.col("batch_no") == n), store=store).collect()}
    assert together == one_by_one and tuple(sorted((u[6], u[0]))) in together and tuple(sorted((u[3], u[1]))) in together
    assert not any(set(pair) == {u[1], u[2]} for pair in together)


def test_coverage_rejects_what_shares_a_part_of_a_run(spark):
    u = ids(4, 23)
    history = [(u[0], "CRUZ", "EDUARDO", "LOPEZ", None, A[0], None, "0101010001", "M"), (u[1], "REYES", "ANA", None, None, B[0], B[1], None, "F")]
    # Born on one day in places of two regions whose other digits are equal: some grams are shared, a whole run isn't.
    batch = spark.createDataFrame([(1, 1, u[2], "CRUZ", "EDUARDO", "LOPEZ", None, A[0], None, "0201010001", "M"), (1, 2, u[3], "REYES", "ANA", None, None, B[0], B[1], "0101010002", "F")], "batch_no long, row_no long, " + PERSON)

    def pairs(coverage):
        store = FingerprintStore(spark, coverage=coverage)
        store.accept(people(spark, history), F.lit(0))
        found: list[int] = []
        verified = store._verified
        store._verified = lambda covered, own: (found.append(covered.count()), verified(covered, own))[1]
        repeated_persons(people(spark, history), batch, store=store).count()
        return found[0]

    assert pairs(0.8) == 1 and pairs(0.1) == 2


def test_winnowing_finds_a_person_with_one_mistyped_attribute(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPRSTUVZ", k=9))
    digit = lambda s, k: s[:k] + str((int(s[k]) + 1) % 10) + s[k + 1 :]
    u, history, new, want = ids(480, 32), [], [], set()
    for i in range(240):
        birth, contact, place = f"19{rng.randint(40, 98)}-{rng.randint(1, 9):02d}-{rng.randint(10, 12)}", f"9{rng.randint(10**8, 10**9 - 1)}", f"01010{rng.randint(10000, 99999)}"
        names = (word(), word(), word(), None)
        other = [(birth, digit(contact, rng.randrange(1, 10)), "0202020002"), (digit(birth, 3), contact, "0202020002"), (digit(birth, rng.choice([3, 6])), None, place), (f"{birth[:4]}-{birth[8:]}-{birth[5:7]}", contact, None), (None, digit(contact, rng.randrange(1, 10)), place), ("1939-01-30", digit(contact, 9), "0202020002")][i % 6]
        history.append((u[2 * i], *names, birth, contact, place, "M"))
        new.append((1, i, u[2 * i + 1], *names, *other, "M"))
        if i % 6 < 5:  # the last has no attribute in common
            want.add(tuple(u[2 * i : 2 * i + 2]))
    found = repeated_persons(people(spark, history), spark.createDataFrame(new, "batch_no long, row_no long, " + PERSON))
    assert {tuple(r) for r in found.collect()} == want


def test_strangers_of_one_place_are_no_candidates(spark):
    rng = random.Random(41)
    word = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPRSTUVZ", k=9))
    birth = lambda: f"19{rng.randint(40, 98)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    # All live in one place and have numbers of one kind; one new row is of the first person, with a mistyped number.
    u = ids(361, 42)
    history = [(x, word(), word(), word(), None, birth(), f"90001{rng.randrange(10**5):05d}", "0101010001", "M") for x in u[:300]]
    new = [(1, i, x, word(), word(), word(), None, birth(), f"90001{rng.randrange(10**5):05d}", "0101010001", "M") for i, x in enumerate(u[300:360])]
    number = history[0][6]
    new.append((1, 60, u[360], *history[0][1:5], None, number[:6] + str((int(number[6]) + 1) % 10) + number[7:], *history[0][7:]))
    store, found = FingerprintStore(spark), []
    store.accept(people(spark, history), F.lit(0))
    verified = store._verified
    store._verified = lambda covered, own: (found.append(covered.count()), verified(covered, own))[1]
    got = repeated_persons(people(spark, history), spark.createDataFrame(new, "batch_no long, row_no long, " + PERSON), store=store)
    assert [tuple(r) for r in got.collect()] == [(u[0], u[360])]
    assert found[0] < 361
    assert fingerprints(prepared(people(spark, history), F.lit(0))).count() < 11 * len(history)


def test_traits_rule_out_only_what_the_check_rejects(spark):
    rng = random.Random(43)
    births = ["", "soon", "1/2/1980", "0000-00-00", "1980-01-02", "1980-02-01", "1980-01-12", "1981-01-02", "1975-05-06"]
    contacts = ["", "0171234567", "0171234569", "0171234599", "0171234999", "9179876543"]
    rows = [(i, *(rng.choice(x) for x in (births, contacts, ["", "0101010001", "0101010002"], ["", "M", "F", "X"]))) for i in range(250)]
    records = spark.createDataFrame(rows, "i int, birth string, contact string, place string, sex string").withColumn("traits", traits())
    side = lambda x: records.select(*(F.col(c).alias(f"{x}_{c}") for c in records.columns))
    both = side("a").crossJoin(side("b")).select(may_agree("a_{}", "b_{}").alias("agree"), may_meet("a_traits", "b_traits").alias("meet")).groupBy("agree", "meet").count().collect()
    counts = {(r["agree"], r["meet"]): r["count"] for r in both}
    assert None not in {x for k in counts for x in k} and (True, False) not in counts
    assert counts[True, True] > 1000 and counts[False, False] > 1000


def test_reference_and_names_find_a_person_with_one_agreement(spark):
    u = ids(2, 24)
    columns = PERSON + ", source_reference string"
    history = spark.createDataFrame([(u[0], "CRUZ", "EDUARDO", "LOPEZ", None, A[0], None, "0101010001", "M", "clinic-7#row=000012")], columns)
    batch = spark.createDataFrame([(1, 1, u[1], "CRUZ", "EDUARDO", "LOPEZ", None, "1980-01-12", None, "0101010001", "M", "clinic-7#row=000012")], "batch_no long, row_no long, " + columns)
    assert [tuple(r) for r in repeated_persons(history, batch).collect()] == [tuple(u)]


def test_blocks_and_classifier():
    x, y, z = band_keys(["ANA CRUZ", "ANA CRUZ", "EDUARDO LOPEZ"], Blocking())
    assert (x == y).all() and not (x == z).any()
    import numpy as np

    rng = np.random.default_rng(0)
    f = rng.random((3000, len(FEATURES)))
    label = (f[:, 0] + f[:, 3] > 1).astype(float)
    model = train(f, label)
    p = model.probability(f)
    assert ((p > 0.5) == (label > 0.5)).mean() > 0.97 and abs(p.mean() - label.mean()) < 0.03
    # Labels move a prior: none, one class or few of them give sane and ordered probabilities.
    at = {name: i for i, name in enumerate(FEATURES)}
    good, bad = np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
    good[at["words"]], good[at["agreements"]], bad[at["contradiction"]] = 3, 1, 1
    for k, y in ((0, label), (1, np.ones(1)), (9, np.zeros(9)), (9, np.ones(9))):
        p = train(np.tile(good if y[:1].sum() else bad, (k, 1)), y[:k]).probability(np.array([good, bad]))
        assert p[0] > 0.5 > p[1]
    assert train(f[:0], label[:0]).probability(f).shape == (3000,)


def test_minhash_recall_for_one_changed_letter():
    rng = random.Random(13)
    letters, n = "ABCDEFGHIJKLMNOPRSTUVZ", 3000
    names = [" ".join(sorted("".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(3))) for _ in range(n)]
    off = []
    for t in names:
        k = rng.choice([i for i, c in enumerate(t) if c != " "])
        off.append(t[:k] + rng.choice([c for c in letters if c != t[k]]) + t[k + 1 :])
    a, b = band_keys(names, Blocking()), band_keys(off, Blocking())
    assert (a == b).any(axis=1).mean() > 0.9 and (a[1:] == b[:-1]).any(axis=1).mean() < 0.01


def test_a_slice_gives_the_rows_of_the_whole(spark):
    rng = random.Random(14)
    u, given = ids(400, 15), ["MARIO", "MARIA", "ERIC", "ERICA", "JOSE", "ROSE"]
    rows = []
    for i in range(0, 400, 2):
        last, birth, place = "".join(rng.choices("ABCDEFGHIJ", k=8)), f"19{rng.randint(40, 99)}-01-02", f"01010{i:05d}"
        k = rng.randrange(6)
        rows += [(u[i], last, given[k], None, None, birth, None, place, None), (u[i + 1], last, given[k ^ rng.randint(0, 1)], "L", None, birth, None, place, None)]
    whole = {tuple(r)[:2] for r in name_variants(people(spark, rows)).collect()}
    part = {tuple(r)[:2] for r in name_variants(people(spark, rows[:20])).collect()}
    kept = {r[0] for r in rows[:20]}
    assert part == {p for p in whole if p[0] in kept} and whole


def test_link(spark):
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPRSTUVZ"
    word = lambda: "".join(rng.choices(letters, k=9))
    left, right, want = [], [], set()
    for i, u in enumerate(ids(300, 4)):
        person = (word(), word(), word(), None, f"19{rng.randint(40, 99)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"09{rng.randint(10**8, 10**9 - 1)}", f"01010{rng.randint(10000, 99999)}", rng.choice("MF"))
        left.append((u, *person))
        if i % 3 == 0:  # the same person, one field off
            p = list(person)
            p[rng.choice([2, 4, 5])] = None
            right.append((i, *p))
            want.add((u, i))
        elif i % 3 == 1:  # a twin
            right.append((i, person[0], word(), *person[2:]))
    right += [(9000, *[None] * 8), (9001, "", "", "", "", "", "", "", "")]
    a = spark.createDataFrame(left, PERSON)
    b = spark.createDataFrame(right, PERSON.replace("internal_uuid string", "partner_row long"))
    got = {(r.internal_uuid, r.partner_row) for r in matches(link(a, b, "internal_uuid", "partner_row")).collect()}
    assert got == want
    assert link(a.limit(0), b, "internal_uuid", "partner_row").count() == 0


def test_block_keys_are_made_in_one_pass(spark):
    rows = [(1, "CRUZ", "EDUARDO", "", "", "1980-01-02", "9171234567", "0101010001", "M"), (2, "CRUZ", "EDUARDO", "", "", "1/2/1981", "", "0101010001", "M"), (3, "", "", "", "", "", "9171234576", "", "")]
    records = spark.createDataFrame(rows, f"h long, {', '.join(f'{c} string' for c in FIELDS)}")
    keyed = blocks(records, Blocking())
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    keys = {h: {r.k for r in keyed.collect() if r.h == h} for h in (1, 2, 3)}
    # Five bands with the birth, three pairs of attributes, and 2 + 2 + 4 keys of what a typing error leaves; then 5, 1 and 2.
    assert [len(keys[h]) for h in (1, 2, 3)] == [16, 8, 0] and len(keys[1] & keys[2]) == 1


def test_link_with_one_mistyped_attribute(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPRSTUVZ", k=9))
    left, right, want = [], [], set()
    for i, u in enumerate(ids(240, 6)):
        person = [word(), word(), word(), None, f"19{rng.randint(40, 99)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"09{rng.randint(10**8, 10**9 - 1)}", f"01010{rng.randint(10000, 99999)}", rng.choice("MF")]
        left.append((u, *person))
        other = list(person)
        if i % 4 == 0:  # birth date equal, place moved, one digit of the contact wrong
            k = rng.randrange(2, 11)
            other[6], other[5] = f"02020{rng.randint(10000, 99999)}", other[5][:k] + str((int(other[5][k]) + 3) % 10) + other[5][k + 1 :]
        elif i % 4 == 1:  # place equal, no contact, one digit of the year wrong
            other[5], other[4] = None, other[4][:3] + str((int(other[4][3]) + 1) % 10) + other[4][4:]
        elif i % 4 == 2:  # place equal, birth date missing, one digit of the contact wrong
            other[4], other[5] = None, other[5][:-1] + str((int(other[5][-1]) + 1) % 10)
        else:  # someone else there with a near birth date
            other[:3] = word(), word(), word()
            other[5], other[4] = None, other[4][:3] + str((int(other[4][3]) + 1) % 10) + other[4][4:]
        right.append((i, *other))
        if i % 4 < 3:
            want.add((u, i))
    a = spark.createDataFrame(left, PERSON)
    b = spark.createDataFrame(right, PERSON.replace("internal_uuid string", "partner_row long"))
    got = {(r.internal_uuid, r.partner_row) for r in matches(link(a, b, "internal_uuid", "partner_row")).collect()}
    assert got == want
