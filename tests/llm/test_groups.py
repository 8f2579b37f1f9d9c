import random
import uuid

import pytest
from pyspark.sql import functions as F

from tallyloom.llm.groups import connected_groups, match_groups, uuid_key, uuid_text

SCHEMA = "record_a_uuid string, record_b_uuid string, pair_key string, u string, root string"


def plain(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_groups_against_union_find(spark):
    rng = random.Random(1)
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(400)]
    pairs = list(zip(ids[:120], ids[1:121]))  # a chain
    pairs += [(ids[130], x) for x in ids[131:200]]  # a star
    pairs += [tuple(rng.sample(ids[200:], 2)) for _ in range(120)]
    pairs += pairs[:20] + [(ids[399], ids[399])]
    forms = [str, str.upper, lambda s: "{" + s + "}", lambda s: s.replace("-", ""), lambda s: f" {s} ", lambda s: f"urn:uuid:{s}"]
    rows = []
    for i, (a, b) in enumerate(pairs):
        x, y, key = forms[i % 6](a), forms[(i // 6) % 6](b), f"{b}|{a}"
        rows.append([(x, y, key), (None, y, key), (x, None, key), (x, y, None), (x, "", key)][i % 5] + ("extra", None))
    got = {r.internal_uuid: r.group_uuid for r in match_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(pairs)


def test_nothing_to_link(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert match_groups(empty).count() == 0
    rows = [(None, None, None, "", ""), ("", " ", "|", "", ""), ("Not A Uuid", None, None, "", ""), (None, None, "x|not a uuid", "", "")]
    got = {r.internal_uuid: r.group_uuid for r in match_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"not a uuid": "not a uuid", "x": "not a uuid"}


def test_any_rounds_and_rate(spark):
    chain = spark.range(20).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("a"), F.concat(F.lit("n"), F.lpad((F.col("id") + 1).cast("string"), 3, "0")).alias("b")).select(uuid_key(F.col("a")).alias("u"), uuid_key(F.col("b")).alias("v"))
    with pytest.raises(ValueError):
        connected_groups(chain, 0.5, 1)
    for beta, rounds in ((0.3, 6), (1.0, 2)):
        found = connected_groups(chain, beta, rounds)
        assert found.count() == 21 and found.select("root").distinct().count() == 1
        assert found.select(uuid_text(F.col("node")).alias("n")).distinct().count() == 21
