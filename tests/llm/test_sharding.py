import math
import zlib
from collections import Counter, defaultdict

import xxhash

from arraylens.llm.sharding import Shard, assign, shard_documents, tree


def spark_hash(key, path):
    h = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    return xxhash.xxh64_intdigest(path.encode(), h)


def brute(key, shards):
    def pick(nodes):
        return min((-math.log(((spark_hash(key, p) >> 12) + 0.5) / 2**52) / w, i) for i, (p, w) in enumerate(nodes))[1] if len(nodes) > 1 else 0

    regions = defaultdict(lambda: defaultdict(list))
    for s in shards:
        if s.weight:
            regions[s.region][s.rack].append(s)
    names = list(regions)
    r = names[pick([(n, sum(s.weight for x in regions[n].values() for s in x)) for n in names])]
    racks = list(regions[r])
    k = racks[pick([(f"{r}/{n}", sum(s.weight for s in regions[r][n])) for n in racks])]
    leaves = regions[r][k]
    found = leaves[pick([(f"{r}/{k}/{s.number}", s.weight) for s in leaves])]
    if not found.closed:
        return found.number
    still = [s for s in shards if s.weight and not s.closed]
    return still[pick([(f"again/{s.region}/{s.rack}/{s.number}", s.weight) for s in still])].number


def test_matches_brute_force_and_law(spark):
    rows = [(i, None if i % 7 == 0 else "é" * (i % 5)) for i in range(3000)] + [(None, "x"), (5, "again"), (5, "again"), (9, "y " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as shard", "1 as slot", "'a' as law", "3 as _chunk")
    got = shard_documents(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in got:
        assert r.law == "key" and r.shard == brute(r.doc_id, tree(8)) and r.grown_shard in (r.shard, 8)
        assert r.grown_shard == brute(r.doc_id, tree(9))
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.3 * 3000 / 8
    assert 0.07 < sum(r.grown_shard == 8 for r in got) / len(got) < 0.15


def test_weights_move_rows_only_across_the_changed_subtree(spark):
    a = [Shard("a", "a1", 0), Shard("a", "a2", 1, 2.0), Shard("b", "b1", 2), Shard("b", "b1", 3)]
    b = [*a[:2], Shard("b", "b1", 2, 3.0), a[3]]
    keys = spark.range(4000)
    got = assign(assign(keys, "id", a, "x"), "id", b, "y").collect()
    assert all(r.x == r.y or r.y in (2, 3) for r in got)
    assert all(not (r.x in (2, 3) and r.y in (0, 1)) for r in got)
    share = Counter(r.x for r in got)
    assert abs(share[1] / 4000 - 0.4) < 0.03
    zero = assign(keys, "id", [Shard("a", "a", 0, 0.0), Shard("a", "a", 1)], "x")
    assert {r.x for r in zero.collect()} == {1}


def test_empty(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_more_shard_takes_rows_only_into_itself_at_every_count(spark):
    df = spark.range(6000)
    for n in range(1, 14):
        df = assign(df, "id", tree(n), f"s{n}")
    rows = df.collect()
    for n in range(1, 13):
        assert all(r[f"s{n + 1}"] in (r[f"s{n}"], n) for r in rows), n
    for n in range(1, 14):
        sizes = Counter(r[f"s{n}"] for r in rows)
        assert set(sizes) == set(range(n)) and max(sizes.values()) < 1.25 * 6000 / n, n
    assert all(r.s5 == brute(r.id, tree(5)) for r in rows[:500])
