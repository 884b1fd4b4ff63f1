import random
import re

import numpy as np
from pyspark.sql import functions as F

from rasterflow.operators import dedupe


def walk(files, near=7):
    """The groups of a plain walk over (ord, sha, sig) in order."""
    seen, groups = {}, []
    for o, sha, sig in sorted(files):
        if sha in seen:
            groups.append(([seen[sha][0], o], seen[sha][1]))
            continue
        seen[sha] = (o, sig)
        for members, leader in groups:
            if ((leader ^ sig) & (2**64 - 1)).bit_count() <= near:
                members.append(o)
                break
        else:
            groups.append(([o], sig))
    return [(k, j, o) for k, members in enumerate((m for m, _ in groups if len(m) > 1), 1) for j, o in enumerate(members)]


def flipped(sig, n):
    sig &= 2**64 - 1
    for b in random.sample(range(64), n):
        sig ^= 1 << b
    return sig - 2**64 if sig >> 63 else sig


def test_groups_are_those_of_a_walk(spark):
    for seed in range(3):
        random.seed(seed)
        bases = [random.getrandbits(63) for _ in range(6)]
        shas = [(f"s{k}", flipped(random.choice(bases), random.randint(0, 6))) for k in range(30)]
        files = [(o, *random.choice(shas)) for o in range(60)]
        df = spark.createDataFrame(files, "ord long, sha string, sig long")
        got = sorted((r.group, r.position, r.ord) for r in dedupe.groups(df).collect())
        assert got == sorted(walk(files))


def test_groups_of_chains_take_few_rounds(spark, monkeypatch):
    """Frames in path order, each near the ones beside it only: decided in a round for each range, not for each frame."""
    random.seed(17)
    sig, files = random.getrandbits(64), []
    for o in range(5000):
        files.append((o, f"s{o}", sig - 2**64 if sig >> 63 else sig))
        for b in range(5):
            sig ^= 1 << (o * 5 + b) % 64
    df = spark.createDataFrame(files, "ord long, sha string, sig long")
    rounds = []
    kept = dedupe.stored
    monkeypatch.setattr(dedupe, "stored", lambda d: (rounds.append(d.columns), kept(d))[1])
    got = sorted((r.group, r.position, r.ord) for r in dedupe.groups(df).collect())
    assert got == sorted(walk(files)) and rounds.count(["node", "created", "leader"]) < 15


def test_groups_over_many_ranges(spark):
    random.seed(29)
    sigs = [flipped(random.getrandbits(6) * 0x0101010101010101, random.randint(0, 3)) for _ in range(150)]
    shas = [(f"s{k}", s) for k, s in enumerate(sigs)]
    files = [(o, *random.choice(shas)) for o in range(300)]
    first = {}
    for o, sha, sig in files:
        first.setdefault(sha, (o, sig))
    nodes, copied = {}, {}
    for o, sig in first.values():
        nodes[sig] = min(o, nodes.get(sig, o))
    for o, sha, sig in files:
        if o > first[sha][0]:
            copied.setdefault(sig, (o, first[sha][0]))
    df = spark.createDataFrame([(o, s, *copied.get(s, (None, None))) for s, o in nodes.items()], "node long, sig long, copied long, copied_first long")
    one, many = (sorted(map(tuple, dedupe._decided(df, 7, ranges).collect())) for ranges in (1, 7))
    assert one == many and len(one) == len(nodes) and len({c for _, c, _ in one}) > 5


def test_near_pairs_miss_nothing(spark):
    random.seed(9)
    sigs = [random.getrandbits(64) - 2**63 for _ in range(40)]
    sigs += [flipped(s, random.randint(0, 9)) for s in sigs]
    df = spark.createDataFrame(list(enumerate(sigs)), "id long, sig long")
    got = {(r.left_id, r.right_id, r.distance) for r in dedupe.near_pairs(df.withColumnRenamed("id", "left_id"), df.withColumnRenamed("id", "right_id")).where("left_id < right_id").collect()}
    want = {(a, b, d) for a in range(len(sigs)) for b in range(a + 1, len(sigs)) if (d := ((sigs[a] ^ sigs[b]) & (2**64 - 1)).bit_count()) <= 7}
    assert got == want


def test_near_pairs_deal_keys_by_number(spark, monkeypatch):
    """No task makes all keys and none are broadcast, few as the bytes of their signatures are; hot parts and copies lose no pair."""
    random.seed(43)
    base = random.getrandbits(64)
    sigs = [flipped(base, random.randint(0, 5)) for _ in range(60)] + [random.getrandbits(64) - 2**63 for _ in range(440)]
    sigs += sigs[:20] + sigs[100:120]
    left = spark.createDataFrame(list(enumerate(sigs)), "left_id long, sig long")
    right = left.withColumnRenamed("left_id", "right_id")
    want = {(a, b, d) for a in range(len(sigs)) for b in range(len(sigs)) if (d := ((sigs[a] ^ sigs[b]) & (2**64 - 1)).bit_count()) <= 7}
    for per_task, tasks in ((1 << 20, 4), (2000, 20)):
        monkeypatch.setattr(dedupe, "KEYS", per_task, raising=False)
        found = dedupe.near_pairs(left, right)
        got = [tuple(r) for r in found.collect()]
        assert set(got) == want and len(got) == len(want)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        dealt = set(re.findall(r"hashpartitioning\((left_sig|right_sig|key)#\w+, (\d+)\), REPARTITION_BY_NUM", plan))
        assert {("left_sig", str(tasks)), ("right_sig", str(tasks))} <= dealt and (("key", str(tasks)) in dealt) == (tasks > 4)


def test_best_takes_the_first_of_equal_scores(spark):
    members = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 7), (2, 0, 8), (2, 1, 9)], "group long, position int, ord long")
    scores = spark.createDataFrame([(6, 3), (7, 3), (5, 1)], "ord long, score int")
    assert sorted((r.group, r.ord) for r in dedupe.best_of_group(members, scores).where("is_best").collect()) == [(1, 6), (2, 8)]


def test_signatures(spark):
    block = [float(k % 11) for k in range(64)]
    df = spark.createDataFrame([(block,)], "c array<double>")
    median = np.median(np.array(block).reshape(8, 8)[1:])
    want = int("".join("1" if x > median else "0" for x in block), 2)
    r = df.select(dedupe.signature(F.col("c")).alias("s"), dedupe.signature_hex(dedupe.signature(F.col("c"))).alias("h")).first()
    assert r.s & (2**64 - 1) == want and r.h == f"{want:016x}"
