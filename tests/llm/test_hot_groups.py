"""A third of the rows in one group: copies, one source, one question."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import leximin, lookalikes, nearcopies, replies


def test_copies_and_boilerplate(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("气候区划指标土壤水分降水温度日照", k=n))
    common = word(180)
    rows = [(i, common) for i in range(60)] + [(100 + i, common + word(150)) for i in range(60)] + [(300 + i, word(200)) for i in range(60)]
    df = spark.createDataFrame(rows, "block_id long, text string")
    members, links = nearcopies.near_copies(df, bucket=20)
    got = {(r.a, r.b) for r in nearcopies.all_pairs(members, links, "block_id").collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60)}
    assert members.count() == 180 and members.select("rep").distinct().count() == 121


def test_one_form_of_many_rows(spark):
    rows = [(i, "Figure 9 Water balance") for i in range(150)] + [(900, "Figurе 9 Water balance")] + [(1000 + i, f"other text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "block_id long, text string")
    got = {(r.a, r.b) for r in lookalikes.alike(lookalikes.families(lookalikes.hashed(lookalikes.forms(df, "block_id", ("text",)), "block_id", {"text": 8}))).collect()}
    assert got == {(i, 900) for i in range(150)}


def test_one_question_and_one_prefix(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 == 0 else f"q{i % 40}", f"c{i}", i % 50 + 1, rng.random(), rng.random(), rng.random(), rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "root_id string, chunk_id string, prior_rank int, rrf_prior double, retrieval_prior double, cosine_sim double, ce_raw double")
    # The hot question is ranked over ranges, the others in their tasks; all in their tasks gives the same.
    vecs = [{(r.root_id, r.chunk_id): r.vec for r in leximin.percentiles(df, "root_id", "chunk_id", one_task=n).collect()} for n in (50, 1000)]
    assert vecs[0] == vecs[1] and len(vecs[0]) == 900
    ranked = leximin.percentiles(df, "root_id", "chunk_id", one_task=50)
    places = [{tuple(r) for r in leximin.order(ranked, "root_id", "chunk_id", one_task=n).collect()} for n in (50, 1000)]
    assert places[0] == places[1] and sorted(p for q, _, p in places[0] if q == "hot") == list(range(1, 301))
    texts = spark.createDataFrame([("同一个开头" + "甲" * (i % 7) + str(i),) for i in range(400)] + [("同一个开头",)], "x string")
    assert {r.x for r in replies.shortened(texts, "x").collect()} >= {"同一个开头"}


def test_groups_of_links(spark):
    rng = random.Random(10)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    random_links = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    links = [(a, b) for a, b in chain + star + random_links if a != b]
    root = {n: n for ab in links for n in ab}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in nearcopies.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == root
    assert nearcopies.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_count_copies(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5)], "block_id long, rep long")
    links = spark.createDataFrame([(1, 3)], "a long, b long")
    got = {tuple(r) for r in nearcopies.groups(members, links, "block_id").collect()}
    assert got == {(1, 1, 1, 2), (2, 1, 1, 2), (3, 3, 1, 2), (5, 5, 5, 1), (6, 5, 5, 1)}


def test_pairs_by_chance_stay_in_their_tasks(spark):
    """Texts with a third in common share bands by chance, pairs of them by the square; what is shuffled is not."""
    rng = random.Random(11)
    word = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5A00)) for _ in range(n))
    common = word(120)
    rows = [(i, common + word(110)) for i in range(1500)]
    rows += [(2000 + i, t[:-1] + "。") for i, t in rows[:30]]
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        jobs = store.jobsList(None)
        stages = {jobs.apply(j).stageIds().apply(k) for j in range(jobs.size()) for k in range(jobs.apply(j).stageIds().size())}
        return sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in stages)

    before = shuffled()
    members, links = nearcopies.near_copies(spark.createDataFrame(rows, "block_id long, text string"))
    got = {(r.a, r.b) for r in nearcopies.all_pairs(members, links, "block_id").collect()}
    assert got == {(i, 2000 + i) for i in range(30)}
    assert shuffled() - before < 60 * len(rows)


@pytest.mark.parametrize("batch", [1, 7, 64, 5000])
def test_buckets_over_batches(batch):
    rng = np.random.default_rng(12)
    base = rng.integers(-(1 << 62), 1 << 62, (12, 6))
    rows = []
    for band, n in enumerate((1, 3, 50, 2, 1, 90, 91, 1, 40, 130)):  # those over 90 are oversized
        for k in range(n):
            nib = base[k % 12].copy()
            nib[: k % 7] ^= rng.integers(0, 1 << 62, k % 7)
            rows.append((band - 4, 1000 * band + k, int(rng.integers(0, 1000)), nib))
            if k % 5 == 0:  # an equal text
                rows.append((band - 4, 1000 * band + k, int(rng.integers(1000, 2000)), nib))
    rows.sort(key=lambda r: r[:3])
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in b]), pa.array([r[1] for r in b]), pa.array([r[2] for r in b]), pa.array([r[3].tolist() for r in b])], ["band", "h1", "rep", "nib"])
               for b in (rows[i : i + batch] for i in range(0, len(rows), batch))]
    got = [(a, b) for t in nearcopies.bucket_pairs(43, 50, 6, 90)(iter(batches)) for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist())]
    want = []
    for band in range(-4, 6):
        one = {}
        for r in rows:
            if r[0] == band:
                one.setdefault(r[1], r)
        if len(one) > 90:
            want += [(r[2], None) for r in one.values()]
            continue
        for x, y in combinations(one.values(), 2):
            digits = [(int(v) >> 4 * i & 15) == (int(w) >> 4 * i & 15) for v, w in zip(x[3], y[3]) for i in range(16)]
            bits = [(int(v) >> 4 * i & 1) == (int(w) >> 4 * i & 1) for v, w in zip(x[3][:4], y[3][:4]) for i in range(16)]
            if sum(digits) >= 50 and sum(bits) >= 43 and x[2] != y[2]:
                want.append((x[2], y[2]))
    key = lambda p: (p[0], -1 if p[1] is None else p[1])
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 200


def test_verified_in_passes(spark):
    rng = random.Random(13)
    texts = [(i, "".join(rng.choices("abcdef ", k=150))) for i in range(20)]
    texts += [(100 + i, t[:-5] + "#####") for i, t in texts] + [(200, texts[0][1])]
    pairs = spark.createDataFrame([(i, j) for i in range(20) for j in (100 + i, 100 + (i + 1) % 20, 200)], "a long, b long")
    df = spark.createDataFrame(texts, "rep long, t string")
    got = [{tuple(r) for r in nearcopies.verified(pairs, df, most=n).collect()} for n in (7, 1000)]
    assert got[0] == got[1] and {r[:2] for r in got[0]} == {(i, 100 + i) for i in range(20)} | {(0, 200)}
