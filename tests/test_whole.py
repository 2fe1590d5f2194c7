"""Queries read all of their input: whole texts, every row, every size."""

import datetime
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions.similarity import edit_operations, token_set_ratio, token_set_ratios
from cuelake.operators import spatial as SP
from cuelake.operators import topk as K
from cuelake.plans import QUERIES


def tables(spark, folder, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_token_set_ratios_equal_one_by_one():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abé一二") for _ in range(r.randint(1, 4)))
    texts = ["", " \n", "a", "一二三四五六", *(" ".join(word() for _ in range(r.randint(1, 12))) for _ in range(150))]
    got = token_set_ratios(texts[:60], texts, 37)
    assert all(got[i, j] == token_set_ratio(a, b) for i, a in enumerate(texts[:60]) for j, b in enumerate(texts))


def test_fuzzy_top_k_of_a_large_memory_needs_no_common_word(spark):
    memory = spark.range(50_001).selectExpr("id", "case when id = 777 then 'runing' when id = 9 then '今天天气很好啊' else concat('zz', id) end as m")
    queries = spark.createDataFrame([(1, "running"), (2, "今天天气很好")], "q long, t string")
    got = {(r.q, r.id) for r in K.fuzzy_top_k(queries, memory, "t", "m", ["q"], ["id"], 1).collect()}
    assert got == {(1, 777), (2, 9)}


def test_fuzzy_top_k_ties_and_nulls(spark):
    memory = spark.createDataFrame([(3, "a b"), (1, "a b"), (2, "a b"), (4, None)], "id long, m string")
    queries = spark.createDataFrame([(1, "b a"), (2, None)], "q long, t string")
    assert sorted((r.q, r.id, r.rank) for r in K.fuzzy_top_k(queries, memory, "t", "m", ["q"], ["id"], 2).collect()) == [(1, 1, 1), (1, 2, 2)]


def test_topk_retrieval_fuzzy_reads_whole_texts(spark, tmp_path):
    """The openings are alike everywhere; what tells the turns apart comes after character 60."""
    head = "same opening words here " * 4
    d = tables(
        spark, tmp_path,
        benchmark=([(1, head + "violet harbour lantern")], "item_id long, text string"),
        conversations=([(i, 1, "user", head + tail) for i, tail in enumerate(["brick", "stone oven", "violet harbor lanterns", "quartz"])], "conv_id long, turn int, role string, text string"),
    )
    rows = QUERIES["topk_retrieval_fuzzy"](spark, d).collect()
    best = next(r for r in rows if r["rank"] == 1)
    assert best.conv_id == 2 and best.score == round(token_set_ratio(head + "violet harbour lantern", head + "violet harbor lanterns"), 6)


def clusters_one_by_one(points, eps, least):
    """Labels by the definition: linked cores are one, numbered by their smallest; others join the first beside them."""
    p = np.array(points) / np.array(eps)
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= 1
    core = near.sum(1) >= least
    label, k = np.full(len(p), -1), 0
    for i in sorted(range(len(p)), key=lambda i: points[i]):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                at = stack.pop()
                if label[at] < 0:
                    label[at] = k
                    stack += [j for j in np.flatnonzero(near[at] & core) if label[j] < 0]
            k += 1
    return [int(label[i]) if core[i] else min((int(label[j]) for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(p))]


def test_density_clusters_across_tiles_equal_the_definition(spark):
    r = random.Random(8)
    want, rows = {}, []
    for video, spread in (("a", 300), ("b", 90), (None, 60)):
        points = [(float(r.randrange(-spread, spread)), float(r.randrange(-spread, spread))) for _ in range(400)] + [(float(x), 0.0) for x in range(-100, 100, 2)]
        for i, (p, c) in enumerate(zip(points, clusters_one_by_one(points, (6.0, 4.0), 5))):
            want[video, i] = c
            rows.append((video, i, p[0] - 1, p[1] - 2, p[0] + 1, p[1] + 2))
    got = SP.density_clusters(spark.createDataFrame(rows, "video_id string, id long, x_min double, y_min double, x_max double, y_max double"), 6.0, 4.0)
    assert {(x.video_id, x.id): x.cluster for x in got.collect()} == want
    assert len(set(want.values())) > 3 and -1 in want.values()


def test_density_scan_has_every_box(spark, tmp_path):
    """Users 40 and on are clustered too, and every box has one row."""
    d = tables(spark, tmp_path, events=([(i, i % 90, "click") for i in range(900)], "event_id long, user_id long, event_type string"))
    got = QUERIES["density_scan"](spark, d).collect()
    assert Counter(r.id for r in got) == Counter(range(900))
    centre = lambda i: (i * 37 % 500 + (20 + i % 90) / 2, i * 53 % 300 + (8 + i % 17) / 2)
    assert {r.id: r.cluster for r in got} == dict(enumerate(clusters_one_by_one([centre(i) for i in range(900)], (12.0, 8.0), 5)))


def test_edit_operations_of_long_texts_equal_the_plain_table():
    def plain(a, b):
        d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
        return d[len(a)][len(b)]

    r = random.Random(2)
    for _ in range(10):
        a, b = ("".join(r.choice("ab é一") for _ in range(r.randint(50, 90))) for _ in range(2))
        ops = edit_operations(a, b)
        made = list(a)
        for kind, i, j in reversed(ops):
            made[i : i + (kind != "insert")] = [] if kind == "delete" else [b[j]]
        assert len(ops) == plain(a, b) and "".join(made) == b


def test_consensus_and_cleanup_hand_back_whole_texts(spark, tmp_path):
    head = "these words open each turn of the conversation, all of them alike, "
    turns = [(1, 1, "user", head + "alpha bravo"), (1, 2, "user", head + "alpha bravo"), (2, 1, "user", head + "xylophones quickly jump over zebras " * 3), (2, 2, "user", head + "mild 1234567890 tuna BOG FEW " * 4)]
    d = tables(spark, tmp_path, conversations=(turns, "conv_id long, turn int, role string, text string"))
    assert {r.text for r in QUERIES["rover_consensus"](spark, d).where("conv_id = 1").collect()} == {head + "alpha bravo"}
    texts = {r.text for r in QUERIES["flicker_cleanup"](spark, d).where("video_id = '2'").collect()}
    assert texts == {t[3].strip() for t in turns[2:]} or texts == {t[3] for t in turns[2:]}


def test_gated_level_does_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    """Means of 64 hundredths are often halfway between two roundings: the order of the sum tells which."""
    r = random.Random(3)
    value = {u: [round(5.01 + r.expovariate(0.02), 2) for _ in range(64)] for u in range(300)}
    for v in value.values():
        for i in range(0, 64, 2):
            v[i], v[i + 1] = v[i] + 40, round(v[i] + 30, 2)
    now = datetime.datetime(2024, 1, 1)
    rows = [(i * 300 + u, now, u, "view", x) for u, v in value.items() for i, x in enumerate(v)]
    r.shuffle(rows)
    d = tables(spark, tmp_path, events=(rows, "event_id long, ts timestamp, user_id long, event_type string, value double"))

    def mean(xs):
        total = 0.0
        for x in xs:
            total += x
        return total / len(xs)

    want = {}
    for u, v in value.items():
        gate = mean(v) - 10
        want[u] = int(mean([x for x in v if x > gate]) * 1e6 + 0.5) / 1e6
    assert {x.user_id: x.level for x in QUERIES["gated_level"](spark, d).collect()} == want


def best_by_every_pair(queries, memory, k):
    pairs = memory.join(queries, F.col("id") != F.col("q")).select("q", "id", F.round(T.cosine("x", "v"), 6).alias("score"))
    return sorted(map(str, K.top_k(pairs, ["q"], "score", ["id"], k).collect()))


def test_cosines_by_blocks_equal_every_pair(spark):
    """Copies, near copies, opposites, vectors without length, null, no number, of another length, and an id twice; in many small blocks and in one."""
    r = np.random.default_rng(2)
    base = r.normal(size=(12, 5)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 12] * (-1 if i % 7 == 3 else 1) * (1 + (i % 3)) + (1e-7 * i if i % 5 == 0 else 0)]) for i in range(300)]
    odd = [None, [0.0] * 5, [float("nan")] * 5, [1.0, 2.0], [], [1.0, None, 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0, 0.0]]
    rows += [(300 + i, v) for i, v in enumerate(odd)] + [(20, rows[20][1])] * 5 + [(None, rows[1][1])]
    for part, k in ((rows, 3), (rows[:2], 3), ([(i, [-1.0, 0.0] if i else [1.0, 0.0]) for i in range(40)], 2), ([(i, [0.5, 0.5]) for i in range(40)], 4)):
        memory = spark.createDataFrame(part, "id long, v array<float>").repartition(5).cache()
        queries = memory.where("id % 10 = 0 or id >= 300").select(F.col("id").alias("q"), F.col("v").alias("x"))
        want = best_by_every_pair(queries, memory, k)
        for size in (7, 1024):
            sizes, (K.QUERY_VECTORS, K.MEMORY_VECTORS) = (K.QUERY_VECTORS, K.MEMORY_VECTORS), (size, size)
            try:
                found = K.cosine_candidates(queries.withColumnRenamed("x", "v"), memory, "q", "id", "v", k, 6)
            finally:
                K.QUERY_VECTORS, K.MEMORY_VECTORS = sizes
            got = K.top_k(found.withColumn("score", F.round("score", 6)), ["q"], "score", ["id"], k)
            assert sorted(map(str, got.collect())) == want


def test_topk_retrieval_semantic_makes_no_row_of_each_pair(spark, tmp_path):
    """Blocks of vectors meet, and of 2,000 equal vectors each query keeps three a task."""
    d = tables(spark, tmp_path, embeddings=([(i, [1.0, float(i % 2)]) for i in range(4000)], "vec_id long, embedding array<float>"))
    found = QUERIES["topk_retrieval_semantic"](spark, d)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.vec_id, r.score, r["rank"]) for r in found.collect()}
    assert got == {(q, v, 1.0, n) for q in range(0, 4000, 50) for n, v in enumerate([x for x in (0, 2, 4, 6) if x != q][:3], 1)}
