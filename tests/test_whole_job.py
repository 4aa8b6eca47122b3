"""Queries over all rows, against plain Python on fixtures with planted rows."""

from __future__ import annotations

import time
from collections import Counter

from spanloom.plans.registry import QUERIES
from spanloom.streaming import journal


def test_jn15_links_orders_of_every_key(spark, tmp_path):
    """Chains of suppliers whose links lie in orders that no small part of the keys holds."""
    orders = {k: [10 * (k // 7) + k % 7, 10 * (k // 7) + k % 7 + 1] for k in range(1, 60)} | {97: [900], 98: [901, 905], 194: [905, 907]}
    lines = [(k, s) for k, members in orders.items() for s in members]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    parent = {s: s for _, s in lines}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for members in orders.values():
        for s in members[1:]:
            a, b = sorted((root(members[0]), root(s)))
            parent[b] = a
    found = QUERIES["jn15_components"](spark, str(tmp_path)).collect()
    assert sorted((r.node, r.root) for r in found) == sorted((s, root(s)) for s in parent)


def test_ag42_scores_every_neighbouring_pair(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber").collect()
    keys = Counter(map(tuple, lines))  # numbers repeat within an order
    wanted = Counter({(k, n): c * keys[k, n + 1] for (k, n), c in keys.items() if (k, n + 1) in keys})
    found = QUERIES["ag42_bidirectional_scores"](spark, sf).collect()
    assert Counter((r.l_orderkey, r.l_linenumber) for r in found) == wanted


def test_tl03_covers_every_known_frame(spark, sf):
    known = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 7 <> 0 and value is not null").count()
    found = QUERIES["tl03_coalesce"](spark, sf).collect()
    assert sum(r.end - r.start for r in found) == sum(r.parts for r in found) == known


def test_prj11_covers_every_frame(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    found = QUERIES["prj11_binary_projection"](spark, sf).where("track = 'c'").collect()
    assert sum(r.end - r.start for r in found) == events


def test_st05_goes_beyond_the_twentieth_part(spark, sf):
    found = QUERIES["st05_chained_parts"](spark, sf).collect()
    assert max(r.released for r in found) > 20
    assert any(r.stopped_at is not None and r.repairs > 2 for r in found)


def test_chained_parts_of_long_episodes(spark, tmp_path):
    """Parts that come last first, some twice, over two batches; one part of episode 2 never comes."""
    n = 40_000
    parts = [(1, k, True) for k in range(n - 1, -1, -1)] + [(2, k, True) for k in range(100) if k != 60]
    schema = "episode long, part long, valid boolean"
    for batch, rows in enumerate((parts[: n // 2], parts[n // 2 :] + [(1, k, True) for k in range(50)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/batch={batch}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = journal.chained_parts(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    began = time.time()
    out.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    took = time.time() - began
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert Counter((r.episode, r.part) for r in found if r.state == "released") == Counter([(1, k) for k in range(n)] + [(2, k) for k in range(60)])
    assert took < 25  # work in proportion to the parts


def test_fn_token_f1_of_every_pair_of_turns(spark, tmp_path):
    texts = {1: ["a b b", "b b c", "", "", "A x"], 2: ["only one"], 3: ["p q", "r s", "s r r"]}
    rows = [(c, t, text) for c, turns in texts.items() for t, text in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    wanted = {}
    for c, turns in texts.items():
        for t, (x, y) in enumerate(zip(turns, turns[1:], strict=False)):
            x, y = Counter(x.lower().split()), Counter(y.lower().split())
            n = x.total() + y.total()
            wanted[c, t] = round(2 * (x & y).total() / n, 6) if n else None
    found = QUERIES["fn_token_f1"](spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.turn): r.f1 for r in found} == wanted


def test_running_sums_over_ranges(spark):
    """Ties, nulls and keys that are null, against a loop; one key holds most rows."""
    from spanloom.operators.stats import running

    values = [(("h" if i % 3 else None) if i % 5 else "g", None if i % 17 == 0 else float(i % 29), i % 4) for i in range(700)]
    rows = spark.createDataFrame(values, "g string, v double, n long").groupBy("g", "v").sum("n").withColumnRenamed("sum(n)", "n")
    found = {(r.g, r.v): (r.before_n, r.total_n) for r in running(rows, "v", ["n"], ["g"], parts=7).collect()}
    place = lambda v: float("-inf") if v is None else v
    wanted = {
        (g, v): (sum(n for h, w, n in values if h == g and place(w) < place(v)), sum(n for h, _, n in values if h == g))
        for g, v, _ in values
    }
    assert found == wanted
    assert running(rows.where("false"), "v", ["n"]).collect() == []


def test_hash_ranks_of_a_hot_group(spark):
    import hashlib

    from spanloom.operators.sampling import hash_ranked

    rows = [(i, None if i % 7 == 0 else "hot") for i in range(500)] + [(3, "hot")]
    found = hash_ranked(spark.createDataFrame(rows, "id long, g string"), "s", "id", ["g"]).collect()
    for g in (None, "hot"):
        order = sorted((hashlib.sha256(f"s:{i}".encode()).hexdigest(), i) for i, h in rows if h == g)
        assert [r.id for r in sorted((r for r in found if r.g == g), key=lambda r: r._place)] == [i for _, i in order]
        assert {r._size for r in found if r.g == g} == {len(order)}
