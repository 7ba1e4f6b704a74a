"""Operators against brute force and boundary cases on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from carda.operators import dedup, gates, graph, hamming, ledger, parse

T0 = dt.datetime(2026, 1, 1)


def events(spark, seconds, user=1):
    return spark.createDataFrame([(i, user, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)], "event_id long, user_id long, ts timestamp_ntz")


def accepted(df):
    return {r["event_id"]: r["accepted"] for r in df.collect()}


def test_throttle_counts_from_accepted(spark):
    got = accepted(gates.throttle(events(spark, [0, 100, 3600, 3700, 7199, 7301]), ["user_id"], 3600))
    assert [k for k in sorted(got) if got[k]] == [0, 2, 5]


def test_throttle_property(spark):
    r = random.Random(5)
    times = sorted(r.randrange(100_000) for _ in range(300))
    got = accepted(gates.throttle(events(spark, times), ["user_id"], 3600))
    kept = [times[i] for i in range(300) if got[i]]
    assert all(b - a >= 3600 for a, b in zip(kept, kept[1:]))
    assert len(got) == 300


def test_rate_limit_matches_a_loop(spark):
    r = random.Random(6)
    times = sorted(r.randrange(20_000) for _ in range(120))
    got = accepted(gates.rate_limit(events(spark, times), ["user_id"], 3600, 4))
    kept, want = [], []
    for t in times:
        ok = len([k for k in kept if k > t - 3600]) < 4
        want.append(ok)
        if ok:
            kept.append(t)
    assert [got[i] for i in range(120)] == want


def test_alert_merge_gap_is_strict(spark):
    rows = gates.alert_merge(events(spark, [0, 3600, 7140]), "user_id", 60).orderBy("event_id").collect()
    assert [r["sends"] for r in rows] == [True, True, False]


def test_stop_after_known(spark):
    marks = "UKKUKKKKKK"
    e = events(spark, range(10)).withColumn("known", F.element_at(F.array(*[F.lit(m == "K") for m in marks]), (F.col("event_id") + 1).cast("int")))
    assert gates.stop_after_known(e, "user_id", "known", 5, ["ts", "event_id"]).count() == 9


@pytest.mark.parametrize("radius", [0, 3, 8])
def test_hamming_probing_equals_brute_force(spark, radius):
    r = random.Random(radius)
    base = [(i, r.getrandbits(64) - (1 << 63)) for i in range(60)]
    near = [(100 + i, s ^ sum(1 << b for b in r.sample(range(63), r.randrange(0, 12)))) for i, s in base]
    rows = base + near + [(300, None), (301, base[0][1])]
    df = spark.createDataFrame(rows, "id long, simhash long")
    want = {(a, b): bin((x ^ y) & (2**64 - 1)).count("1") for a, x in rows for b, y in rows if x is not None and y is not None}
    want = {k: d for k, d in want.items() if d <= radius}
    got = {(x["id"], x["base_id"]): x["dist"] for x in hamming.neighbor_pairs(df, df, radius).collect()}
    assert got == want
    best = {x["id"]: (x["dist"], x["best_id"]) for x in hamming.nearest(df, df, radius, "self").collect()}
    brute = {}
    for (a, b), d in want.items():
        if a != b:
            brute[a] = min(brute.get(a, (99, 0)), (d, b))
    assert best == brute


def cluster(spark, n=1500):
    """Fingerprints that nearly all lie within 8 of each other, none of them equal, hardly any within 3."""
    r = random.Random(n)
    prints = sorted({0x5A5A5A5A5A5A5A5A ^ sum(1 << b for b in r.sample(range(63), 4)) for _ in range(n)})
    r.shuffle(prints)
    return list(enumerate(prints)), spark.createDataFrame(list(enumerate(prints)), "id long, simhash long")


@pytest.fixture
def no_broadcast(spark):
    """Tables past the size Spark broadcasts by itself."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def best_of(probe, base, radius, allowed):
    out = {}
    for a, x in probe:
        near = [(d, b) for b, y in base if allowed(a, b) and (d := ((x ^ y) & (2**64 - 1)).bit_count()) <= radius]
        if near:
            out[a] = min(near)
    return out


def shuffled_records(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gw = sc._gateway
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gw.new_array(gw.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("exclude, allowed", [(None, lambda a, b: True), ("self", lambda a, b: a != b), ("later", lambda a, b: b < a)])
def test_nearest_of_a_cluster_writes_no_pairs(spark, no_broadcast, exclude, allowed):
    rows, df = cluster(spark)
    probe, base = (rows, rows) if exclude else (rows[:700], rows[700:])
    before = shuffled_records(spark)
    got = hamming.nearest(df.where("id < 700") if not exclude else df, df.where("id >= 700") if not exclude else df, 8, exclude).collect()
    assert {x["id"]: (x["dist"], x["best_id"]) for x in got} == best_of(probe, base, 8, allowed)
    assert shuffled_records(spark) - before < 40 * len(rows)


@pytest.mark.parametrize("exclude, allowed", [(None, lambda a, b: True), ("self", lambda a, b: a != b), ("later", lambda a, b: b < a)])
def test_nearest_in_many_parts_equals_brute_force(spark, monkeypatch, exclude, allowed):
    monkeypatch.setattr(hamming, "SMALL_PAIRS", 0)
    r = random.Random(9)
    base = [(i, r.getrandbits(64) - (1 << 63)) for i in range(80)]
    base += [(500 + i, base[i % 80][1]) for i in range(40)]
    # probes that are no rows of the base, some under an id of it
    probe = [(i * 7, s ^ sum(1 << b for b in r.sample(range(63), r.randrange(0, 12)))) for i, s in base[:100]]
    frame = lambda rows: spark.createDataFrame(rows, "id long, simhash long")
    got = {x["id"]: (x["dist"], x["best_id"]) for x in hamming.nearest(frame(probe), frame(base), 8, exclude).collect()}
    assert got == best_of(probe, base, 8, allowed)


@pytest.mark.parametrize("d, contact, status, confidence", [(2, 1, "dup_cross", "high"), (3, 1, "dup_cross", "high"), (4, 1, "review", "low"), (8, 1, "review", "low"), (9, 1, "unique", "high"), (2, 0, "dup_cross", "low"), (3, 0, "review", "low"), (9, 0, "unique", "low")])
def test_verdict_thresholds(spark, d, contact, status, confidence):
    key = (lambda k: f"{k}|") if contact else (lambda k: None)
    df = spark.createDataFrame([(1, 1 << 40, key(1), None), (2, (1 << 40) ^ ((1 << d) - 1), key(2), None)], "id long, simhash long, contact_key string, contact_phone string")
    v = {r["id"]: r for r in dedup.judge(df, None, "online").collect()}
    assert (v[1]["status"], v[2]["status"], v[2]["confidence"]) == ("unique", status, confidence)


@pytest.mark.parametrize("mode, allowed", [("online", lambda a, b: b < a), ("rejudge", lambda a, b: a != b)])
def test_judging_a_cluster_writes_no_pairs(spark, no_broadcast, mode, allowed):
    rows, df = cluster(spark, 1400)
    jobs = df.select("*", F.lit(None).cast("string").alias("contact_key"), F.lit(None).cast("string").alias("contact_phone"))
    before = shuffled_records(spark)
    got = dedup.judge(jobs, None, mode).where("matched_id is not null").collect()
    assert {x["id"]: (x["hamming_dist"], x["matched_id"]) for x in got} == best_of(rows, rows, 8, allowed)
    assert shuffled_records(spark) - before < 60 * len(rows)


def cluster_with_posts(spark):
    """Jobs and live posts of one cluster, and for jobs far from it posts within and beyond the review distance."""
    rows, _ = cluster(spark, 1400)
    r = random.Random(2)
    far = [(2000 + i, r.getrandbits(63)) for i in range(12)]
    jobs = rows[:900] + far
    posts = rows[900:] + [(3000 + i, x ^ (1 << i) - 1) for i, (_, x) in enumerate(far)]
    frame = lambda x: spark.createDataFrame(x, "id long, simhash long")
    text = F.lit(None).cast("string")
    return jobs, posts, frame(jobs).select("*", text.alias("contact_key"), text.alias("contact_phone")), frame(posts).select("*", text.alias("phone_norm"), F.lit(1).alias("status"))


def brute_verdicts(jobs, posts):
    inside, outside = best_of(jobs, jobs, 8, lambda a, b: a != b), best_of(jobs, posts, 8, lambda a, b: True)
    out = {}
    for i, _ in jobs:
        (d, b), main = (inside[i], False) if i in inside else (outside.get(i, (None, None)), i in outside)
        out[i] = ("unique" if d is None else "review" if d > 2 else "exists_in_main" if main else "dup_cross", d, b)
    return out


def test_rejudging_a_cluster_against_posts_writes_no_pairs(spark, no_broadcast):
    rows, posts, jobs, live = cluster_with_posts(spark)
    before = shuffled_records(spark)
    got = dedup.judge(jobs, live, "rejudge").collect()
    assert {x["id"]: (x["status"], x["hamming_dist"], x["matched_id"]) for x in got} == brute_verdicts(rows, posts)
    assert {x["status"] for x in got if x["matched_against"] == "main"} == {"exists_in_main", "review"}
    assert shuffled_records(spark) - before < 60 * len(rows)


def test_applying_the_rejudgement_of_a_cluster_writes_no_pairs(spark, no_broadcast):
    rows, posts, jobs, live = cluster_with_posts(spark)
    jobs = jobs.select("*", F.lit("unique").alias("dedup_status"), F.lit("high").alias("confidence"), F.lit(1).alias("import_ready"))
    before = shuffled_records(spark)
    got = dedup.apply_rejudge(jobs, dedup.judge(jobs, live, "rejudge")).collect()
    want = {i: ("unique", "high", 1) if status == "unique" else (status, "low", 0) for i, (status, _, _) in brute_verdicts(rows, posts).items()}
    assert {x["id"]: (x["dedup_status"], x["confidence"], x["import_ready"]) for x in got} == want and len(got) == len(rows)
    assert shuffled_records(spark) - before < 70 * len(rows)


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (7000, 7000), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(400)} == {0} and {got[i] for i in range(1000, 1061)} == {1000} and got[7000] == 7000
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_upsert_and_insert_ignore(spark):
    rows = spark.createDataFrame([("u", "a", 1, T0), ("u", "b", 2, T0 + dt.timedelta(1)), ("v", "c", 3, T0)], "k string, site string, status int, at timestamp_ntz")
    got = {r["k"]: (r["site"], r["status"]) for r in ledger.upsert_latest(rows, ["k"], ["at"], ["site"]).collect()}
    assert got == {"u": ("a", 2), "v": ("c", 3)}
    new = ledger.insert_ignore(rows.where("k = 'v'"), rows, ["k"], ["at"]).collect()
    assert [(r["k"], r["status"]) for r in new] == [("u", 1)]


def test_tree_repairs_and_selects():
    root = parse.parse_html("<div class='a b'><p>x<p>y <b>z</div><ul><li><a href='/q'>T</a></li></ul>")
    assert parse.first_text(root, "div.a") == "xy z"
    assert [n.attrs["href"] for n in parse.select(root, "ul li a")] == ["/q"]
    assert parse.select(root, "") == [] and parse.first_text(root, "table td") is None


def test_purge_partitions_the_posts(spark):
    posts = spark.createDataFrame([(1, "crawler"), (2, "user"), (3, "crawler")], "id long, origin string")
    led = spark.createDataFrame([(10, 1, 0, "b"), (11, 2, 0, "b"), (12, 9, 0, "c"), (13, 3, 1, "c")], "id long, main_job_id long, purged int, import_batch string")
    out = {r["map_id"]: r["outcome"] for r in ledger.purge_report(led, posts).collect()}
    assert out == {10: "deleted", 11: "skipped", 12: "skipped"}
    assert sorted(r["id"] for r in ledger.posts_after_purge(led, posts).collect()) == [2, 3]


def test_stream_throttle_equals_batch(spark, tmp_path):
    from carda.streaming.gates import throttle_stream

    e = events(spark, [0, 100, 3600, 3700, 7199, 7301])
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = throttle_stream(s, ["user_id"], 3600).writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert accepted(spark.table("throttled")) == accepted(gates.throttle(e, ["user_id"], 3600))


def broadcast_rows(spark):
    """Rows of all broadcasts so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    executions, total = store.executionsList(), 0
    for k in range(executions.size()):
        x = executions.apply(k).executionId()
        nodes, values = store.planGraph(x).allNodes(), store.executionMetrics(x)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if node.name() == "BroadcastExchange" else ():
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def open_among_settled(spark):
    """A cluster of jobs of which one in nine has no contact: few probes against many rows, as Spark broadcasts them by itself."""
    rows, df = cluster(spark, 1400)
    key = F.when(F.col("id") % 9 > 0, "k")
    jobs = df.select("*", key.alias("contact_key"), F.lit(None).cast("string").alias("contact_phone"))
    return rows, jobs, {i: best for i, best in best_of(rows, rows, 8, lambda a, b: a != b).items() if i % 9 == 0}


def test_rejudging_few_open_jobs_broadcasts_no_variants(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BROADCAST_FINGERPRINTS", 0)
    rows, jobs, want = open_among_settled(spark)
    before = broadcast_rows(spark)
    got = dedup.judge(jobs, None, "rejudge").where("signal = 'simhash' and matched_id is not null").collect()
    assert {x["id"]: (x["hamming_dist"], x["matched_id"]) for x in got} == want
    assert broadcast_rows(spark) - before < 20 * len(rows)


def test_applying_the_rejudgement_of_few_open_jobs_broadcasts_no_variants(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BROADCAST_FINGERPRINTS", 0)
    rows, jobs, best = open_among_settled(spark)
    jobs = jobs.select("*", F.lit("unique").alias("dedup_status"), F.lit("high").alias("confidence"), F.lit(1).alias("import_ready"))
    before = broadcast_rows(spark)
    got = dedup.apply_rejudge(jobs, dedup.judge(jobs, None, "rejudge")).collect()
    low = {i: ("dup_cross" if d <= 2 else "review", "low", 0) for i, (d, _) in best.items()}
    want = {i: low.get(i, ("unique", "high", 1)) if i % 9 == 0 else ("dup_cross", "high", 0) for i, _ in rows}
    assert {x["id"]: (x["dedup_status"], x["confidence"], x["import_ready"]) for x in got} == want and len(got) == len(rows)
    assert broadcast_rows(spark) - before < 20 * len(rows)
