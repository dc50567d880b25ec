"""Golden cases and small fixtures."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import aggregate, dedup, gates, groups, normalize, predicates, scores, spatial, textstats, windows
from loomstat.operators.graph import connected_components, expand
from loomstat.operators.limits import Limits
from loomstat.plans.q_aggregate import state
from loomstat.sources import sinks


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_attention_states(spark):
    # The public thresholds of the states.
    cases = [(0.0, 1.0, "QUIET"), (0.24, 1.0, "QUIET"), (0.25, 1.0, "MODERATE"), (0.49, 1.0, "MODERATE"), (0.5, 1.0, "ELEVATED_ATTENTION"), (0.74, 1.0, "ELEVATED_ATTENTION"), (0.75, 1.0, "HIGH_ATTENTION"), (1.0, 1.0, "HIGH_ATTENTION"), (0.8, 0.5, "MODERATE"), (0.75, 0.6, "MODERATE")]
    df = spark.createDataFrame(cases, "s double, c double, expected string")
    assert df.where(state(F.col("s"), F.col("c")) != F.col("expected")).count() == 0


def test_limits_cannot_be_weakened():
    for bad in ({"min_size": 2}, {"min_sources": 1}, {"delay_hours": 23}):
        with pytest.raises(ValueError):
            Limits(**bad)


def test_release_gate(spark):
    old, new = "2025-03-01 08:30:00", "2025-03-09 21:00:00"
    data = [("ok", 7, 4, old, 2.25), ("small", 2, 4, old, 2.25), ("one source", 7, 1, old, 2.25), ("new", 7, 4, new, 2.25), ("weak", 7, 4, old, 0.75), ("null", 7, 4, None, 2.25)]
    df = spark.createDataFrame(data, "topic string, size int, n_sources int, t string, volume double").withColumn("last_ts", F.to_timestamp("t"))
    now = F.to_timestamp(F.lit("2025-03-10 09:00:00"))
    assert [r["topic"] for r in gates.release(df, Limits(), now).collect()] == ["ok"]
    failed = {r["topic"]: r["f"] for r in df.select("topic", gates.failed(Limits(), now).alias("f")).collect()}
    assert failed == {"ok": [], "small": ["size"], "one source": ["sources"], "new": ["delay"], "weak": ["volume"], "null": ["delay"]}
    a = gates.audit(df, Limits(), now).first()
    assert (a["n_in"], a["n_out"], a["pass_size"]) == (6, 1, 5)


def test_identity_columns_are_refused(spark, tmp_path):
    df = spark.sql("select 1 as id, named_struct('author', 'x') as meta, array(named_struct('email', 'y')) as more")
    assert gates.identity_fields(df.schema) == ["meta.author", "more.email"]
    with pytest.raises(ValueError):
        sinks.json_rows(df, f"file://{tmp_path}/x")
    fields = "user_id device_id ip_address phone_number name email social_media_handle biometric_data precise_coordinates street_address license_plate mac_address imei advertising_id ssn account_id".split()
    for f in fields:
        assert gates.identity_fields(spark.range(1).withColumnRenamed("id", f.upper()).schema) == [f.upper()]


def test_state_machine(spark):
    df = spark.createDataFrame([("a", "1", "elevated"), ("a", "2", "quiet"), ("a", "3", "active"), ("a", "4", "elevated"), ("a", "5", "silent"), ("a", "6", "active")], "region string, day string, wanted string")
    got = rows(gates.state_machine(df), "day")
    assert [r[4] for r in got] == ["silent", "quiet", "active", "elevated", "elevated", "active"]
    assert [r[1:4] for r in rows(gates.transitions(gates.state_machine(df)), "day")] == [("2", "silent", "quiet"), ("3", "quiet", "active"), ("4", "active", "elevated"), ("6", "elevated", "active")]
    for s, allowed in gates.ALLOWED.items():
        for t in gates.STATES:
            assert gates.advance(s, t) == (t if t in allowed or t == s else s)


def test_connected_components(spark):
    v = spark.range(1, 31)
    chain = [(k, k + 1) for k in range(1, 20)]
    triangles = [(21, 22), (22, 23), (21, 23), (25, 26), (26, 27), (25, 27)]
    got = dict(rows(connected_components(v, spark.createDataFrame(chain + triangles, "a long, b long"))))
    assert all(got[k] == 1 for k in range(1, 21))
    assert [got[k] for k in (21, 22, 23, 24, 25, 26, 27, 30)] == [21, 21, 21, 24, 25, 25, 25, 30]


def test_expand(spark):
    e = spark.createDataFrame([("a", "b", 5), ("b", "c", 5), ("c", "d", 5), ("a", "x", 1)], "a string, b string, weight int")
    assert rows(expand(spark.createDataFrame([("a",)], "node string"), e, 2, 3), "node") == [("a", 0), ("b", 1), ("c", 2)]


def test_dbscan_across_cells(spark):
    p = spark.createDataFrame([(1, 40.0, -74.0), (2, 40.001, -74.0), (3, 40.002, -74.0), (4, 41.0, -74.0)], "id int, lat double, lon double")
    assert rows(spatial.dbscan(p, 0.2, 2), "id") == [(1, 1), (2, 1), (3, 1), (4, -1)]


@pytest.mark.parametrize("min_points", [1, 3, 6])
def test_dbscan_against_brute_force(spark, monkeypatch, min_points):
    """Dense places, chains and single points; no plan of a crowd makes its near pairs."""
    monkeypatch.setattr(spatial, "PROBES", 2)
    rng = random.Random(min_points)
    pts = [(40 + rng.gauss(0, 0.004), -74 + rng.gauss(0, 0.004)) for _ in range(150)] + [(40 + rng.uniform(-0.1, 0.1), -74 + rng.uniform(-0.1, 0.1)) for _ in range(150)] + [(40.2 + k * 0.008, -74.0) for k in range(20)] + [(40.5, -74.0)] * 4
    pts = [(k * 7 % len(pts), *p) for k, p in enumerate(pts)]
    a = np.array(pts)
    lat, lon = np.radians(a[:, 1]), np.radians(a[:, 2])
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    near = 2 * 6371.0 * np.arcsin(np.sqrt(h)) <= 1.0
    core, label = near.sum(1) >= min_points, a[:, 0].copy()
    for _ in pts:
        label = np.where(core, np.where(near & core[None], label[None], 1e9).min(1), 1e9)
    label = np.where(core, label, np.where(near & core[None], label[None], 1e9).min(1))
    got = rows(spatial.dbscan(spark.createDataFrame(pts, "id int, lat double, lon double"), 1.0, min_points), "id")
    assert got == sorted((int(i), int(g) if g < 1e9 else -1) for i, g in zip(a[:, 0], label, strict=True))


def test_getis_ord_constant_is_empty(spark):
    p = spark.createDataFrame([(k, 40.0 + k / 1000, -74.0, 1.0) for k in range(5)], "id int, lat double, lon double, w double")
    assert spatial.getis_ord(p, 0.2).count() == 0


def test_ema_against_recursion(spark):
    y = [float((k * 7) % 11) for k in range(40)]
    df = spark.createDataFrame([("r", f"2024-01-01 00:00:{k:02d}", v) for k, v in enumerate(y)], "k string, t string, n double").withColumn("bucket", F.to_timestamp("t"))
    num = den = 0.0
    for v in y:
        num, den = num * (1 - windows.ALPHA) + v, den * (1 - windows.ALPHA) + 1
    assert windows.ema(df, ["k"]).first()["ema"] == pytest.approx(num / den)


def test_burst(spark):
    t = [f"2024-01-{1 + h // 24:02d} {h % 24:02d}:10:00" for h in range(48)] + ["2024-01-02 20:30:00"] * 19
    df = spark.createDataFrame([("r", x) for x in t], "region string, t string").withColumn("ts", F.to_timestamp("t"))
    got = windows.bursts(windows.series(df, "hour", ["region"]), ["region"]).where("burst")
    assert [(r["bucket"].hour, r["n"]) for r in got.collect()] == [(20, 20)]


def test_entropy_and_gini(spark):
    df = spark.createDataFrame([("a", s) for s in "wxyz"] + [("b", "w")] * 4, "g string, s string")
    got = {r["g"]: (round(r["h"], 6), round(r["normalized"], 6), round(r["simpson"], 6)) for r in scores.entropy(df, ["g"], "s").collect()}
    assert got == {"a": (2.0, 1.0, 1.0), "b": (0.0, 0.0, 0.0)}
    dim = spark.createDataFrame([(x,) for x in "wxyz"], "s string")
    g = {r["g"]: round(r["gini"], 6) for r in scores.gini(dim, df, "s", ["g"]).collect()}
    assert g == {"a": 0.0, "b": 0.75}


def test_coherence_identity(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 2.0]), ("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "g string, v array<double>")
    got = {r["g"]: round(r["coherence"], 6) for r in scores.coherence(df, ["g"], "v").collect()}
    assert got == {"a": round(1 / 3, 6), "b": 1.0}


def test_density_groups(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.1, 0.0]), (3, [0.2, 0.0]), (4, [5.0, 5.0]), (5, None)], "id long, v array<double>")
    assert [(r[0], r[1]) for r in rows(groups.density_groups(df, "id", "v", 0.15, 2), "id")] == [(1, 1), (2, 1), (3, 1), (4, -1), (5, -1)]


def test_predicates(spark):
    df = spark.createDataFrame([(1, "Alpha", None), (2, "beta", 5)], "id int, s string, n int")
    ids = lambda spec: [r["id"] for r in df.where(predicates.tree(spec)).orderBy("id").collect()]
    assert ids({"field": "s", "operator": "starts_with", "value": "al"}) == [1]
    assert ids({"field": "n", "operator": "not_equals", "value": 5}) == [1]
    assert ids({"logic": "OR", "rules": [{"field": "n", "operator": "exists"}, {"field": "s", "operator": "contains", "value": "PHA"}]}) == [1, 2]
    assert ids({"rules": []}) == [1, 2]
    with pytest.raises(ValueError):
        predicates.tree({"field": "s", "operator": "like"})


def test_scrub(spark):
    text = "mail a.b@c.org or +1 (555) 555-1234, ip 10.0.0.1, ssn 123-45-6789, card 4111111111111111, none"
    got = spark.createDataFrame([(text,)], "t string").select(normalize.scrub(F.col("t"))).first()[0]
    assert got == "mail [EMAIL] or [PHONE], ip [IP], ssn [SSN], card [CARD], none"


def test_dates(spark):
    df = spark.createDataFrame([("Mon, 05 Feb 2024 10:00:00",), ("2024-02-05",), ("02/05/2024",), ("February 5, 2024",), ("20240205",), ("soon",)], "t string")
    assert [r[0] for r in df.select(F.date_format(normalize.parse_date(F.col("t")), "yyyy-MM-dd")).collect()] == ["2024-02-05"] * 5 + [None]


def test_cooccurrence(spark):
    df = spark.createDataFrame([(1, "aaa bbb ccc aaa"), (2, None), (3, "solo"), (4, "")], "id int, t string")
    assert rows(textstats.cooccurrence(df, "t", 3, []), "a", "b") == [("aaa", "bbb", 2), ("aaa", "ccc", 2), ("bbb", "ccc", 1)]
    assert rows(textstats.cooccurrence(df, "t", 3, ["bbb"]), "a", "b") == [("aaa", "ccc", 2)]


def test_cooccurrence_by_counting(spark, monkeypatch):
    """Pairs of many texts against a plain count, shuffled once; a task that hands on its counts early loses none."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["cat", "dog", "the", "Token", "fish", "bird", "x", "zoo"], k=n)) for n in (0, 1, 5, 300, 40)] + [None, "the the cat"]
    want = {}
    for t in texts:
        words = [w for w in re.findall("[a-z]{3,}", (t or "").lower()) if w != "the"]
        for i, x in enumerate(words):
            for y in words[i + 1 : i + 5]:
                if x != y:
                    want[min(x, y), max(x, y)] = want.get((min(x, y), max(x, y)), 0) + 1
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = textstats.cooccurrence(df, "t", 5, ["the"])
    assert rows(got, "a", "b") == [(a, b, n) for (a, b), n in sorted(want.items())]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    import pyarrow as pa

    monkeypatch.setattr(textstats, "TOKENS", 7)
    monkeypatch.setattr(textstats, "MOST_PAIRS", 3)
    lists = [None if t is None else re.findall("[a-z]{3,}", t.lower()) for t in texts]
    held = {}
    for b in textstats.pair_counts(iter([pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["t"])]), 5, ["the"]):
        for a, z, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held[a, z] = held.get((a, z), 0) + n
    assert held == want


def test_expand_reads_its_edges_once(spark):
    """Each hop reads what was computed, not the edges' plan again."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    e = spark.createDataFrame([("a", "b", 5), ("b", "c", 5), ("c", "d", 5)], "a string, b string, weight int").mapInArrow(count, "a string, b string, weight int")
    assert rows(expand(spark.createDataFrame([("a",)], "node string"), e, 2, 3), "node") == [("a", 0), ("b", 1), ("c", 2)]
    assert seen.value == 3


def test_keywords_by_counting(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["cat", "dog", "the", "token", "fish", "bird", "x"], k=n)) for n in (0, 1, 5, 300)] + [None, "the the"]
    got = {}
    for r in textstats.keywords(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", ["the"], ["token"], 3).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["term"], r["c"], r["score"]))
    for k, t in enumerate(texts):
        words = [w for w in re.findall("[a-z]{3,}", (t or "").lower()) if w != "the"]
        best = sorted(set(words), key=lambda w: (-words.count(w) * (3 if w == "token" else 1), words.index(w)))[:3]
        assert sorted(got.get(k, [])) == [(n + 1, w, words.count(w), words.count(w) * (3 if w == "token" else 1)) for n, w in enumerate(best)]


def test_entities(spark):
    from loomstat.plans.q_text import DATE, ORG

    df = spark.createDataFrame([(1, "The Apache License of 2024-02-03, Rome and ROME, 5 May 2020; Acme Widgets Inc"), (2, None)], "id int, t string")
    places = spark.createDataFrame([("rome", "Rome", "PLACE")], "name string, entity string, kind string")
    got = rows(textstats.entities(df, "id", "t", {"ORG": ORG, "DATE": DATE}, places), "kind", "entity")
    assert got == [(1, "DATE", "2024-02-03", 1), (1, "DATE", "5 May 2020", 1), (1, "ORG", "Acme Widgets Inc", 1), (1, "ORG", "The Apache License", 1), (1, "PLACE", "Rome", 2)]


@pytest.mark.parametrize(("lat", "lon"), [(0.0, 0.0), (41.0, -74.0), (60.0, 10.0), (70.0, 179.999), (-70.0, -180.0), (89.999, 0.0)])
def test_near_pairs_everywhere(spark, lat, lon):
    """All pairs within reach at any latitude, across the date line and at a pole, against brute force."""
    rng = random.Random(3)
    pts = [(k, max(-90.0, min(90.0, lat + rng.uniform(-0.02, 0.02))), (lon + rng.uniform(-0.06, 0.06) / max(0.02, math.cos(math.radians(lat))) + 540) % 360 - 180) for k in range(60)]

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    want = sorted((a[0], b[0]) for a in pts for b in pts if a[0] != b[0] and km(a, b) <= 1.0)
    got = rows(spatial.near_pairs(spark.createDataFrame(pts, "id int, lat double, lon double"), 1.0), "a", "b")
    assert got == want


def test_near_points_of_a_crowd_are_spread(spark, monkeypatch):
    """One cube of many points is worked on by many tasks, and none of its pairs is lost."""
    monkeypatch.setattr(spatial, "PIECE", 10)
    monkeypatch.setattr(spatial, "PAIRS", 5000)
    rng = random.Random(5)
    pts = [(k, 40 + rng.uniform(0, 0.001), -74 + rng.uniform(0, 0.001)) for k in range(300)]
    got = spatial.near_points(spark.createDataFrame(pts, "id int, lat double, lon double"), 5.0)
    per = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 300 * 299 and max(per) < 300 * 299 / 4


def test_slices_give_whole_windows(spark):
    """Windows in slices of time against windows over whole keys: counts to both sides, and gaps."""
    from loomstat.operators import slices

    rng = random.Random(5)
    at = [(k, rng.choice("ab"), rng.choice([rng.randrange(0, 40 * 3600), 6 * 3600, 6 * 3600 + 1])) for k in range(300)]
    df = spark.createDataFrame(at, "id int, region string, s long").withColumn("ts", F.timestamp_seconds("s"))
    for before, after in ((3600, 0), (0, 7199), (600, 600)):
        got = {r["id"]: r["k"] for r in slices.counts_within(df, ["region"], before * 10**6, after * 10**6).collect()}
        assert got == {k: sum(1 for _, q, t in at if q == r and s - before <= t <= s + after) for k, r, s in at}
    times = {r: sorted(s for _, q, s in at if q == r) for r in "ab"}
    want = sorted((r, (b - a) * 10**6) for r, ts in times.items() for a, b in zip(ts[:-1], ts[1:], strict=True))
    assert rows(slices.gaps(df, ["region"]), "region", "gap") == want


def test_percentiles_are_exact(spark):
    rng = random.Random(6)
    data = [("a", rng.choice([rng.gauss(0, 9), 1.0, 1e9])) for _ in range(700)] + [("b", 5.0)] * 9 + [("c", None), ("d", 2.5)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: (r["p10"], r["p50"], r["p99"]) for r in aggregate.percentiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, ranges=8).collect()}
    for k in "abd":
        v = [x for q, x in data if q == k]
        assert got[k] == pytest.approx(tuple(np.percentile(v, [10, 50, 99])))
    assert "c" not in got


def test_inputs_hash_ignores_order(spark):
    a = spark.createDataFrame([("g", 1, "x"), ("g", 2, "y"), ("g", 2, "y")], "k string, i int, s string")
    b = spark.createDataFrame([("g", 2, "y"), ("g", 1, "x"), ("g", 2, "y")], "k string, i int, s string").repartition(3)
    c = spark.createDataFrame([("g", 2, "y"), ("g", 1, "x"), ("g", 1, "x")], "k string, i int, s string")
    h = [aggregate.inputs_hash(df, ["k"], ["i", "s"]).first()["hash"] for df in (a, b, c)]
    assert h[0] == h[1] != h[2]


def test_topics_and_merging(spark):
    one, two = "budget vote council meeting chamber", "river flood water bridge rain"
    df = spark.createDataFrame([(k, " ".join(random.Random(k).choices((one if k % 2 else two).split(), k=30))) for k in range(40)] + [(90, ""), (91, "!!")], "id int, t string")
    got = {r["id"]: (r["topic"], r["words"]) for r in groups.topics(df, "id", "t", 2, 500, ["the"]).collect()}
    assert len({got[k][0] for k in range(1, 40, 2)}) == 1 and len({got[k][0] for k in range(0, 40, 2)}) == 1 and got[1][0] != got[0][0]
    assert got[90] == (-1, None) and len(got[0][1].split(",")) == 10 and any(" " in w for _, ws in got.values() if ws for w in ws.split(","))
    counts = spark.createDataFrame([("a", "x", 9), ("a", "y", 1), ("b", "x", 8), ("c", "z", 5), ("d", "x", 7), ("d", "z", 7)], "topic string, term string, n long")
    assert rows(groups.merged_topics(counts, 0.72), "id") == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]


def test_embed_query_by_counting(spark, sf):
    """Term frequencies by bucket times log((texts + 1) / (texts with the bucket + 1)), for every document."""
    from pyspark.ml.feature import HashingTF

    from loomstat.plans import registry

    docs = {r["doc_id"]: re.findall("[a-z]{3,}", (r["text"] or "").lower()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tf = HashingTF(numFeatures=256)
    place = {t: tf.indexOf(t) for t in {t for ts in docs.values() for t in ts}}
    counts = {k: np.bincount([place[t] for t in ts], minlength=256) if ts else np.zeros(256) for k, ts in docs.items()}
    idf = np.log((len(docs) + 1) / (sum((c > 0).astype(int) for c in counts.values()) + 1))
    got = {r["doc_id"]: r["embedding"] for r in registry.queries()["embed"](spark, sf).collect()}
    assert set(got) == set(docs)
    for k, c in counts.items():
        assert np.allclose(got[k], c * idf, atol=2e-6), k


def test_kmeans_query_is_settled(spark, sf):
    """Nearly every vector is in the group whose mean is nearest."""
    from loomstat.plans import registry

    x = {r["vec_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null").collect()}
    group = {r["signal_id"]: r["group"] for r in registry.queries()["kmeans_cluster"](spark, sf).collect()}
    assert set(group) == set(x) and 2 <= len(set(group.values())) <= 10
    names = sorted(set(group.values()))
    means = np.array([np.mean([x[k] for k in x if group[k] == g], axis=0) for g in names])
    near = {k: names[int(np.linalg.norm(means - v, axis=1).argmin())] for k, v in x.items()}
    assert sum(near[k] == group[k] for k in x) >= 0.95 * len(x)


def test_user_embedding_model(spark):
    def load():
        return lambda texts: [[len(t), t.count("a")] for t in texts]

    df = spark.createDataFrame([(1, "banana"), (2, None), (3, "")], "id int, t string")
    assert rows(groups.embed_with(df, "id", "t", load), "id") == [(1, [6.0, 3.0]), (2, None), (3, [0.0, 0.0])]


def test_opinion_groups_of_many_statements(spark):
    """Two camps over thirty statements are found whatever the statements' numbers; a camp below five sessions is hidden."""
    from loomstat.operators import opinions

    rng = random.Random(2)
    votes = []
    for s in range(34):
        camp = 0 if s < 18 else 1 if s < 31 else 2
        votes += [(s, 100 + 7 * q, (1 if (q + camp) % 2 else -1) if camp < 2 else (1 if q < 15 else -1)) for q in range(30) if rng.random() < 0.95]
    grouped = opinions.opinion_groups(spark.createDataFrame(votes, "session long, statement long, v int"))
    got = sorted(r["n"] for r in grouped.where("group >= 0").groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect())
    assert got == [13, 18]


@pytest.mark.parametrize("block", [1024, 16])
def test_density_groups_against_brute_force(spark, monkeypatch, block):
    """No link within eps is missed, whatever the cells and blocks."""
    monkeypatch.setattr(groups, "BLOCK", block)
    if block < 1024:
        edges = groups.near_edges
        monkeypatch.setattr(groups, "near_edges", lambda v, eps: edges(v, eps, per_cell=20))
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(40, 8)) * 0.05 + c for c in rng.normal(size=(5, 8)) * 3] + [rng.normal(size=(20, 8)) * 9])
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["group"] for r in groups.density_groups(df, "id", "v", 0.6, 3).collect()}
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.6
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    size = np.bincount(label, minlength=len(x))
    want = {k: int(label[k]) if size[label[k]] >= 3 else -1 for k in range(len(x))}
    assert got == want


def test_near_edges_sends_rows_to_blocks(spark, monkeypatch):
    """Vectors without any clusters reach all cells, but are sent to a few blocks only; the links are all found."""
    from loomstat.operators import blocks

    monkeypatch.setattr(blocks, "FEW", 200)
    monkeypatch.setattr(blocks, "TILE", 32)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6))
    written = []
    monkeypatch.setattr(groups, "cut", lambda d, cut=groups.cut: written.append(cut(d)) or written[-1])
    v = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)], "id long, x array<double>")
    found = groups.near_edges(v, 0.8, per_cell=10).collect()
    sent = [d.agg(F.sum(F.size(c))).first()[0] for d in written for c, t in d.dtypes if t == "array<int>"]
    assert sent and sent[0] <= 3 * len(x)
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.8
    assert found and all(a != b for a, b in found)
    label = lambda i, j: groups.forest(np.array(i, dtype=int), np.array(j, dtype=int), len(x)).tolist()
    assert label([a for a, _ in found], [b for _, b in found]) == label(*np.nonzero(near))


def test_keep_last(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "signal_id int, text string")
    new = spark.createDataFrame([(3, "x")], "signal_id int, text string")
    assert rows(dedup.keep_last(old, new, ["text"]).select("signal_id", "text"), "text") == [(3, "x"), (2, "y")]


def test_upsert_keeps_codes_as_text(spark, tmp_path):
    p = f"file://{tmp_path}/t"
    sinks.upsert(spark.createDataFrame([("01582", 1, 10), ("01101", 2, 20)], "region string, id int, n int"), p, ["id"], ["region"])
    sinks.upsert(spark.createDataFrame([("01582", 1, 11)], "region string, id int, n int"), p, ["id"], ["region"])
    got = spark.read.schema("id int, n int, region string").parquet(p)
    assert rows(got.select("region", "id", "n"), "id") == [("01582", 1, 11), ("01101", 2, 20)]
