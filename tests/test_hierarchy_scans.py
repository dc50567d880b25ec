"""Hierarchical density groups, scans, gazetteers, kernel cells and keyed streams against plain versions."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomstat.operators import density, gates, groups, normalize, opinions, rules, scans, spatial, textstats, windows


def plain_leaves(rows):
    """Leaves of the single-linkage hierarchy, merge by merge: (id -> group, size). rows: (id, vector)."""
    points: dict[tuple, list[int]] = {}
    for i, x in rows:
        points.setdefault(tuple(x), []).append(i)
    names = {min(ids): (np.array(x), ids) for x, ids in points.items()}
    edges = sorted((float(np.sqrt(((names[a][0] - names[b][0]) ** 2).sum())), a, b) for a in names for b in names if a < b)
    part = {i: i for i in names}
    held = {i: [i] for i in names}
    size = {i: len(names[i][1]) for i in names}
    split, leaves = dict.fromkeys(names, False), []
    for _, a, b in edges:
        a, b = part[a], part[b]
        if a == b:
            continue
        if size[a] > 1 and size[b] > 1:
            leaves += [list(held[s]) for s in (a, b) if not split[s]]
            split[a] = True
        split[a] = split[a] or split[b]
        for i in held.pop(b):
            part[i] = a
            held[a].append(i)
        size[a] += size[b]
    out = {i: (-1, 1) for i, _ in rows}
    for leaf in leaves:
        ids = [i for p in leaf for i in names[p][1]]
        out |= {i: (min(ids), len(ids)) for i in ids}
    return out


def vectors():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 5)) * 4
    x = [centres[k % 12] + rng.normal(size=5) * 0.5 for k in range(470)] + [rng.normal(size=5) * 20 for _ in range(20)]
    x += [x[3], x[3], x[7], x[480], x[480], x[480]] + [np.zeros(5), np.zeros(5)]
    return [(1000 - k, [float(v) for v in row]) for k, row in enumerate(x)]


def test_leaf_groups(spark, monkeypatch):
    rows = vectors()
    want = plain_leaves(rows)
    assert len({g for g, _ in want.values()}) > 20 and sum(g == -1 for g, _ in want.values()) > 20
    df = spark.createDataFrame(rows, "vec long, v array<double>").withColumn("x", F.lit("clash")).repartition(3)
    got = {r["vec"]: (r["group"], r["size"]) for r in density.leaf_groups(df, "vec", "v").collect()}
    assert got == want
    monkeypatch.setattr(density, "CELL", 16)  # many cells
    visits = []
    monkeypatch.setattr(density, "cut", lambda d, cut=density.cut: visits.append(cut(d)) or visits[-1])
    assert {r["vec"]: (r["group"], r["size"]) for r in density.leaf_groups(df, "vec", "v").collect()} == want
    met = [v for v in visits if "visits" in v.columns]
    shares = [v.agg(F.avg(F.size("visits"))).first()[0] for v in met]
    assert shares[0] < 0.2 * 30  # nearest rows: below a fifth of the 30 cells


def test_leaf_groups_without_clusters(spark, monkeypatch):
    """Vectors without any clusters reach all cells, but are sent to a few blocks only, and to less than that the second time; several blocks and parts of blocks give the same leaves."""
    from loomstat.operators import blocks

    rng = np.random.default_rng(6)
    rows = [(k, [float(a) for a in x]) for k, x in enumerate(rng.normal(size=(400, 10)))]
    monkeypatch.setattr(density, "CELL", 8)
    monkeypatch.setattr(blocks, "FEW", 100)
    monkeypatch.setattr(blocks, "TILE", 32)
    visits = []
    monkeypatch.setattr(density, "cut", lambda d, cut=density.cut: visits.append(cut(d)) or visits[-1])
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert {r["id"]: (r["group"], r["size"]) for r in density.leaf_groups(df, "id", "v").collect()} == plain_leaves(rows)
    first, again = (v.agg(F.avg(F.size("visits"))).first()[0] for v in visits if "visits" in v.columns)
    assert first <= 3 and again <= 0.7 * first
    monkeypatch.setattr(density, "BLOCK", 64)
    assert {r["id"]: (r["group"], r["size"]) for r in density.leaf_groups(df, "id", "v").collect()} == plain_leaves(rows)


def test_leaf_groups_hard_rows(spark):
    """Nulls, other lengths, non-finite content, only copies, one row, no rows; signs of zero don't matter."""
    rows = [(1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [0.0, 1.0]), (6, [-0.0, 1.0]), (7, [5.0, 5.0]), (8, [5.0, 5.5]), (9, [5.0, 7.0]), (10, [100.0, 100.0]), (11, [1.0]), (None, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: (r["group"], r["size"]) for r in density.leaf_groups(df, "id", "v").collect()}
    # 9 joins the pair 7, 8 before that meets the copies 5, 6; 10 joins all of them.
    assert got == {1: (-1, 1), 2: (-1, 1), 3: (-1, 1), 4: (-1, 1), 5: (5, 2), 6: (5, 2), 7: (7, 3), 8: (7, 3), 9: (7, 3), 10: (-1, 1), 11: (-1, 1), None: (-1, 1)}
    assert {r["group"] for r in density.leaf_groups(df.where("id in (7, 8, 9)"), "id", "v").collect()} == {-1}  # no split
    assert density.leaf_groups(df.where("1 = 0"), "id", "v").count() == 0


def test_scan_of_states_equals_a_fold(spark, monkeypatch):
    """Any history, sparse or dense, over several levels of slices."""
    rng = np.random.default_rng(4)
    rows = [(r, str(int(d)), str(rng.choice(gates.STATES))) for r, n, span in (("a", 700, 1000), ("b", 3, 90_000), ("c", 1, 5)) for d in rng.choice(span, n, replace=False)]
    got = {(r["region"], int(r["day"])): (r["before"], r["state"]) for r in gates.state_machine(spark.createDataFrame(rows, "region string, day string, wanted string")).collect()}
    assert len(got) == len(rows)
    now = dict.fromkeys("abc", "silent")
    for r, d, w in sorted(((r, int(d), w) for r, d, w in rows)):
        before, now[r] = now[r], gates.advance(now[r], w)
        assert got[r, d] == (before, now[r])
    assert gates.state_machine(spark.createDataFrame([], "region string, day string, wanted string")).count() == 0


def test_decayed_sums_equal_a_fold(spark):
    rng = np.random.default_rng(4)
    places = sorted(rng.choice(3000, 400, replace=False).tolist())
    values = rng.normal(size=400).tolist()
    df = spark.createDataFrame(list(zip(["k"] * 400, places, values, strict=True)), "k string, at long, v double")
    got = {r["at"]: (r["total"], r["weight"]) for r in scans.decayed_sums(df, ["k"], "at", F.col("v"), 0.9).collect()}
    t = w = 0.0
    for at, v in zip(places, values, strict=True):
        t, w = t * 0.9 + v, w * 0.9 + 1
        assert np.allclose(got[at], (t, w))


def test_daily_baselines_end_at_the_last_one(spark):
    """The last day's baseline is that of baseline(); every day's is that of the days up to it."""
    rng = np.random.default_rng(1)
    n = rng.poisson(5, 40).tolist()
    df = spark.createDataFrame([("r", k, int(x)) for k, x in enumerate(n)], "region string, k int, n long").withColumn("bucket", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, k)")).drop("k")
    names = ("days", "ema", "std", "weekend_factor", "weekday_factor")
    daily = {r["bucket"].timetuple().tm_yday: [r[c] for c in names] for r in windows.daily_baselines(df, ["region"]).collect()}
    for day in (1, 6, 7, 20, 40):
        last = windows.baseline(df.where(F.dayofyear("bucket") <= day), ["region"]).first()
        assert np.allclose(daily[day], [last[c] for c in names]), day


def plain_names(text, names, most):
    """Names from the left, the longest first, none over another."""
    by_words = {}
    for name, entity, kind in names:
        w = tuple(re.findall(r"[^\W_]+", (name or "").lower()))
        if 0 < len(w) <= most:
            by_words[w] = min(by_words.get(w, (entity, kind)), (entity, kind))
    tokens = re.findall(r"[^\W_]+", (text or "").lower())
    out, at = [], 0
    while at < len(tokens):
        n = next((n for n in range(most, 0, -1) if tuple(tokens[at : at + n]) in by_words and at + n <= len(tokens)), 0)
        if n:
            out.append((*by_words[tuple(tokens[at : at + n])], at, n))
        at += n or 1
    return out


def test_name_matches(spark):
    """Overlapping names of several words, aliases, names that begin alike, other scripts and cases, against a plain scan."""
    rng = random.Random(8)
    words = ["new", "york", "city", "of", "east", "Middle", "é", "São", "paulo", "7"]
    names = [(" ".join(rng.choices(words, k=rng.randint(1, 5))), f"e{k % 30}", rng.choice(["PLACE", "ORG"])) for k in range(60)]
    names += [("New-York", "NYC", "PLACE"), ("...", "none", "PLACE"), (None, "null", "PLACE"), ("", "empty", "PLACE"), (" ".join(["of"] * 6), "too long", "PLACE")]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(300)] + [None, "", "new york, NEW YORK CITY! middle_east"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("entity", F.lit("clash")).withColumn("words", F.lit(1)).repartition(3)
    gazetteer = spark.createDataFrame(names, "name string, entity string, kind string")
    got = {}
    for r in normalize.name_matches(df, gazetteer, "text", "id", 5).collect():
        got.setdefault(r["id"], []).append((r["entity"], r["kind"], r["start"], r["words"]))
    for k, t in enumerate(texts):
        assert sorted(got.get(k, []), key=lambda x: x[2]) == plain_names(t, names, 5), t
    assert normalize.name_matches(df, gazetteer.where("1 = 0"), "text", "id").count() == 0


def test_name_matches_looks_once_and_at_first_words_only(spark, monkeypatch):
    """The plan finds the words of a text once, and only places of first words become rows; a gazetteer of too many first words gives the same names."""
    df = spark.createDataFrame([(k, "old town of new york and rome " * 20) for k in range(30)], "id int, text string")
    gazetteer = spark.createDataFrame([("new york", "NYC", "PLACE"), ("rome", "Rome", "PLACE")], "name string, entity string, kind string")
    got = normalize.name_matches(df, gazetteer, "text", "id")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(text") == 1 and " IN (" in plan
    few = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(normalize, "MOST_FIRSTS", 1)
    assert len(few) == 1200 and few == sorted(map(tuple, normalize.name_matches(df, gazetteer, "text", "id").collect()))


def test_kde_cells(spark):
    """Densities equal a whole sum over all points; outlines are closed; degenerate points have no cells."""
    rng = np.random.default_rng(2)
    p = np.column_stack([rng.normal(40, 0.05, 300), rng.normal(-74, 0.1, 300), rng.random(300)])
    p[:, 1] += 0.8 * (p[:, 0] - 40)
    p[5] = p[6]
    df = spark.createDataFrame([tuple(map(float, r)) for r in p], "lat double, lon double, weight double")
    got = {(r["i"], r["j"]): (r["density"], r["ring"]) for r in spatial.kde_cells(df, 25).collect()}
    w = p[:, 2] / p[:, 2].sum()
    cov = np.cov(p[:, :2].T, aweights=w) * (1 / (w**2).sum()) ** (-1 / 3)
    up, side = 1000 / 110_574, 1000 / (111_320 * np.cos(np.radians(w @ p[:, 0])))
    south, north, west, east = p[:, 0].min() - up, p[:, 0].max() + up, p[:, 1].min() - side, p[:, 1].max() + side
    grid = np.stack(np.meshgrid(np.linspace(south, north, 25), np.linspace(west, east, 25), indexing="ij"), -1)
    d = grid[:, :, None] - p[None, None, :, :2]
    k = (w * np.exp(-0.5 * np.einsum("ijka,ab,ijkb->ijk", d, np.linalg.inv(cov), d))).sum(-1)
    k /= k.max()
    want = {(i, j): k[i, j] for i in range(24) for j in range(24) if k[i, j] >= 0.01}
    assert set(got) == set(want) and all(abs(got[c][0] - want[c]) < 1e-9 for c in want)
    assert all(len(ring) == 5 and ring[0] == ring[4] and np.allclose(np.ptp(ring, axis=0), [(east - west) / 25, (north - south) / 25]) for _, ring in got.values())
    line = df.limit(3).withColumn("lon", F.col("lat") * 2)
    for few in (df.limit(1), line, df.where("1 = 0"), df.withColumn("weight", F.lit(0.0))):
        assert spatial.kde_cells(few, 10).count() == 0


def test_principal_scores(spark):
    """Sparse votes on many statements: distances along the components are those of a full decomposition with centred columns."""
    rng = np.random.default_rng(6)
    side = rng.integers(0, 3, 60)
    a = np.zeros((60, 400))
    for k in range(60):
        some = rng.choice(400, 80, replace=False)
        a[k, some] = np.where(rng.random(80) < 0.85, np.where((some + side[k]) % 3 == 0, 1, -1), rng.integers(-1, 2, 80))
    votes = [(int(i), int(j) * 7, int(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    got = opinions.principal_scores(spark.createDataFrame(votes, "session long, statement long, v int"), 2, rounds=4).orderBy("session").toPandas()
    u, s, _ = np.linalg.svd(a - a.mean(axis=0), full_matrices=False)
    want, have = u[:, :2] * s[:2], got[["p0", "p1"]].to_numpy()
    near = lambda x: np.linalg.norm(x[:, None] - x[None], axis=2)
    assert np.abs(near(want) - near(have)).max() < 0.05 * near(want).max()


def test_group_measures(spark):
    m = spark.createDataFrame([(s, q, v) for s, q, v in [(1, 1, 1), (2, 1, 1), (3, 1, -1), (4, 1, 1), (1, 2, 1), (3, 2, 1), (9, 2, -1), (2, 3, -1)]], "session long, statement long, v int")
    g = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (9, -1)], "session long, group int")
    by = opinions.by_group(m, g)
    assert {(r["group"], r["statement"]): (r["mean"], r["ratio"], r["n"]) for r in by.collect()} == {(0, 1): (1.0, 1.0, 2), (1, 1): (0.0, 0.5, 2), (0, 2): (1.0, 1.0, 1), (1, 2): (1.0, 1.0, 1), (0, 3): (-1.0, 0.0, 1)}
    assert {r["statement"]: r["consensus"] for r in opinions.consensus(by, 2).collect()} == {1: False, 2: True, 3: False}
    assert {r["statement"]: r["spread"] for r in opinions.divisive(by).collect()} == {1: 0.5}
    assert [(r["group"], r["statement"], r["rank"]) for r in opinions.representatives(by, 1).orderBy("group").collect()] == [(0, 1, 1), (1, 2, 1)]


def test_seed_groups(spark):
    """Seeds are apart, every row is near the nearest seed, each seed is what its round allows, and the order of rows doesn't matter."""
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.random((150, 3)) * 100, rng.normal(50, 3, (150, 3)), np.full((5, 3), 7.0))).clip(0, 100)
    rows = [(k, *map(float, v)) for k, v in enumerate(x)] + [(1000, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g long, a double, b double, c double")
    got = {r["g"]: (r["seed"], r["distance"]) for r in groups.seed_groups(df.repartition(4), "g", ["a", "b", "c"], 25.0).collect()}
    assert got == {r["g"]: (r["seed"], r["distance"]) for r in groups.seed_groups(df.orderBy(F.desc("g")), "g", ["a", "b", "c"], 25.0).collect()}
    assert sorted(got) == list(range(305))
    seeds = sorted({s for s, _ in got.values()})
    d = np.linalg.norm(x[:, None] - x[seeds][None], axis=2)
    assert all(got[s] == (s, 0.0) for s in seeds) and (d[seeds] + 1000 * np.eye(len(seeds)) >= 25).all()
    for k, (s, dist) in got.items():
        assert abs(dist - d[k].min()) < 1e-9 < 25 and seeds[int(d[k].argmin())] == s
    assert groups.seed_groups(df.where("1 = 0"), "g", ["a", "b", "c"], 25.0).count() == 0


def test_record_rules(spark):
    """Each rule breaks on its own fault; nulls, equal records and an empty table."""
    good = ("2024-01-05", "01101", 10.0, 20.0, 3.0, "News", "stable", "s", "x")
    faults = [
        ({0: None}, {"temporal.dateExists", "temporal.dateValid", "integrity.hasRequiredFields", "temporal.dateNotFuture", "temporal.dateWithinRange"}), ({0: "2025-01-01"}, {"temporal.dateNotFuture", "temporal.dateWithinRange"}),
        ({0: "2019-12-31"}, {"temporal.dateWithinRange"}), ({1: ""}, {"spatial.zipExists", "spatial.zipFormat", "integrity.hasRequiredFields", "spatial.zipInRegion"}), ({1: "1101"}, {"spatial.zipFormat", "spatial.zipInRegion"}), ({1: "99999"}, {"spatial.zipInRegion"}),
        ({2: 50.0}, {"spatial.coordinatesValid"}), ({2: None}, set()), ({4: 11.0}, {"logical.intensityRange"}), ({4: 90.0}, {"logical.intensityRange", "statistical.noOutliers"}), ({4: None}, set()), ({5: "rumour"}, {"logical.sourceTypeValid"}), ({5: None}, set()), ({6: "UP"}, {"logical.trendLogical"}),
        ({7: None}, {"integrity.sourceExists"}), ({8: "twice"}, {"integrity.noDuplicates"}), ({8: "twice"}, {"integrity.noDuplicates"}),
    ]
    rows = [(k, *[change.get(c, f"{v}{k}" if c == 8 else v) for c, v in enumerate(good)]) for k, (change, _) in enumerate(faults)]
    rows += [(100 + k, *good[:8], f"y{k}") for k in range(30)]
    schema = "id long, date string, zip string, lat double, lon double, intensity double, source_type string, trend string, source string, summary string"
    df = spark.createDataFrame(rows, schema)
    places = spark.createDataFrame([("01101",), ("01101",), (None,)], "zip string")
    judged = rules.judged(df, places, (9.0, 11.0, 19.0, 21.0), "2024-01-31")
    got = {r["id"]: (set(r["errors"]) | set(r["warnings"]), r["valid"]) for r in judged.collect()}
    for k, (change, want) in enumerate(faults):
        assert got[k][0] == want, (change, got[k])
    assert all(got[k] == (set(), True) for k in range(100, 130)) and sum(not v for _, v in got.values()) == 3
    assert rules.cleaned(judged).count() == 44
    assert rules.rates(rules.judged(df.where("1 = 0"), places, (9.0, 11.0, 19.0, 21.0), "2024-01-31")).first()["total"] == 0
    same = rules.judged(df.where("id in (100, 101)").withColumn("zip", F.lit("01101")), places, (9.0, 11.0, 19.0, 21.0), "2024-01-31")
    assert all(r["warnings"] == ["statistical.distributionNormal"] for r in same.collect())


def test_events(spark):
    """Types by most triggers, dates and places of the sentence or else of the text, long sentences cut, texts without triggers left out."""
    texts = [
        (1, "A meeting in New York on 2024-03-05. The Order and the filing came! No more? Token report, in Rome."), (2, None), (3, ""), (4, "nothing here"), (5, "order " * 100), (6, "Vote. In 2021 it rained in Rome. An order was filed."),
    ]
    df = spark.createDataFrame(texts, "id int, t string").withColumn("pos", F.lit(-1)).withColumn("date", F.lit("clash"))
    triggers = spark.createDataFrame([("meeting", "meeting"), ("order", "filing"), ("filing", "filing"), ("report", "report"), ("token", "report"), ("vote", "b"), ("vote", "a")], "term string, kind string")
    places = spark.createDataFrame([("new york", "New York", "PLACE"), ("rome", "Rome", "PLACE"), ("york", "York", "ORG")], "name string, entity string, kind string")
    got = sorted(map(tuple, textstats.events(df, "id", "t", triggers, places, "[0-9]{4}-[0-9]{2}-[0-9]{2}|20[0-9]{2}").collect()))
    assert got == [
        (1, 0, "meeting", "2024-03-05", "New York", "A meeting in New York on 2024-03-05"), (1, 1, "filing", "2024-03-05", "New York", "The Order and the filing came"), (1, 3, "report", "2024-03-05", "Rome", "Token report, in Rome."),
        (5, 0, "filing", None, None, ("order " * 100)[:300]), (6, 0, "a", "2021", "Rome", "Vote"), (6, 2, "filing", "2021", "Rome", "An order was filed."),
    ]


def test_accelerating(spark):
    """The rolling rule, the rule for short series, and too few hours, against the plain formulas."""
    rng = np.random.default_rng(12)
    series = {f"k{n}{k}": [float(x) for x in rng.poisson(6, n)] for n in (1, 2, 3, 4, 9, 14, 40) for k in range(4)} | {"flat": [5.0] * 30, "jump": [5.0] * 20 + [50.0], "pair": [0.0, 0.0, 9.0]}
    rows = []
    for key, counts in series.items():
        v = [None, *np.diff(counts).tolist()]
        a = [None, None, *np.diff(np.diff(counts)).tolist()][: len(counts)]
        rows += [(key, h, c, y, x) for h, (c, y, x) in enumerate(zip(counts, v, a, strict=True))]
    got = {r["key"]: (r["hours"], r["accelerating"]) for r in windows.accelerating(spark.createDataFrame(rows, "key string, bucket int, n double, velocity double, acceleration double"), ["key"]).collect()}
    for key, counts in series.items():
        a = np.diff(np.diff(counts)) if len(counts) > 2 else np.zeros(0)
        if len(a) >= 12:
            part = [a[max(0, k - 11) : k + 1] for k in range(len(a))]
            std = [x.std(ddof=1) if len(x) > 1 and x.std(ddof=1) > 0 else 1 for x in part]
            want = any((a[k] - part[k].mean()) / std[k] > 2 for k in range(len(a)))
        else:
            want = len(a) > 0 and np.abs(a).max() > a.mean() + 2 * (max(a.std(), 0.01) if len(a) > 1 else 1)
        assert got[key] == (len(counts), bool(want and len(counts) >= 3)), key
