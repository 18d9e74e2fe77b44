"""Models, tests, quantiles, resampling and segments: against numpy, plain Python or all possibilities."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenledger.operators import draws, effects, factors, joins, models, morphology, quantiles, ranks, resampling, segments, stats, tuning


@pytest.fixture(scope="module")
def crossed(spark):
    """Two factors of which one's levels are rare in some of the other's, features that follow a factor at a large offset, clustered noise."""
    rng = np.random.default_rng(1)
    n = 700
    a, b, c = rng.integers(0, 5, n), rng.integers(0, 8, n), rng.integers(0, 40, n)
    b[a < 2] = np.minimum(b[a < 2], 4)
    x = rng.normal(size=(n, 2)) + a[:, None] * 1e4
    y = x @ [1.0, -2.0] + a * 3 + b * 2 + rng.normal(size=40)[c] + rng.normal(size=n)
    rows = [(i, f"a{p}", f"b{q}", int(r), *map(float, v), float(w)) for i, (p, q, r, v, w) in enumerate(zip(a, b, c, x, y, strict=True))]
    rows += [(n, None, "b0", 0, 1.0, 1.0, 1.0), (n + 1, "a0", "b0", 0, None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "id long, a string, b string, c int, x1 double, x2 double, y double"), a, b, c, x, y


def test_crossed_effects_equal_dummies(crossed):
    df, a, b, _, x, y = crossed
    design = np.column_stack([x - x.mean(0), np.eye(5)[a], np.eye(8)[b]])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    fit = effects.crossed_effects(df, ["x1", "x2"], "y", ["a", "b"])
    rss, left = ((y - design @ want) ** 2).sum(), len(y) - np.linalg.matrix_rank(design)
    assert np.allclose(fit["beta"], want[:2], rtol=1e-8) and math.isclose(fit["rss"], rss, rel_tol=1e-8) and fit["left"] == left and fit["settled"] and fit["lost"] == 0
    inner = x - design[:, 2:] @ np.linalg.lstsq(design[:, 2:], x, rcond=None)[0]
    errors = np.sqrt(np.diag(np.linalg.inv(inner.T @ inner)) * rss / left)
    assert np.allclose(fit["errors"], errors, rtol=1e-6)


def test_levels_that_no_row_connects(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", "z"), ("d", "z"), (None, "w"), ("e", None)], "f string, g string")
    assert factors.identifiability(df, "f", "g") == {"levels_a": 4, "levels_b": 3, "components": 2, "lost": 1, "identified": False}
    assert factors.identifiability(df.where("f = 'a'"), "f", "g")["identified"] and not factors.identifiability(df.where("false"), "f", "g")["identified"]


def test_random_intercept_needs_an_identified_model(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 12}", "left" if i % 12 < 6 else "right", float(x), float(2 * x + i % 12 + z)) for i, (x, z) in enumerate(rng.normal(size=(240, 2)))]
    df = spark.createDataFrame(rows, "s string, side string, x double, y double").withColumn("again", F.col("x") * 2)
    assert models.random_intercept(df, ["x"], "y", "s")["usable"]
    # each group is on one side: groups and sides can't be told apart; a feature that repeats another one
    apart, twice = models.random_intercept(df, ["x"], "y", "s", fixed=("side",)), models.random_intercept(df, ["x", "again"], "y", "s")
    assert not apart["identified"] and not apart["usable"] and not twice["identified"] and not twice["usable"]


def test_clustered_errors(crossed):
    df, _, _, c, x, y = crossed
    rows = effects.coefficients(df, ["x1", "x2"], "y", "c")
    design = np.column_stack([np.ones(len(y)), x])
    center = np.column_stack([np.ones(len(y)), x - x.mean(0)])
    beta = np.linalg.lstsq(center, y, rcond=None)[0]
    scores = np.zeros((40, 3))
    np.add.at(scores, c, center * (y - center @ beta)[:, None])
    # the stray row with null levels and x1 = 1 belongs to cluster 0 too
    assert [r["feature"] for r in rows] == ["intercept", "x1", "x2"]
    clean = effects.coefficients(df.where("a IS NOT NULL"), ["x1", "x2"], "y", "c")
    bread = np.linalg.inv(center.T @ center)
    want = np.sqrt(np.diag(bread @ scores.T @ scores @ bread) * 40 / 39)
    assert np.allclose([r["std_error"] for r in clean[1:]], want[1:], rtol=1e-6) and np.allclose([r["coefficient"] for r in clean[1:]], beta[1:], rtol=1e-5)
    move = np.array([1, *-x.mean(0)])
    assert math.isclose(clean[0]["std_error"], math.sqrt(move @ (bread @ scores.T @ scores @ bread) @ move * 40 / 39), rel_tol=1e-4) and design.shape == center.shape


def test_interactions(crossed):
    df, a, b, c, _, y = crossed
    rows = {(r.a, r.b): r for r in effects.interaction_tests(df.where("id < 700"), "y", "a", "b", "c").collect()}
    mean = {(i, j): y[(a == i) & (b == j)].mean() for i in range(5) for j in range(8) if ((a == i) & (b == j)).any()}
    size = {k: ((a == k[0]) & (b == k[1])).sum() for k in mean}
    want = {}
    for i, j in mean:
        if i and j and all(k in mean for k in ((i, 0), (0, j), (0, 0))):
            pull = np.zeros(40)
            for k, w in (((i, j), 1), ((i, 0), -1), ((0, j), -1), ((0, 0), 1)):
                own = (a == k[0]) & (b == k[1])
                np.add.at(pull, c[own], w * (y[own] - mean[k]) / size[k])
            want[f"a{i}", f"b{j}"] = (mean[i, j] - mean[i, 0] - mean[0, j] + mean[0, 0], math.sqrt((pull**2).sum() * 40 / 39))
    assert set(rows) == set(want) and len(want) < 4 * 7
    for k, (contrast, error) in want.items():
        z = contrast / error
        assert math.isclose(rows[k].contrast, contrast, rel_tol=1e-8) and math.isclose(rows[k].std_error, error, rel_tol=1e-8)
        assert math.isclose(rows[k].p_value, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-8)


def test_tails(spark):
    z = [0.0, 0.3, 1.0, 2.0, 2.82, 2.83, 4.0, 6.0, 10.0, -1.5]
    for a, b in spark.createDataFrame([(x,) for x in z], "z double").select("z", stats.two_sided(F.col("z"))).collect():
        assert math.isclose(b, math.erfc(abs(a) / math.sqrt(2)), rel_tol=1e-12, abs_tol=1e-16)
    draws = np.random.default_rng(3).chisquare(4, 400_000)
    for x in (0.5, 2.0, 8.0):
        assert abs(effects.chi_square_tail(x, 4) - (draws > x).mean()) < 4e-3 and math.isclose(effects.chi_square_tail(x, 1), math.erfc(math.sqrt(x / 2)), rel_tol=1e-10)
    value, d = effects.wald(np.array([1.0, 3.0, 2.0]), np.diag([1.0, 4.0, 1.0]), np.array([[0.0, 1.0, 0.0], [0.0, 2.0, 0.0]]))
    assert math.isclose(value, 9 / 4) and d == 1


def test_ridge_is_tuned_inside_the_training_part(crossed):
    df, _, _, _, x, y = crossed
    df = df.where("id < 700").withColumns({"x1": F.col("x1") / 1e4, "x2": F.col("x2") / 1e4})
    got = tuning.tuned_ridge(df, ["x1", "x2"], "y", "id", 7, 8, folds=4)
    split = df.select("id", (tuning.unit_hash(F.col("id"), 7) < 0.2).alias("held"), tuning.fold_of(F.col("id"), 8, 4).alias("fold")).orderBy("id").collect()
    held, fold, x = np.array([r.held for r in split]), np.array([r.fold for r in split]), x / 1e4

    def line(rows, penalty):
        own, target = x[rows] - x[rows].mean(0), y[rows] - y[rows].mean()
        gram = own.T @ own
        slopes = np.linalg.solve(gram + penalty * np.diag(np.diag(gram)), own.T @ target)
        return y[rows].mean() - slopes @ x[rows].mean(0), slopes

    for r in got:
        lost = 0.0
        for f in range(4):
            start, slopes = line(~held & (fold != f), r["penalty"])
            own = ~held & (fold == f)
            lost += ((y[own] - start - x[own] @ slopes) ** 2).sum()
        assert math.isclose(r["error"], lost / (~held).sum(), rel_tol=1e-6) and np.allclose(r["slopes"][1:], line(~held, r["penalty"])[1], rtol=1e-6)
    assert [r["chosen"] for r in got] == [r["error"] == min(x["error"] for x in got) for r in got]
    # other values in the held-out part change nothing
    wild = df.withColumn("y", F.when(tuning.unit_hash(F.col("id"), 7) < 0.2, 1e9).otherwise(F.col("y")))
    assert [r["error"] for r in tuning.tuned_ridge(wild, ["x1", "x2"], "y", "id", 7, 8, folds=4)] == [r["error"] for r in got]


def test_gram_parts_add_up(spark):
    x = np.random.default_rng(4).normal(size=(300, 3)) + 1e6
    df = spark.createDataFrame([(int(i % 3), *map(float, r)) for i, r in enumerate(x)], "g int, a double, b double, c double")
    parts = models.grams(df, ["a", "b", "c"], "g")
    whole = parts[0] + parts[1] + parts[2]
    away = x - x.mean(0)
    assert np.allclose(whole.mean, x.mean(0)) and np.allclose(whole.products, away.T @ away, rtol=1e-8, atol=1e-6) and whole.n == 300
    beta, rss = whole.line()
    assert math.isclose(whole.errors(beta), rss, rel_tol=1e-6)


def test_discoveries_in_families_of_any_size(spark):
    """One family holds most rows and spans all ranges, others a row or a few; ties and nulls among the p-values."""
    rng = random.Random(5)
    rows = [("big" if rng.random() < 0.7 else f"f{rng.randrange(30)}", i, rng.choice([0.0, 0.01, 0.5, rng.random() ** 3, None])) for i in range(900)] + [(None, 900 + i, 0.02 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "family string, k long, p double").repartition(6)
    got = {r.k: (r["rank"], r.q, r.rejected) for r in stats.benjamini_hochberg(df, "p", "k", family="family").collect()}
    want = {}
    for name in {f for f, _, _ in rows}:
        own = sorted((p, k) for f, k, p in rows if f == name and p is not None)
        low = 1.0
        for i in range(len(own), 0, -1):
            low = min(low, own[i - 1][0] * len(own) / i)
            want[own[i - 1][1]] = (i, low, low <= 0.05)
    assert set(got) == set(want) and all(got[k][0] == v[0] and math.isclose(got[k][1], v[1], rel_tol=1e-12, abs_tol=1e-15) and got[k][2] == v[2] for k, v in want.items())
    assert stats.benjamini_hochberg(df.where("family = 'big'"), "p", "k").columns == ["family", "k", "p", "rank", "q", "rejected"]
    assert ranks.falling(df.where("false"), ["family"], ["p", "k"], F.col("p"), "r", "s", "least").count() == 0


def test_dealt_join(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(900)], "k string, i long")
    facts = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("fact", F.length("k"))
    out = joins.dealt_join(rows, facts, ["k"], "n", ["i"])
    assert out.count() == 900 and out.where("fact <> length(k)").count() == 0 and out.select("i").distinct().count() == 900


@pytest.mark.parametrize("buckets,by_rank", [(1024, 4), (3, 2), (2, 100)])
def test_quantiles_equal_sorting(spark, monkeypatch, buckets, by_rank):
    """Ties, infinities, extreme sizes, null groups and values; few buckets make many rounds."""
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    monkeypatch.setattr(quantiles, "BY_RANK", by_rank)
    rng = np.random.default_rng(6)
    values = {"ties": rng.integers(0, 5, 300).astype(float), "wide": np.exp(rng.normal(size=200) * 40) * rng.choice([-1, 1], 200), "one": np.array([3.5]), None: rng.normal(size=50), "ends": np.array([-1.7e308, 1.7e308, 0.0, 1.0])}
    if buckets == 2:
        values.pop("wide")
    rows = [(k, float(v)) for k, own in values.items() for v in own] + [("ties", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = [0.0, 0.1, 0.5, 0.93, 1.0]
    got = {(r.g, r.point): r.quantile for r in quantiles.quantiles(df, F.col("v"), points, ["g"]).collect()}
    assert set(got) == {(k, p) for k in values for p in points}
    for k, own in values.items():
        own = np.sort(own)
        for p in points:
            place = (len(own) - 1) * p
            low, high = int(math.floor(place)), int(math.ceil(place))
            want = own[low] if low == high else (high - place) * own[low] + (place - low) * own[high]
            assert math.isclose(got[k, p], want, rel_tol=1e-12), (k, p)
    assert quantiles.medians(df.where("false"), F.col("v"), ["g"]).count() == 0


@pytest.mark.parametrize("parts", [4, 128])
def test_poisson_medians(spark, monkeypatch, parts):
    monkeypatch.setattr(resampling, "PARTS", parts)
    rng = np.random.default_rng(7)
    v = np.round(rng.normal(size=300), 1 if parts == 4 else 6)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(300, None)], "k long, v double")
    got = {r.resample: r.median for r in resampling.poisson_medians(df, "v", "k", 60, 11).collect()}
    drawn = resampling.weighted(df.where("v IS NOT NULL").select("v", resampling.key_number(F.col("k")).alias("k")), 60, 11).collect()
    copies = {b: [] for b in range(60)}
    for r in drawn:
        copies[r.resample] += [r.v] * r.w
    assert got == pytest.approx({b: float(np.median(x)) for b, x in copies.items()})
    counts = np.array([r.w for r in drawn])
    # Poisson(1): a share 1 - 1/e of rows is drawn, once on average
    assert abs(len(counts) / (300 * 60) - (1 - math.exp(-1))) < 0.02 and abs(counts.sum() / (300 * 60) - 1) < 0.04
    assert resampling.poisson_medians(df.where("false"), "v", "k", 5, 1).count() == 0


def test_cheapest_paths_equal_all_cuts():
    rng = random.Random(8)
    for _ in range(200):
        costs = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))): float(rng.randrange(1, 6)) for _ in range(rng.randrange(1, 9))}
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))
        every = []
        for cuts in itertools.product((0, 1), repeat=max(0, len(word) - 1)):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
            own = [word[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if word else []
            if all(p in costs or len(p) == 1 for p in own):
                every.append((sum(costs.get(p, 7.5) for p in own), len(own)))
        path = segments.best_path(word, segments.trie(costs), 7.5)
        assert "".join(path) == word and (sum(costs.get(p, 7.5) for p in path), len(path)) == min(every)


def test_segments_of_made_words(spark):
    """Words of stems and endings come apart at the seams, and the texts' measures equal those of plain counting."""
    rng = random.Random(9)
    stems = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "ing", "ed", "est"]) for _ in range(60)) for _ in range(40)] + ["", None, "1 2 3"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    model = segments.learn(segments.word_counts(df, "k", "t"))
    cut = {r.word: r.pieces for r in segments.segmented(segments.word_counts(df, "k", "t"), model).collect()}
    assert all("".join(p) == w for w, p in cut.items())
    ends = [w for w in cut if w.endswith("ing") and w[:-3] in stems]
    assert np.mean([cut[w][-1] == "ing" for w in ends]) > 0.9
    got = {r.k: (r.words, r.pieces, r.prefixes, r.suffixes) for r in segments.measures(df, "k", "t", model).collect()}
    for k, t in enumerate(texts[:40]):
        own = [cut[w] for w in t.split()]
        first = [max(range(len(p)), key=lambda i, p=p: (len(p[i]), -i)) for p in own]
        assert got[k] == (len(own), sum(map(len, own)), sum(first), sum(len(p) - 1 - s for p, s in zip(own, first, strict=True)))
    assert set(got) == set(range(40))
    parts = morphology.analysed(df.where("k = 0"), "t", segments.analyzer(model)).first()
    assert all(texts[0][x.start : x.start + x.length] == x.form and x.tag in (segments.PREFIX, segments.STEM, segments.SUFFIX) for x in parts.morpheme_sequence)


@pytest.mark.parametrize("q", [0.5, 0.9])
def test_quantile_lines_are_optimal(spark, q):
    """The best line of the linear program goes through two points: no line through any two has a lower check loss."""
    rng = np.random.default_rng(10)
    x = rng.random(90) * 7 + 1000
    y = 3 * x + (x - 999) * rng.standard_t(3, 90)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double")
    fit = models.quantile_regression(df, ["x"], "y", q)
    loss = lambda a, b: float(np.where((r := y - a - b * x) >= 0, q * r, (q - 1) * r).sum())
    best = min(loss(y[i] - (y[j] - y[i]) / (x[j] - x[i]) * x[i], (y[j] - y[i]) / (x[j] - x[i])) for i, j in itertools.combinations(range(90), 2))
    own = loss(*fit["beta"])
    assert fit["converged"] and fit["n"] == 90 and math.isclose(own, fit["loss"], rel_tol=1e-6) and own <= best * (1 + 1e-5) and abs(fit["gap"]) < 1e-4
    assert best >= own - fit["gap"] * 90 - 1e-6


# draws


def test_md5_of_numbers():
    for low, high in ((0, 1), (0, 120), (95, 1005), (10**9 - 3, 10**9 + 3)):
        words, size = draws.digits(low, high)
        for prefix in ("1:2:", "12:3:", "123:4:", "4263151703:4999:", "18446744073709551615:49999:"):
            want = [int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:8], 16) for k in range(low, high)]
            assert draws.md5_heads(prefix.encode(), words, size).tolist() == want


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 7, "SLICE": 20, "CHUNK": 90}, {"SPREAD": 0.01}])
def test_drawn_medians_equal_plain_draws(spark, monkeypatch, sizes):
    """With ties and null values; over several slices of rows; with an interval that has to be widened."""
    for name, size in sizes.items():
        monkeypatch.setattr(draws, name, size)
    rng = np.random.default_rng(3)
    values = [None if i % 11 == 0 else float(v) for i, v in enumerate(np.round(rng.normal(size=401), 1))]
    df = spark.createDataFrame([(f"{i:04d}", v) for i, v in enumerate(values)], "k string, v double").repartition(5)
    got = {r.resample: r.median for r in stats.bootstrap_medians(df, "v", "k", 30, 17).collect()}
    drawn = [[values[int(hashlib.md5(f"17:{b}:{k}".encode()).hexdigest()[:8], 16) % 401] for k in range(401)] for b in range(30)]
    assert got == {b: float(np.median([v for v in xs if v is not None])) for b, xs in enumerate(drawn)}
    assert stats.bootstrap_medians(df.where("v IS NULL"), "v", "k", 30, 17).count() == 0


def test_draws_stay_off_the_driver(spark):
    """15 million draws of 3,000 rows, where no table of more than 256 MB may be broadcast."""
    df = spark.range(3000).select(F.col("id").alias("k"), F.sqrt(F.col("id")).alias("v"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "256m")
    try:
        r = stats.bootstrap_interval(df, "v", "k", 5000, 5).first()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert 36 < r.low < math.sqrt(1500) < r.high < 41
