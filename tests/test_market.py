import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions.vocabulary import INTENTS, PATTERNS, TYPES
from marlstone.operators import clusters, daily, evaluation, features, participants, pipeline, selftrain, submission
from marlstone.sources import ticks


def test_generated_ticks_do_not_depend_on_partitions(spark):
    a = ticks.generated_ticks(spark, ["x", "y"], ["2026-05-07"], (300, 650))
    day = lambda: sorted(map(str, daily.daily_features(a).select("symbol", "n_snapshots", F.round("net_active", 9), F.round("impact_per_amount", 4)).collect()))
    first = day()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert day() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_daily_features_against_pandas(spark):
    raw = ticks.generated_ticks(spark, ["s"], ["2026-05-07"])
    got = daily.daily_features(raw).first()
    g = raw.toPandas().sort_values("date").reset_index(drop=True)
    damt = g["amount"].diff().clip(lower=0).fillna(0)
    minute = ((g["date"] / 1000 + 28800) % 86400) / 60
    total = damt.sum() + 1e-9
    edge = damt[(minute >= 570) & (minute < 600)].sum() / total + damt[(minute >= 890) & (minute <= 900)].sum() / total
    ret = g["price"].pct_change().fillna(0)
    gap = g["date"].diff().dropna()
    cv = gap.std() / (gap.mean() + 1e-9)
    share = damt.groupby(minute // 30).sum() / (damt.sum() + 1e-9)
    lean = (g["totalbidvolume"] - g["totalaskvolume"]) / (g["totalbidvolume"] + g["totalaskvolume"] + 1e-9)
    assert got.n_snapshots == len(g)
    assert got.edge_concentration == pytest.approx(edge) and got.px_std_pct == pytest.approx(ret.std() * 100)
    assert got.regularity == pytest.approx(1 / (1 + cv)) and got.pi_herfindahl_30min == pytest.approx((share**2).sum())
    assert got.imbalance_vol == pytest.approx(lean.std())
    trading = [m for m in [*range(570, 690), *range(780, 900)]]
    for b in range(8):
        inside = np.floor(minute).isin(trading[30 * b : 30 * b + 30])
        assert got.net_active_seq[b] == pytest.approx(lean[inside].mean() if inside.any() else 0.0, abs=6e-5)


def test_average_linkage_against_plain_code():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(14, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    groups = [[i] for i in range(14)]
    while len(groups) > 4:
        _, a, b = min((d[np.ix_(p, q)].mean(), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        groups[a] += groups.pop(b)
    labels = clusters.cut(14, clusters.average_linkage(d), 4)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(labels == k).tolist()) for k in range(4)}


def test_silhouette_against_plain_code():
    rng = np.random.default_rng(5)
    x, labels = rng.normal(size=(12, 2)), np.array([0] * 5 + [1] * 6 + [2])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    each = []
    for i in range(12):
        own = [j for j in range(12) if labels[j] == labels[i] and j != i]
        if not own:
            each.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, labels == k].mean() for k in set(labels) - {labels[i]})
        each.append((b - a) / max(a, b))
    assert clusters.silhouette(d, labels) == pytest.approx(np.mean(each))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_small_batches(n):
    d = np.abs(np.arange(n)[:, None] - np.arange(n)[None]).astype(float)
    labels = clusters.best_cut(d)
    assert len(labels) == n and len(set(labels)) == (1 if n < 3 else 3)


def test_run_on_synthetic_days(spark):
    days = ticks.synthetic_days(spark, 60)
    result = pipeline.run(days, self_train=True)
    predicted, patterns = result.predictions.cache(), result.patterns.cache()
    assert predicted.count() == patterns.count() == 60
    assert {r[0] for r in predicted.select("capital_type").collect()} <= set(TYPES)
    assert {r[0] for r in predicted.select("capital_intention").collect()} <= set(INTENTS)
    assert {r[0] for r in patterns.select("pattern_type").collect()} <= set(PATTERNS)
    true = predicted.join(days.select("symbol", F.col("_true_type").alias("truth")), "symbol")
    assert evaluation.weighted_f1(true, "truth", "capital_type").first()[0] > 0.8
    names = {"symbol": "stock_code", "date": "transaction_date"}
    assert submission.issues(patterns.withColumnsRenamed(names), predicted.withColumnsRenamed(names)).count() == 0


def test_self_training_gates(spark):
    rows, reason = selftrain.self_trained(ticks.synthetic_days(spark, 10).transform(features.derive).withColumn("b", F.lit(0)), "b")
    assert reason == "fewer than 30 rows" and rows.count() == 10


def test_self_training_trains(spark):
    days = features.derive(ticks.synthetic_days(spark, 80)).withColumn("b", F.lit(0)).drop("small_order_pct", "low_big_order", "oss_small_amount_pct")
    rows, reason = selftrain.self_trained(days, "b")
    got = rows.select("capital_type", "_true_type", "trained").collect()
    assert len(got) == 80 and (reason or any(r.trained for r in got))
    if not reason:
        assert sum(r.capital_type == r._true_type for r in got) > 70


def test_missing_figures_fall_through(spark):
    df = spark.createDataFrame([(float("nan"), None)], "net_active double, iceberg double")
    assert participants.market_phase(df).first().market_phase == "整理"
    assert df.select(participants.pattern_of(df).alias("p")).first().p == "散户博弈"
    assert participants.classify_intent(df).first().capital_intention == "中性"


def test_reconcile_does_not_fan_out(spark):
    p = spark.createDataFrame([("a", "1", "买入", 0.4), ("b", "1", "买入", 0.9), ("c", "1", "买入", None)], "symbol string, date string, capital_intention string, intention_confidence double")
    t = spark.createDataFrame([("a", "1", "盘中诱多"), ("a", "1", "盘中诱多"), ("b", "1", "盘中诱多")], "symbol string, date string, pattern_type string")
    got = {r.symbol: (r.capital_intention, r.intent_consistent, r.intent_overridden) for r in participants.reconcile(p, t).collect()}
    assert got == {"a": ("卖出", True, True), "b": ("买入", False, False), "c": ("买入", True, False)}


def test_submission_checks(spark):
    a = spark.createDataFrame([("1", "d", "大单吸筹"), ("2", "d", "?")], "stock_code string, transaction_date string, pattern_type string")
    b = spark.createDataFrame([("1", "d", "散户", "买入"), ("3", "d", "散户", None)], "stock_code string, transaction_date string, capital_type string, capital_intention string")
    assert {r.issue for r in submission.issues(a, b).collect()} == {"key without prediction", "key without pattern", "unknown pattern", "unknown intent"}
    result, wrong = submission.overlay(spark.createDataFrame([("q", "A")], "qid string, answer string"), spark.createDataFrame([("q", "A"), ("z", "B")], "qid string, answer string"), "qid", "answer")
    assert result.first().answer == "A" and {r.issue for r in wrong.collect()} == {"unknown key", "no change"}


def test_calinski_harabasz_and_scaling(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 3)) + np.repeat(np.eye(3) * 4, 10, axis=0)
    df = spark.createDataFrame([(0, v.tolist(), i // 10) for i, v in enumerate(x)], "b int, v array<double>, l int")
    means = np.array([x[10 * k : 10 * k + 10].mean(0) for k in range(3)])
    between = (10 * ((means - x.mean(0)) ** 2).sum()) / 2
    within = sum(((x[10 * k : 10 * k + 10] - means[k]) ** 2).sum() for k in range(3)) / 27
    assert evaluation.calinski_harabasz(df, "b", "v", "l").first().calinski_harabasz == pytest.approx(between / within, abs=0.006)
    days = spark.createDataFrame(pd.DataFrame({"b": 0, "regularity": x[:, 0], "spoof": 0.0}))
    got = np.array([r.scaled for r in features.robust_scaled(days, "b").orderBy("regularity").collect()])
    q = np.quantile(x[:, 0], [0.25, 0.5, 0.75])
    assert np.allclose(got[:, 0], (np.sort(x[:, 0]) - q[1]) / (q[2] - q[0])) and not got[:, 1].any()


def test_quantiles_and_ranges_by_batch_against_numpy(spark):
    rng = np.random.default_rng(9)
    rows = [(b, float(rng.integers(0, 5)), float(rng.normal())) for b in ("x", "y", None) for _ in range(int(rng.integers(3, 20)))]
    df = spark.createDataFrame(rows, "b string, spoof double, regularity double")
    got = {(r.scope, r.feature): r.q for r in features.quantiles(df, "b", ["spoof", "regularity"], (0.1, 0.5, 0.75)).collect()}
    assert len(got) == 6
    for (b, f), q in got.items():
        assert np.allclose(q, np.quantile([r[1 + f] for r in rows if r[0] == b], [0.1, 0.5, 0.75]))
    met, within = features.with_ranges(df, "b", ["spoof"])
    for r in met.select("b", "spoof", within["spoof"].alias("w")).collect():
        some = [x[1] for x in rows if x[0] == r.b]
        want = 0.5 if max(some) == min(some) else (r.spoof - min(some)) / (max(some) - min(some))
        assert r.w == pytest.approx(want)
    assert met.count() == len(rows) == features.robust_scaled(df, "b").count()


def test_calinski_harabasz_keeps_its_digits_far_from_zero(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 2)) + np.repeat(np.eye(3)[:, :2] * 4, 10, axis=0)
    value = lambda shift: evaluation.calinski_harabasz(spark.createDataFrame([(0, (v + shift).tolist(), i // 10) for i, v in enumerate(x)], "b int, v array<double>, l int"), "b", "v", "l").first().calinski_harabasz
    assert value(0.0) == pytest.approx(value(1e8), rel=1e-3)


def test_answer_scores_have_defaults(spark):
    truth = spark.createDataFrame([("a", "AC"), ("b", "B"), ("c", "D")], "qid string, answer string")
    said = spark.createDataFrame([("a", "CA"), ("b", "BA"), ("z", "A")], "qid string, answer string")
    asked = spark.createDataFrame([("b", "research", "mcq")], "qid string, domain string, answer_format string")
    got = {r.qid: (r.domain, r.answer_format, r.predicted, r.correct) for r in evaluation.answer_scores(truth, said, asked).collect()}
    assert got == {"a": ("?", "multi", "CA", True), "b": ("research", "mcq", "BA", True), "c": ("?", "multi", "", False)}
    assert submission.first_questions(asked, 0).count() == 1


def _plain_clusters(d, least=3, most=8):
    """Average linkage and the best cut, by plain loops over groups."""
    n = len(d)
    groups, cuts = [[i] for i in range(n)], {}
    while len(groups) > 1:
        cuts[len(groups)] = [list(g) for g in groups]
        _, a, b = min((np.mean([d[i][j] for i in p for j in q]), i0, j0) for i0, p in enumerate(groups) for j0, q in enumerate(groups) if i0 < j0)
        groups[a] = groups[a] + groups.pop(b)

    def score(some):
        total = 0.0
        for g in some:
            for i in g:
                if len(g) > 1:
                    a = sum(d[i][j] for j in g if j != i) / (len(g) - 1)
                    b = min(np.mean([d[i][j] for j in h]) for h in some if h is not g)
                    total += (b - a) / max(a, b) if max(a, b) else 0.0
        return total / n

    best = max(range(least, min(most, n - 1) + 1), key=lambda k: (round(score(cuts[k]), 12), -k))
    return {frozenset(g) for g in cuts[best]}


def test_clusters_of_batches_against_plain_code(spark):
    rng = np.random.default_rng(12)
    rows = []
    for b in ("x", "y"):
        for i in range(9):
            parts = rng.dirichlet(np.ones(3)).tolist()
            rows.append((b, f"k{i}", *parts, ";".join(f"{v:.4f}" for v in rng.normal(size=8))))
    df = spark.createDataFrame(rows, "date string, symbol string, oss_mega_amount_pct double, oss_large_amount_pct double, oss_small_amount_pct double, net_active_seq string")
    labels = clusters.cluster_labels(df, "date", "symbol").collect()
    pairs = clusters.pair_distances(df, "date", "symbol").collect()
    for b in ("x", "y"):
        names = sorted(r.symbol for r in labels if r.date == b)
        at = {k: i for i, k in enumerate(names)}
        d = np.zeros((9, 9))
        for r in (p for p in pairs if p.batch == b):
            d[at[r.i], at[r.j]] = d[at[r.j], at[r.i]] = r.distance
        got = {frozenset(at[r.symbol] for r in labels if r.date == b and r.cluster == c) for c in {r.cluster for r in labels}} - {frozenset()}
        assert got == _plain_clusters(d.tolist())


def test_pattern_clusters_query_against_plain_code(spark, sf):
    from marlstone.plans import registry

    got = registry.queries()["pattern_clusters"](spark, sf).toPandas()
    pairs = registry.queries()["pair_distances"](spark, sf).toPandas()
    assert len(got) == 150 and set(got["pattern_type"]) <= set(PATTERNS)
    for day, rows in got.groupby("date"):
        names = sorted(rows["symbol"])
        d = np.zeros((len(names), len(names)))
        for p in pairs[pairs["batch"] == day].itertuples():
            i, j = names.index(p.i), names.index(p.j)
            d[i, j] = d[j, i] = p.distance
        assert {frozenset(names.index(x) for x in g["symbol"]) for _, g in rows.groupby("cluster")} == _plain_clusters(d.tolist()), day
        assert all(g["pattern_type"].nunique() == 1 for _, g in rows.groupby("cluster"))


def test_cluster_quality_query_against_plain_code(spark, sf):
    from marlstone.plans import market

    rows = features.robust_scaled(market._clustered(spark, sf), "date").select("date", "scaled", "cluster").toPandas()
    got = market.cluster_quality(spark, sf).toPandas().set_index("date")
    for day, some in rows.groupby("date"):
        x, labels = np.stack(some["scaled"]), some["cluster"].to_numpy()
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        each = []
        for i in range(len(x)):
            own = [j for j in range(len(x)) if labels[j] == labels[i] and j != i]
            a = d[i, own].mean() if own else 0.0
            b = min(d[i, labels == k].mean() for k in set(labels) - {labels[i]})
            each.append((b - a) / max(a, b) if own else 0.0)
        assert got.loc[day, "silhouette"] == pytest.approx(np.mean(each), abs=6e-5)


def test_market_run_query_joins_its_parts(spark, sf):
    from marlstone.plans import registry

    run = registry.queries()["market_run"](spark, sf).toPandas().set_index(["symbol", "date"])
    types = registry.queries()["participant_types"](spark, sf).toPandas().set_index(["symbol", "date"])
    phases = registry.queries()["market_phases"](spark, sf).toPandas().set_index(["symbol", "date"])
    named = registry.queries()["pattern_clusters"](spark, sf).toPandas().set_index(["symbol", "date"])
    intents = registry.queries()["intents"](spark, sf).toPandas().set_index(["symbol", "date"])
    assert len(run) == 150
    for key, r in run.iterrows():
        assert (r["capital_type"], r["market_phase"], r["pattern_type"]) == (types.loc[key, "capital_type"], phases.loc[key, "market_phase"], named.loc[key, "pattern_type"])
        prior = PATTERNS.get(r["pattern_type"], (None, None))[1]
        said, sure = intents.loc[key, "capital_intention"], intents.loc[key, "intention_confidence"]
        over = prior is not None and prior != said and sure < 0.55
        assert r["intent_overridden"] == over and r["capital_intention"] == (prior if over else said)


def test_self_training_against_plain_newton_steps(spark):
    """The trained model is the minimum of the weighted multinomial loss with the stated ridge."""
    days = features.derive(ticks.synthetic_days(spark, 80)).withColumn("b", F.lit(0)).drop("small_order_pct", "low_big_order", "oss_small_amount_pct")
    rows, reason = selftrain.self_trained(days, "b")
    assert not reason
    ruled = selftrain.classify_type(days, "b")
    names = [c for c in selftrain.MODEL_FEATURES if c in days.columns]
    scaled = features.robust_scaled(ruled, "b", names).orderBy("symbol").toPandas()
    x = np.hstack([np.stack(scaled["scaled"]), np.ones((len(scaled), 1))])
    sure = scaled["type_confidence"] >= np.quantile(scaled["type_confidence"], 0.5)
    kinds = [t for t in TYPES if t in set(scaled["capital_type"][sure])]
    y = np.array([kinds.index(t) for t in scaled["capital_type"][sure]])
    n = len(y)
    weight = np.array([n / (len(kinds) * (y == k).sum()) for k in y])
    xs, k, m = x[sure.to_numpy()], len(kinds), x.shape[1]
    w, ridge = np.zeros((k, m)), np.ones(m) / n
    ridge[-1] = 0
    for _ in range(60):
        z = xs @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - np.eye(k)[y]) * weight[:, None]).T @ xs / weight.sum() + w * ridge
        h = np.zeros((k * m, k * m))
        for a in range(k):
            for b in range(k):
                h[a * m : a * m + m, b * m : b * m + m] = (xs * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ xs / weight.sum() + (np.diag(ridge) if a == b else 0)
        step = np.linalg.lstsq(h, g.ravel(), rcond=None)[0].reshape(k, m)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    z = x @ w.T
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    got = rows.orderBy("symbol").toPandas()
    assert np.allclose(got["type_confidence"], p.max(1), atol=2e-3) and list(got["capital_type"]) == [kinds[i] for i in p.argmax(1)]


def test_self_trained_types_agree_with_their_sql_where_the_gates_pass(spark, tmp_path):
    import duckdb

    from marlstone.plans import registry

    copies = "select * replace (event_id + i * 100000 as event_id, ts + to_days((30 * i)::int) as ts) from '/root/testdata/sf0.01/events.parquet', range(6) t(i)"
    duckdb.sql(f"copy ({copies}) to '{tmp_path}/events.parquet' (format parquet)")
    got = registry.queries()["self_trained_types"](spark, str(tmp_path)).toPandas()
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = duck.sql(registry.oracle_sql()["self_trained_types"]).df()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want[list(got.columns)].values.tolist()))
    assert set(got["reason"]) == {""}
    trained = registry.queries()["model_types"](spark, str(tmp_path)).toPandas()
    assert len(trained) == len(got) and trained["trained"].any()


def test_silhouette_of_a_batch_of_several_blocks(spark):
    rng = np.random.default_rng(11)
    x, labels = rng.normal(size=(4500, 4)), rng.integers(0, 5, 4500)
    x += labels[:, None]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    rows = [("all", v, f"l{k}") for v, k in zip(x.tolist(), labels.tolist())] + [("few", [0.0], "a"), ("few", [0.0], "a"), ("few", [3.0], "b"), ("one", [1.0], "a"), ("one", [2.0], "a")]
    got = evaluation.mean_silhouette(spark.createDataFrame(rows, "batch string, v array<double>, l string"), "batch", "v", "l").collect()
    got = {r.batch: r.silhouette for r in got}
    assert got["all"] == pytest.approx(clusters.silhouette(d, labels), abs=6e-5)
    assert got["few"] == pytest.approx(2 / 3, abs=6e-5) and got["one"] is None
