import numpy as np
import pandas as pd
import pytest

from spotweave.operators import training
from spotweave.operators.heads import backward, forward, initial_params, row_seeds
from spotweave.streaming.stateless import apply_to_stream

SHAPE = dict(hidden=(7, 5), type_hidden=6)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n, spots = 60, 6
    owner = np.where(rng.random(n) < 0.5, 0, rng.integers(0, spots, n))  # one spot owns half of the grids
    owner[:spots] = np.arange(spots)
    x = rng.normal(size=(n, 4)).astype(np.float32)
    frame = pd.DataFrame({"target_ord": owner, "spot_id": owner.astype(str), "feature": list(x)})
    bags = spark.createDataFrame(frame, "target_ord long, spot_id string, feature array<float>").repartition(3)
    expr, prop = rng.random((spots, 3)) * 20, rng.dirichlet(np.ones(2), spots)
    targets = spark.createDataFrame([(i, expr[i].tolist(), prop[i].tolist()) for i in range(spots)], "target_ord long, expression array<double>, proportions array<double>")
    return owner, x, expr, prop, bags, targets


def _loss(p, owner, x, expr, prop, lam, alpha):
    e, q, _ = forward(p, x.astype(float))
    n = len(expr)
    s = np.stack([e[owner == i].sum(0) for i in range(n)])
    m = np.stack([q[owner == i].mean(0) for i in range(n)])
    gap = np.abs(np.log1p(s) - np.log1p(expr))
    huber = np.where(gap <= 1, 0.5 * gap**2, gap - 0.5).sum()
    kl = (prop * (np.log(prop) - np.log(m))).sum() / n
    return huber + lam * (alpha * -np.log(q.max(1)).mean() + (1 - alpha) * kl)


def test_loss_and_gradient_match_finite_differences(data):
    owner, x, expr, prop, bags, targets = data
    options = training.FitOptions(lambda_type=0.7, alpha=0.05)
    p = initial_params(4, 3, 2, 5, seed=1, **SHAPE)
    row, g = training.loss_and_gradient(bags, targets, p, options)
    assert row["loss"] == pytest.approx(_loss(p, owner, x, expr, prop, 0.7, 0.05), rel=1e-5)
    assert set(g) == set(p)
    rng = np.random.default_rng(2)
    for name in p:
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        moved = []
        for step in (1e-4, -1e-4):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            moved.append(_loss(q, owner, x, expr, prop, 0.7, 0.05))
        assert g[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-4, rel=2e-2, abs=2e-3), name


def test_predictions_match_numpy(data):
    owner, x, *_, bags, _targets = data
    p = initial_params(4, 3, 2, 5, seed=1, **SHAPE)
    e, q, _ = forward(p, x.astype(float))
    got = {r.target_ord: r for r in training.predict_bags(bags, p, 2, 3).collect()}
    for spot in set(owner):
        assert np.allclose(got[spot].expr, e[owner == spot].sum(0), rtol=1e-4)
        assert np.allclose(got[spot].prob, q[owner == spot].mean(0), rtol=1e-4)


def test_fit_lowers_the_loss_and_keeps_the_best(spark, data, tmp_path):
    *_, bags, targets = data
    options = training.FitOptions(projection_dim=5, max_epochs=4, lr=0.02, hidden=(7, 5), type_hidden=6, steps_per_epoch=1, dropout=0.0)
    result = training.fit(bags, targets, 4, 3, 2, options)
    losses = [h["train_loss"] for h in result.history]
    assert losses[-1] < losses[0] and result.best_epoch == int(np.argmin(losses))
    training.save_params(spark, result.params, str(tmp_path / "m"))
    back = training.load_params(spark, str(tmp_path / "m"))
    assert all(np.array_equal(back[k], v) for k, v in result.params.items())
    stopped = training.fit(bags, targets, 4, 3, 2, training.FitOptions(projection_dim=5, max_epochs=9, lr=0.0, patience=2, hidden=(7, 5), type_hidden=6, steps_per_epoch=1, dropout=0.0))
    assert len(stopped.history) == 3


def _plain_fit(batches, targets, validation, options):
    """Epochs of the default path in plain numpy: dropout by row, all losses, AdamW, best epoch. ``batches``: (owner, x) per batch."""
    p = initial_params(4, 3, 2, options.projection_dim, options.seed, options.hidden, options.type_hidden)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    order, step, history, best = np.random.default_rng(options.seed), 0, [], (np.inf, 0)
    expr, prop = targets

    def losses(p, owner, x, drop, seed):
        e, q, memo = forward(p, x, drop, row_seeds(x, seed) if drop else None)
        spots = np.unique(owner)
        s, n = np.stack([e[owner == i].sum(0) for i in spots]), np.array([(owner == i).sum() for i in spots])
        mean = np.stack([q[owner == i].mean(0) for i in spots])
        gap = np.log1p(np.maximum(s, 0)) - np.log1p(expr[spots])
        huber = np.where(np.abs(gap) <= 1, 0.5 * gap**2, np.abs(gap) - 0.5).sum()
        share = prop[spots]
        kind = options.alpha * -np.log(q.max(1)).mean() + (1 - options.alpha) * (share * (np.log(share) - np.log(mean))).sum() / len(spots)
        at = np.searchsorted(spots, owner)
        d_expr = (np.where(s > 0, np.clip(gap, -1, 1) / (1 + s), 0))[at]
        d_prob = (-share / mean * options.lambda_type * (1 - options.alpha) / len(spots) / n[:, None])[at]
        top = q.argmax(1)
        d_prob[np.arange(len(q)), top] -= options.lambda_type * options.alpha / len(q) / q[np.arange(len(q)), top]
        return huber + options.lambda_type * kind, huber, kind, (memo, d_expr, d_prob)

    for epoch in range(options.max_epochs):
        sums = np.zeros(3)
        for k in order.permutation(len(batches)).tolist():
            *told, (memo, d_expr, d_prob) = losses(p, *batches[k], options.dropout, (options.seed * 1_000_003 + epoch) * 1_000_003 + k)
            sums += told
            step += 1
            for name, g in backward(p, memo, d_expr, d_prob).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                p[name] = p[name] * (1 - options.lr * options.weight_decay) - options.lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        val = losses(p, *validation, 0.0, 0)[0]
        best = min(best, (val, epoch))
        history.append((*(sums / len(batches)), val, best[1]))
    return history


def test_default_path_against_loops_and_after_a_break(spark, data, tmp_path, monkeypatch):
    """Per-epoch losses, validation and best epoch as in plain loops; a fit that breaks off goes on to the same history."""
    owner, x, expr, prop, bags, targets = data
    options = training.FitOptions(batch_size=2, projection_dim=5, hidden=(7, 5), type_hidden=6, max_epochs=4, lr=0.02, dropout=0.2, seed=3)
    learn, held = bags.where("target_ord <> 4"), bags.where("target_ord = 4")
    parts, _ = training._batches(learn, options)
    spots = [{r["target_ord"] for r in part.select("target_ord").collect()} for part in parts]
    x = x.astype(float)
    chosen = [np.isin(owner, list(own)) for own in spots]
    want = _plain_fit([(owner[c], x[c]) for c in chosen], (expr, prop), (owner[owner == 4], x[owner == 4]), options)
    told = lambda result: [(h["train_loss"], h["train_expr_loss"], h["train_type_loss"], h["val_loss"], h["best_epoch"]) for h in result.history]
    whole = training.fit(learn, targets, 4, 3, 2, options, (held, targets))
    assert np.allclose(told(whole), want, rtol=1e-3)

    path, plain, calls = str(tmp_path / "state"), training.loss_and_gradient, []

    def breaking(*args, **named):
        calls.append(1)
        if len(calls) == 2 * (len(parts) + 1) + 2:
            raise RuntimeError("the driver is gone")
        return plain(*args, **named)

    monkeypatch.setattr(training, "loss_and_gradient", breaking)
    with pytest.raises(RuntimeError):
        training.fit(learn, targets, 4, 3, 2, options, (held, targets), path)
    before = len(calls)
    again = training.fit(learn, targets, 4, 3, 2, options, (held, targets), path)
    assert len(calls) - before == 2 * (len(parts) + 1)  # the two epochs that were missing
    assert np.allclose(told(again), told(whole), rtol=1e-6) and again.best_epoch == whole.best_epoch
    assert all(np.allclose(again.params[k], v, rtol=1e-4, atol=1e-7) for k, v in whole.params.items())
    left = sorted(p.name for p in (tmp_path / "state").iterdir())
    assert [n for n in left if n.startswith("epoch")] == ["epoch=3"] and len([n for n in left if n.startswith("best")]) == 1
    done = len(calls)
    assert told(training.fit(learn, targets, 4, 3, 2, options, (held, targets), path)) == told(again) and len(calls) == done
    other = training.fit(learn, targets, 4, 3, 2, training.FitOptions(**{**options.__dict__, "lr": 0.01, "max_epochs": 1}), (held, targets), path)
    assert len(other.history) == 1  # other options do not go on from this state


def test_encoder_hook(spark):
    patches = spark.createDataFrame([(0, 1.0), (1, 2.0)], "patch_index long, level double")

    def encoder(frame):
        tokens = np.arange(256)[None, :, None] * frame["level"].to_numpy()[:, None, None] * np.ones((1, 1, 2))
        return tokens, frame["level"].to_numpy()[:, None]

    encoded = training.encode_patches(patches, encoder)
    assert {r.patch_index: list(r.tile) for r in encoded.collect()} == {0: [1.0, 127.5, 127.5], 1: [2.0, 255.0, 255.0]}
    assert training.token_rows(encoded).where("patch_index = 1 AND token_linear = 3").first()["token"] == [6.0, 6.0]


def test_encoder_gets_and_hands_on_bounded_batches(spark, monkeypatch):
    patches = spark.range(23, numPartitions=2).selectExpr("cast(id AS int) AS patch_index", "cast(id AS double) AS level")

    def encoder(frame):
        assert len(frame) <= 5
        tokens = np.arange(256.0)[None, :, None] + frame["level"].to_numpy()[:, None, None] * np.ones((1, 1, 3))
        return tokens, frame[["level"]].to_numpy()

    monkeypatch.setattr(training, "_SLAB_BYTES", 2 * 256 * 4 * 3)
    got = {r.patch_index: r for r in training.encode_patches(patches, encoder, batch_size=5).collect()}
    assert sorted(got) == list(range(23))
    assert all(list(got[k].tile) == [k] + [127.5 + k] * 3 and len(got[k].tokens) == 256 and got[k].tokens[200] == [200.0 + k] * 3 for k in got)
    assert training.encode_patches(patches.where("level < 0"), encoder).count() == 0
    with pytest.raises(Exception, match="Expected 5 patches"):
        training.encode_patches(patches.coalesce(1), lambda frame: (np.ones((1, 256, 2)), np.ones((1, 1))), batch_size=5).collect()


def test_stateless_steps_run_on_streams(spark, data, tmp_path):
    *_, bags, _targets = data
    p = initial_params(4, 3, 2, 5, seed=1, **SHAPE)
    bags.write.parquet(str(tmp_path / "in"))
    query = apply_to_stream(spark, str(tmp_path / "in"), bags.schema, lambda df: training.predict_grids(df, p, ("spot_id",)), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == bags.count()


def test_backward_shapes():
    p = initial_params(4, 3, 2, 5, seed=1, **SHAPE)
    e, q, memo = forward(p, np.ones((2, 4)))
    assert {k: v.shape for k, v in backward(p, memo, np.ones_like(e), np.ones_like(q)).items()} == {k: v.shape for k, v in p.items()}


def test_batches_hold_every_spot_once_and_default_steps_train(spark, data):
    bags, targets = data[4:]
    options = training.FitOptions(batch_size=2, projection_dim=5, hidden=(7, 5), type_hidden=6, max_epochs=3, lr=0.02)
    batches, sizes = training._batches(bags, options)
    owners = [sorted({r["target_ord"] for r in batch.select("target_ord").collect()}) for batch in batches]
    assert [len(o) for o in owners] == sizes and sorted(x for o in owners for x in o) == sorted({r["target_ord"] for r in bags.select("target_ord").collect()})
    history = training.fit(bags, targets, 4, 3, 2, options).history
    assert history[-1]["train_loss"] < history[0]["train_loss"]


def test_dropout_masks_follow_the_row():
    from spotweave.operators.heads import forward, initial_params, row_seeds

    p = initial_params(4, 3, 2, 5, 1, (7, 5), 6)
    x = np.random.default_rng(0).normal(size=(50, 4))
    whole = forward(p, x, 0.3, row_seeds(x, 9))
    part = forward(p, x[20:30], 0.3, row_seeds(x[20:30], 9))
    assert np.allclose(whole[0][20:30], part[0]) and np.allclose(whole[1][20:30], part[1])
    other = forward(p, x, 0.3, row_seeds(x, 10))
    assert not np.allclose(whole[0], other[0])
    masks = np.concatenate([m.ravel() for m in whole[2]["gene_mask"][:-1]])
    assert set(np.round(np.unique(masks), 6)) == {0.0, round(1 / 0.7, 6)} and abs((masks == 0).mean() - 0.3) < 0.08


def test_a_step_computes_no_targets_anew(spark, data):
    """Targets and held-out rows are made once per fit, whatever the number of steps."""
    bags, targets = data[4:]
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def told(table):
        return table.mapInArrow(counted, table.schema)

    options = training.FitOptions(batch_size=2, projection_dim=5, hidden=(7, 5), type_hidden=6, max_epochs=3, lr=0.02)
    held = bags.where("target_ord = 4")
    history = training.fit(bags.where("target_ord <> 4"), told(targets), 4, 3, 2, options, (told(held), told(targets))).history
    assert len(history) == 3 and made.value <= 3 * targets.count() + held.count()


def test_a_step_of_a_small_batch_is_one_job(spark, data, monkeypatch):
    """Small batches are whole spots: one job, and the losses and gradient that the same rows give as grids; large batches stay grids."""
    *_, bags, targets = data
    # A target twice counts twice, and a spot without one only in the number of spots.
    targets = targets.where("target_ord <> 3").unionByName(targets.where("target_ord = 2"))
    options = training.FitOptions(batch_size=2, projection_dim=5, hidden=(7, 5), type_hidden=6, lambda_type=0.7, dropout=0.2, reduction="mean")
    p = initial_params(4, 3, 2, 5, seed=1, **SHAPE)
    grids, sizes = training._batches(bags, options)
    small, n_spots, wanted = training._batches(bags, options, targets, (4, 5))
    assert n_spots == sizes and wanted == [None] * 3

    def step(k, batch, own):
        spark.sparkContext.setJobGroup(f"step-{k}-{own is None}", "")
        try:
            return training.loss_and_gradient(batch, own, p, options, n_spots=sizes[k], dropout=0.2, seed=7 + k)
        finally:
            spark.sparkContext.setJobGroup("other", "")

    want = [step(k, grids[k], targets) for k in range(3)]
    for gathered in (training._GATHERED_BYTES, 0):  # on the driver, and by a shuffle
        monkeypatch.setattr(training, "_GATHERED_BYTES", gathered)
        for k, (row, g) in enumerate(want):
            got, h = step(k, small[k], None)
            assert set(got) == set(row) and all(got[n] == pytest.approx(row[n], rel=1e-9) for n in row)
            assert set(h) == set(g) and all(np.allclose(h[n], g[n], rtol=1e-9, atol=1e-12) for n in g)
            if gathered:
                assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"step-{k}-True")) == 1

    held = {k: bags.join(grids[k].select("target_ord").distinct(), "target_ord").count() for k in range(3)}
    largest = max(held, key=held.get)
    monkeypatch.setattr(training, "_BATCH_BYTES", 8 * (held[largest] * 4 + 2 * 5) - 1)
    mixed, _, wanted = training._batches(bags, options, targets, (4, 5))
    assert [w is not None for w in wanted] == [k == largest for k in range(3)]
    for k, (row, g) in enumerate(want):
        got, h = step(k, mixed[k], wanted[k])
        assert got["loss"] == pytest.approx(row["loss"], rel=1e-9) and all(np.allclose(h[n], g[n], rtol=1e-9, atol=1e-12) for n in g)


def test_a_spot_larger_than_a_slab(monkeypatch):
    rng = np.random.default_rng(4)
    p = initial_params(4, 3, 2, 5, seed=1, **SHAPE)
    counts, x = np.array([23]), rng.normal(size=(23, 4))
    rest = (np.log1p(rng.random((1, 3)) * 9), np.array([[0.3, 0.7]]), 1.0, 0.5, 0.01, 2, 0.2, 5)
    whole = training._spots_pass(p, counts, x, *rest)
    monkeypatch.setattr(training, "_SLAB", 10)
    pieces = training._spots_pass(p, counts, x, *rest)
    assert set(whole) == set(pieces) and all(np.allclose(pieces[k], v) for k, v in whole.items())
    assert list(training._slabs(np.array([4, 6, 1, 23, 2, 8, 3]))) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
    assert list(training._slabs(np.array([], int))) == []
