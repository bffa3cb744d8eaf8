"""Model application and fitting as Spark jobs over grid rows.

A bag is never brought together: the forward pass sums grid outputs per spot with a partial step, the loss and its
gradient are columns of one row per spot, and the backward pass meets grids with their spot's gradient by an
equi-join. A spot with a third of all grids is therefore only many rows. The driver holds the parameters, whose
size the architecture fixes, and nothing that grows with the data.

The batches of a fit that are small, by a bound in bytes, are stored as whole spots with their targets. A task then has all it needs for the
forward and the backward pass of its spots, and a step is one job without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.functions.arrays import first_max_index, normalised
from spotweave.functions.vectors import vector_mean, vector_sum
from spotweave.operators.heads import Params, backward, forward, initial_params, row_seeds
from spotweave.operators.ordinals import ordinal
from spotweave.session import by_shuffle, durable, release, scratch_path

_CHUNK = 4096   # parameters per gradient row
_SLAB = 1024    # grids per numpy batch
_SLAB_BYTES = 64 << 20  # of patches given to an encoder at once, and of tokens handed on in one batch
_BATCH_BYTES = 64 << 20  # of features and targets, as doubles, of a batch that is stored as whole spots
_GATHERED_BYTES = 32 << 20  # of the gradients that the tasks of a step hand to the driver; larger ones are summed by a shuffle
_PIECES = "name string, chunk int, values array<double>"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _lists(matrix: np.ndarray, kind) -> pa.ListArray:
    offsets = pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel().astype(kind)))


def predict_grids(grids: DataFrame, params: Params, keep: tuple[str, ...] = ("grid_index",), shared=None, dropout: float = 0.0, seed: int = 0) -> DataFrame:
    """``(*keep, expr_pred, type_prob, type_top1)`` for every grid; Arrow batches, parameters broadcast once.

    ``shared``: a broadcast of the parameters that the caller owns and releases. ``dropout`` is for fitting only.
    """
    shared = shared or grids.sparkSession.sparkContext.broadcast(params)
    columns = list(keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SLAB):
                part = batch.slice(start, _SLAB)
                x = _matrix(part.column("feature"))
                expr, prob, _ = forward(shared.value, x, dropout, row_seeds(x, seed) if dropout else None)
                arrays = [part.column(c) for c in columns] + [_lists(expr, np.float32), _lists(prob, np.float32)]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, "expr_pred", "type_prob"])

    kept = grids.select(*columns, "feature")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "feature")
    out = kept.mapInArrow(apply, f"{fields}, expr_pred array<float>, type_prob array<float>")
    return out.withColumn("type_top1", first_max_index(F.col("type_prob")).cast("short"))


def predict_bags(bag_features: DataFrame, params: Params, n_types: int | None = None, n_genes: int | None = None) -> DataFrame:
    """``(target_ord, spot_id, expr, prob, n_grids)``: expression summed, type probability averaged over a spot's grids."""
    grids = predict_grids(bag_features, params, ("target_ord", "spot_id"))
    return grids.groupBy("target_ord", "spot_id").agg(
        vector_sum(F.col("expr_pred"), n_genes).alias("expr"),
        vector_mean(F.col("type_prob"), n_types).alias("prob"),
        F.count(F.lit(1)).alias("n_grids"),
    )


def encode_patches(patches: DataFrame, encoder: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], batch_size: int = 64) -> DataFrame:
    """Apply a caller's encoder to batches of patches.

    The encoder maps a frame of patches to ``(tokens [n, 256, d], class_token [n, d])``. Returns one row per patch:
    ``(patch_index, tokens array<array<float>>, tile array<float>)`` with tile = class token, then token mean.

    An encoder is given ``batch_size`` patches at most, fewer where these are large. Tokens leave as one buffer with offsets, in
    batches of bounded size, so neither the width of a token nor the size of Spark's batches can overrun an Arrow list.
    """
    def encoded(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        tokens, lead = encoder(frame)
        if tokens.ndim != 3 or tokens.shape[1] != 256:
            raise ValueError(f"Expected 256 tokens per patch, got shape {tokens.shape}.")
        if len(tokens) != len(frame) or len(lead) != len(frame):
            raise ValueError(f"Expected {len(frame)} patches, got {len(tokens)} with tokens and {len(lead)} with a class token.")
        return tokens, np.concatenate([lead, tokens.mean(axis=1)], axis=1)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, min(batch_size, int(batch.num_rows * _SLAB_BYTES / max(1, batch.nbytes))))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                tokens, tile = encoded(part.to_pandas())
                handed = max(1, _SLAB_BYTES // (256 * 4 * max(1, tokens.shape[2])))
                for first in range(0, len(tokens), handed):
                    own = tokens[first : first + handed]
                    views = _lists(own.reshape(-1, own.shape[2]), np.float32)
                    whole = pa.ListArray.from_arrays(pa.array(np.arange(0, len(views) + 1, 256, dtype=np.int32)), views)
                    index = part.column("patch_index").slice(first, handed).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([index, whole, _lists(tile[first : first + handed], np.float32)], ["patch_index", "tokens", "tile"])

    return patches.mapInArrow(apply, "patch_index bigint, tokens array<array<float>>, tile array<float>")


def token_rows(encoded: DataFrame) -> DataFrame:
    return encoded.select("patch_index", F.posexplode("tokens").alias("token_linear", "token"))


@dataclass
class FitOptions:
    projection_dim: int = 3584
    lambda_type: float = 1.0
    alpha: float = 0.05
    max_epochs: int = 120
    lr: float = 5e-5
    weight_decay: float = 1e-4
    reduction: str = "sum"
    train_all: bool = True
    val_fraction: float = 0.1
    patience: int = 20
    min_delta: float = 1e-4
    seed: int = 0
    #: Spots per optimiser step. Each step is a Spark job, or a few of a large batch, so 4, which small data need to converge in few epochs, suits a
    #: local session; on a cluster hundreds of spots per step and a larger ``lr`` keep the executors busy.
    batch_size: int = 4
    #: Steps per epoch in place of a batch size; 1 uses all spots in each step.
    steps_per_epoch: int | None = None
    #: Share of hidden units of both heads left out in each step.
    dropout: float = 0.05
    hidden: tuple[int, ...] = (512, 512, 256)
    type_hidden: int = 512


@dataclass
class FitResult:
    params: Params
    history: list[dict] = field(default_factory=list)
    best_epoch: int = 0
    monitor: str = "train_loss_epoch"


def _forward_sums(bag_features: DataFrame, params: Params, n_genes: int, n_types: int, shared=None, dropout: float = 0.0, seed: int = 0) -> DataFrame:
    predicted = predict_grids(bag_features, params, ("target_ord",), shared, dropout, seed)
    return predicted.groupBy("target_ord").agg(
        vector_sum(F.col("expr_pred"), n_genes).alias("expr"),
        vector_mean(F.col("type_prob"), n_types).alias("prob"),
        F.count(F.lit(1)).alias("n_grids"),
        F.sum(-F.log(F.greatest(F.array_max("type_prob").cast("double"), F.lit(1e-8)))).alias("conf_sum"),
    )


def spot_losses(sums: DataFrame, targets: DataFrame, reduction: str, n_spots: int, n_genes: int, lambda_type: float, alpha: float) -> DataFrame:
    """One row per spot: its loss terms and the loss gradients at the summed expression and the mean probability.

    ``sums``: ``(target_ord, expr, prob, n_grids, conf_sum)``; ``targets``: ``(target_ord, expression, proportions)``.
    """
    scale = 1.0 if reduction == "sum" else 1.0 / (n_spots * n_genes)
    both = sums.join(targets, "target_ord")
    clean = lambda v: F.log1p(F.greatest(v, F.lit(0.0)))
    gap = F.zip_with("expr", F.col("expression").cast("array<double>"), lambda p, t: clean(p) - clean(t))
    huber = F.aggregate(gap, F.lit(0.0), lambda a, d: a + F.when(F.abs(d) <= 1, 0.5 * d * d).otherwise(F.abs(d) - 0.5))
    slope = F.zip_with("_gap", "expr", lambda d, p: F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d)) / (1.0 + p) * scale).otherwise(0.0))
    target = normalised(F.col("proportions"), 1e-8)
    kl = F.aggregate(
        F.zip_with("_t", "prob", lambda t, p: F.when(t > 0, t * (F.log(t) - F.log(F.greatest(p, F.lit(1e-8))))).otherwise(0.0)),
        F.lit(0.0), lambda a, v: a + v,
    )
    weight = lambda_type * (1.0 - alpha if alpha > 0 else 1.0) / n_spots
    return both.withColumn("_gap", gap).withColumn("_t", target).select(
        "target_ord", "n_grids", "conf_sum",
        (huber * scale).alias("expr_loss"),
        (kl / n_spots).alias("deconv_loss"),
        slope.alias("d_expr"),
        F.zip_with("_t", "prob", lambda t, p: F.when(p > 1e-8, -t / p * weight).otherwise(0.0)).alias("d_prob_mean"),
    )


def loss_and_gradient(
    bag_features: DataFrame | _WholeSpots, targets: DataFrame | None, params: Params, options: FitOptions, with_gradient: bool = True,
    n_spots: int | None = None, dropout: float = 0.0, seed: int = 0,
) -> tuple[dict, Params | None]:
    """Losses of the given spots and, if asked, the gradient of every parameter.

    ``bag_features``: ``(target_ord, spot_id, feature)``, one row per grid of a spot, or a small batch of whole spots, which has its
    targets; ``n_spots`` is counted if not known. The parameters are broadcast once and released at the end.
    """
    last_gene = max(int(k[4:-2]) for k in params if k.startswith("gene") and k.endswith(".w"))
    n_genes, n_types = params[f"gene{last_gene}.b"].size, params["type_class.b"].size
    if isinstance(bag_features, _WholeSpots):
        return _whole_spots_step(bag_features, params, options, n_spots, n_genes, dropout, seed)
    shared = bag_features.sparkSession.sparkContext.broadcast(params)
    sums = _forward_sums(bag_features, params, n_genes, n_types, shared, dropout, seed)
    n_spots = n_spots or bag_features.select("target_ord").distinct().count()
    per_spot = spot_losses(sums, targets, options.reduction, n_spots, n_genes, options.lambda_type, options.alpha).cache()
    row = per_spot.agg(
        F.sum("expr_loss").alias("expr_loss"), F.sum("deconv_loss").alias("deconv_loss"),
        (F.sum("conf_sum") / F.sum("n_grids")).alias("confidence_loss"), F.sum("n_grids").alias("n_grids"),
    ).first().asDict()
    row, alpha = _with_loss(row, options), options.alpha
    if not with_gradient:
        per_spot.unpersist()
        shared.destroy()
        return row, None

    confidence = options.lambda_type * alpha / row["n_grids"] if alpha > 0 else 0.0

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Params | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, _SLAB):
                part = batch.slice(start, _SLAB)
                x = _matrix(part.column("feature"))
                _, prob, memo = forward(shared.value, x, dropout, row_seeds(x, seed) if dropout else None)
                d_prob = _less_confidence(_matrix(part.column("d_prob")), prob, confidence)
                total = _added(total, backward(shared.value, memo, _matrix(part.column("d_expr")), d_prob))
        yield from _pieces(total or {})

    sent = bag_features.join(per_spot, "target_ord").select(
        "feature", "d_expr", F.transform("d_prob_mean", lambda v: v / F.col("n_grids")).alias("d_prob")
    )
    summed = _summed(sent.mapInArrow(gradients, _PIECES))
    per_spot.unpersist()
    shared.destroy()
    return row, {name: values.reshape(params[name].shape) for name, values in summed.items()}


def _added(total: Params | None, more: Params) -> Params:
    return more if total is None else {k: total[k] + more[k] for k in more}


def _less_confidence(d_prob: np.ndarray, prob: np.ndarray, confidence: float) -> np.ndarray:
    """The gradient at the probabilities of grids, with the share of the confidence term."""
    if confidence:
        top = prob.argmax(axis=1)
        rows = np.arange(len(top))
        best = prob[rows, top]
        d_prob[rows, top] -= np.where(best > 1e-8, confidence / best, 0.0)
    return d_prob


def _pieces(total: Params) -> Iterator[pa.RecordBatch]:
    """Arrays as rows ``(name, chunk, values)`` of bounded size."""
    chunks = [(name, i, values.ravel()[first : first + _CHUNK]) for name, values in total.items() for i, first in enumerate(range(0, values.size, _CHUNK))]
    for start in range(0, len(chunks), 256):
        names, places, values = zip(*chunks[start : start + 256], strict=True)
        offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.float64)))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(places, pa.int32()), lists], ["name", "chunk", "values"])


def _summed(pieces: DataFrame, gather: bool = False) -> dict[str, np.ndarray]:
    """Each array, summed over the tasks that gave it: by a shuffle, or on the driver if the pieces of all tasks are small."""
    if gather:
        rows = pieces.collect()
    else:
        rows = pieces.groupBy("name", "chunk").agg(vector_sum(F.col("values")).alias("values")).toLocalIterator()  # as large as the model, in chunks
    parts: dict[str, dict[int, np.ndarray]] = {}
    for piece in rows:
        chunks, values = parts.setdefault(piece["name"], {}), np.asarray(piece["values"])
        chunks[piece["chunk"]] = chunks[piece["chunk"]] + values if piece["chunk"] in chunks else values
    return {name: np.concatenate([chunks[i] for i in sorted(chunks)]) for name, chunks in parts.items()}


@dataclass
class _WholeSpots:
    """A small batch. ``rows``: one per spot with ``n_grids``, the features of its grids in one list, ``want`` (the logarithm of one plus the target
    expression) and ``share`` (target proportions that sum to one). A spot has as many rows as targets.
    """

    rows: DataFrame
    n_grids: int
    n_tasks: int


def _slabs(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of spots with at most ``_SLAB`` grids together, or of one spot with more."""
    first, grids = 0, 0
    for i, n in enumerate(counts.tolist()):
        if i > first and grids + n > _SLAB:
            yield first, i
            first, grids = i, 0
        grids += n
    if first < len(counts):
        yield first, len(counts)


def _spots_pass(
    p: Params, counts: np.ndarray, x: np.ndarray, want: np.ndarray, share: np.ndarray, scale: float, weight: float, confidence: float,
    n_spots: int, dropout: float, seed: int,
) -> Params:
    """Losses and gradient of a slab of whole spots: the rules of :func:`spot_losses`, sums in single precision's values as there.

    A spot with more grids than a slab is gone through twice, in pieces.
    """
    pieces = [slice(i, i + _SLAB) for i in range(0, len(x), _SLAB)]
    ends = np.cumsum(counts)
    starts = ends - counts if len(pieces) == 1 else np.zeros(1, np.int64)
    run = lambda own: forward(p, x[own], dropout, row_seeds(x[own], seed) if dropout else None)
    sums: np.ndarray | float = 0.0
    for own in pieces:
        out = run(own)
        expr, prob = (v.astype(np.float32).astype(np.float64) for v in out[:2])
        conf = -np.log(np.maximum(prob.max(axis=1), 1e-8))
        sums = sums + np.add.reduceat(np.concatenate([expr, prob, conf[:, None]], axis=1), starts, axis=0)
    expr, mean, conf = sums[:, : want.shape[1]], sums[:, want.shape[1] : -1] / counts[:, None], sums[:, -1]
    # As in Spark's order, where NaN is the largest number.
    gap = np.log1p(np.maximum(expr, 0.0)) - want
    huber = np.where(np.abs(gap) <= 1, 0.5 * gap * gap, np.abs(gap) - 0.5).sum()
    d_expr = np.where(expr <= 0, 0.0, np.clip(gap, -1.0, 1.0) / (1.0 + np.maximum(expr, 0.0)) * scale)
    known = share > 0
    kl = np.where(known, share * (np.log(np.where(known, share, 1.0)) - np.log(np.maximum(mean, 1e-8))), 0.0).sum()
    d_mean = np.where(mean <= 1e-8, 0.0, -share / np.maximum(mean, 1e-8) * weight) / counts[:, None]
    total: Params | None = None
    for own in pieces:
        if len(pieces) > 1:
            out = run(own)
        _, prob, memo = out
        spot = np.repeat(np.arange(len(counts)), counts)[own]
        total = _added(total, backward(p, memo, d_expr[spot], _less_confidence(d_mean[spot], prob, confidence)))
    return total | {_LOSSES: np.array([huber * scale, kl / n_spots, conf.sum()])}


_LOSSES = "losses"


def _whole_spots_step(batch: _WholeSpots, params: Params, options: FitOptions, n_spots: int, n_genes: int, dropout: float, seed: int) -> tuple[dict, Params]:
    """Losses and gradient of a small batch, in one job."""
    if not batch.n_grids:
        raise ValueError("No spot of the batch has targets.")
    alpha, lam = options.alpha, options.lambda_type
    scale = 1.0 if options.reduction == "sum" else 1.0 / (n_spots * n_genes)
    weight = lam * (1.0 - alpha if alpha > 0 else 1.0) / n_spots
    confidence = lam * alpha / batch.n_grids if alpha > 0 else 0.0
    shared = batch.rows.sparkSession.sparkContext.broadcast(params)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Params | None = None
        for part in batches:
            counts = part.column("n_grids").to_numpy()
            want, share = _matrix(part.column("want")), _matrix(part.column("share"))
            features, ends = part.column("features"), np.cumsum(counts)
            for first, last in _slabs(counts):
                values = features.slice(first, last - first).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = values.reshape(int(ends[last - 1] - (ends[first - 1] if first else 0)), -1)
                total = _added(total, _spots_pass(
                    shared.value, counts[first:last], x, want[first:last], share[first:last], scale, weight, confidence, n_spots, dropout, seed))
        yield from _pieces(total or {})

    size = 8 * sum(v.size for v in params.values())
    summed = _summed(batch.rows.mapInArrow(apply, _PIECES), gather=size * batch.n_tasks <= _GATHERED_BYTES)
    shared.destroy()
    expr_loss, deconv, conf = (float(v) for v in summed.pop(_LOSSES))
    row = {"expr_loss": expr_loss, "deconv_loss": deconv, "confidence_loss": conf / batch.n_grids, "n_grids": batch.n_grids}
    return _with_loss(row, options), {name: values.reshape(params[name].shape) for name, values in summed.items()}


def _with_loss(row: dict, options: FitOptions) -> dict:
    alpha = options.alpha
    kind = alpha * row["confidence_loss"] + (1 - alpha) * row["deconv_loss"] if alpha > 0 else row["deconv_loss"]
    row["type_loss"], row["loss"] = kind, row["expr_loss"] + options.lambda_type * kind
    return row


def adamw_step(params: Params, gradient: Params, state: dict, lr: float, weight_decay: float) -> Params:
    """One AdamW step (betas 0.9 and 0.999, epsilon 1e-8, decoupled decay); ``state`` is updated in place."""
    step = state["step"] = state.get("step", 0) + 1
    out: Params = {}
    for name, value in params.items():
        g = gradient.get(name, np.zeros_like(value))
        m = state[f"m:{name}"] = 0.9 * state.get(f"m:{name}", 0.0) + 0.1 * g
        v = state[f"v:{name}"] = 0.999 * state.get(f"v:{name}", 0.0) + 0.001 * g * g
        moved = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        out[name] = value * (1 - lr * weight_decay) - lr * moved
    return out


def _batches(
    bag_features: DataFrame, options: FitOptions, targets: DataFrame | None = None, widths: tuple[int, int] = (0, 0),
) -> tuple[list, ...]:
    """The grids of each batch and its number of spots; then, if ``targets`` are given, the targets of each batch's spots.

    All are stored by batch, so a step reads what it needs and computes nothing anew. With ``targets``, and ``widths`` (numbers of a feature,
    and of a target), a batch of at most ``_BATCH_BYTES`` becomes :class:`_WholeSpots`, and None stands for its targets.
    """
    spark = bag_features.sparkSession
    spots = durable(bag_features.groupBy("target_ord").agg(F.count(F.lit(1)).alias("_n")))
    n = spots.count()
    size = -(-n // options.steps_per_epoch) if options.steps_per_epoch else options.batch_size
    if size >= n:
        own = () if targets is None else ([durable(targets.join(spots.select("target_ord"), "target_ord", "left_semi"))],)
        return [durable(bag_features)], [n], *own
    drawn = F.xxhash64(F.lit(options.seed), F.col("target_ord"))
    dealt = ordinal(spots.withColumn("_drawn", drawn), ["_drawn", "target_ord"], name="_place")
    dealt = durable(dealt.select("target_ord", "_n", F.floor(F.col("_place") / size).cast("int").alias("_batch")))
    count = -(-n // size)
    n_spots = [min(size, n - k * size) for k in range(count)]

    def stored(rows: DataFrame, of: DataFrame, chosen: list[int]) -> list[DataFrame]:
        path = scratch_path(spark, "batches")
        rows.join(of, "target_ord").select("_batch", *rows.columns).repartition("_batch", "target_ord").write.partitionBy("_batch").parquet(path)
        # Read as one table, the folder of a batch without rows need not be there.
        whole = spark.read.schema(f"_batch int, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}").parquet(path)
        return [whole.where(F.col("_batch") == k).drop("_batch") for k in chosen]

    if targets is None:
        return stored(bag_features, dealt.select("target_ord", "_batch"), list(range(count))), n_spots
    size_of = 8 * (F.sum("_n") * widths[0] + F.count(F.lit(1)) * widths[1])
    sizes = durable(dealt.groupBy("_batch").agg(F.sum("_n").alias("n"), (size_of <= _BATCH_BYTES).alias("_small")))
    small = {r["_batch"]: r["n"] for r in sizes.where("_small").collect()}
    chosen = dealt.join(by_shuffle(sizes), "_batch").select("target_ord", "_batch", "_small")
    batches: list = [None] * count
    wanted: list = [None] * count
    if large := [k for k in range(count) if k not in small]:
        rest = chosen.where("NOT _small").drop("_small")
        for k, grids, own in zip(large, stored(bag_features, rest, large), stored(targets, rest, large), strict=True):
            batches[k], wanted[k] = grids, own
    if small:
        limit = -(-size // min(spark.sparkContext.defaultParallelism, -(-max(small.values()) // _SLAB)))  # spots of a task
        # A spot beyond the bound is in no small batch and must not meet itself in one task; there are no more of them than the table has bounds.
        beyond = spots.where(F.col("_n") * 8 * widths[0] > _BATCH_BYTES).select("target_ord")
        light = bag_features.join(F.broadcast(beyond), "target_ord", "left_anti") if large else bag_features
        for k, batch in _whole_spots(light, targets, chosen.where("_small").drop("_small"), limit, list(small)).items():
            batches[k] = batch
    return batches, n_spots, wanted


def _whole_spots(bag_features: DataFrame, targets: DataFrame, dealt: DataFrame, limit: int, chosen: list[int]) -> dict[int, _WholeSpots]:
    """Small batches as rows of whole spots, stored in files of ``limit`` rows, each of which is a task of a step."""
    spark = bag_features.sparkSession
    ready = targets.select(
        "target_ord", F.transform(F.col("expression").cast("array<double>"), lambda t: F.log1p(F.greatest(t, F.lit(0.0)))).alias("want"),
        normalised(F.col("proportions"), 1e-8).alias("share"))
    path, kind = scratch_path(spark, "batches"), bag_features.schema["feature"].dataType.simpleString()
    whole = bag_features.select("target_ord", "feature").join(by_shuffle(dealt), "target_ord").groupBy("target_ord", "_batch").agg(
        F.count(F.lit(1)).alias("n_grids"), F.flatten(F.collect_list("feature")).alias("features")
    ).join(by_shuffle(ready), "target_ord").drop("target_ord")
    whole.repartition("_batch").write.option("maxRecordsPerFile", limit).partitionBy("_batch").parquet(path)
    stored = spark.read.schema(f"_batch int, n_grids long, features {kind}, want array<double>, share array<double>").parquet(path)
    made = stored.groupBy("_batch").agg(F.sum("n_grids").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    sizes = {r["_batch"]: (r["n"], -(-r["rows"] // limit)) for r in made}
    return {k: _WholeSpots(stored.where(F.col("_batch") == k).drop("_batch"), *sizes.get(k, (0, 0))) for k in chosen}


@dataclass
class _State:
    """What an epoch leaves behind: parameters, moments, and where the search for the best epoch stands."""

    params: Params
    moments: dict = field(default_factory=dict)
    best_params: Params = field(default_factory=dict)
    best: float = float("inf")
    stop_best: float = float("inf")
    waited: int = 0
    best_epoch: int = 0
    history: list[dict] = field(default_factory=list)

    NUMBERS = ("best", "stop_best", "waited", "best_epoch", "history")


def _store_epoch(spark, path: str, state: _State, mark: str) -> None:
    """Write the state of an epoch; its record comes last, so a half-written epoch is never read. Older epochs are released."""
    epoch = len(state.history) - 1
    arrays = {k: v for k, v in state.moments.items() if k != "step"}
    save_params(spark, state.params, f"{path}/epoch={epoch}/params")
    save_params(spark, arrays, f"{path}/epoch={epoch}/moments")
    if state.best_epoch == epoch:
        save_params(spark, state.best_params, f"{path}/best={epoch}")
    record = {"mark": mark, "epoch": epoch, "step": state.moments.get("step", 0), **{k: getattr(state, k) for k in _State.NUMBERS}}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/records/epoch={epoch}")
    if epoch:
        release(spark, f"{path}/epoch={epoch - 1}")
    for old in {h["best_epoch"] for h in state.history[:-1]} - {state.best_epoch}:
        release(spark, f"{path}/best={old}")


def _stored_epoch(spark, path: str, mark: str) -> _State | None:
    """The state of the last epoch that was written whole, if it was made with the same options and data."""
    try:
        records = [json.loads(r["value"]) for r in spark.read.text(f"{path}/records").select("value").collect()]
    except AnalysisException:
        return None
    last = max((r for r in records if r["mark"] == mark), key=lambda r: r["epoch"], default=None)
    if last is None:
        return None
    moments = {**load_params(spark, f"{path}/epoch={last['epoch']}/moments"), "step": last["step"]}
    best = load_params(spark, f"{path}/best={last['best_epoch']}")
    return _State(load_params(spark, f"{path}/epoch={last['epoch']}/params"), moments, best, **{k: last[k] for k in _State.NUMBERS})


def fit(
    bag_features: DataFrame, targets: DataFrame, n_in: int, n_genes: int, n_types: int, options: FitOptions,
    validation: tuple[DataFrame, DataFrame] | None = None, state_path: str | None = None,
) -> FitResult:
    """Synchronous data-parallel AdamW with best-by-metric selection and early stopping.

    Spots are dealt to batches once, in a seeded order, and their grids are stored by batch, so that a step reads its own rows
    only, as whole spots where the batch is small; epochs go through the batches in changing order. The monitored value is the training loss (with dropout), or the
    validation loss (without) if given. Each epoch's record has the losses, and the best epoch so far.

    With ``state_path`` (a folder on shared storage) parameters, moments, best epoch and patience are written after every epoch, and a
    fit that finds the state of an earlier run with the same options goes on from its last whole epoch. Masks and the order of
    batches follow from the seed, the epoch and the step, so the history is the same as without the break.
    """
    spark = bag_features.sparkSession
    monitor = "train_loss_epoch" if validation is None else "val_loss"
    batches, n_spots, wanted = _batches(bag_features, options, targets, (n_in, n_genes + n_types))
    if validation is not None:
        shown = durable(validation[0])
        validation = shown, durable(validation[1].join(shown.select("target_ord").distinct(), "target_ord", "left_semi"))
    held = validation[0].select("target_ord").distinct().count() if validation is not None else 0
    mark = repr((asdict(options) | {"max_epochs": None}, n_in, n_genes, n_types, n_spots, held))
    state = _stored_epoch(spark, state_path, mark) if state_path else None
    if state is None:
        params = initial_params(n_in, n_genes, n_types, options.projection_dim, options.seed, options.hidden, options.type_hidden)
        state = _State(params, best_params=params)
    order = np.random.default_rng(options.seed)
    for epoch in range(options.max_epochs):
        steps = order.permutation(len(batches)).tolist()
        if epoch < len(state.history):
            continue
        if state.waited >= options.patience:
            break
        epoch_loss = {"loss": 0.0, "expr_loss": 0.0, "type_loss": 0.0}
        for step in steps:
            draw = (options.seed * 1_000_003 + epoch) * 1_000_003 + step
            row, gradient = loss_and_gradient(batches[step], wanted[step], state.params, options, n_spots=n_spots[step], dropout=options.dropout, seed=draw)
            state.params = adamw_step(state.params, gradient, state.moments, options.lr, options.weight_decay)
            for key in epoch_loss:
                epoch_loss[key] += row[key]
        record = {"epoch": epoch, **{f"train_{k}": float(v / max(len(steps), 1)) for k, v in epoch_loss.items()}}
        if validation is not None:
            row, _ = loss_and_gradient(validation[0], validation[1], state.params, options, with_gradient=False, n_spots=held)
            record["val_loss"] = float(row["loss"])
        watched = record["val_loss"] if validation is not None else record["train_loss"]
        if watched < state.best:
            state.best, state.best_params, state.best_epoch = watched, state.params, epoch
        if watched < state.stop_best - options.min_delta:
            state.stop_best, state.waited = watched, 0
        else:
            state.waited += 1
        state.history.append(record | {"best_epoch": state.best_epoch})
        if state_path:
            _store_epoch(spark, state_path, state, mark)
    return FitResult(state.best_params, state.history, state.best_epoch, monitor)


#: Numbers of a stored row of parameters.
_STORED = 1 << 20


def save_params(spark, params: Params, path: str) -> None:
    """Parameters as a parquet table ``(name, shape, part, numbers)``: doubles as bytes, in parts of bounded size."""
    rows = [
        (name, [int(s) for s in np.shape(v)], i, bytearray(np.ascontiguousarray(v, np.float64).ravel()[first : first + _STORED].tobytes()))
        for name, v in params.items() for i, first in enumerate(range(0, max(1, np.size(v)), _STORED))
    ]
    spark.createDataFrame(rows, "name string, shape array<int>, part int, numbers binary").write.mode("overwrite").parquet(path)


def load_params(spark, path: str) -> Params:
    parts: dict[str, dict[int, np.ndarray]] = {}
    shapes: dict[str, list[int]] = {}
    for r in spark.read.parquet(path).toLocalIterator():
        parts.setdefault(r["name"], {})[r["part"]] = np.frombuffer(r["numbers"], np.float64)
        shapes[r["name"]] = r["shape"]
    return {name: np.concatenate([own[i] for i in sorted(own)]).reshape(shapes[name]) for name, own in parts.items()}
