"""The projector, gene head and type head as small numpy batches: forward, and gradients of the parameters.

Only what runs inside a task lives here. Spark partitions the grids, sums the bags and adds up the gradients.
"""

from __future__ import annotations

import numpy as np

HIDDEN = (512, 512, 256)
TYPE_HIDDEN = 512
TEMPERATURE = 2.0
BETA = 20.0
SLOPE = 0.01
EPS = 1e-5

Params = dict[str, np.ndarray]


def initial_params(n_in: int, n_genes: int, n_types: int, projection: int, seed: int = 0,
                   hidden: tuple[int, ...] = HIDDEN, type_hidden: int = TYPE_HIDDEN) -> Params:
    """Uniform weights within one over the square root of the fan-in; unit scale and zero shift for norms."""
    rng = np.random.default_rng(seed)
    p: Params = {}

    def linear(name: str, a: int, b: int) -> None:
        bound = 1.0 / np.sqrt(a)
        p[f"{name}.w"] = rng.uniform(-bound, bound, (a, b))
        p[f"{name}.b"] = rng.uniform(-bound, bound, b)

    def norm(name: str) -> None:
        p[f"{name}.g"], p[f"{name}.c"] = np.ones(projection), np.zeros(projection)

    linear("proj", n_in, projection)
    norm("proj_norm")
    widths = [projection, *hidden, n_genes]
    for i, (a, b) in enumerate(zip(widths[:-1], widths[1:])):
        linear(f"gene{i}", a, b)
    norm("type_norm")
    linear("type_in", projection, type_hidden)
    linear("type_out", type_hidden, projection)
    linear("type_class", projection, n_types)
    return p


def _erf(x: np.ndarray) -> np.ndarray:
    # Coefficients of the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7).
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1.0 / (1.0 + 0.3275911 * np.abs(x))
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    return np.sign(x) * (1.0 - poly * np.exp(-x * x))


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and derivative."""
    cdf = 0.5 * (1.0 + _erf(x / np.sqrt(2.0)))
    return x * cdf, cdf + x * np.exp(-0.5 * x * x) / np.sqrt(2.0 * np.pi)


def _norm(x: np.ndarray, g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, tuple]:
    inv = 1.0 / np.sqrt(x.var(axis=1, keepdims=True) + EPS)
    hat = (x - x.mean(axis=1, keepdims=True)) * inv
    return hat * g + c, (hat, inv)


def _norm_back(d: np.ndarray, g: np.ndarray, memo: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hat, inv = memo
    dh = d * g
    dx = inv * (dh - dh.mean(axis=1, keepdims=True) - hat * (dh * hat).mean(axis=1, keepdims=True))
    return dx, (d * hat).sum(axis=0), d.sum(axis=0)


def row_seeds(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit number per row of features, the same in whatever batch the row comes."""
    odd = np.random.default_rng(seed).integers(0, 2**63, x.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    return (np.ascontiguousarray(x, np.float64).view(np.uint64) * odd).sum(axis=1, dtype=np.uint64)


def _kept(seeds: np.ndarray, place: int, width: int, rate: float) -> np.ndarray:
    """0 with probability ``rate``, else 1 / (1 - rate), drawn from the row's seed, the layer and the unit."""
    unit = (np.arange(width, dtype=np.uint64) + np.uint64((place + 1) << 32)) * np.uint64(0x9E3779B97F4A7C15)
    v = seeds[:, None] ^ unit[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
    return ((v >> np.uint64(11)) * 2.0**-53 >= rate) / (1.0 - rate)


def forward(p: Params, x: np.ndarray, dropout: float = 0.0, seeds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """Expression and type probabilities of a batch of grid features, with what the gradient needs.

    With ``dropout``, hidden units of both heads are left out at random, by the rows' seeds (:func:`row_seeds`).
    """
    memo: dict = {"x": x}
    mask = lambda place, width: _kept(seeds, place, width, dropout) if dropout else 1.0
    act, memo["proj_d"] = gelu(x @ p["proj.w"] + p["proj.b"])
    h, memo["proj_norm"] = _norm(act, p["proj_norm.g"], p["proj_norm.c"])
    memo["h"] = h

    layers = sum(1 for k in p if k.startswith("gene") and k.endswith(".w"))
    u, memo["gene_in"], memo["gene_z"], memo["gene_mask"] = h, [], [], []
    for i in range(layers):
        memo["gene_in"].append(u)
        z = u @ p[f"gene{i}.w"] + p[f"gene{i}.b"]
        memo["gene_z"].append(z)
        last = i == layers - 1
        memo["gene_mask"].append(1.0 if last else mask(i, z.shape[1]))
        u = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(BETA * z))) / BETA if last else np.where(z >= 0, z, SLOPE * z) * memo["gene_mask"][i]
    expr = u

    n, memo["type_norm"] = _norm(h, p["type_norm.g"], p["type_norm.c"])
    t, memo["type_d"] = gelu(n @ p["type_in.w"] + p["type_in.b"])
    memo["t_mask"], memo["res_mask"] = mask(layers, t.shape[1]), mask(layers + 1, h.shape[1])
    t = t * memo["t_mask"]
    res = h + (t @ p["type_out.w"] + p["type_out.b"]) * memo["res_mask"]
    q, memo["res_d"] = gelu(res)
    memo["n"], memo["t"], memo["q"] = n, t, q
    logits = (q @ p["type_class.w"] + p["type_class.b"]) / TEMPERATURE
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    prob = e / e.sum(axis=1, keepdims=True)
    memo["prob"] = prob
    return expr, prob, memo


def backward(p: Params, memo: dict, d_expr: np.ndarray, d_prob: np.ndarray) -> Params:
    """Parameter gradients summed over the batch, given the gradients at both outputs."""
    g: Params = {}
    z = memo["gene_z"][-1]
    d = d_expr / (1.0 + np.exp(-np.clip(BETA * z, -500, 500)))
    for i in reversed(range(len(memo["gene_z"]))):
        if i < len(memo["gene_z"]) - 1:
            d = d * memo["gene_mask"][i] * np.where(memo["gene_z"][i] >= 0, 1.0, SLOPE)
        g[f"gene{i}.w"], g[f"gene{i}.b"] = memo["gene_in"][i].T @ d, d.sum(axis=0)
        d = d @ p[f"gene{i}.w"].T
    d_h = d

    prob = memo["prob"]
    d = prob * (d_prob - (d_prob * prob).sum(axis=1, keepdims=True)) / TEMPERATURE
    g["type_class.w"], g["type_class.b"] = memo["q"].T @ d, d.sum(axis=0)
    d_res = (d @ p["type_class.w"].T) * memo["res_d"]
    d = d_res * memo["res_mask"]
    g["type_out.w"], g["type_out.b"] = memo["t"].T @ d, d.sum(axis=0)
    d = (d @ p["type_out.w"].T) * memo["t_mask"] * memo["type_d"]
    g["type_in.w"], g["type_in.b"] = memo["n"].T @ d, d.sum(axis=0)
    d, g["type_norm.g"], g["type_norm.c"] = _norm_back(d @ p["type_in.w"].T, p["type_norm.g"], memo["type_norm"])
    d_h = d_h + d_res + d

    d, g["proj_norm.g"], g["proj_norm.c"] = _norm_back(d_h, p["proj_norm.g"], memo["proj_norm"])
    d = d * memo["proj_d"]
    g["proj.w"], g["proj.b"] = memo["x"].T @ d, d.sum(axis=0)
    return g
