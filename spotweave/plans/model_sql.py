"""The forward pass and the loss of the model as SQL, with the parameters as a relation that the rows are joined to."""

from __future__ import annotations

import numpy as np

from spotweave.operators.heads import Params

_ROOT2 = "1.4142135623730951e0"
_KEYS = "grid_index, target_ord"


def _list(values: np.ndarray) -> str:
    return "[" + ", ".join(f"{float(v):.17e}" for v in values) + "]"


def weights_sql(p: Params) -> str:
    """``(layer, i, b, j, w)``: a row per weight, with the shift of its unit."""
    layers = [k[:-2] for k in p if k.endswith(".w")]
    units = [f"('{name}', {i}, {float(p[name + '.b'][i]):.17e}, {_list(column)})" for name in layers for i, column in enumerate(p[f"{name}.w"].T)]
    return f"SELECT layer, i, b, unnest(range(len(ws))) AS j, unnest(ws) AS w FROM (VALUES {', '.join(units)}) AS units(layer, i, b, ws)"


def _dense(prefix: str, name: str, source: str) -> str:
    return f"(SELECT {_KEYS}, i AS pos, sum(v * w) + max(b) AS v FROM {source} JOIN {{{prefix}_weights}} ON layer = '{name}' AND j = pos GROUP BY {_KEYS}, i)"


def _each(source: str, value: str) -> str:
    return f"SELECT {_KEYS}, pos, {value} AS v FROM {source}"


def _gelu() -> str:
    """The value at ``v``, with the error function by its fixed rational approximation."""
    t = f"(1e0 / (1e0 + 0.3275911e0 * abs(v) / {_ROOT2}))"
    poly = f"{t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0))))"
    return f"v * 0.5e0 * (1e0 + sign(v) * (1e0 - {poly} * exp(-v * v / 2e0)))"


def _norm(source: str) -> str:
    return f"SELECT {_KEYS}, pos, (v - avg(v) OVER own) / sqrt(var_pop(v) OVER own + 1e-5) AS v FROM {source} WINDOW own AS (PARTITION BY {_KEYS})"


def forward_parts(prefix: str, p: Params) -> dict[str, str]:
    """Steps from ``{model_input}`` (``grid_index, target_ord, x``) to ``{<prefix>_out}`` with ``expr`` and ``prob``.

    Between them a row is one element of one grid's vector. The scale and shift of the norms are those of fresh parameters, 1 and 0.
    """
    part = lambda name: f"{{{prefix}_{name}}}"
    parts = {f"{prefix}_weights": weights_sql(p)}
    parts[f"{prefix}_x"] = f"SELECT {_KEYS}, unnest(range(len(x))) AS pos, unnest(x) AS v FROM {{model_input}}"
    parts[f"{prefix}_act"] = _each(_dense(prefix, "proj", part("x")), _gelu())
    parts[f"{prefix}_h"] = _norm(part("act"))
    source, layers = part("h"), sum(1 for k in p if k.startswith("gene") and k.endswith(".w"))
    for i in range(layers):
        soft = "greatest(v, 0e0) + ln(1e0 + exp(-abs(20e0 * v))) / 20e0"
        parts[f"{prefix}_gene{i}"] = _each(_dense(prefix, f"gene{i}", source), soft if i == layers - 1 else "CASE WHEN v >= 0 THEN v ELSE 0.01e0 * v END")
        source = part(f"gene{i}")
    parts[f"{prefix}_n"] = _norm(part("h"))
    parts[f"{prefix}_t"] = _each(_dense(prefix, "type_in", part("n")), _gelu())
    both = f"(SELECT {_KEYS}, pos, h.v + r.v AS v FROM {part('h')} AS h JOIN {_dense(prefix, 'type_out', part('t'))} AS r USING ({_KEYS}, pos))"
    parts[f"{prefix}_q"] = _each(both, _gelu())
    parts[f"{prefix}_e"] = f"SELECT {_KEYS}, pos, exp((v - max(v) OVER (PARTITION BY {_KEYS})) / 2e0) AS v FROM {_dense(prefix, 'type_class', part('q'))}"
    parts[f"{prefix}_out"] = (
        f"SELECT {_KEYS}, expr, prob FROM (SELECT {_KEYS}, list(CAST(v AS FLOAT) ORDER BY pos) AS expr FROM {source} GROUP BY {_KEYS}) JOIN "
        f"(SELECT {_KEYS}, list(CAST(v / s AS FLOAT) ORDER BY pos) AS prob FROM (SELECT *, sum(v) OVER (PARTITION BY {_KEYS}) AS s FROM {part('e')}) GROUP BY {_KEYS}) USING ({_KEYS})")
    n_genes, n_types = p[f"gene{layers - 1}.b"].size, p["type_class.b"].size
    parts[f"{prefix}_bag"] = (
        "SELECT target_ord, count(*) AS n_grids, " + ", ".join(f"sum(CAST(expr[{i + 1}] AS DOUBLE)) AS e{i}" for i in range(n_genes)) + ", "
        + ", ".join(f"avg(CAST(prob[{i + 1}] AS DOUBLE)) AS q{i}" for i in range(n_types))
        + f", sum(-ln(greatest(CAST(list_max(prob) AS DOUBLE), 1e-8))) AS conf FROM {part('out')} GROUP BY 1")
    return parts


def loss_sql(prefix: str, n_genes: int, n_types: int, alpha: float, lambda_type: float) -> str:
    """Training loss of all spots of ``{spot_truth}`` that have grids, summed over spots and genes."""
    gaps = ["abs(ln(1 + greatest(e{i}, 0)) - ln(1 + greatest(t{i}, 0)))".format(i=i) for i in range(n_genes)]
    huber = " + ".join(f"CASE WHEN {g} <= 1 THEN 0.5 * {g} * {g} ELSE {g} - 0.5 END" for g in gaps)
    whole = "greatest(" + " + ".join(f"greatest(c{i}, 0)" for i in range(n_types)) + ", 1e-8)"
    kl = " + ".join(f"CASE WHEN c{i} > 0 THEN c{i} / {whole} * (ln(c{i} / {whole}) - ln(greatest(q{i}, 1e-8))) ELSE 0 END" for i in range(n_types))
    return f"""
        SELECT sum({huber}) + {lambda_type} * ({alpha} * sum(conf) / sum(n_grids) + (1 - {alpha}) * sum({kl}) / count(*)) AS loss
        FROM {{{prefix}_bag}} JOIN {{spot_truth}} ON spot = target_ord"""
