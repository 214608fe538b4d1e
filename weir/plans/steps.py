"""Lists of steps over DataFrames, as dicts or JSON files.

Every step is one operator call with one input; Spark sees the whole chain as a single
lazy plan, apart from steps that are saved.

A saved frame has no order of its own: its files are read in any order and split anew. So
every step tells in which order its rows are, and a saved step is sorted again by it where
it is read. Spark turns that sort and a following limit into one top-n.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.predicates import check_filter
from weir.operators.aggregate import METRIC_FNS, aggregate, aggregate_one
from weir.operators.basic import filter_rows
from weir.operators.changepoint import changepoint_step
from weir.operators.decompose import deseasonalize
from weir.operators.profile import EVIDENCE, evidence
from weir.operators.ranking import (
    RANK_METHODS,
    STEP_METHODS,
    check_limit,
    limit_rows,
    rank_columns,
    rank_order,
    rank_step,
    rank_step_order,
    sample_rows,
)
from weir.operators.resample import parse_freq, resample, resample_grouped
from weir.sources.sinks import FORMATS, materialize, write_frame

Params = Mapping[str, Any]


def _filters(p: Params) -> list[Params]:
    return list(p["filters"]) if "filters" in p else [p]


def _filter(df: DataFrame, p: Params) -> DataFrame:
    return filter_rows(df, _filters(p))


def _aggregate(df: DataFrame, p: Params) -> DataFrame:
    if "metrics" in p:
        return aggregate(df, p.get("groupby", []), p["metrics"])
    metric = p["metric"]
    group = p.get("group", [])
    if p.get("freq") and "eff_gas_day" in group:
        return resample_grouped(df, group, p["freq"], metric["col"], metric["fn"])
    return aggregate_one(df, group, metric["col"], metric["fn"])


def _resample(df: DataFrame, p: Params) -> DataFrame:
    return resample(df, p["freq"], p["on"], p.get("agg"))


def _limit(df: DataFrame, p: Params) -> DataFrame:
    return limit_rows(df, p["n"], p.get("offset", 0))


def _ordinal(p: Params) -> bool:
    return p.get("method") == "ordinal"


def _rank(df: DataFrame, p: Params) -> DataFrame:
    if _ordinal(p):
        return rank_step(df, p["by"], p.get("descending", True))
    return rank_columns(df, p["by"], p.get("method", "average"), p.get("descending", False))


def _rank_order(df: DataFrame, p: Params) -> list[Column]:
    """Order of what the rank step makes of ``df``."""
    if _ordinal(p):
        return rank_step_order(df)
    return rank_order(df, p["by"], p.get("descending", False))


def _evidence(df: DataFrame, p: Params) -> DataFrame:
    """Rows of the input, or with ``metrics`` (basic, nulls, numeric, strings) its profile.

    The profile is one table of (part, column, name, value). With a ``path`` the evidence is
    written there, also when no step reads it.
    """
    if p.get("columns"):
        df = df.select(*p["columns"])
    if p.get("metrics"):
        found = evidence(df, p["metrics"])
    else:
        found = sample_rows(df, p.get("sample_size", 100), p.get("method", "random"))
    return write_frame(found, p["path"], p.get("format", "parquet")) if p.get("path") else found


def _deseasonalize(df: DataFrame, p: Params) -> DataFrame:
    date_col = p.get("date_column", "eff_gas_day")
    column = p.get("column") or p["on"]
    series = p.get("series")
    if series is None:
        # The other text columns of an aggregated table name its series.
        series = [c for c, t in df.dtypes if t == "string"]
    seasonal = p.get("seasonal", ("weekly", "annual"))
    return deseasonalize(df, column, date_col, series, seasonal, p.get("trend_window", 365))


def _changepoint(df: DataFrame, p: Params) -> DataFrame:
    known = ("column", "date_column", "method", "cost", "min_size", "penalty")
    known += ("min_confidence", "groupby", "jump")
    return changepoint_step(df, **{k: p[k] for k in known if k in p})


def _save(df: DataFrame, p: Params) -> DataFrame:
    return write_frame(df, p["path"], p.get("format", "parquet"), p.get("overwrite", True))


STEPS: dict[str, Callable[[DataFrame, Params], DataFrame]] = {
    "filter": _filter,
    "aggregate": _aggregate,
    "resample": _resample,
    "limit": _limit,
    "rank": _rank,
    "evidence_collect": _evidence,
    "stl_deseasonalize": _deseasonalize,
    "changepoint": _changepoint,
    "save_artifact": _save,
}
# Steps that leave the rows in the order they came in.
KEEP_ORDER = ("filter", "limit", "save_artifact")
# Steps whose rows have no order, so that a limit has to choose one.
UNORDERED = ("aggregate", "resample", "changepoint", "stl_deseasonalize")
# Steps that are run again for each reader.
CHEAP = ("filter", "limit", "save_artifact")
REQUIRED = {
    "resample": ("freq", "on"),
    "limit": ("n",),
    "rank": ("by",),
    "changepoint": ("column",),
    "save_artifact": ("path",),
}


def check_step(op: str, p: Params) -> None:
    """Raise ValueError for parameters the step cannot run with."""
    if op not in STEPS:
        raise ValueError(f"unknown step {op!r}; choose from {sorted(STEPS)}")
    for name in REQUIRED.get(op, ()):
        if p.get(name) in (None, "", []):
            raise ValueError(f"{op} needs {name!r}")
    if op == "filter":
        for f in _filters(p):
            check_filter(f.get("column"), f.get("op"), f.get("value"))
    elif op == "aggregate":
        metrics = p.get("metrics") or ([p["metric"]] if p.get("metric") else [])
        if not metrics:
            raise ValueError("aggregate needs metrics")
        for metric in metrics:
            if "col" not in metric or "fn" not in metric:
                raise ValueError("a metric has 'col' and 'fn'")
            if metric["fn"].lower() not in (*METRIC_FNS, "mean", "median"):
                raise ValueError(f"unsupported aggregation function {metric['fn']!r}")
    elif op == "resample":
        parse_freq(p["freq"])
    elif op == "limit":
        check_limit(p["n"], p.get("offset", 0))
    elif op == "rank" and p.get("method", "average") not in (*RANK_METHODS, *STEP_METHODS):
        raise ValueError(f"unsupported rank method {p['method']!r}")
    elif op == "evidence_collect":
        if p.get("sample_size", 100) < 1:
            raise ValueError("sample_size is 1 or more")
        if set(p.get("metrics") or ()) - set(EVIDENCE):
            raise ValueError(f"evidence metrics are {sorted(EVIDENCE)}")
    elif op == "stl_deseasonalize" and not (p.get("column") or p.get("on")):
        raise ValueError("stl_deseasonalize needs a column")
    elif op == "save_artifact" and p.get("format", "parquet") not in FORMATS:
        raise ValueError(f"unknown format {p['format']!r}")


def run_steps(
    spec: Mapping[str, Any], inputs: Mapping[str, DataFrame], keep: str = "auto"
) -> DataFrame:
    """Result of the first output of ``{"nodes", "edges", "inputs", "outputs"}``.

    A node is ``{"id", "op", "params"}``, an edge ``{"src", "dst"}``; a node has exactly
    one input. Saving steps run even when nothing reads them. ``keep`` decides what
    happens to a result that several steps read: ``auto`` writes it to the work folder when
    it took more than filters to make (a pushed-down filter is cheaper to run again),
    ``all`` writes every step, ``never`` leaves everything to Spark.
    """
    if keep not in ("auto", "all", "never"):
        raise ValueError("keep is 'auto', 'all' or 'never'")
    nodes = {}
    for node in spec["nodes"]:
        if node["id"] in nodes or node["id"] in inputs:
            raise ValueError(f"step id {node['id']!r} is used twice")
        check_step(node["op"], node.get("params", {}))
        nodes[node["id"]] = node
    readers: dict[str, list[str]] = {}
    source: dict[str, str] = {}
    for edge in spec.get("edges", []):
        src, dst = edge["src"], edge["dst"]
        if dst not in nodes or (src not in nodes and src not in inputs):
            raise ValueError(f"edge {src!r} -> {dst!r} names an unknown step")
        if dst in source:
            raise ValueError(f"step {dst!r} has more than one input")
        source[dst] = src
        readers.setdefault(src, []).append(dst)
    results: dict[str, DataFrame] = dict(inputs)
    # Order of each result; None where there is none, missing for the inputs.
    orders: dict[str, list[Column] | None] = {}

    def result_of(name: str, waiting: tuple[str, ...] = ()) -> DataFrame:
        if name in waiting:
            raise ValueError(f"steps form a circle at {name!r}")
        if name in results:
            return results[name]
        if name not in source:
            raise ValueError(f"step {name!r} has no input")
        op, params = nodes[name]["op"], nodes[name].get("params", {})
        before = result_of(source[name], (*waiting, name))
        if op == "rank":
            orders[name] = _rank_order(before, params)
        elif op in KEEP_ORDER and source[name] in orders:
            orders[name] = orders[source[name]]
        elif op in UNORDERED:
            orders[name] = None
        if op == "limit" and name in orders and orders[name] is None:
            orders[name] = [F.col(c).asc_nulls_last() for c in before.columns]
            before = before.orderBy(*orders[name])
        df = STEPS[op](before, params)
        shared = len(readers.get(name, [])) > 1 and op not in CHEAP
        stored = op == "save_artifact"
        if keep == "all" or (keep == "auto" and shared):
            df, stored = materialize(df), True
        if stored and orders.get(name):
            df = df.orderBy(*orders[name])
        results[name] = df
        return df

    outputs = spec.get("outputs") or [spec["nodes"][-1]["id"]]
    if outputs[0] not in nodes:
        raise ValueError(f"unknown output {outputs[0]!r}")
    for name, node in nodes.items():
        if node["op"] == "save_artifact" or (
            node["op"] == "evidence_collect" and node.get("params", {}).get("path")
        ):
            result_of(name)
    return result_of(outputs[0])


def load_steps(path: str) -> dict[str, Any]:
    """Read a step list from a JSON file."""
    with open(path, encoding="utf-8") as handle:
        spec = json.load(handle)
    if not isinstance(spec, dict) or "nodes" not in spec:
        raise ValueError("a step list has 'nodes'")
    return spec

