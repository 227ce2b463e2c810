"""States of kernels as text that can be stored, checked and read again: no pickle.

A state is JSON with a format number, the kernel's class, a SHA-256 digest of
its body and the body. Numbers keep all their bits. Reading gives a kernel only
if digest, format, classes, attributes and the shapes of its models are what a
fresh kernel of the same settings has; else ``StateError`` says what is wrong.
"""

from __future__ import annotations

import hashlib
import json
import random
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import sequential

FORMAT = 1
#: A small instance of each class that a state may hold; it tells the attributes.
_LIKE = {type(o).__name__: o for o in (
    sequential.RecursiveLeastSquares(1), sequential.AdaptiveInterval(), sequential.Reference(), sequential.PageHinkley(), sequential.AdaptiveWindow(), sequential.FeatureShift(), sequential.Cooldown(),
    sequential.Buffer(), sequential.Standardiser(1), sequential.ScopeLearner(1, ""), sequential.Hysteresis())}


class StateError(ValueError):
    """A stored state that cannot be used."""


def _plain(value):
    """``value`` in JSON's types, tagged where those are not enough."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return float(value)
    if isinstance(value, np.ndarray):
        return {"array": list(value.shape), "of": [float(v) for v in value.ravel()]}
    if isinstance(value, deque):
        return {"deque": [_plain(v) for v in value], "most": value.maxlen}
    if isinstance(value, (list, tuple)):
        return {type(value).__name__: [_plain(v) for v in value]}
    if isinstance(value, dict):
        return {"dict": [[_plain(k), _plain(v)] for k, v in value.items()]}
    if isinstance(value, random.Random):
        return {"random": _plain(value.getstate())}
    if type(value).__name__ in _LIKE:
        return {"kernel": type(value).__name__, "of": {k: _plain(v) for k, v in vars(value).items()}}
    raise StateError(f"a state cannot hold {type(value).__name__}")


def _value(plain):
    if not isinstance(plain, dict):
        return plain
    if "array" in plain:
        return np.array(plain["of"], float).reshape(plain["array"])
    if "deque" in plain:
        return deque((_value(v) for v in plain["deque"]), maxlen=plain["most"])
    if "list" in plain:
        return [_value(v) for v in plain["list"]]
    if "tuple" in plain:
        return tuple(_value(v) for v in plain["tuple"])
    if "dict" in plain:
        return {_value(k): _value(v) for k, v in plain["dict"]}
    if "random" in plain:
        out = random.Random()
        out.setstate(_value(plain["random"]))
        return out
    like = _LIKE.get(plain.get("kernel"))
    if like is None:
        raise StateError(f"no kernel {plain.get('kernel')!r}")
    if set(plain["of"]) != set(vars(like)):
        raise StateError(f"{plain['kernel']} has other attributes: {sorted(set(plain['of']) ^ set(vars(like)))}")
    out = type(like).__new__(type(like))
    out.__dict__.update({k: _value(v) for k, v in plain["of"].items()})
    return out


def _models(value) -> set[tuple[int, ...]]:
    """Shapes of all linear models that a kernel holds."""
    if isinstance(value, sequential.RecursiveLeastSquares):
        if not (np.isfinite(value.w).all() and np.isfinite(value.p).all()):
            raise StateError("a model is not finite")
        return {(*value.w.shape, *value.p.shape)}
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, (list, tuple)) else vars(value).values() if type(value).__name__ in _LIKE else ()
    return set().union(*map(_models, inner)) if inner else set()


def encode(kernel) -> str:
    body = json.dumps(_plain(kernel), separators=(",", ":"), sort_keys=True)
    return json.dumps({"format": FORMAT, "digest": hashlib.sha256(body.encode()).hexdigest(), "body": body})


def decode(text: str | None, like=None):
    """The kernel; ``like``, a fresh one, tells what class and model shapes are expected."""
    try:
        whole = json.loads(text)
        fmt, digest, body = whole["format"], whole["digest"], whole["body"]
        if fmt != FORMAT:
            raise StateError(f"format {fmt}, not {FORMAT}")
        if hashlib.sha256(body.encode()).hexdigest() != digest:
            raise StateError("the digest does not match")
        kernel = _value(json.loads(body))
        if like is not None:
            if type(kernel) is not type(like):
                raise StateError(f"a {type(kernel).__name__}, not a {type(like).__name__}")
            found, wanted = _models(kernel), _models(like)
            if wanted and not found <= wanted:
                raise StateError(f"models of shape {sorted(found - wanted)}, not {sorted(wanted)}")
    except StateError:
        raise
    except (TypeError, ValueError, KeyError, IndexError, AttributeError) as error:
        raise StateError(f"unreadable: {error}") from error
    return kernel


def save(states: DataFrame, path: str, version: int) -> None:
    """Store states (key columns and ``state``) as a version; a version is never written twice."""
    states.write.parquet(f"{path.rstrip('/')}/version={version}")


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The states of a version, the newest unless given."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version").alias("v")).first().v
    return stored.filter(F.col("version") == version).drop("version")
