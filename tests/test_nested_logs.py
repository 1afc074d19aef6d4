"""Nested extras of log lines as paths, kinds and masked values."""

from __future__ import annotations

import json
import random

from packlens.sources import logs


def by_hand(value, path="$", secret=False):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            low = k.lower()
            hidden = any(m in low for m in logs.SECRET_MARKERS) and not (low.endswith("_tokens") or low == "tokens")
            yield from by_hand(v, f"{path}.{k}", secret or hidden)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from by_hand(v, f"{path}[{i}]", secret)
    elif secret:
        yield path, logs.MASK
    elif value is None or isinstance(value, (dict, list)):
        yield path, None
    else:
        yield path, str(value).lower() if isinstance(value, bool) else str(value)


def some_value(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind < 4:
        return [rng.randrange(100), f"t{rng.randrange(9)}", rng.random() < 0.5, None][kind]
    if kind == 4:
        return [some_value(rng, depth - 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["a", "Password", "input_tokens", "x_api_key", "tokens", "b c", "token"]): some_value(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_leaves_of_any_depth(spark):
    rng = random.Random(11)
    values = [{"k": some_value(rng, 5)} for _ in range(150)] + [{}, [], 7, "text", None]
    rows = [(i, json.dumps(v), "x") for i, v in enumerate(values)] + [(900, None, "x"), (901, "{cut", "x"), (902, "", "x")]
    frame = spark.createDataFrame(rows, "event_id long, line string, path string")
    got = sorted(((r["event_id"], r["path"], r["value"]) for r in logs.leaves(frame, "event_id").collect()), key=str)
    assert got == sorted(((i, p, v) for i, x in enumerate(values) for p, v in by_hand(x)), key=str)
    assert logs.leaves(frame.limit(0), "event_id").collect() == []


def test_kinds_are_kept(spark):
    frame = spark.createDataFrame([(1, '{"n": 3, "x": 1.5, "s": "3", "b": true, "z": null, "e": {}}')], "event_id long, line string")
    kinds = {r["path"]: r["kind"] for r in logs.leaves(frame, "event_id").collect()}
    assert kinds == {"$.n": "BIGINT", "$.x": "DECIMAL", "$.s": "STRING", "$.b": "BOOLEAN", "$.z": "VOID", "$.e": "OBJECT"}
