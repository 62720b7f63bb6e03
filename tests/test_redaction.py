"""Recursive redaction against a plain recursion."""

from __future__ import annotations

import json
import random
import re

from evidentia.functions import text as X
from evidentia.operators import redaction


def plain(value, patterns):
    if isinstance(value, dict):
        return {k: "[REDACTED]" if sensitive(k) else plain(v, patterns) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v, patterns) for v in value]
    if isinstance(value, str):
        for pattern, replacement in patterns:
            value = re.sub(pattern, replacement, value)
    return value


def sensitive(key):
    flat = re.sub("[^a-z0-9]", "", key.lower())
    return key.lower() in X.SENSITIVE_KEYS or any(re.search(m, flat) for m in X.SENSITIVE_MARKERS)


def grown(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["plain", "sk-abcdefghij1234567890", "ü \"quoted\" \n", "", 7, -3, True, None])
    if rng.random() < 0.5:
        return [grown(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    names = ["a", "note", "api_key", "Token", "pass word", "é", "list", ""]
    return {k: grown(rng, depth - 1) for k in rng.sample(names, rng.randint(0, 4))}


def test_nested_values_of_any_depth(spark):
    rng = random.Random(4)
    values = [grown(rng, d) for d in range(6) for _ in range(30)] + [{"a": [[[[[[[{"secret": 1, "b": ["x"]}]]]]]]]}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "{not json"), (902, ""), (903, "[]"), (904, "{}")]
    frame = spark.createDataFrame(rows, "id long, body string")
    got = {r["id"]: r["redacted"] for r in redaction.redact_json(frame, "id", "body").collect()}
    assert set(got) == {r[0] for r in rows}
    # The patterns are plain ones, written alike in both languages but for group references.
    patterns = [(p.replace("(?i)", "(?i)"), re.sub(r"\$(\d)", r"\\\1", r)) for p, r in X.SECRETS]
    for i, value in enumerate(values):
        want = json.dumps(plain(value, patterns), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert json.loads(got[i]) == json.loads(want), value
        assert got[i] == want
    assert got[900] is None and got[901] is None and got[903] == "[]" and got[904] == "{}"
    assert redaction.redact_json(frame.limit(0), "id", "body").count() == 0
