"""More secret rules than a number has bits."""

import re

from corvane.llm import secrets


def test_more_rules_than_bits(spark):
    rules = tuple(secrets.Rule(f"kind{i}", rf"key{i:03d}x[0-9]{{3}}", 0, 0) for i in range(130))
    texts = [f"a key{i:03d}x12{i % 10} b key{(i * 7) % 130:03d}x999 key{i:03d}x1" for i in range(130)] + ["none", None]
    found = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules).collect()
    for r in found:
        wanted = sorted((m.start(), i, m.end(), f"kind{i}") for i in range(130) for m in re.finditer(rf"key{i:03d}x[0-9]{{3}}", r["text"] or ""))
        assert [tuple(s) for s in r["secrets"]] == wanted
    assert sum(len(r["secrets"]) for r in found) > 200
