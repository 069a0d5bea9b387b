"""Line de-duplication: lines that only begin alike form no pairs."""

from __future__ import annotations

import numpy as np

from millwright.llm import line_dedup


def test_lines_that_begin_alike_make_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    begin = [f"r{i}" for i in range(8)]                    # rarer than the words behind: the shared prefix tokens
    texts = [" ".join(begin + [f"v{k}" for k in rng.integers(0, 10, 30)]) for _ in range(40)]
    texts.append(texts[0] + " v0")                         # one real near copy
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, write = [], line_dedup.written

    def counted(df, name):
        out = write(df, name)
        if name == "line-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    got = {r["doc_id"]: list(r["removed_lines"]) for r in line_dedup.summary(docs).collect()}
    assert got == {d: [0] if d == 40 else [] for d in range(41)}
    assert 1 <= sum(pairs) <= 41                           # all pairs: 820
