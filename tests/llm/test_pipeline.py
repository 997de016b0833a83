"""The pipeline: stages on odd rows, the whole against its stages by brute force."""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from chunkloom.llm import common as C
from chunkloom.llm import decontaminate as D
from chunkloom.llm import packing as P
from chunkloom.llm import quality as Q
from chunkloom.llm import secret_scan as S
from chunkloom.llm import simhash as H



def naive(text: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).lower()) if not unicodedata.combining(c))
    return "".join(c if c.isalnum() else " " for c in plain).split()


DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, sf_dir, odd, k):
    out = corpus_pipeline.STAGES[k][1](spark, odd, sf_dir)
    rows = out.collect()
    assert rows
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == odd.columns and {x.doc_id for x in rows} <= {x.doc_id for x in odd.collect()}
    assert corpus_pipeline.STAGES[k][1](spark, odd.limit(0), sf_dir).count() == 0


def test_run_equals_brute_force(spark, sf_dir):
    rows = {x.doc_id: x.text for x in C.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    ids = list(rows)
    keep = Q.verdict(*Q.ratios(pa.array([rows[i] for i in ids], pa.string())))
    ids = [i for i, k in zip(ids, keep) if k]
    fp, some = H.fingerprint_array(pa.array([rows[i] for i in ids]))
    near = (np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1) <= H.LIMIT) & some[:, None] & some[None]
    seen, stay = set(), []
    for k in np.argsort(ids).tolist():
        if k in seen:
            continue
        todo, group = [k], {k}
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        stay.append(ids[min(group, key=lambda j: ids[j])])
    items = [naive(x.text) for x in C.table(spark, sf_dir, "benchmark").collect()]
    windows = {" ".join(w[i : i + D.WINDOW]) for w in items if len(w) >= D.SHORTEST for i in range(max(1, len(w) - D.WINDOW + 1))}
    stay = [i for i in stay if not any(f" {w} " in f" {' '.join(naive(rows[i]))} " for w in windows)]
    model = S.learn(S.labelled())
    texts = {}
    for i in stay:
        t, at, parts = rows[i], 0, []
        for _, a, b, *_ in sorted(S.found(model, pa.array([rows[i]]))):
            parts += [t[at:a], S.MASK]
            at = b
        texts[i] = "".join(parts) + t[at:]
    key, n = P.keys_of(pa.array(list(texts.values())))
    want, at = {}, 0
    for _, i, m in sorted((int(k), i, int(m)) for k, i, m in zip(key, texts, n) if m):
        for p in range(at // P.CAPACITY, (at + m - 1) // P.CAPACITY + 1):
            a, b = max(at, p * P.CAPACITY), min(at + m, (p + 1) * P.CAPACITY)
            want[p, i, a - at] = (a - p * P.CAPACITY, b - at)
        at += m
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(x.pack_id, x.doc_id, x.doc_start): (x.pack_start, x.doc_end) for x in out} == want and len(out) == len(want)
    whole = {}
    for x in sorted(out, key=lambda x: x.pack_id):
        whole[x.doc_id] = whole.get(x.doc_id, "") + x.text
    assert whole == {i: t for i, t in texts.items() if i in whole} and set(whole) == {i for i, m in zip(texts, n) if m}
