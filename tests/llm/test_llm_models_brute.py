"""The trained models against plain loops: the whole training, not only its outcome."""

import math
import os
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assetloom.llm.quality import LABELLERS, Settings as QualitySettings, _Reader, fit_votes, score_quality, train_quality
from assetloom.llm.queries import all_queries
from assetloom.llm.toxicity import Settings, _Sample, train_nnpu

SF_DIR = "/root/testdata/sf0.001"


def log1pexp(z):
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def risk(w, b, positive, unlabelled, prior):
    """The non-negative risk, as defined."""

    def g(x):
        return b + sum(wi * xi for wi, xi in zip(w, x, strict=True))

    on_positive = sum(log1pexp(-g(x)) for x in positive) / len(positive)
    against = sum(log1pexp(g(x)) for x in positive) / len(positive)
    clean = sum(log1pexp(g(x)) for x in unlabelled) / len(unlabelled) - prior * against
    return prior * on_positive + max(0.0, clean), clean


def dense(sample, n, k):
    out = [[0.0] * k for _ in range(n)]
    for d in range(n):
        for at, v in zip(sample.place[sample.ends[d] : sample.ends[d + 1]], sample.value[sample.ends[d] : sample.ends[d + 1]], strict=True):
            out[d][at] += v
    return out


def plain_nnpu(positive, unlabelled, k, prior, s, seed):
    """The same descent in loops, with slopes found by differences of the risk."""
    rng = np.random.default_rng(seed)
    w, b, grown, grown_b = [0.0] * k, -1.0, [1e-4] * k, 1e-4
    n_pos, n_unl = len(positive), len(unlabelled)
    size_u, size_p = min(s.batch, n_unl), max(1, min(n_pos, s.batch // 4))
    turned = 0
    for _ in range(s.epochs):
        order_p, order_u = rng.permutation(n_pos), rng.permutation(n_unl)
        for t in range(n_unl // size_u):
            some_p = [positive[order_p[i % n_pos]] for i in range(t * size_p, (t + 1) * size_p)]
            some_u = [unlabelled[i] for i in order_u[t * size_u : (t + 1) * size_u]]
            _, clean = risk(w, b, some_p, some_u, prior)
            turned += clean < 0

            def value(w_, b_, some_p=some_p, some_u=some_u, clean=clean):
                whole, part = risk(w_, b_, some_p, some_u, prior)
                # below zero the step goes up the second part instead
                return whole - max(0.0, part) + part if clean >= 0 else -part

            h = 1e-5
            slopes = []
            for j in range(k):
                up, down = list(w), list(w)
                up[j] += h
                down[j] -= h
                slopes.append((value(up, b) - value(down, b)) / (2 * h))
            slope_b = (value(w, b + h) - value(w, b - h)) / (2 * h)
            for j in range(k):
                grown[j] += slopes[j] ** 2
                w[j] -= s.rate * slopes[j] / math.sqrt(grown[j])
            grown_b += slope_b**2
            b -= s.rate * slope_b / math.sqrt(grown_b)
    return w, b, turned


@pytest.mark.parametrize(("prior", "batch"), [(0.2, 16), (0.6, 16), (0.9, 4)])
def test_whole_training_in_plain_loops(prior, batch):
    rng = np.random.default_rng(3)
    k = 4
    docs_p = [np.unique(rng.choice(k, rng.integers(1, 4), p=[0.5, 0.3, 0.1, 0.1])) for _ in range(9)]
    docs_u = [np.unique(rng.choice(k, rng.integers(0, 4), p=[0.2, 0.2, 0.3, 0.3])) for _ in range(32)]
    docs_u += docs_u[:4]  # repeated rows
    rarity = np.array([1.0, 0.7, 0.4, 0.2])
    p, u = _Sample(docs_p, np.arange(k), rarity), _Sample(docs_u, np.arange(k), rarity)
    s = Settings(batch=batch, epochs=3, rate=0.3)
    w, b = train_nnpu(p, u, len(docs_p), len(docs_u), k, prior, s, 11)
    want_w, want_b, turned = plain_nnpu(dense(p, len(docs_p), k), dense(u, len(docs_u), k), k, prior, s, 11)
    np.testing.assert_allclose(w, want_w, atol=1e-5)
    assert b == pytest.approx(want_b, abs=1e-5)
    # the correction of the risk takes place
    assert turned > 0 or prior < 0.9


def plain_em(votes, rounds):
    """EM document by document: the posterior of each document's votes."""
    n = len(votes[0]) if votes else 0
    post = [(v.count("1") + 1) / (v.count("1") + 4 * v.count("0") + 2) for v in votes]
    for _ in range(rounds):
        rates = []
        for c in (0, 1):
            mine = [p if c else 1 - p for p in post]
            rows = []
            for j in range(n):
                good = 1 + sum(m for m, v in zip(mine, votes, strict=True) if v[j] == "1")
                bad = 1 + sum(m for m, v in zip(mine, votes, strict=True) if v[j] == "0")
                rows.append({"1": good / (good + bad), "0": bad / (good + bad)})
            rates.append(rows)
        share = (sum(post) + 1) / (len(votes) + 2)
        new = []
        for v in votes:
            logs = [math.log(1 - share), math.log(share)]
            for c in (0, 1):
                logs[c] += sum(math.log(rates[c][j][v[j]]) for j in range(n) if v[j] != "-")
            new.append(1 / (1 + math.exp(max(-500, min(500, logs[0] - logs[1])))))
        moved = max(abs(a - b) for a, b in zip(new, post, strict=True))
        post = new
        if moved < 1e-6:
            break
    return post


def test_em_in_plain_loops():
    rng = np.random.default_rng(5)
    truth = rng.random(400) < 0.7
    votes = ["".join("-" if rng.random() < 0.2 else str(int(t ^ (rng.random() > q))) for q in (0.9, 0.8, 0.7, 0.95)) for t in truth]
    votes += ["----", "1111", "0000"] + votes[:50]
    posterior, _, _ = fit_votes(Counter(votes), 40)
    for v, p in zip(votes, plain_em(votes, 40), strict=True):
        assert posterior[v] == pytest.approx(p, abs=1e-9)


def test_quality_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in all_queries()["op7_quality"](spark, SF_DIR).collect()}
    assert set(got) == set(docs)
    read = _Reader()
    votes = {d: read(t)[0] for d, t in docs.items()}
    assert all(len(v) == len(LABELLERS) for v in votes.values())
    order = list(docs)
    for d, p in zip(order, plain_em([votes[d] for d in order], QualitySettings().em_rounds), strict=True):
        assert got[d]["weak_label"] == pytest.approx(p, abs=1e-6)
    for r in got.values():
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["kept"] == (r["predicted"] == 1)
    agree = sum((r["weak_label"] >= 0.5) == (r["score"] >= 0.5) for r in got.values())
    assert agree >= 0.9 * len(got)


def test_quality_of_repeated_and_odd_rows(spark):
    good = "A plain sentence of words that reads well. Another one follows it, and says a little more. " * 6
    bad = "@@@@ #### 1234 BUY BUY BUY BUY BUY!!! $$$ " * 10
    rows = [(i, good + str(i)) for i in range(30)] + [(100 + i, bad) for i in range(20)]
    rows += [(1, good + "1"), (None, None), (500, ""), (501, "\n \t"), (502, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id bigint, text string, score string")
    out = score_quality(docs, train_quality(docs))
    assert out.columns == ["doc_id", "text", "weak_label", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"] or "", set()).add((r["weak_label"], r["score"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert all(r["predicted"] == 1 for r in got if (r["text"] or "").startswith("A plain"))
    assert all(r["predicted"] == 0 for r in got if (r["text"] or "").startswith("@@@@"))
    model = train_quality(docs.limit(0))
    assert score_quality(docs.limit(0), model).count() == 0
