"""The language model: counts and base scores against plain ones, slopes against differences, whole documents against one step at a time."""

from __future__ import annotations

import math
import re
import resource
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import gated_lm
from palimpsest.llm.queries import QUERIES
from palimpsest.llm.shared import keep_freed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = object()


def tokens(text: str | None) -> list:
    return [*WORD.findall((text or "").translate(AZ)), END]


def is_held(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def plain_base(rows: list[tuple]) -> tuple[Counter, dict]:
    count = Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    score = lambda t: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    return count, Counter((i, is_held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(score(t), 5)) for i, t in rows)


@pytest.mark.parametrize("frequent", [0, 40, gated_lm.FREQUENT])
@pytest.mark.parametrize("name", ["docs", "hostile", "empty"])
def test_base(request, monkeypatch, name, frequent):
    """Also where nearly all words go through the join."""
    table = request.getfixturevalue(name)
    words = min(frequent, gated_lm.WORDS)
    vocabulary = gated_lm.vocabulary
    monkeypatch.setattr(gated_lm, "vocabulary", lambda counts, ends: vocabulary(counts, ends, words, frequent))
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = gated_lm.scored(table).collect()
    assert Counter((*r[:5], round(r["base_score"], 5)) for r in got) == plain_base(rows)[1]
    assert all(r["score"] < 0 for r in got)


def small(dtype=np.float32, hidden: int = 5) -> gated_lm.Network:
    rng = np.random.default_rng(2)
    counts = np.array([40, 10, 30, 20, 9, 8, 7, 3, 3, 2, 2, 1])
    shape = gated_lm.Shape(hidden=hidden)
    net = gated_lm.Network(counts, shape)
    return gated_lm.Network(counts, shape, (net.flat + rng.normal(0, 0.3, len(net.flat))).astype(dtype))


def test_every_position_has_a_slope(monkeypatch):
    """Also the first steps of long windows, and what is left beyond whole lanes."""
    net, seen = small(), []
    monkeypatch.setattr(net, "slope", lambda before, after, state: seen.append(after.size) or np.zeros_like(net.flat))
    for n in (1, 63, 64, 1000, 1003):
        seen.clear()
        gated_lm.Learner(net, gated_lm.Round(1, 8, 64, 0.01)).stream((np.arange(n) % 12).astype(np.uint16))
        assert sum(seen) == n


def loss(net: gated_lm.Network, before: np.ndarray, after: np.ndarray) -> float:
    state = np.zeros((net.shape.hidden, before.shape[1]), net.flat.dtype)
    return -float(net.told(net.steps(before, state).reshape(net.shape.hidden, -1), after.ravel())[0].mean())


def test_slope():
    """Against differences of the loss, in double precision, with ends inside the window."""
    net = small(np.float64)
    rng = np.random.default_rng(3)
    stream = rng.integers(0, 12, (9, 4)).astype(np.uint16)
    stream[4, 1] = stream[0, 2] = stream[2, 2] = gated_lm.END
    before, after = stream[:-1], stream[1:]
    got = net.slope(before, after, np.zeros((5, 4)))
    used = sum(int(np.prod(s)) for s in net.sizes)
    for i in range(used):
        held = net.flat[i]
        net.flat[i] = held + 1e-5
        up = loss(net, before, after)
        net.flat[i] = held - 1e-5
        assert abs((up - loss(net, before, after)) / 2e-5 - got[i]) < 1e-7
        net.flat[i] = held
    assert np.abs(got[:used]).sum() > 0.1 and not got[used:].any()


def plain_log(net: gated_lm.Network, ids: list[int]) -> float:
    """One document, word by word, in double precision."""
    h, total, last = np.zeros(net.shape.hidden), 0.0, gated_lm.END
    k = net.shape.hidden
    part = [x.astype(np.float64) for x in (net.words, net.turn, net.to_class, net.class_bias, net.to_word, net.word_bias)]
    for w in ids:
        gate, turned = part[0][:, last], part[1] @ h
        reset, update = (1 / (1 + np.exp(-(gate[s] + turned[s]))) for s in (slice(0, k), slice(k, 2 * k)))
        h = update * h + (1 - update) * np.tanh(gate[2 * k :] + reset * turned[2 * k :])
        own = int(net.of[w])
        x = part[2] @ h + part[3]
        total += x[own] - np.log(np.exp(x).sum())
        lo, hi = net.starts[own], net.starts[own + 1]
        x = part[4][lo:hi] @ h + part[5][lo:hi]
        total += x[w - lo] - np.log(np.exp(x).sum())
        last = w
    return float(total)


@pytest.mark.parametrize("lanes,window", [(1, 3), (3, 7), (64, 64)])
def test_whole_documents(lanes, window):
    """Documents of all lengths, among them very long ones, at any width: the state is carried over windows and never over documents."""
    net, rng = small(), np.random.default_rng(7)
    docs = [[*rng.choice([0, *range(2, 12)], int(n)).tolist(), gated_lm.END] for n in [0, 1, 2, 5, 63, 64, 65, 700, 3, 0, 130]]
    places = np.cumsum([0, *map(len, docs)])
    got = gated_lm.likelihoods(net, np.concatenate(docs).astype(np.uint16), places, lanes, window)
    assert np.allclose(got, [plain_log(net, d) for d in docs], rtol=1e-5, atol=1e-4)


def test_probabilities_sum_to_one():
    net = small()
    states = np.random.default_rng(1).normal(size=(5, 1)).astype(np.float32)
    every = np.arange(12, dtype=np.uint16)
    assert np.isclose(np.exp(net.told(np.repeat(states, 12, axis=1), every)[0]).sum(), 1, atol=1e-5)
    v = gated_lm.Vocabulary(np.arange(3, dtype=np.uint64), np.array([7, 5, 2]), np.array([2, 0, 0], np.uint16), 4, 18, 4)
    assert np.isclose((5 + 0.1 + 2 + 0.1 + 0.1) / v.others(), 1) and v.base() == 18 + 0.5


def test_shares_beyond_the_range_of_exp():
    """Weights so great that exponentials of single precision overflow or vanish: as in double precision, where they don't."""
    net, rng = small(), np.random.default_rng(5)
    net.word_bias[:] = rng.permutation(len(net.word_bias)) * 40
    net.class_bias[:] = rng.permutation(len(net.class_bias)) * -60 - 50
    wide = gated_lm.Network(np.array([40, 10, 30, 20, 9, 8, 7, 3, 3, 2, 2, 1]), net.shape, net.flat.astype(np.float64))
    states, after = rng.normal(0, 0.5, (5, 300)), rng.integers(0, 12, 300).astype(np.uint16)
    slopes = [np.zeros_like(x.flat) for x in (net, wide)]
    got = net.told(states.astype(np.float32), after, net.parts(slopes[0]))
    want = wide.told(states, after, wide.parts(slopes[1]))
    assert np.allclose(got[0], want[0], rtol=1e-5, atol=1e-3) and np.allclose(got[1], want[1], atol=1e-5) and np.allclose(slopes[0], slopes[1], atol=1e-5)
    assert want[0].min() < -100
    first, last = wide.to_class @ states + wide.class_bias[:, None], wide.to_word @ states + wide.word_bias[:, None]
    own = wide.of[after]
    for i in range(300):
        inside = last[wide.starts[own[i]] : wide.starts[own[i] + 1], i]
        plain = first[own[i], i] - np.logaddexp.reduce(first[:, i]) + last[after[i], i] - np.logaddexp.reduce(inside)
        assert np.isclose(want[0][i], plain)


def test_windows_take_no_new_memory():
    """Once some windows are done, a worker's arrays come from memory that it holds: thousands of pages anew for each took a third of the time."""
    keep_freed()
    shape = gated_lm.Shape()
    net, ids = gated_lm.Network(np.arange(2048, 0, -1), shape), np.random.default_rng(4).integers(0, 2048, (65, 128)).astype(np.uint16)
    window = lambda: net.slope(ids[:-1], ids[1:], np.zeros((shape.hidden, 128), np.float32))
    for _ in range(3):
        window()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(10):
        window()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 5000


def test_training_uses_every_document_once(docs):
    seen = []
    vocab = gated_lm.vocabulary(gated_lm.counted(docs), docs.count())
    rows = gated_lm.encoded(docs, vocab)
    low = 0
    for turn in gated_lm.ROUNDS:
        seen += [r["doc_id"] for r in rows.where(f"part between {low} and {low + turn.parts - 1}").collect()]
        low += turn.parts
    assert sorted(seen) == sorted(r["doc_id"] for r in docs.collect()) and low == 64


def test_weights_alike_in_any_order(spark, docs):
    vocab = gated_lm.vocabulary(gated_lm.counted(docs), docs.count())
    rows = gated_lm.encoded(docs.coalesce(1), vocab)
    shape = gated_lm.Shape(hidden=8)
    assert np.array_equal(gated_lm.trained(rows, vocab, shape), gated_lm.trained(rows, vocab, shape))


def test_held_out_text_is_likelier_than_by_counts(spark):
    """On documents that it didn't learn from, after one pass over a thousand others, the network beats the counts."""
    got = QUERIES["op13_gated_recurrent_lm"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert len(got) > 50
    assert sum(r["score"] for r in got) > 0.97 * sum(r["base_score"] for r in got)


def test_learns_an_order(spark):
    """Words that follow one another in a circle: nearly certain once learned, though by count all are alike."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{(s + k) % 20}" for k in range(200))) for i, s in enumerate(rng.integers(0, 20, 600).tolist())]
    got = gated_lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    share = sum(r["score"] for r in got) / sum(r["base_score"] for r in got)
    assert share < 0.5
