"""The mixer in Java against a plain one, decision by decision; probabilities; what scores don't depend on."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.llm import lm_mix as L

M32, M64, POLY, MIX, TREE = 0xFFFFFFFF, (1 << 64) - 1, 0x9E3779B97F4A7C15, 0x85EBCA6B, 0x9E3779B1
DOCS = "doc_id long, text string, score string, model string, held_out string"


def mixed(h):
    h ^= h >> 16
    h = h * MIX & M32
    return h ^ h >> 13


def contexts(t, i):
    h, out = 0, []
    for j in range(1, 7):
        h = (h + (t[i - j] if i >= j else 256) + 1) * 0x01000193 & M32
        h ^= h >> 15
        if j in (3, 4, 6):
            out.append(mixed(h * 0x2C1B3C6D + j & M32))
    first = i
    while first > 0 and i - first < 32 and not (t[first - 1] == 0x20 or 9 <= t[first - 1] <= 13):
        first -= 1
    word = sum((t[k] + 1) * pow(POLY, k - first, 1 << 64) for k in range(first, i)) & M64
    return [*out, mixed(word >> 32 ^ word & M32)]


class Plain:
    def __init__(self, model):
        self.m, self.odds = model, L.odds_table()

    def way(self, t, i, symbol):
        """(node, branch, slots) of each decision on the way to a symbol at place i."""
        c = self.m.codes
        key = (t[i - 1] if i else 256) * 257 + symbol
        at, found = range(c.start[key], c.start[key] + c.length[key]), []
        top = inside = 0
        for n, d in enumerate(at):
            node, branch = int(c.node[d]), int(c.branch[d])
            if n % 4 == 0:
                top, inside = node * TREE & M32, 1
            else:
                inside = 2 * inside + int(c.branch[d - 1])
            slots = []
            for h in contexts(t, i):
                h = (h ^ top) * MIX & M32
                h ^= h >> 15
                slots.append(h >> 32 - self.m.bits + 4 << 4 | (h ^ inside) & 15)
            found.append((node, branch, slots))
        return found

    def share(self, node, branch, slots, w, left_out=False):
        """(inputs towards the branch, gate, probability of the branch)."""
        x, gate = [], 0
        for k, s in enumerate(slots):
            cell = int(self.m.tables[k][s])
            if left_out:
                cell -= ((cell & 255) > 0) if branch else 256 * (cell >> 8 > 0)
            x.append(float(self.odds[cell]))
            if k >= 2:
                gate = gate * 3 + ((cell >> 8) + (cell & 255) > 0) + ((cell >> 8) + (cell & 255) > 3)
        u = np.array([*x, float(self.m.codes.prior[node]), 0.3]) * (1 if branch else -1)
        return u, gate, 1 / (1 + math.exp(-float(np.clip(w[gate] @ u, -16, 16))))

    def read(self, t, w, rate, left_out=False):
        """log10 of the text's probability; w changes."""
        total, pull, held = 0.0, np.zeros_like(w), 0
        for i in range(len(t) + 1):
            if held and i % L.PIECE == 0:
                w[:], pull, held = np.clip(w + pull, -4, 4), np.zeros_like(w), 0
            for node, branch, slots in self.way(t, i, t[i] if i < len(t) else 256):
                u, gate, p = self.share(node, branch, slots, w, left_out)
                total += math.log10(p)
                pull[gate] += rate * (1 - p) * u
                held += 1
                if held == L.FEW:
                    w[:], pull, held = np.clip(w + pull, -4, 4), np.zeros_like(w), 0
        w[:] = np.clip(w + pull, -4, 4)
        return total


def model_of(texts, bits=16, rng=None):
    pairs = np.zeros((257, 257))
    for t in texts:
        for a, b in zip([256, *t], [*t, 256], strict=True):
            pairs[a, b] += 1
    m = L.Model(L.Codes.of(pairs), bits)
    if rng:
        m.tables = [np.array([rng.randrange(65536) if rng.random() < 0.7 else 0 for _ in range(1 << bits)], np.uint16) for _ in range(4)]
        m.weights = np.array([[rng.uniform(-0.2, 0.6) for _ in range(6)] for _ in range(9)], np.float32)
    return m


def made(rng):
    words = ["the", "of", "alpha", "beta", "été", "x" * 40, "42"]
    return ["", "a", " ", *(" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 9, 60, 61)), "\t\n" * 9, "z" * 300]


@pytest.fixture(scope="module")
def ready(spark):
    L.functions(spark)
    return spark


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text_ string").coalesce(1)


def test_scores_are_those_of_the_plain_mixer(ready):
    rng = random.Random(1)
    texts = made(rng)
    model = model_of([t.encode() for t in texts], rng=rng)
    row = L.with_model(L.text_blocks(frame(ready, texts), 1 << 20), L.model_table(ready, model)).select(F.call_function("context_mixer_scores", "model", L.packed_weights(model.weights), "text", "lengths").alias("s")).first()
    plain = Plain(model)
    want = [plain.read(t.encode(), model.weights.astype(float), L.ONLINE) for t in texts]
    assert np.allclose(np.frombuffer(bytes(row["s"]), "<f8"), want, rtol=1e-4, atol=1e-4)
    fixed = [plain.read(t.encode(), model.weights.astype(float), 0.0) for t in texts]
    assert abs(want[-1] - fixed[-1]) > 0.05 * abs(fixed[-1])  # short texts are refined too


def test_probabilities_of_all_continuations_are_one(ready):
    rng = random.Random(2)
    model = model_of([b"abc abd", b"abba"], rng=rng)
    plain, w = Plain(model), np.array(model.weights, float)
    for t in (b"", b"ab", b"ab abc\xff"):
        total = sum(math.prod(plain.share(n, b, s, w)[2] for n, b, s in plain.way(t, len(t), symbol)) for symbol in range(257))
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_counts_and_first_weights_are_those_of_plain_loops(ready):
    rng = random.Random(3)
    texts = [*made(rng), "ab" * 40_000]
    data = [t.encode() for t in texts]
    model = model_of(data)
    counts = [Counter() for _ in range(4)]
    plain = Plain(model)
    for t in data[:-1]:
        for i in range(len(t) + 1):
            for _, branch, slots in plain.way(t, i, t[i] if i < len(t) else 256):
                for k, s in enumerate(slots):
                    counts[k][2 * s + branch] += 1
    got = L.count_tables(frame(ready, texts[:-1]).repartition(3), model)
    for k in range(4):
        want = np.zeros(2 << 16, np.int64)
        for s, n in counts[k].items():
            want[s] = n
        assert np.array_equal(got[k], L.cells(want))
    # more than 16 bits of one slot: both bytes of a long run are counted 40,000 times and more
    long = L.count_tables(frame(ready, texts[-1:] * 3), model)
    assert all(t.max() >= 255 for t in long) and np.array_equal(long[0], L.count_tables(frame(ready, texts[-1:] * 3).repartition(3), model)[0])
    model.tables = got
    row = L.with_model(L.text_blocks(frame(ready, texts[:6]), 1 << 20), L.model_table(ready, model)).select(F.call_function("context_mixer_learned", "model", L.packed_weights(model.weights), "text", "lengths", F.lit(0.05).cast("float")).alias("w")).first()
    w, kept = np.full((9, 6), 0.25), []
    for i, t in enumerate(data[:6]):
        plain.read(t, w, 0.05, True)
        if 2 * i >= 5:
            kept.append(w.copy())
    assert np.allclose(np.frombuffer(bytes(row["w"]), "<f4").reshape(9, 6), np.mean(kept, axis=0), atol=1e-3)


def test_first_weights_are_fitted_to_all_training_texts(ready):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(1500)]
    table, got = L.train_model(frame(ready, texts).withColumn("held_out", F.lit(False)).repartition(3))
    data = [t.encode() for t in texts]
    model = model_of(data)
    model.bits = min(L.BITS, max(L.LEAST_BITS, int(math.log2(sum(map(len, data)) + len(data) + 1)) + 1))
    model.tables = L.count_tables(frame(ready, texts), model)
    plain, start = Plain(model), np.full((L.GATES, L.INPUTS), 0.25)
    left, right = np.zeros((L.GATES, L.INPUTS, L.INPUTS)), np.zeros((L.GATES, L.INPUTS))
    for t in data:
        for i in range(len(t) + 1):
            for node, branch, slots in plain.way(t, i, t[i] if i < len(t) else 256):
                u, gate, p = plain.share(node, branch, slots, start, True)
                left[gate] += p * (1 - p) * np.outer(u, u)
                right[gate] += (p * (1 - p) * (start[gate] @ u) + 1 - p) * u
    want = [np.linalg.solve(a + L.HOLD * np.eye(L.INPUTS), b + L.HOLD * w) for a, b, w in zip(left, right, start, strict=True)]
    assert np.allclose(got, want, atol=2e-3) and not np.allclose(got, start, atol=0.1)


def test_scores_do_not_depend_on_how_rows_are_dealt_out(ready, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "own", "own", "own") for i in range(120)] + [(None, None, None, None, None), (5, "again", None, None, None), (5, "again", None, None, None), (300, "w " * 50_000, None, None, None)]
    results = []
    for n, block in ((1, 1 << 20), (5, 1 << 9)):
        monkeypatch.setattr(L, "BLOCK_BYTES", block)
        monkeypatch.setattr(L, "FAN_IN", n)
        out = L.document_scores(ready.createDataFrame(rows, DOCS).repartition(n)).collect()
        results.append(Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in out))
    assert results[0] == results[1] and results[0].total() == len(rows)


def test_unseen_texts_gain_from_what_others_hold(ready):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    docs = ready.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(150)), None, None, None) for i in range(300)], DOCS)
    out = L.document_scores(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg("bits_per_byte")).first()
    # six letters and a blank, of which log2(300) bits are news
    assert out[0] > 1.2 * out[1] and out[2] < 1.25 * math.log2(300) / 7 + 0.2


def test_tokens_of_a_block_are_those_of_a_plain_split(ready):
    rng = random.Random(7)
    texts = [*made(rng), "A aB\x0bÉ É\x1cx  ", "\x00 a\x85b c", *(" ".join(str(rng.randrange(9000)) for _ in range(400)) for _ in range(20))]
    row = L.text_blocks(frame(ready, texts), 1 << 20).select(F.call_function("context_mixer_words", "text", "lengths").alias("w")).first()
    places, sizes, blob, lengths = (bytes(x) for x in row["w"])
    want = [[*t.encode().lower().split(), b""] for t in texts]
    number = {}
    for t in want:
        for w in t:
            number.setdefault(w, len(number))
    assert np.frombuffer(places, "<u4").tolist() == [number[w] for t in want for w in t]
    assert np.frombuffer(sizes, "<u4").tolist() == [len(t) for t in want]
    assert blob == b"".join(number) and np.frombuffer(lengths, "<u4").tolist() == [len(w) for w in number]


def test_fitted_sums_are_those_of_single_decisions(ready):
    rng = random.Random(8)
    texts = [*made(rng), " ".join(rng.choice(["ab", "ba", "abba"]) for _ in range(900))]  # more decisions than wait in one gate
    data = [t.encode() for t in texts]
    model = model_of(data, rng=rng)
    row = L.with_model(L.text_blocks(frame(ready, texts), 1 << 20), L.model_table(ready, model)).select(F.call_function("context_mixer_fits", "model", L.packed_weights(model.weights), "text", "lengths").alias("s")).first()
    plain, w = Plain(model), model.weights.astype(float)
    want = np.zeros((L.GATES, L.SUMS))
    for t in data:
        for i in range(len(t) + 1):
            for node, branch, slots in plain.way(t, i, t[i] if i < len(t) else 256):
                u, gate, p = plain.share(node, branch, slots, w, True)
                want[gate, : -L.INPUTS] += p * (1 - p) * np.outer(u, u)[np.triu_indices(L.INPUTS)]
                want[gate, -L.INPUTS :] += (p * (1 - p) * (w[gate] @ u) + 1 - p) * u
    assert np.allclose(np.array(row["s"]).reshape(L.GATES, L.SUMS) / L.ROUNDED, want, rtol=1e-4, atol=2e-2)


def test_every_text_is_read_four_times(ready):
    read = ready.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = ready.createDataFrame([(i, f"word{i % 7} and {i}", None, None, None) for i in range(90)], DOCS)
    got = L.document_scores(docs.mapInArrow(counted, DOCS)).collect()
    # for codes, counts and first weights, and once for both scores and tokens
    assert len(got) == 90 and read.value == 4 * 90


def test_long_runs_of_one_gate_are_those_of_the_plain_mixer(ready):
    rng = random.Random(9)
    texts = [*made(rng), " ".join(rng.choice(["ab", "ba", "abba", "öl"]) for _ in range(400))]
    model = model_of([t.encode() for t in texts], rng=rng)
    # of 200 slots one is empty, all others are full: runs of many decisions, longer than AT_ONCE, that other gates break
    model.tables = [np.array([(rng.randrange(2, 256) << 8 | rng.randrange(2, 256)) * (rng.random() > 0.005) for _ in range(1 << 16)], np.uint16) for _ in range(4)]
    row = L.with_model(L.text_blocks(frame(ready, texts), 1 << 20), L.model_table(ready, model)).select(F.call_function("context_mixer_scores", "model", L.packed_weights(model.weights), "text", "lengths").alias("s")).first()
    plain = Plain(model)
    want = [plain.read(t.encode(), model.weights.astype(float), L.ONLINE) for t in texts]
    assert np.allclose(np.frombuffer(bytes(row["s"]), "<f8"), want, rtol=1e-4, atol=1e-4)
