import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The contract's patterns and conditions, as written."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd, even = digits[::-1][::2], digits[::-1][1::2]
            total = sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)
            if (
                kind == "email"
                or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                or kind == "card" and 12 <= len(digits) <= 19 and total % 10 == 0
                or kind == "phone" and 9 <= len(digits) <= 15
            ):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


@settings(max_examples=2000, deadline=None)
@given(st.text("a1.@-_%+ ()0é25\n", max_size=60))
def test_base_equals_the_patterns(text):
    assert P.base_spans(text) == plain(text)


def test_base_on_tables_and_hard_texts(spark, sf):
    rng = random.Random(1)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["".join(rng.choice("0123456789. -+()") for _ in range(200)) for _ in range(500)]
    assert sum(len(P.base_spans(t)) for t in texts) > 0
    for t in texts:
        assert P.base_spans(t) == plain(t)
    for t in ("1" * 200_000, "a" * 200_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000):
        P.base_spans(t)  # in linear time


@pytest.fixture(scope="module")
def model():
    return P.default_field()


def test_held_out_lines(model):
    right = total = 0
    for tokens, labels in P.labelled_table(300, seed=99):
        right += (model.label(tokens, np.array([len(tokens)])) == labels).sum()
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_of_all_paths(model):
    rng = random.Random(3)
    pool = [t for tokens, _ in P.labelled_table(60, seed=5) for t in tokens]
    lines = [[rng.choice(pool) for _ in range(rng.randrange(1, 6))] for _ in range(40)]
    lengths = np.array([len(x) for x in lines])
    got = model.label([t for x in lines for t in x], lengths)
    ends = np.cumsum(lengths) - 1
    score = model.emissions([t for x in lines for t in x], ends - lengths + 1, ends)
    at = 0
    for n in lengths:
        def value(path):
            return model.first[path[0]] + sum(score[at + i, y] for i, y in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(5), repeat=int(n)), key=value)
        assert abs(value(best) - value(tuple(got[at : at + n]))) < 1e-9
        at += n


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mail jane dot doe at example dot org now", [("email", "jane dot doe at example dot org")]),
        ("call (555) 123-4567 or 555-123-4567.", [("phone", "(555) 123-4567"), ("phone", "555-123-4567")]),
        ("and 4387.5130.3523.7269 too", [("card", "4387.5130.3523.7269")]),
        ("th +1 (269) 555-3296 4524132264652876 an", [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]),
        ("in 2024-01-02 at 12:30, page 12, v2.0", []),
        ("LOOK!! AT!! THE!! SHOP.!! DOT!!", []),
    ],
)
def test_added_spans(model, text, want):
    base, spans = P.find([text], model)[0]
    assert base == [] and [(k, text[a:b]) for k, a, b in spans] == want


def test_whole_table(spark, sf):
    out = P.op7_random_field_pii(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert len(out) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        base, row = plain(text), out.loc[doc_id]
        assert row.base_sha256 == hashlib.sha256(P.written(base).encode()).hexdigest()
        assert tuple(row[[f"n_{k}" for k in P.KINDS]]) == tuple(sum(s[0] == k for s in base) for k in P.KINDS)
        assert {P.written([s]) for s in base} <= set(row.spans.split(","))


def test_null_empty_repeated_long_and_clashing(spark, model):
    rows = [(1, None, "a"), (2, "", "b"), (None, "a@b.de x " * 20_000, None), (3, "é a@b.de", "c"), (3, "é a@b.de", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumnRenamed("spans", "masked_by")
    out = P.detect(docs, ["doc_id", "masked_by"], model, masked=True).collect()
    assert [len(r.spans) for r in out] == [0, 0, 20_000, 1, 1]
    assert [r.masked for r in out[:2]] == [None, ""] and out[3].masked == "é <email>" == out[4].masked
    assert [tuple(s) for s in out[3].base] == [("email", 2, 8)]
    assert P.detect(docs.limit(0), ["doc_id"], model).count() == 0


@pytest.mark.parametrize("n", [29, 63, 64, 67, 100, 200])
def test_long_tokens_are_seen_whole(model, n):
    name = ("ab" * n)[: n - 22]
    text = f"write to {name}[at]example[dot]org please"
    assert [(k, text[a:b]) for k, a, b in P.find([text], model)[0][1]] == [("email", f"{name}[at]example[dot]org")]


def test_lists_without_blanks(model):
    text = "to jane[at]example[dot]org,joe[at]example[dot]net;ann[at]post[dot]de for 1,234,567"
    assert [text[a:b] for _, a, b in P.find([text], model)[0][1]] == ["jane[at]example[dot]org", "joe[at]example[dot]net", "ann[at]post[dot]de"]


@settings(max_examples=500, deadline=None)
@given(st.text("ab1,;| \u2003\x1c", max_size=40))
def test_tokens_and_their_places(line):
    assert P.words_of(line) == [line[a:b] for a, b in P.places_of(line, 0, len(line))]
    assert "".join(P.words_of(line)) == "".join(line.split())


def test_a_long_line_in_parts_is_as_the_whole_line(model):
    rng = random.Random(8)
    lines = [" ".join(tokens) for tokens, _ in P.labelled_table(900, seed=31)]
    text = " ".join(rng.choice(lines) for _ in range(3_000))
    whole, parts = P.find([text], model, 10**9)[0], P.find([text], model, 20_000)[0]
    assert len(text) > 100_000 and len(whole[1]) - len(whole[0]) > 200
    assert parts == whole
    assert P.find(["x" * 50_000 + " " + text], model, 20_000)[0][0] == [(k, a + 50_001, b + 50_001) for k, a, b in whole[0]]


def test_outside_is_the_comparison_of_all_pairs():
    rng = random.Random(2)
    for _ in range(200):
        base = sorted((("ip", a, a + rng.randrange(1, 9)) for a in rng.sample(range(60), 6)), key=lambda s: s[1])
        new = [("email", a, a + rng.randrange(1, 9)) for a in rng.sample(range(60), 6)]
        assert P.outside(new, base) == [s for s in new if all(s[2] <= x[1] or s[1] >= x[2] for x in base)]


def test_likelihood_is_the_sum_over_all_paths_and_its_gradient_the_differences():
    lines = [(["a1", "at", "b"], [1, 1, 0]), (["555-1234", "x"], [4, 0]), (["Hi"], [0])]
    risk = P.Likelihood(lines, 0.01)
    rng = np.random.default_rng(5)
    w = rng.normal(size=risk.size + 30)

    def loss(w):
        W, A, B = w[: risk.size].reshape(-1, 5), w[risk.size : risk.size + 25].reshape(5, 5), w[risk.size + 25 :]
        total = 0.0
        for tokens, labels in lines:
            def value(path):
                out = B[path[0]] + sum(A[a, b] for a, b in zip(path, path[1:]))
                for t, y in enumerate(path):
                    seen = [(0, f) for f in P.own_features(tokens[t])]
                    seen += [(1, f) for f in P.side_features(tokens[t - 1])] if t else []
                    seen += [(2, f) for f in P.side_features(tokens[t + 1])] if t + 1 < len(path) else []
                    out += sum(W[risk.names[s], y] for s in seen)
                return out
            total += np.log(sum(np.exp(value(p)) for p in itertools.product(range(5), repeat=len(tokens)))) - value(labels)
        return total / len(lines) + 0.01 * (w * w).sum() / 2

    got, g = risk(w)
    assert abs(got - loss(w)) < 1e-9
    for i in rng.choice(len(w), 40, replace=False).tolist() + list(range(risk.size, risk.size + 30)):
        e = np.zeros(len(w))
        e[i] = 1e-6
        assert abs((loss(w + e) - loss(w - e)) / 2e-6 - g[i]) < 1e-6
