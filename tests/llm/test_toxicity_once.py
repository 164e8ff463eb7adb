"""Only real near copies count once among the training texts."""

import numpy as np

from blockloom.llm import toxicity as X


def test_once_is_the_comparison_of_all_pairs():
    rng = np.random.default_rng(5)
    common = np.sort(rng.choice(2_000, 40, replace=False))
    rows = []
    for _ in range(120):
        f = np.union1d(common, 10_000 + rng.choice(1 << 20, rng.integers(5, 300), replace=False)).astype(np.uint32)
        rows += [f, f, f[rng.random(len(f)) < 0.92], f[rng.random(len(f)) < 0.8]]
    rows.append(np.empty(0, np.uint32))
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    want = []
    for f in rows:
        sets = [len(np.intersect1d(f, g)) / max(1, len(np.union1d(f, g))) for g in want]
        if not any(s >= 0.8 for s in sets):
            want.append(f)
    got = X.once(rows)
    assert len(got) == len(want) and all(np.array_equal(a, b) for a, b in zip(got, want))


def test_common_words_do_not_make_copies():
    shared = "the of and to in a is that for it"
    rows = [X.features(shared + " " + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(30)]
    assert len(X.once(rows)) == 30
    assert len(X.once(rows + rows)) == 30
