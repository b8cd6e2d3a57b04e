import random

import numpy as np
import pytest

from paperloom.llm import edit


def edited(rng, s, n, letters):
    out = list(s)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(letters)
        elif kind == 1:
            out.insert(at, rng.choice(letters))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


@pytest.mark.parametrize("banded", [1, 3, 10**9])
@pytest.mark.parametrize("letters", ["ab", "abcdefgh éß가"])
def test_words_near_the_diagonal_decide(monkeypatch, banded, letters):
    """Pairs of many lengths, with distances on both sides of their bounds, and with all edits at one end."""
    monkeypatch.setattr(edit, "BANDED", banded)
    rng = random.Random(banded)
    pairs = []
    for k in range(160):
        a = "".join(rng.choices(letters, k=rng.choice([1, 63, 64, 65, 128, 200, 321, 640, 900])))
        most = max(1, int(0.2 * len(a)))
        b = edited(rng, a, rng.choice([0, 1, most // 2, most, most + 1, 2 * most]), letters)
        if k % 5 == 0:  # a shift by as much as the bound allows
            b = "".join(rng.choices(letters, k=most)) + a[: len(a) - rng.choice([0, most // 2])]
        elif k % 5 == 1:
            b = "".join(rng.choices(letters, k=max(1, len(a) + rng.randrange(-3, 4))))
        pairs.append(sorted((a, b), key=len))
    real = np.array([edit.distance(*p) for p in pairs])
    for bound in ([int(0.2 * len(b)) for _, b in pairs], real, real - 1, [30] * len(pairs)):
        some = [k for k, (a, b) in enumerate(pairs) if len(b) - len(a) <= bound[k]]
        got = edit._table([pairs[k][0] for k in some], [pairs[k][1] for k in some], np.array([bound[k] for k in some]))
        assert got.tolist() == [bool(real[k] <= bound[k]) for k in some]


def test_pairs_of_all_lengths_share_a_table():
    """One table of short and long pairs, in blocks of columns, gives what one distance after the other gives."""
    rng = random.Random(7)
    pairs = []
    for k in range(120):
        a = "".join(rng.choices("abcdefgh é가", k=rng.choice([1, 30, 64, 130, 700, 1500, 2600])))
        most = int(0.2 * len(a))
        b = edited(rng, a, rng.choice([0, most // 2, most, 3 * most // 2, 2 * most + 2]), "abcdefgh xyz")
        if k % 3 == 0:
            b = b[most:] + "".join(rng.choices("abcd", k=rng.choice([most, most // 2]))) or "x"
        pairs.append(sorted((a, b), key=len))
    real = np.array([edit.distance(*p) for p in pairs])
    for bound in (np.array([int(0.2 * len(b)) for _, b in pairs]), real, real - 1):
        some = [k for k, (a, b) in enumerate(pairs) if len(b) - len(a) <= bound[k]]
        got = edit._table([pairs[k][0] for k in some], [pairs[k][1] for k in some], bound[some])
        assert got.tolist() == (real[some] <= bound[some]).tolist()
        # alone, a pair whose distance must exceed its bound stops early
        assert [edit.distance(*pairs[k], int(bound[k])) <= bound[k] for k in some] == got.tolist()
    near = np.array([int(0.2 * len(b)) for _, b in pairs])
    assert 20 < (real <= near).sum() < 100
    got = edit.within([(edit.Form(a), edit.Form(b)) for a, b in pairs], 0.8)
    assert got.tolist() == (real <= near).tolist()


def test_profiles_rule_out_most_far_pairs_and_no_near_one():
    """Lines that share frequent words only need no distance; similar ones, and long or empty lines, still do."""
    import pyarrow as pa

    from paperloom.llm.decontaminate import NORMAL
    from paperloom.llm.words import BRIEF, Profiles

    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvwéß한0123456789", k=rng.randrange(2, 9))) for _ in range(500)] + ["the", "of", "and", "to"] * 60
    lines = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 30))) for _ in range(600)]
    near = [edited(rng, x, rng.randrange(1 + len(x) // 4), "ab é한,. 7") or "x" for x in lines]
    lines = ["", " .. ", "x" * BRIEF, "é" * BRIEF, *lines, *(f" {x.upper()}  !" if k % 7 == 0 else x for k, x in enumerate(near))]
    profiles = Profiles(pa.array(["before", *lines]).slice(1))
    forms = [b" ".join(x.encode().translate(NORMAL).split()).decode() for x in lines]
    similar = lambda a, b: edit.distance(forms[a], forms[b]) <= 0.2 * max(len(forms[a]), len(forms[b])) + 1e-9
    i, j = np.arange(4, 604), np.arange(604, 1204)
    alike = np.array([similar(a, b) for a, b in zip(i, j)])
    assert 200 < alike.sum() < 600 and profiles.may(i, j, 0.8)[alike].all()
    others = np.array([rng.sample(range(4, 604), 2) for _ in range(3000)])
    kept = profiles.may(others[:, 0], others[:, 1], 0.8)
    assert kept.mean() < 0.15 and all(kept[k] for k, (a, b) in enumerate(others) if similar(a, b))
    assert profiles.may(np.array([0, 1, 2, 3]), np.array([1, 2, 3, 2]), 0.8).tolist() == [True] * 4
