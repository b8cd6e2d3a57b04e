import random

from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm.suffix_array import lyndon_groups, suffix_array


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text("ab", max_size=60), st.text("abc", max_size=60), st.text(max_size=40)))
def test_sorts_suffixes(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_repetitive_and_numbers():
    for text in ("a" * 500, "ab" * 300, "aab" * 200 + "b", "banana" * 50):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    rng = random.Random(1)
    numbers = [rng.randrange(1000) for _ in range(3000)]
    assert suffix_array(numbers) == sorted(range(len(numbers)), key=lambda i: numbers[i:])


def test_groups_share_their_lyndon_prefix():
    def lyndon(s):
        n = 1
        for k in range(1, len(s) + 1):
            if all(s[:k] < s[j:k] for j in range(1, k)):
                n = k
        return s[:n]

    text = "abracadabraabracadabra"
    groups, _ = lyndon_groups(text)
    words = [{lyndon(text[i:]) for i in g} for g in groups if g]
    assert all(len(w) == 1 for w in words)
    assert [w for s in words for w in s] == sorted({lyndon(text[i:]) for i in range(len(text))})
