import numpy as np
import pytest

from strandmill.llm.fm_index import END, FMIndex, suffix_array


def corpus(rng, sigma, repeat):
    docs = [rng.integers(1, sigma, rng.integers(0, 40)) for _ in range(rng.integers(1, 9))]
    docs += docs[:repeat]
    return np.concatenate([np.append(d, END) for d in docs]).astype(np.int64)


@pytest.mark.parametrize("trial", range(25))
def test_counts_and_places(trial):
    rng = np.random.default_rng(trial)
    sigma = int(rng.integers(2, 9)) if trial % 5 else 300
    s = corpus(rng, sigma, trial % 3)
    f = FMIndex(s, sigma)
    sa = suffix_array(s, f.bits)
    assert sorted(sa) == list(range(len(s)))
    assert (f.locate(np.arange(f.n)) == sa).all()
    text, phrase = s.tolist(), rng.integers(1, sigma, 15)
    for most, least, longest in ((1, 1, 5), (2, 2, 3), (100, 1, 1)):
        ends, k, lo, hi = f.shortest_rare(phrase, np.repeat([0, 7], [7, 8]), most, least, longest)
        got = {}
        for e, n, a, b in zip(ends.tolist(), k.tolist(), lo, hi):
            p = phrase[e - n + 1 : e + 1].tolist()
            assert sorted(f.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text)) if text[i : i + n] == p]
            got[e] = n
        for e in range(15):
            first = 0 if e < 7 else 7
            want = None
            for n in range(1, min(longest, e - first + 1) + 1):
                p = phrase[e - n + 1 : e + 1].tolist()
                count = sum(text[i : i + n] == p for i in range(len(text)))
                if count == 0:
                    break
                if (count <= most and n >= least) or n == longest:
                    want = n
                    break
            assert got.get(e) == want


def test_suffixes_end_at_their_text():
    s = np.array([1, 2, END, 1, 2, END, 1, END])
    assert suffix_array(s, 2).tolist()[:3] == [2, 5, 7]
    f = FMIndex(np.array([END, END]), 2)
    assert sorted(f.locate(np.arange(2)).tolist()) == [0, 1]


def test_long_repeats():
    s = np.concatenate([np.append(np.tile([1, 2, 3], 2000), END)] * 3)
    f = FMIndex(s, 4)
    lo, hi = np.array([0]), np.array([f.n])
    for c in (3, 2, 1, 3, 2, 1):
        lo, hi = f.step(np.array([c]), lo, hi)
    assert int(hi[0] - lo[0]) == 3 * 1999
