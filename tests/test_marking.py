"""The plans against a plain reading of the marking rule, on random reads."""

import random

import numpy as np
import pytest

from seqloom.operators.kmers import reference_seeds
from seqloom.operators.marking import mark
from seqloom.operators.params import SearchParams
from seqloom.operators.search import search
from seqloom.operators.seeds import prescreen, seed_hits

RC = str.maketrans("ACGT", "TGCA")


def union(places):
    covered = set()
    for p in places:
        covered |= set(range(p, p + 21))
    return len(covered)


def brute(mates, refs, p):
    found = {}
    for read, mate, seq in mates:
        n = len(seq)
        for strand, s in enumerate((seq, seq.translate(RC)[::-1])):
            for ref, r in refs:
                hits = sorted((j - i, i) for i in range(n - 20) for j in range(len(r) - 20) if "N" not in s[i : i + 21] and s[i : i + 21] == r[j : j + 21])
                if not hits:
                    continue
                enough = lambda b: np.float32(p.coverage_ratio) * np.float32(n) <= np.float32(b) and b >= p.covered_bases  # noqa: B023, E731
                answer = None
                if p.continuous_bases > 21:
                    start, last, run = None, None, None
                    for d, i in hits:
                        if last is None or last[0] != d or last[1] + 21 < i:
                            start = i
                        last = (d, i)
                        if i - start + 21 >= p.continuous_bases:
                            run = i - start + 21
                            break
                    if run is None:
                        continue
                    if enough(run):
                        answer = run
                if answer is None:
                    if not p.covered_bases and not p.coverage_ratio:
                        answer = 0
                    else:
                        for d in sorted({d for d, _ in hits}):
                            b = union({i for e, i in hits if d <= e <= d + p.max_diag_delta})
                            if enough(b):
                                answer = b
                                break
                if answer is not None:
                    key = (read, mate) if p.per_mate else (read,)
                    found.setdefault(key, []).append(((mate, strand, ref), (read, mate, n, answer)))
    return sorted(min(v)[1] for v in found.values())


@pytest.fixture(scope="module")
def data():
    r = random.Random(7)
    refs = [(i, "".join(r.choice("ACGT") for _ in range(160))) for i in range(3)]
    refs.append((3, refs[0][1][:90] + refs[1][1][:60]))
    mates = []
    for read in range(60):
        for mate in range(2):
            s = r.choice(refs)[1]
            a = r.randrange(0, 60)
            s = list(s[a : a + r.randrange(20, 100)])
            for _ in range(r.randrange(0, 4)):
                i = r.randrange(len(s))
                s[i : i + 1] = r.choice(["", "N", "A", "CG", s[i]])
            s = "".join(s)
            mates.append((read, mate, s.translate(RC)[::-1] if r.random() < 0.4 else s))
    return refs, mates


@pytest.mark.parametrize("p", [SearchParams(), SearchParams(per_mate=True, coverage_ratio=0.9), SearchParams(continuous_bases=40, covered_bases=50, per_mate=True), SearchParams(continuous_bases=22, coverage_ratio=0.8, max_diag_delta=0), SearchParams(coverage_ratio=0.0), SearchParams(covered_bases=45, coverage_ratio=0.0, max_diag_delta=1)])
def test_marks(spark, data, p):
    refs, mates = data
    r = spark.createDataFrame(refs, "ref_ord bigint, seq string")
    m = spark.createDataFrame(mates, "read_ord bigint, mate int, seq string")
    assert sorted(tuple(x) for x in mark(seed_hits(m, reference_seeds(r)), p).collect()) == brute(mates, refs, p)


def test_prescreen_keeps_marks(spark, data):
    from seqloom.operators.refdb import screening_words

    refs, mates = data
    r = spark.createDataFrame(refs, "ref_ord bigint, seq string")
    m = spark.createDataFrame(mates, "read_ord bigint, mate int, seq string")
    seeds = reference_seeds(r)
    screened = prescreen(m, screening_words(r))
    assert screened.count() == len(mates) and screened.filter("seq = ''").count() > 0
    assert sorted(mark(seed_hits(screened, seeds)).collect()) == sorted(mark(seed_hits(m, seeds)).collect())


def test_codes_by_hand(spark):
    """Codes and reverse complements of odd sequences, other columns and masks included."""
    from seqloom.operators import kmers

    r = random.Random(3)
    data = [(i, "".join(r.choice("ACGTACGTACGTN") for _ in range(r.choice([0, 1, 20, 21, 22, 300]))), "x") for i in range(60)] + [(60, None, None), (61, "acgu" * 20, "y"), (62, "é" * 30, "z")]
    df = spark.createDataFrame(data, "read_ord bigint, seq string, kind string").repartition(3)

    def code(x):
        return sum("ACGT".index(c) << (2 * j) for j, c in enumerate(x))

    for k in (1, 2, 16, 21, 31):
        want = sorted((i, kind, p, code(s[p : p + k]), code(s[p : p + k].translate(RC)[::-1])) for i, s, kind in data for p in range(len(s or "") - k + 1) if set(s[p : p + k]) <= set("ACGT"))
        assert sorted(tuple(x) for x in kmers.kmers(df, k=k, reverse=True).select("read_ord", "kind", "pos", "kmer", "reverse").collect()) == want
    assert kmers.kmers(df.limit(0)).count() == 0


def test_long_sequence():
    """Time and memory follow the length: slices overlap, and none loses a k-mer."""
    from seqloom.operators import kmers

    digits = np.random.default_rng(0).integers(0, 4, 5 * kmers.SLICE + 17).astype(np.uint8)
    got = list(kmers._cut(digits, np.array([0, 10, len(digits)]), 21))
    assert max(len(x[0]) for x in got) <= kmers.SLICE
    seq, at, code = (np.concatenate(x) for x in zip(*got))
    assert set(seq) == {1} and (at == np.arange(len(digits) - 10 - 20)).all() and (code == kmers.codes(digits[10:], 21)).all()


def test_empty(spark):
    refs = spark.createDataFrame([], "ref_ord bigint, seq string")
    reads = spark.createDataFrame([(0, "r", 0, "ACGT"), (1, "s", 0, None)], "read_ord bigint, read_id string, mate int, seq string")
    marks, report = search(reads, refs)
    assert marks.count() == report.count() == 0


def test_float_ratio(spark):
    """0.6 of 100 is more than 60 in single precision."""
    hits = spark.createDataFrame([(0, 0, 0, 0, i, i, 0, 100) for i in range(40)], "read_ord bigint, mate int, strand int, ref_ord bigint, readpos int, refpos int, diag int, len int")
    assert mark(hits, SearchParams(coverage_ratio=0.6)).count() == 0


def test_bad_params():
    with pytest.raises(ValueError):
        SearchParams(coverage_ratio=1.5)
