"""Each operator against SQL or brute force, and on odd input."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seqloom.llm import _components, bpe, host_quality, kneser_ney, mtree, packing, pii, simhash_dedup, substring_dedup, suffix_dedup, url_filter
from seqloom.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, spans string, _did string, c0 int, word string"


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and clashing columns."""
    r = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    base = " ".join(r.choice(words) for _ in range(120))
    long = " ".join(r.choice(words) for _ in range(30_000)) + " " + "z" * 300_000
    data = [(1, None), (2, ""), (3, base), (4, base), (4, base), (5, base + " tail"), (None, base), (None, None), (6, long), (7, "a " * 300), (8, "\n\t \x0b"), (9, base.upper()), (9, "another text under the same id " * 10), (10, "mail x.y@ex.org or +49 30 1234 5678, 4111 1111 1111 1111, 10.0.0.1, 300.1.1.1"), (11, "ééé ＡＢ \U0001f600 日本 " * 40)]
    return spark.createDataFrame([(i, t, None if k % 3 else f"s{k % 2}", None, "x", "y", k, "z") for k, (i, t) in enumerate(data)], SCHEMA)


def collected(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("name", ORACLES)
def test_sql(same, name):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, sf_dir, tmp_path, name):
    for table in ("documents", "pages", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


# ------------------------------------------------------------- language model


def test_kneser_ney(spark, sf_dir, texts):
    got = QUERIES["op1_kneser_ney"](spark, sf_dir).collect()
    tokens = {i: WORD.findall(t.translate(LOWER)) + ["</s>"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c, pairs = Counter(), Counter()
    for i, t in tokens.items():
        if not held[i]:
            c.update(t)
            pairs.update(zip(["</s>"] + t[:-1], t))
    n, v = sum(c.values()), len(c)
    before, kinds = Counter(w for _, w in pairs), defaultdict(lambda: [0, 0, 0])
    for (a, _), k in pairs.items():
        kinds[a][min(k, 3) - 1] += 1
    d, e = ([0, *kneser_ney.discounts([sum(x == k for x in counts.values()) for k in (1, 2, 3, 4)])] for counts in (pairs, before))
    spare = sum(e[min(x, 3)] for x in before.values()) / len(pairs)
    alone = lambda w: max(before[w] - e[min(before[w], 3)], 0) / len(pairs) + spare / (v + 1)

    def p(a, w):
        if not c[a]:
            return alone(w)
        return max(pairs[a, w] - d[min(pairs[a, w], 3)], 0) / c[a] + sum(x * y for x, y in zip(d[1:], kinds[a])) / c[a] * alone(w)

    for word in ("the", "</s>", "never seen"):
        assert sum(p(word, w) for w in c) + p(word, "unknown") == pytest.approx(1)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip(["</s>"] + t[:-1], t)))
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_kneser_ney_odd(spark, odd):
    model = kneser_ney.train(odd.select("text"))
    rows = kneser_ney.score(odd, model, F.lit(False)).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    assert kneser_ney.train(odd.filter("false").select("text")).vocabulary == 0


# ----------------------------------------------------------------------- PII


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m.group())
        total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits))))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab@.-1+ ", "0123456789. -+()", "1 +(-.9@a", "é٣@a.1 2"])
def test_base_spans(letters):
    r = random.Random(5)
    for _ in range(5000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 50)))
        assert pii.base_spans(t) == plain_spans(t)


def test_pii(spark, sf_dir, texts):
    for r in QUERIES["op2_pii"](spark, sf_dir).collect():
        spans = plain_spans(texts[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term")) == text


def test_disclosing_terms(spark):
    r = random.Random(1)
    filler = ["alpha", "beta", "gamma", "delta", "epsilon"]
    data = [(i, " ".join(r.choice(filler) for _ in range(40))) for i in range(200)]
    for i in range(200, 206):
        data.append((i, f"{' '.join(r.choice(filler) for _ in range(6))} Quillworthe q.w@ex.org {' '.join(r.choice(filler) for _ in range(6))}"))
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    out = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    assert all("Quillworthe" not in out[i] and "q.w@ex.org" not in out[i] and "<email>" in out[i] for i in range(200, 206))
    assert all(out[i] == t for i, t in data if i < 200)
    assert not any("<removed>" in x.text for x in pii.sanitise(docs.filter("doc_id < 202")).collect())


def plain_terms(rows, bits):
    """Term spans (start, stop, removed) by id from whole counts: identifiers, and words that tell an entity."""
    spans = {i: plain_spans(t) for i, t in rows}
    spans = {i: spans[i] + pii.identifiers(t, spans[i], bits) for i, t in rows}
    entities = {i: {pii.entity_of(t, x) for x in spans[i]} for i, t in rows}
    places, words = {}, {}
    for i, t in rows:
        all_ = [(m.group().translate(LOWER), m.start(), m.end()) for m in WORD.finditer(t)]
        words[i] = {w for w, _, _ in all_}
        places[i] = [(w, a, b) for w, a, b in all_ if any(c.isalnum() for c in w) and all(b <= x or y <= a for x, _, y in spans[i])]
    n, out = len(rows), {i: {(a, b): True for a, k, b in spans[i] if k == 4} for i, _ in rows}
    with_entity = Counter(e for i in entities for e in entities[i])
    with_term = Counter(w for i in words for w in words[i])
    both, texts = Counter(), defaultdict(set)
    for i, t in rows:
        for e in entities[i]:
            for w in {w for w, _, _ in places[i]}:
                both[e, w] += 1
                texts[e, w].add(t)
    for i, _ in rows:
        for w, a, b in places[i]:
            for e in entities[i]:
                ic = -math.log2(with_entity[e] / n)
                pmi = math.log2(both[e, w] * n / (with_entity[e] * with_term[w]))
                if len(texts[e, w]) >= 3 and ic > 0 and pmi >= 0.9 * ic:
                    out[i][a, b] = out[i].get((a, b), False) or pmi >= 0.98 * ic
    return {i: sorted((a, b, r) for (a, b), r in x.items()) for i, x in out.items()}


def test_terms_by_brute_force(spark):
    """PMI, information content and identifiers of a small corpus, counted in full."""
    r = random.Random(8)
    common = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]
    people = [(f"p{k}.x@ex{k}.org", [f"Name{k}", f"case-{k}", r.choice(common)]) for k in range(6)]
    rows = []
    for i in range(240):
        words = [r.choice(common) for _ in range(r.randint(20, 60))]
        if i % 3 == 0:
            mail, own = r.choice(people)
            words[r.randrange(len(words))] = mail
            for w in own:
                words[r.randrange(len(words))] = w if r.random() < 0.8 else words[0]
        if i % 17 == 0:
            words.insert(3, 'token = "%s"' % "".join(r.choice("0123456789abcdef") for _ in range(40)))
        if i % 29 == 0:
            words.append(r.choice(["Name1", "case-2"]))
        rows.append((i, " ".join(words)))
    rows += [(240 + k, rows[k][1]) for k in range(5)]  # copies
    rows += [(250, "z" * 500 + " abababababababababababababababababab")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    counts = Counter(x for _, t in rows for x in zip(t.translate(LOWER).encode(), t.translate(LOWER).encode()[1:]))
    table = np.zeros((256, 256))
    for (a, b), n in counts.items():
        table[a, b] = n
    want = plain_terms(rows, pii.pair_bits(table))
    got = {x.doc_id: sorted((s.start, s.stop, s.removed) for s in x.found if s.kind == 4) for x in pii.find(docs).collect()}
    assert got == want
    assert any(not r for x in want.values() for _, _, r in x) and want[250] == [] and sum(b - a == 40 for x in want.values() for a, b, _ in x) == 16


def test_terms_of_whole_documents(spark):
    """A telling term far from its entity, numeric or short, wherever it occurs there."""
    r = random.Random(2)
    filler = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    data = [(i, filler(60)) for i in range(200)]
    data += [(i, f"q.w@ex.org {filler(40)} 4711-08 {filler(20)} 王伟 é {filler(9)} QW 4711-08 - end") for i in range(200, 205)]
    data += [(i, f"a.b@ex.org {filler(30)} Zedekiah x Zedekiah") for i in (205, 206)]  # two documents, three places
    data += [(i, f"c.d@ex.org {filler(30)} Ottoline") for i in (207, 208)]
    data += [(i, data[-1][1]) for i in range(209, 213)]  # copies of one of two texts
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    out = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    for i, t in data:
        if 200 <= i < 205:
            want = t.replace("q.w@ex.org", "<email>")
            for x in ("4711-08", "王伟", "é", "QW", "end"):
                want = want.replace(f" {x}", " <removed>")
            assert out[i] == want
    assert all(out[i] == t for i, t in data if i < 200) and "Zedekiah x Zedekiah" in out[205] and "Ottoline" in out[208]
    got = pii.terms("éa Bb, - x@y.org 12", [(9, 0, 16)])
    assert [x.tolist() for x in got[1:]] == [[0, 3, 17], [2, 6, 19]]


def test_pii_odd(spark, odd):
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.filter("doc_id = 10").first().text == "mail <email> or <phone>, <card>, <ip>, 300.1.1.1"
    assert out.filter("doc_id = 10").first().n_chars == len("mail <email> or <phone>, <card>, <ip>, 300.1.1.1")
    assert out.filter("text IS NULL").count() == 2


# ------------------------------------------------------------ near-duplicates


def simhash(t, size=3):
    w = WORD.findall(t.translate(LOWER))
    shingles = [" ".join(w[j : j + size]) for j in range(max(1, len(w) - size + 1))] if w else []
    import xxhash

    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints, distance=2):
    ids, parent = list(prints), {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark, sf_dir, texts):
    prints = {i: simhash(t) for i, t in texts.items()}
    want = sorted((i, f"{prints[i]:016x}", c) for i, c in roots(prints).items())
    assert sorted(collected(QUERIES["op3_simhash"](spark, sf_dir), "doc_id", "fingerprint", "component_id")) == want


@pytest.mark.parametrize("crowd", [1, 5, 64])
def test_links(spark, crowd):
    r = random.Random(crowd)
    prints = {r.getrandbits(64): None for _ in range(30)}
    for x in list(prints):
        for _ in range(8):
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
            prints[x] = None
    signed = {x - (1 << 64) if x >> 63 else x: x for x in prints}
    want = defaultdict(set)
    for i, c in roots(signed).items():
        want[c].add(i)
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    found = dict(tuple(x) for x in _components.components(simhash_dedup.links(df, crowd=crowd)).collect())
    got = defaultdict(set)
    for x in signed:
        got[found.get(x, x)].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_odd(spark, odd):
    got = collected(simhash_dedup.simhash_groups(odd), "doc_id", "fingerprint", "component_id")
    assert len(got) == odd.count()
    assert {c for i, f, c in got if f == "0" * 16} == {1}
    assert {c for i, f, c in got if i == 4 or i == 3} == {3}
    kept = simhash_dedup.near_dedup(odd)
    assert kept.columns == odd.columns and {1, 3, 6} <= {r.doc_id for r in kept.collect()}


def test_similar_groups(spark, monkeypatch):
    """Groups of near copies of 2 to 60, against all pairs' exact similarity."""
    r = random.Random(11)
    words = ["w%d" % i for i in range(3000)]
    data = []
    for size in (60, 20, 9, 3, 2, 2, *[1] * 30):
        base = [r.choice(words) for _ in range(400)]
        for _ in range(size):
            text = list(base)
            for at in r.sample(range(400), 3):  # 15 of 396 shingles each
                text[at] = r.choice(words)
            data.append((len(data), " ".join(text)))
    sets = [simhash_dedup.shingle_set(x, 5) for _, x in data]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if simhash_dedup.jaccard(sets[a], sets[b]) >= 0.8]
    want = {i: i for i, _ in data}
    for _ in data:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert len(set(want.values())) == 36
    for ahead in (1, 4):
        monkeypatch.setattr(simhash_dedup, "AHEAD", ahead)
        assert dict(collected(simhash_dedup.similar_groups(df), "doc_id", "component_id")) == want


def test_family_of_templates(spark, monkeypatch):
    """Near copies among pages of one template that lie below 0.8, against all pairs."""
    data = [[f"t{j}" for j in range(240)] + [f"p{i}x{j}" for j in range(60)] for i in range(300)]
    data += [page[:240] + [f"q{i}x{j}" for j in range(15)] + page[255:] for i, page in enumerate(data[:30])]
    sets = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in data]
    links = {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert links == {(300 + i, i) for i in range(30)}
    monkeypatch.setattr(simhash_dedup, "SIDE", 16, raising=False)
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(data)], "doc_id bigint, text string")
    got = dict(collected(simhash_dedup.similar_groups(df), "doc_id", "component_id"))
    assert {i for i in range(330) if got[i] != i} == set(range(300, 330)) and all(got[a] == b for a, b in links)


def test_repeated_words_decide_nothing(spark):
    """Different texts with one long run of a word, and copies but for case and spaces."""
    data = [" ".join([f"a{i}x{j}" for j in range(100)] + ["same"] * run) for i, run in enumerate((34, 34, 64, 64, 300, 300))]
    data += [data[0].upper().replace(" ", "  ")]
    sets = [simhash_dedup.shingle_set(x, 5) for x in data]
    assert simhash_dedup.jaccard(sets[0], sets[1]) < 0.01 and simhash_dedup.jaccard(sets[0], sets[6]) == 1
    df = spark.createDataFrame(list(enumerate(data)), "doc_id bigint, text string")
    assert dict(collected(simhash_dedup.similar_groups(df), "doc_id", "component_id")) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0}


def test_close_pairs():
    r = np.random.default_rng(0)
    a, b = (r.integers(0, 4, (n, 2), dtype=np.uint64) for n in (7, 9))
    roots_a, roots_b = r.integers(0, 3, 7), r.integers(0, 3, 9)
    want = {(i, j) for i in range(7) for j in range(9) if roots_a[i] != roots_b[j] and sum((int(x) ^ int(y)).bit_count() for x, y in zip(a[i], b[j])) <= 1}
    assert set(zip(*(x.tolist() for x in simhash_dedup.close_pairs(a, b, roots_a, roots_b, 1)))) == want


# ---------------------------------------------------------------------- URLs


def test_rules(spark):
    urls = {"http://A.Com/x": ("a.com", "/x", "com/", "allow"), "http://com": ("com", "", None, None), "https://example.com/en/1?q": ("example.com", "/en/1", "example.com/en/", "block"), "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://b.www.example.com/en/a#x": ("b.www.example.com", "/en/a", "www.example.com/en/", "allow"), "http://x.net/es/a": ("x.net", "/es/a", "net/es/", "block"), "http://xnet/es/": ("xnet", "/es/", None, None), "nothing": ("", "", None, None), None: ("", "", None, None), "a://b://c.net/fr/": ("b:", "//c.net/fr/", None, None)}
    pages = spark.createDataFrame([(i, u, i, "n") for i, u in enumerate(urls)], "page_id bigint, url string, rule int, label string")
    for r in url_filter.url_filter(pages).collect():
        host, path, rule, verdict = urls[list(urls)[r.page_id]]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in (verdict, *([] if verdict else ["allow", "block"]))


def test_trees_on_held_out_urls():
    r = random.Random(0)

    def one():
        bad = r.random() < 0.4
        host = "".join(r.choice("abcdefgh" if not bad else "xqzk0123456789") for _ in range(10)) + r.choice([".org", ".com", ".biz"])
        path = "/" + "/".join("".join(r.choice("abcdef0123456789" if bad else "abcdef") for _ in range(6)) for _ in range(r.randint(1, 4)))
        return (f"http://{host}{path}", host, path), bad

    rows = [one() for _ in range(1200)]
    model = url_filter.Model.fit([x for x, _ in rows[:800]], [y for _, y in rows[:800]])
    assert (model.blocks([x for x, _ in rows[800:]]) == np.array([y for _, y in rows[800:]])).mean() > 0.95
    assert url_filter.Model.fit([], []).constant == "allow"


@pytest.mark.parametrize("hot", [1, 1000])
def test_suffixes_of_all_pages(spark, monkeypatch, hot):
    """Suffix counts go beyond the sample, and copies of one URL do not fill it."""
    data = [(f"http://h{i}.{'bad' if i % 2 else 'good'}/p{i % 7}/", "block" if i % 2 else "allow") for i in range(400)]
    data += [("http://hot.good/", "allow")] * 300 + [("http://u:8/a/b", None), ("x", None), ("http://h1.bad/q", None)]
    pages = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(data)], "page_id bigint, url string, y string")
    fitted, batches = [], []
    fit, without = url_filter.Model.fit.__func__, url_filter.Suffixes.without.__func__
    monkeypatch.setattr(url_filter.Model, "fit", classmethod(lambda cls, rows, *rest: fitted.append((rows, *rest)) or fit(cls, rows, *rest)))
    monkeypatch.setattr(url_filter.Suffixes, "without", classmethod(lambda cls, tables, *rest: batches.append(tables) or without(cls, tables, *rest)))
    monkeypatch.setattr(url_filter, "HOT", hot)
    got = {r.page_id: r.verdict for r in url_filter.url_filter(pages, (), label=F.col("y"), sample=40).collect()}
    rows, _, _, folds, others = fitted[0]
    assert len(set(rows)) == len(rows) == len(folds) == 40 and len(others) == url_filter.FOLDS
    assert {k: tuple(map(sum, v)) for k, v in batches[0][0].items()} == {"bad": (200, 200), "good": (0, 500)}
    assert got[1] == got[702] == "block" and got[0] == got[500] == "allow" and len(got) == 703


def test_no_label_is_its_own_feature():
    """Suffixes that occur once, under labels by chance, tell the trees nothing."""
    r = random.Random(4)
    rows = [(f"http://site{i}.zone{i}/p", f"site{i}.zone{i}", "/p") for i in range(600)]
    labels = [r.random() < 0.5 for _ in rows]
    fitted = url_filter.Model.fit(rows, labels)
    assert (fitted.blocks(rows[:300]) == np.array(labels[:300])).mean() < 0.8


def test_url_query(spark, sf_dir):
    """Rules as a plain reading has them, over all pages; copies agree, and labelled URLs of a fold left out are told apart."""
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    got = QUERIES["op4_url_filter"](spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    by_url, labelled = defaultdict(set), {}
    for r in got:
        rest = pages[r.page_id].split("://", 1)[1] if "://" in (pages[r.page_id] or "") else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(len(x), x, v) for v, x in url_filter.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
        by_url[pages[r.page_id]].add(r.verdict)
        if rule:
            labelled[pages[r.page_id], host, path] = verdict == "block"
    assert all(len(x) == 1 for x in by_url.values())
    rows = sorted(labelled)
    held = [zlib.crc32(x[0].encode()) % 4 == 0 for x in rows]
    model = url_filter.Model.fit([x for x, h in zip(rows, held) if not h], [labelled[x] for x, h in zip(rows, held) if not h])
    told = model.blocks([x for x, h in zip(rows, held) if h]) == np.array([labelled[x] for x, h in zip(rows, held) if h])
    assert told.mean() >= 0.8  # five URLs of the smallest tables


def test_url_odd(spark):
    """Repeated rows, very long URLs, clashing columns; one kind of label alone."""
    urls = ["http://a.net/es/x", "http://a.net/es/x", "http://b.org/" + "y" * 200_000, "http://b.org/" + "y" * 200_000, None, "", "://", "http://c.com/?q=1#f"]
    pages = spark.createDataFrame([(i if i < 6 else None, u, "h", "p") for i, u in enumerate(urls)], "page_id bigint, url string, host string, _k0 string")
    got = url_filter.url_filter(pages).collect()
    assert len(got) == len(urls)
    assert len({r.verdict for r in got if r.host == "b.org"}) == 1 and {r.verdict for r in got if r.host == "a.net"} == {"block"}
    assert {r.verdict for r in url_filter.url_filter(pages, (("block", "net/es/"),)).collect()} == {"block"}


# ----------------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    return path, bpe.PrefixEncoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


LETTERS = list("ab  'stre\n\t\r\x1c\x85　日本語é12٣\U0001f600​.,-LL")


def test_bpe_random(tokenizer):
    _, ours, theirs = tokenizer
    r = random.Random(1)
    for _ in range(1500):
        t = "".join(r.choice(LETTERS) for _ in range(r.randint(0, 60)))
        assert ours.encode(t) == theirs.encode_ordinary(t)
        assert ours.decode(ours.encode(t)) == t.encode()


def test_bpe_edits(tokenizer):
    _, ours, theirs = tokenizer
    r = random.Random(2)
    for _ in range(100):
        t = "".join(r.choice(LETTERS) for _ in range(r.randint(0, 30)))
        text = bpe.Editable(ours, t)
        for _ in range(5):
            a = r.randint(0, len(t))
            b, new = r.randint(a, len(t)), "".join(r.choice(LETTERS) for _ in range(r.randint(0, 8)))
            text.replace(a, b, new)
            t = t[:a] + new + t[b:]
            assert text.text == t and text.ids() == theirs.encode_ordinary(t)
            text.append(new)
            t += new
            assert text.ids() == theirs.encode_ordinary(t)


def test_bpe_query(spark, sf_dir, texts, tokenizer, odd):
    path, _, theirs = tokenizer
    for r in QUERIES["op5_bpe"](spark, sf_dir).collect():
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    encoded = bpe.encode(odd, path, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, path, public_tokenizers.PATTERN)
    assert Counter(bytes(r.data).decode() for r in back.collect()) == Counter(r.text or "" for r in odd.collect())


# -------------------------------------------------------------------- search


def test_top_k_odd(spark):
    r = np.random.default_rng(0)
    base = [(int(i), [float(x) for x in r.normal(size=6)]) for i in range(300)]
    base += [(1000 + i, base[10][1]) for i in range(40)] + [(300, None), (350, [1.0, None]), (400, [1.0, float("nan")]), (450, [float("inf")]), (None, [1.0] * 6), (500, [1.0, 2.0]), (501, [2.0, 2.0]), (550, []), (10, base[10][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in base], "vec_id bigint, embedding array<float>, rank int")
    got = mtree.top_k(df, df.filter("vec_id % 50 = 0"), 5, block=64).collect()
    valid = {(i, tuple(np.float32(v).astype(float))) for i, v in base if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in valid]
    want = []
    for i, q in whole:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert sorted(tuple(x) for x in got) == sorted(want)


def plain_top(base, asked, k):
    """Whole-number scores of all pairs."""
    whole = {(i, tuple(math.floor(256.0 * x) for x in v)) for i, v in base}
    out = []
    for i, q in whole:
        if asked(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 2.0**21, 2.0**29, 2.0**40])
def test_top_k_of_doubles(spark, scale):
    """The floor of doubles, not of floats; exact scores of large components, also beyond a long."""
    r = np.random.default_rng(3)
    base = [(i, [float(x) * scale for x in r.normal(size=4)]) for i in range(120)] + [(200, [0.99609375 - 1e-12, 2.0, 2.0, 2.0]), (201, [scale, scale, scale - 0.01, 1.0]), (202, [scale, scale, scale, 1.0])]
    df = spark.createDataFrame(base, "vec_id bigint, embedding array<double>")
    got = mtree.top_k(df, df.filter("vec_id % 10 = 0"), 5, block=16, chunk=7).collect()
    assert sorted(tuple(x) for x in got) == plain_top(base, lambda i: i % 10 == 0, 5)


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_bound_of_large_scores(spark, sign):
    """Scores a few units apart near 2**55, where doubles are four or eight apart, over several cells."""
    r = np.random.default_rng(2)
    base = [(0, [sign * 2.0**20, 1 / 256, 0.0])] + [(i, [2.0**19, float(r.integers(2, 16)) / 256, float(r.integers(-(2**19), 2**19))]) for i in range(1, 200)]
    df = spark.createDataFrame(base, "vec_id bigint, embedding array<double>")
    got = mtree.top_k(df, df.filter("vec_id = 0"), 5, block=200).collect()
    assert sorted(tuple(x) for x in got) == plain_top(base, lambda i: i == 0, 5)


def test_cells_spare_searches(spark, monkeypatch):
    """Clustered vectors, of which one is very common: few cells are met, results are exact."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 6)) * 40
    base = [(i, [float(x) for x in centres[i % 12] + r.normal(size=6) * 0.2]) for i in range(600)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(200)]
    df = spark.createDataFrame(base, "vec_id bigint, embedding array<double>")
    met = []
    search = mtree._search
    monkeypatch.setattr(mtree, "_search", lambda c, visits, *rest: met.append(visits.count()) or search(c, visits, *rest))
    got = mtree.top_k(df, df.filter("vec_id % 50 = 0"), 5, block=40).collect()
    assert sorted(tuple(x) for x in got) == plain_top(base, lambda i: i % 50 == 0, 5)
    assert met[0] == 16 and met[1] < 16 * mtree.PIVOTS / 2


def test_tree_avoids_distances():
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 8)) * 50
    x = np.floor(np.concatenate([c + r.normal(size=(50, 8)) for c in centres]))
    block, seen = mtree.Block(np.arange(len(x)), x, 5), []
    search = block.tree.search
    block.tree.search = lambda q, consider, limit, margin: search(q, lambda rows, p: (seen.append(len(rows)), consider(rows, p)), limit, margin)
    assert [i for _, i in block.best(-1, x[7])] == sorted(range(len(x)), key=lambda j: (-(x[j] @ x[7]), j))[:5]
    assert sum(seen) < len(x) / 2


@pytest.mark.parametrize("spread", [0.0, 1.0, 50.0])
def test_queries_go_through_the_tree_together(monkeypatch, spread):
    """Opened nodes do not grow with the queries; ties, copies, the query itself and given bounds."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 8)) * (50 - spread)
    x = np.floor(np.repeat(centres, 50, axis=0) + r.normal(size=(2000, 8)) * spread)
    x[::7] = x[3]  # a copy of one vector, and whole clusters of them without spread
    ids, own = r.permutation(5000)[:2000], np.arange(0, 2000, 2)
    alone, calls, pairs = [], [], []
    one, every = mtree.MTree.search, getattr(mtree.MTree, "search_all", None)
    monkeypatch.setattr(mtree.MTree, "search", lambda *a: alone.append(1) or one(*a))
    monkeypatch.setattr(mtree.MTree, "search_all", lambda t, q, c, *rest: every(t, q, lambda at, rows, p: (calls.append(1), pairs.append(len(at) * len(rows)), c(at, rows, p)), *rest), raising=False)
    scores = x @ x.T
    for least in (None, np.sort(scores, axis=1)[:, -8]):
        sides = [mtree.pa.table({"vec_id": ids[at], "query_key": at, "width": np.full(len(at), 8), "embedding": (x[at] / 256).tolist(), "least": mtree.pa.array([None] * len(at) if least is None else least[at], mtree.pa.float64())}) for at in (np.arange(2000), own)]
        got = mtree._solve(5)(*sides).to_pylist()
        want = []
        for i in own.tolist():
            best = sorted((-int(s), j) for s, j in zip(scores[i], ids.tolist()) if j != ids[i] and (least is None or s >= least[i]))[:5]
            want += [(int(ids[i]), i, j, -s) for s, j in best]
        assert sorted((g["query_id"], g["query_key"], g["vec_id"], g["score"]) for g in got) == sorted(want)
    leaves = sum(kids is None for kids in mtree.Block(ids, x, 5).tree.children)
    assert not alone and len(calls) <= 2 * 2 * leaves
    assert sum(pairs) < 2 * len(own) * 2000 * (0.5 if spread == 1.0 else 1.0)


# ------------------------------------------------------------------- quality


def test_hosts(spark):
    good, bad = " ".join(f"word{i}" for i in range(80)), "spam spam spam"
    data = [(i, good, "clean") for i in range(50)] + [(100 + i, bad if i % 10 else good, "junk") for i in range(60)] + [(200, good, "tiny"), (201, good, None), (202, good, "")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    kept = {r.doc_id for r in host_quality.host_quality(docs).filter("kept").collect()}
    assert set(range(50)) | {200, 201, 202} == kept
    assert {r.doc_id for r in host_quality.quality_filter(docs).collect()} == kept


def test_rejected_hosts_match_sql(spark, duck):
    """Hosts that stand out are rejected with their clean documents, as in SQL; too few documents convict none."""
    good, bad = " ".join(f"word{i}" for i in range(80)), "spam spam spam"
    data = [(f"host{h}", good if i % 10 else bad) for h in range(12) for i in range(40)]
    data += [("junk", bad if i % 8 else good) for i in range(80)] + [("half", bad if i % 2 else good) for i in range(60)] + [("few", bad), ("few", good), (None, good), ("", good)]
    data = [(i, t, h) for i, (h, t) in enumerate(data)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    duck.register("documents_fixture", docs.toPandas())
    want = {r[0]: r[-1] for r in duck.execute("SELECT doc_id, kept FROM (" + host_quality.ORACLE.replace("FROM documents", "FROM documents_fixture") + ")").fetchall()}
    got = {r.doc_id: r.kept for r in host_quality.host_quality(docs).collect()}
    assert got == want
    assert not any(got[i] for i, _, h in data if h == "junk") and all(got[i] for i, t, h in data if h != "junk" and t == good)
    assert {r.doc_id for r in host_quality.quality_filter(docs).collect()} == {i for i in got if got[i]}


def test_quality_odd(spark, odd):
    judged = host_quality.host_quality(odd)
    assert judged.count() == odd.count()
    kept = host_quality.quality_filter(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged.filter("kept").collect()} == {3, 4, 5, None, 6, 9}


# ----------------------------------------------------------------- substrings


def removed_words(data, window):
    """By place: (id, text) rows in order -> kept words."""
    places = sorted({(i if i is not None else -(2**63), t) for i, t in data})
    first, gone = {}, defaultdict(set)
    for did, t in places:
        w = WORD.findall(t)
        for s in range(len(w) - window + 1):
            if first.setdefault(tuple(w[s : s + window]), (did, t, s)) != (did, t, s):
                gone[did, t] |= set(range(s, s + window))
    return gone


def test_substrings_random(spark):
    r = random.Random(4)
    data = []
    for i in range(80):
        w = [r.choice("abc") for _ in range(r.randint(0, 40))]
        if i % 3 == 0 and data:
            w = WORD.findall(r.choice(data)[1])[: r.randint(0, 40)] + w[:5]
        data.append((i, " ".join(w)))
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    for window, gram in ((6, 3), (20, 8)):
        gone = removed_words(data, window)
        for x in substring_dedup.substring_dedup(docs.repartition(5), window=window, gram=gram).collect():
            w, out = WORD.findall(data[x.doc_id][1]), gone[x.doc_id, data[x.doc_id][1]]
            assert (x.n_removed, x.kept) == (len(out), " ".join(v for k, v in enumerate(w) if k not in out))


def test_paths_are_compacted_and_verified(spark):
    """Chains become one path where place and source go on alike; a span whose words differ from its source's is left."""
    text = [f"w{i}" for i in range(600)]
    docs = spark.createDataFrame([(1, 0, " ".join(text)), (2, 0, "  ".join(text[:300] + ["other"] + text[301:])), (3, 0, " ".join(text[100:]))], "_did bigint, _key bigint, text string")
    pieces = [(2, 0, s, 7, 1, 0, s) for s in range(0, 280, 7)] + [(2, 0, 301, 50, 1, 0, 301), (2, 0, 351, 229, 1, 0, 351)]
    pieces += [(3, 0, 0, 100, 1, 0, 100), (3, 0, 100, 200, 2, 0, 200), (3, 0, 300, 100, 1, 0, 400), (3, 0, 400, 81, 1, 0, 500)]
    pieces += [(2, 0, 14, 7, 1, 0, 14), (2, 0, 15, 1, 1, 0, 15)]  # as of repeated rows, settled in another task
    df = spark.createDataFrame(pieces, "_did bigint, _key bigint, start int, n int, sdid bigint, skey bigint, sstart int")
    paths = substring_dedup.compacted(df.repartition(3))
    want = {(2, 0, 0, 280, 1, 0, 0), (2, 0, 301, 279, 1, 0, 301), (3, 0, 0, 100, 1, 0, 100), (3, 0, 100, 200, 2, 0, 200), (3, 0, 300, 181, 1, 0, 400)}
    found = {tuple(r) for r in paths.collect()}
    whole = {x for x in found if x != (2, 0, 15, 265, 1, 0, 15)}  # what an overlap begins is a part of its path
    assert whole | {(2, 0, 0, 280, 1, 0, 0)} == want | ({(2, 0, 0, 21, 1, 0, 0)} & whole)
    got = {tuple(r) for r in substring_dedup.verified(docs, paths, 20).collect()}
    assert got == {x[:4] for x in found if x[3] != 200}
    covered = {i for _, _, s, n in (x for x in got if x[0] == 2) for i in range(s, s + n)}
    assert covered == set(range(280)) | set(range(301, 580))


def test_substrings_odd(spark, odd):
    got = {(x.doc_id, x.n_words, x.n_removed) for x in substring_dedup.substring_dedup(odd).collect()}
    assert {(None, 120, 0), (3, 120, 120), (4, 120, 120), (5, 121, 120), (1, 0, 0), (2, 0, 0)} <= got
    out = substring_dedup.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.filter("doc_id = 5").first().text == "tail" and out.filter("doc_id = 6").first().n_chars is None


def marked_bytes(data, length):
    seen = defaultdict(set)
    for i, t in data:
        b = t.encode()
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]].add((i, s))
    gone = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i] |= set(range(s, s + length))
    return gone


@pytest.mark.parametrize("hot", [0, 2, 2000])
def test_suffixes_random(spark, hot):
    r = random.Random(hot)
    data = []
    for i in range(60):
        t = "".join(r.choice("abé") for _ in range(r.randint(0, 60)))
        if i % 2 and data:
            t = r.choice(data)[1][r.randint(0, 10) :] + t[:7]
        data.append((i, t))
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    gone = marked_bytes(data, 12)
    for x in suffix_dedup.suffix_dedup(docs, length=12, gram=4, keep="none", hot=hot).collect():
        b = data[x.doc_id][1].encode()
        assert (x.n_removed, bytes(x.kept)) == (len(gone[x.doc_id]), bytes(v for k, v in enumerate(b) if k not in gone[x.doc_id]))
    first = suffix_dedup.suffix_dedup(docs, length=12, gram=4, keep="first", hot=hot).collect()
    whole = {bytes(x.kept) for x in first}
    assert sum(x.n_removed for x in first) < sum(map(len, gone.values())) and whole


def test_longest_factors():
    """Longest previous and next factors, against all pairs' common prefixes."""
    r = np.random.default_rng(1)
    for _ in range(150):
        raw, depth = r.integers(0, 3, int(r.integers(20, 100))).astype(np.uint8), int(r.integers(1, 20))
        if r.random() < 0.3:
            raw = np.concatenate([raw, raw[::-1], raw])
        starts = np.sort(r.choice(len(raw) - depth + 1, size=int(r.integers(1, len(raw) - depth)), replace=False))
        views = np.lib.stride_tricks.sliding_window_view(raw, depth)[starts]
        common = np.minimum.accumulate(views[:, None] == views[None], axis=2).sum(2)
        previous, following = suffix_dedup.longest_factors(raw, starts, depth)
        assert (previous == np.tril(common, -1).max(1)).all() and (following == np.triu(common, 1).max(1)).all()


def test_suffix_query(spark, sf_dir, texts):
    """The query, at its 400 bytes, against windows counted by their hashes."""
    seen, hashes = Counter(), {}
    for i, t in texts.items():
        b = t.encode()
        hashes[i] = [hash(b[s : s + 400]) for s in range(len(b) - 399)]
        seen.update(hashes[i])
    rows = QUERIES["op10_suffix_array"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        b = texts[r.doc_id].encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for s, h in enumerate(hashes[r.doc_id]):
            if seen[h] > 1:
                gone[s] += 1
                gone[s + 400] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed > 0 for r in rows) > 10


def test_suffixes_odd(spark, odd):
    got = suffix_dedup.suffix_dedup(odd, keep="none").collect()
    assert len(got) == odd.count()
    assert {x.n_removed for x in got if x.doc_id in (1, 2, 10)} == {0} and all(x.n_removed == x.n_bytes for x in got if x.doc_id in (3, 4))


# ------------------------------------------------------------------- packing


def test_best_fit():
    r = random.Random(0)
    for _ in range(150):
        window = r.choice([16, 64, 2048])
        lengths = [r.randint(1, window - 1) for _ in range(r.randint(0, 50))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [x for x in rooms if x >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else window) - n)
        assert sorted(window - sum(lengths[i] for i in g) for g in packing.best_fit_decreasing(lengths, window)) == sorted(rooms)
        pieces = defaultdict(list)
        for sequence in packing.pack_items(lengths, window, r.randint(1, 20)):
            assert 0 < sum(b - a for _, a, b in sequence) <= window
            for i, a, b in sequence:
                pieces[i].append((a, b))
        for i, n in enumerate(lengths):
            p = sorted(pieces[i])
            assert p[0][0] == 0 and p[-1][1] == n and all(x[1] == y[0] < y[1] for x, y in zip(p, p[1:]))


def whole_pieces(rows, ids_of):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, pieces in by_doc.items():
        ids, at = ids_of(doc), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 2048 - at if at & (at - 1) else 0
    return padding / total


def test_packing(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    rows = QUERIES["op9_packing"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert whole_pieces(rows, ids.__getitem__) < 0.01
    same = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(same) == sorted(rows)


def test_packing_odd(spark, odd):
    rows = packing.pack(odd, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert sum(r.doc_tokens == 1 for r in rows) == 3 and {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}


def test_ranks_are_the_json_vocabulary(spark):
    """The query's ids are those of the unmodified tokenizer, special strings included."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert special == {"<|endoftext|>": 50256}
    encode = packing._encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), tuple(special.items()))
    r = random.Random(9)
    for _ in range(1000):
        t = "".join(r.choice([*LETTERS, "<|endoftext|>", "<|end"]) for _ in range(r.randint(0, 60)))
        assert encode([t])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, "hi <|endoftext|> yo")], "doc_id bigint, text string")
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), special=special).collect()
    assert sum(x.length for x in got) == got[0].doc_tokens == 5
