"""The pipeline against a plain reading of its five stages, and on odd input."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_llm import LOWER, SCHEMA, WORD, plain_spans, plain_terms, removed_words, whole_pieces
from tokenizers import Tokenizer

import corpus_pipeline
from seqloom.llm import packing, pii


def fails(text):
    """(base rules, any rule)"""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    again = {p for k in range(len(w) - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for p in (k, k + 1, k + 2)}
    base = len(w) < 50 or 100 * len(again) > 50 * len(w)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, w))
    return base, base or 10 * sum(c in "#*$%&|<>" for c in text) > len(w) or chars < 2 * len(w) or chars > 12 * len(w) or 10 * (len(lines) - len(set(lines))) > 3 * len(lines)


def brute(rows):
    """(id, text, host) -> texts by id before packing."""
    judged = [(i, t, h, *fails(t)) for i, t, h in rows]
    n, bad = Counter(h for _, _, h, _, _ in judged), Counter(h for _, _, h, _, f in judged if f)
    rates = [bad[h] / n[h] for h in n]
    mean, var = np.mean(rates), np.var(rates)
    weight = min(max(mean * (1 - mean) / var - 1, 2), 10_000) if var else 10_000
    rate = {h: (bad[h] + mean * weight) / (n[h] + weight) for h in n}
    rejected = {h for h in n if rate[h] - 3 * (rate[h] * (1 - rate[h]) / (n[h] + weight + 1)) ** 0.5 > 0.5}
    kept = {i: t for i, t, h, b, _ in judged if not b and h not in rejected}
    sets = {}
    for i, t in kept.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    root = {i: i for i in kept}
    for _ in kept:
        for a in kept:
            for b in kept:
                if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in root):
            break
    kept = {i: t for i, t in kept.items() if root[i] == i}
    gone = removed_words(list(kept.items()), 20)
    cut = {}
    for i, t in kept.items():
        places = [m.start() for m in WORD.finditer(t)] + [len(t)]
        cut[i] = t[: places[0]] + "".join(t[a:b] for k, (a, b) in enumerate(zip(places, places[1:])) if k not in gone[i, t])
    pairs = np.zeros((256, 256))
    for t in cut.values():
        b = t.translate(LOWER).encode()
        for x in zip(b, b[1:]):
            pairs[x] += 1
    found = plain_terms(list(cut.items()), pii.pair_bits(pairs))
    return {i: pii.redact(t, sorted([(a, k, b, True) for a, k, b in plain_spans(t)] + [(a, 4, b, r) for a, b, r in found[i]])) for i, t in cut.items()}, rejected


def corpus():
    r = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ter", "sun", "vel") for b in ("ra", "no", "shi", "dem", "pul") for c in ("", "s", "ing", "or", "el")]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = text(60)
    rows = []
    for i in range(60):
        words = text(r.randint(70, 140)).split(" ")
        if i % 4 == 0:
            words[30:30] = passage.split(" ")
        if i % 5 == 0:
            words[10:10] = [f"someone{i % 3}@ex{i % 3}.example.org", f"Case{i % 3}x"]
        if i % 9 == 0:
            words[20:20] = ["token", "=", '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"']
        rows.append((i, " ".join(words).replace(" ", "\n", 3), f"host{i % 5}"))
    for i in range(60, 70):  # near copies: one word differs
        words = rows[i - 50][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), "host1"))
    rows += [(70, rows[3][1], "host2"), (71, "short text", "host3"), (72, "again and again " * 40, "host4")]
    rows += [(80 + i, text(80) if i % 8 == 0 else "bad", "junk") for i in range(60)]
    return rows


def test_pipeline_by_brute_force(spark, tmp_path):
    rows = corpus()
    want, rejected = brute(rows)
    assert rejected == {"junk"} and 40 < len(want) < 62
    frame = spark.createDataFrame([(i, t, "en", h, len(t)) for i, t, h in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(want)
    whole_pieces(out, lambda i: [*tokenizer.encode(want[i], add_special_tokens=False).ids, packing.END])
    assert sum("<removed>" in t for t in want.values()) > 5 and sum("<email>" in t for t in want.values()) > 5


def test_stages_keep_columns_and_rows(spark, tmp_path):
    """Each stage but the last gives the columns of documents, with texts changed in place."""
    data = [(i, t, None if i % 3 else f"s{i % 2}", len(t or ""), "x", "y", 1, "z") for i, t in enumerate([None, "", "short", " ".join(f"w{j}" for j in range(90)), "\n\t", "a " * 300, "é \U0001f600 日本 " * 40])]
    data += [(None, " ".join(f"v{j}" for j in range(90)), "s0", 5, "x", "y", 1, "z"), (3, data[3][1], "s0", 5, "x", "y", 1, "z"), (50, " ".join(f"w{j}" for j in range(40_000)), "s0", 5, "x", "y", 1, "z")]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i))
    assert ids == [None, 3, 3, 50]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {None, 3, 50}
    groups = defaultdict(int)
    for r in pieces:
        groups[r.sequence_id] += r.length
    assert max(groups.values()) <= packing.WINDOW


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, sf_dir)
    assert out.count() == 0 and (stage == "packing" or out.columns == docs.columns)
