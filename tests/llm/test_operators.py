"""Each operator of the pipeline against brute force, and on the cases that break things: nulls, empty texts, repeated
rows, empty tables, columns whose names clash."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushspan.llm import bpe, common, langid, licenses, minhash, mixing, pii, quality, rollup, simhash, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, keep string, v long, size string, rate string, spans string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One two three four five six. " * 30), (4, "One two three four five six. " * 30), (None, "x"), (5, "é😀中 ' ''s it's"), (6, "a" * 5000), (7, "9" * 3000 + "@")]


def table(spark, rows, sources=("a", None)):
    return spark.createDataFrame([(i, t, "en", sources[k % len(sources)], 1, 9, "k", 9, "s", "r", "x") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def near(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "w%d" % rng.randrange(10**6)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows = random.Random(3), []
    for k in range(60):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.choice([3, 40, 400, 1500])))
        rows += [text] + [near(rng, text, rng.choice([0, 1, 3])) for _ in range(k % 4)]
    rng.shuffle(rows)
    return table(spark, list(enumerate(rows)))


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    import xxhash

    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Smallest id of each id's component, by comparing all pairs."""
    best = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if bin(a ^ b).count("1") <= 4 and best[j] < best[i]:
                    best[i], changed = best[j], True
    return best


def test_simhash(spark, corpus, odd, none):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(corpus).collect()}
    prints = [(r["doc_id"], brute_print(r["text"])) for r in corpus.collect()]
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == dict(prints)
    assert {i: r["component_id"] for i, r in got.items()} == classes(prints)
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.distinct_documents(odd).count() <= 7


def exact_classes(texts):
    """Smallest index of each text's component under links of exact Jaccard similarity, and the number of links."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label, links = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links += 1
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label, links


def similar_classes(spark, texts):
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(table(spark, list(enumerate(texts)))).collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(found[i], i)
    return [least[found[i]] for i in range(len(texts))]


def test_similar_equals_brute_force(spark):
    rng, texts = random.Random(8), []
    for size in [12, 40, 90, 300] * 15:
        words = ["w%d" % rng.randrange(10**6) for _ in range(size)]
        texts.append(" ".join(words))
        for share in (0.70, 0.75, 0.78, 0.80, 0.82):
            # the first words of the text, then others: shingles in common over all are about `share`
            same = round(2 * share / (1 + share) * (size - 4)) + 4
            texts.append(" ".join(words[:same] + ["v%d" % rng.randrange(10**6) for _ in range(size - same)]))
    label, links = exact_classes(texts)
    assert links > 60 and similar_classes(spark, texts) == label


def family(rng, count, every):
    """Texts that share a passage (similarity under 0.75); each `every`-th has a near copy."""
    passage, texts = ["p%d" % i for i in range(204)], []
    for k in range(count):
        own = ["o%d" % rng.randrange(10**8) for _ in range(40)]
        texts.append(" ".join(passage + own))
        if k % every == 0:
            texts.append(" ".join(passage + own[:-5] + ["q%d" % rng.randrange(10**8) for _ in range(5)]))
    rng.shuffle(texts)
    return texts


def test_families_keep_true_pairs_apart_from_noise(spark):
    texts = family(random.Random(9), 40, 4)
    label, links = exact_classes(texts)
    assert links == 10 and similar_classes(spark, texts) == label


def test_long_runs_are_compared_whole(spark):
    texts = family(random.Random(10), 150, 1)
    label, links = exact_classes(texts)
    assert links == 150 and similar_classes(spark, texts) == label


def test_ball_hashing_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, np.uint64)
    values = list(base)
    for v in base[:100]:
        for k in range(6):
            values.append(v ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))))
    values = np.unique(np.array(values, np.uint64))
    label = np.arange(len(values))
    for prefix in range(16):
        a, b = simhash.forest(values, 4, prefix, 64, 2)
        own = np.bitwise_count((values >> np.uint64(60)) ^ np.uint64(prefix)) <= 2
        assert own[a].all() and own[b].all()
        label = simhash.joined(label, a, b)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            assert label[i] == label[j]


def test_chunks_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    values = np.unique(np.uint64(7) << np.uint64(40) ^ rng.integers(0, 2**12, 200).astype(np.uint64))
    whole = simhash.forest(values, 4, 0, 64, 2)
    monkeypatch.setattr(simhash, "CHUNK", 10_000)
    parts = simhash.forest(values, 4, 0, 64, 2)
    assert (simhash.joined(np.arange(len(values)), *whole) == simhash.joined(np.arange(len(values)), *parts)).all()


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    assert got == {x: find(x) for x in up}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, corpus, odd, none):
    rows = mixing.mix(table(spark, [(r["doc_id"], r["text"]) for r in corpus.collect()], ("b", "a", None, "c"))).collect()
    again = mixing.mix(table(spark, [(r["doc_id"], r["text"]) for r in corpus.collect()], ("b", "a", None, "c"))).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    sizes, weight = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weight[s] = (5, 2, 1)[k % 3]
    target, open_ = {}, set(sizes)
    left = 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        for s in over or set(open_):
            target[s] = 2.0 * sizes[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert own[0]["target"] == pytest.approx(target[s]) and own[0]["source_size"] == sizes[s]
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(target[s], rel=1e-5)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 0.02 * target[s]
        assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in own)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0


def test_mixing_meets_targets_with_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(common, "UNFOLD", 7)
    same = [(None, "five words in this text")] * 100
    rows = same + [(7, " ".join(["w"] * (1 + k % 9))) for k in range(100)] + [(k, "a b c") for k in range(50)]
    docs = spark.createDataFrame([(i, t, "a" if k < 100 else "b") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")


def plain_encoder(vocabulary):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, odd, none, vocabulary):
    plain, rng = plain_encoder(vocabulary), random.Random(4)
    bits = ["'", "'s", "'re", "'ll", "'LL", " ", "  ", "\n", "\r\n", "\t", "　", " ", "a", "Éa", "中文", "1", "½", ".", "!!", "😀", "́", "x" * 80, "ab" * 300, "\U00010d40", "don't", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(1500)]
    own = bpe.coder(bpe.read_ranks(vocabulary), bpe.class_table())
    ids, offsets = own.encode(texts)
    for text, packed, places in zip(texts, ids, offsets, strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == plain.encode_ordinary(text)
        assert own.decode(packed).decode() == text and (len(places) == 0) == (text == "")
    rows = bpe.decode(bpe.encode(odd, vocabulary), vocabulary).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["n_tokens"] == len(plain.encode_ordinary(r["text"] or "")) and bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode(none, vocabulary).count() == 0
    counted = bpe.count_tokens(odd, vocabulary).select("n_tokens").collect()
    assert sorted(r[0] for r in counted) == sorted(r["n_tokens"] for r in rows)


def test_scan_equals_steps():
    """The blockwise scan and a plain run of the automaton agree."""
    table_ = np.frombuffer(bpe.class_table(), np.uint8)
    rng, text = random.Random(6), ""
    for _ in range(700):
        text += rng.choice(["a", " ", "\n", "'s", "'", "1", ".", "'ve"])
    points = np.frombuffer((text + "\n").encode("utf-32-le"), np.uint32)
    starts = bpe.token_starts(points, np.array([len(text)]), table_)
    import regex

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    assert np.flatnonzero(starts[:-1]).tolist() == [m.start() for m in regex.finditer(pattern, text)]


BASES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    out = []
    for kind, pattern in BASES.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255) or (kind == "card" and not (14 <= len(d) <= 19 and pii.luhn(d))) or (kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii(spark, odd, none):
    rng = random.Random(3)
    bits = [*"0123456789", "@", ".", "a", "b.c", "+", "-", " ", "(", ")", "1.2.3.4", "@x.y", "4111111111111111", "é", "a@b@c.d"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == brute_base(text), text
    weights = pii.trained()
    found = lambda t: [s[:3] for s in pii.spans_of(t, weights)]
    assert found("call (743) 555-3824 now") == [("phone", 5, 19)]
    assert found("ssn 123-45-6789.") == [("ssn", 4, 15)]
    assert found('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == [("secret", 9, 49)]
    for clean in ("version 2.0 of 1999, page 12.", "Licensed under CC BY-NC 4.0.", "Apache License, Version 2.0.", "at 10:30, 3 of 7", "it costs $100.50"):
        assert not found(clean)
    right = total = extra = 0
    for text, gold in pii.generated(150, 77):
        got = set(pii.Island(text, 0, len(text)).best(weights))
        right, total, extra = right + len(got & set(gold)), total + len(gold), extra + len(got - set(gold))
    assert right / total > 0.8 and extra / total < 0.2
    rows = pii.find(odd).collect()
    assert len(rows) == len(ODD) and pii.find(none).count() == 0
    clean = pii.redact(table(spark, [(1, "mail a.b@c.org or +1 (743) 555-3824!"), (2, None)])).orderBy("doc_id").collect()
    assert clean[0]["text"] == "mail [EMAIL] or [PHONE]!" and clean[1]["text"] is None


def test_pii_long_texts_are_linear():
    import time

    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "1." * 100_000, "+1 " * 50_000):
        pii.base_spans(text)
    assert time.time() - began < 20


WORDS = {"aa": "lo mi sa tu ve pan dor kel".split(), "bb": "ich und der schu wer zug ost nem".split(), "cc": "que los una bra cion dad por sil".split()}


def test_langid(spark, odd, none):
    rng, rows = random.Random(8), []
    for i in range(400):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang if i % 9 else None, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    got = langid.identify(docs).collect()
    truth = {r[0]: r[3] for r in rows}
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    scored = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert scored[1]["lang_pred"] == scored[2]["lang_pred"] == scored[3]["lang_pred"] == "und" and scored[1]["score"] == 0
    assert langid.identify(none).count() == 0


def test_minhash(spark, corpus, odd, none):
    rows = minhash.edited_likeness(corpus).orderBy(F.desc("doc_id")).collect()
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    order = sorted(texts, reverse=True)
    sets = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    wrong = []
    for k, r in enumerate(rows):
        own, nxt = texts[order[k]], texts[order[(k + 1) % len(order)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(own)
        for other, value in ((edited, r["near_edited"]), (nxt, r["near_next"])):
            a, b = sets(own), sets(other)
            wrong.append(abs(len(a & b) / len(a | b) - value))
    assert np.mean(wrong) < 0.06
    by_text = {}
    for r in minhash.fingerprints(corpus).collect():
        assert by_text.setdefault(r["text"], r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) == minhash.BINS
    assert minhash.edited_likeness(odd).count() == len(ODD) and minhash.edited_likeness(none).count() == 0


def test_next_text_with_null_repeated_and_many_rows(spark, monkeypatch):
    """Against a walk over all rows in order; ranges so small that ends, parts of one id and often repeated rows all occur."""
    monkeypatch.setattr(minhash, "BUCKET", 8)
    rng = random.Random(12)
    words = lambda: " ".join(rng.choice("abcdefghijk") * rng.randint(1, 3) for _ in range(rng.randint(0, 30)))
    rows = [(i, words()) for i in range(120)] + [(None, words()) for _ in range(60)] + [(57, words()) for _ in range(50)] + [(None, None)] * 30 + [(-5, "the same text of one id")] * 40 + [(300, "")] * 3 + [(-(2**63), "x y z"), (2**63 - 1, "é😀 中")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "t", F.xxhash64("t").alias("h")).collect()
    order = sorted(keyed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    want = []
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        half = len(r["t"]) // 2
        text = r["t"][: len(r["t"]) - half] + n["t"][:half]
        want.append((str(r["doc_id"]), len(r["t"]), hashlib.sha256(text.encode()).hexdigest()))
    got = minhash.edited_likeness(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    prints = {(r["doc_id"], r["text"]): r["fingerprint"] for r in minhash.fingerprints(docs).collect()}
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got) and {r["fingerprint"] for r in got} == set(prints.values())


def brute_top(vectors, k):
    fine = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in fine:
        if q % 100 == 0:
            scored = sorted((-int(a @ b), i) for i, b in fine if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("shard", [64, 4096])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    rng = np.random.default_rng(3)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(500)]
    vectors += [(500 + i, vectors[0][1]) for i in range(40)] + [(600, None), (601, [float("nan")] * 8), (602, [None] + [1.0] * 7), (700, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int, rank int")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect()}
    assert got == brute_top(vectors, 10)
    assert topk.top_k(df.limit(0)).count() == 0


def test_licenses(spark, odd, none):
    mit = f"{licenses.SENTENCES['mit-grant']}.\n{licenses.SENTENCES['mit-notice']}.\n{licenses.SENTENCES['as-is']}."
    texts = ["Intro. RELEASED under the MIT License.", mit, licenses.SENTENCES["mit-notice"] + ".", "Licensed under the Apache License, Version 2.0!\nAll rights reserved.", "This### work$$$ is*** licensed under the GNU General Public License, version 3.", "the MIT License was released", None]
    got = [r["licences"] for r in licenses.scan(table(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == ["MIT", "MIT", "", "all-rights-reserved,Apache-2.0", "GPL-3.0", "", ""]
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0


def test_wrapped_licenses(spark):
    import textwrap

    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"""
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    wrap = lambda text, mark, width=72: "\n\n".join(textwrap.fill(x, width, initial_indent=mark, subsequent_indent=mark) for x in text.split("\n\n"))
    texts = [wrap(t, m, w) for t in (mit, apache, gpl) for m in ("", " * ", "# ") for w in (40, 72, 10000)]
    texts += ["/*\n" + wrap(apache, " * ") + "\n */\nint x;", "A heading\nReleased under the MIT\nLicense.", "Released under the MIT license\nand more words"]
    got = [r["licences"] for r in licenses.scan(table(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == ["MIT"] * 9 + ["Apache-2.0"] * 9 + ["GPL-3.0-or-later"] * 9 + ["Apache-2.0", "MIT", "MIT"]


def junk(rng, text):
    words = text.split()
    return rng.choice([" ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in words), " ".join(w.upper() + "!!" for w in words[:3] * 20), " ".join(x for w in words[:8] for x in [w] * 12), " | ".join(words)])


def test_quality(spark, odd, none):
    rng, rows = random.Random(2), []
    for i in range(500):
        text = ". ".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 14))).capitalize() for _ in range(rng.randint(3, 12))) + "."
        rows.append((i, junk(rng, text) if i % 5 == 0 else text))
    got = quality.classify(table(spark, rows)).collect()
    assert sum(r["keep"] == (r["doc_id"] % 5 != 0) for r in got) >= 490
    assert all(r["keep"] for r in got if r["doc_id"] % 5) or sum(not r["keep"] for r in got if r["doc_id"] % 5) <= 2
    share, accuracy, _ = quality.estimate({(1, 1): 80, (0, 0): 15, (1, 0): 3, (0, -1): 2})
    assert 0.7 < share < 0.95 and accuracy[0, 1, 1] > 0.8
    assert quality.classify(odd).count() == len(ODD) and quality.classify(none).count() == 0


@pytest.mark.parametrize("repeated", [None, "spam $$$ " * 40])
def test_quality_learns_from_distinct_texts(spark, monkeypatch, repeated):
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda rows, f=quality.fit: fitted.append(rows) or f(rows))
    monkeypatch.setattr(quality, "SAMPLE", 200)
    rng, rows = random.Random(4), []
    for i in range(1200):
        text = ". ".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 14))).capitalize() for _ in range(rng.randint(3, 12))) + "."
        rows.append((i, repeated if i % 3 == 0 else junk(rng, text) if i % 3 == 1 and i % 2 else text))
    got = quality.classify(table(spark, rows)).collect()
    assert len(fitted[0]) < 300 and sum(r[2] < 0.5 for r in fitted[0]) > 60
    bad = [r["keep"] for r in got if r["doc_id"] % 3 == 1 and r["doc_id"] % 2]
    assert sum(bad) < 0.05 * len(bad) and sum(r["keep"] for r in got if r["doc_id"] % 3 == 2) > 390


def test_rollup(spark, tmp_path, odd, none):
    words = lambda d: d.withColumn("n_tokens", F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("long"))
    total = rollup.Rollup(spark, f"file://{tmp_path}/r")
    state = lambda: {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in total.totals().collect()}
    assert state() == {}
    assert total.commit("b1", rollup.changes(odd, "t", words)) and not total.commit("b1", rollup.changes(odd, "t", words))
    first = state()
    assert sum(n for n, _ in first.values()) == len(ODD) and (None, "en") in first
    some = odd.where("doc_id = 4")
    assert total.commit("b2", rollup.revised(some, some.withColumn("text", F.lit("a b")), "t", words))
    after = state()
    assert after != first and sum(n for n, _ in after.values()) == len(ODD)
    total.compact()
    assert state() == after and total.covered() == {"b1", "b2"} and not total.commit("b2", rollup.changes(odd, "t", words))
    assert total.commit("b3", rollup.changes(none, "t", words)) and state() == after
    assert total.commit("b4", rollup.changes(odd, "t", words, -1).unionByName(rollup.revised(some.withColumn("text", F.lit("a b")), some, "t", words)))
    assert state() == {}
    with pytest.raises(ValueError):
        total.commit("../x", rollup.changes(odd, "t", words))


def test_rollup_of_a_broken_compaction_and_of_two_writers(spark, tmp_path, odd, monkeypatch):
    words = lambda d: d.withColumn("n_tokens", F.lit(5).cast("long"))
    total = rollup.Rollup(spark, f"file://{tmp_path}/r")
    state = lambda: sorted(map(tuple, total.totals().collect()), key=str)
    batch = rollup.changes(odd, "t", words)
    total.commit("b1", batch)
    total.commit("b2", batch)
    want = state()
    # lost between taking in the base and deleting what it covers
    monkeypatch.setattr(rollup.Rollup, "_sweep", lambda self: None)
    total.compact()
    assert state() == want and total.covered() == {"b1", "b2"} and not total.commit("b1", batch)
    monkeypatch.undo()
    total.commit("b3", batch)
    more = state()
    total.compact()
    assert state() == more and total.covered() == {"b1", "b2", "b3"} and len(total.taken()) == 1
    # a second writer that has seen no b4 either: it comes after the first one's rename
    fs = total._system()
    once = rollup.Rollup(spark, total.path)
    monkeypatch.setattr(once, "covered", lambda: set())
    assert total.commit("b4", batch) and not once.commit("b4", batch)
    after = state()
    # one that checked before the first renamed, and renames after it
    class Late:
        def __init__(self, fs):
            self.fs = fs
        def __getattr__(self, name):
            return (lambda path: False if path.getName() == "b4" else self.fs.exists(path)) if name == "exists" else getattr(self.fs, name)
    monkeypatch.setattr(once, "_system", lambda: Late(fs))
    assert not once.commit("b4", batch) and state() == after != more


def test_token_counts_query_equals_a_recount(spark, vocabulary):
    from collections import Counter

    from hushspan.llm import queries

    sf = "/root/testdata/sf0.001"
    plain, docs, tokens = plain_encoder(vocabulary), Counter(), Counter()
    for r in queries.documents(spark, sf).collect():
        docs[r["source"], r["lang"]] += 1
        tokens[r["source"], r["lang"]] += len(plain.encode_ordinary(r["text"] or ""))
    got = queries.op10_token_counts(spark, sf).collect()
    assert {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in got} == {k: (docs[k], tokens[k]) for k in docs}


def test_few_texts_of_a_language_are_enough(spark):
    texts = {"en": "the cat sat on the mat and the dog ran", "es": "el perro come en la casa de mi padre", "de": "der hund und die katze sind im haus"}
    rows = [(i, t, lang) for i, (lang, t) in enumerate([*texts.items()] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["de", "en", "es"]
    assert all(r["lang_pred"] == lang for r, (_, _, lang) in zip(langid.identify(docs).orderBy("doc_id").collect(), rows, strict=True))


def test_masks_answer_for_every_language(spark):
    """Hits by the bit-sliced filter against sets: each n-gram of a language is found, others only at the false rate."""
    import pandas as pd

    rng = np.random.default_rng(2)
    langs = [f"l{i:02d}" for i in range(70)]
    sets = {x: np.unique(rng.integers(0, 1 << 62, 300)) for x in langs}
    model = langid.build(pd.DataFrame([(x, g, 1) for x in langs for g in sets[x]], columns=["lang", "gram", "n"]))
    every = np.concatenate(list(sets.values())).astype(np.uint64)
    both = np.bitwise_and.reduce([model.masks[at] for at in langid.slots(every, model.log2)])
    for i, x in enumerate(langs):
        bit = (both[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        own = np.isin(every, sets[x].astype(np.uint64))
        assert bit[own].all() and abs(bit[~own].mean() - model.false[i]) < 0.01
