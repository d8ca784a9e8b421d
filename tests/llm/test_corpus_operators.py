"""Each corpus operator against brute force, and on odd tables."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonearm.llm import bpe, bwt, components, minhash, ordering, packing, quality, spotsigs, substrings, toolcalls, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, hash string, row string"
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(n, seed=0):
    r = random.Random(seed)
    return [r.choice("the of and river stone cloud lamp window green slow house music tone paper".split()) + str(r.randint(0, 40)) for _ in range(n)]


def corpus():
    base = words(120)
    out = [(i, " ".join(words(80, i + 1))) for i in range(12)]
    out += [(20, " ".join(base)), (21, " ".join(base)), (22, " ".join(base[:-4] + ["x", "y", "z", "q"])), (23, " ".join(words(60, 99) + base[:60]))]
    out += [(30, None), (31, ""), (32, "  \n "), (33, "One two"), (34, "one TWO"), (35, "é" * 300), (36, "a" * 400), (40, out[0][1]), (41, "x " * 3000), (42, "hi <|endoftext|> you<|endoftext|><|endoftext|>")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "h", "r") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows and one id with two texts."""
    same = " ".join(words(50, 7))
    return frame(spark, [(None, same), (None, None), (1, same), (1, same), (1, "other " * 40), (2, None)])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_minhash(spark, docs):
    rows = corpus()
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    want = {d: (len(sets[i]), min(groups[root(i)])) for i, (d, _) in enumerate(rows)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups(spark, docs).collect()}
    assert got == want
    assert minhash.keep_one(spark, docs).count() == len({c for _, c in want.values()})


def test_superminhash_estimates_jaccard():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 2**63, 400).astype(np.uint64), r.integers(0, 2**63, 100).astype(np.uint64)
    h = np.concatenate([np.sort(a), np.sort(np.concatenate([a[:300], b])), np.sort(a[:1])])
    s = minhash.signatures(h, np.array([0, 400, 800, 801]))
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15 and len(set(s[2].tolist())) == minhash.REGISTERS


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r["vertex"]: r["root"] for r in components.components(spark, edges)[0].collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_substrings(spark, docs):
    seen, want = set(), {}
    for d, t in sorted(corpus()):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            gone[p : p + 100] |= data[p : p + 100] in seen
            seen.add(data[p : p + 100])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[d] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r["row"]["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(spark, docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000


def test_hot_anchors_agree(spark, docs, monkeypatch):
    want = sorted(map(str, substrings.remove_repeats(spark, docs).collect()))
    monkeypatch.setattr(substrings, "HOT", 1)
    assert sorted(map(str, substrings.remove_repeats(spark, docs).collect())) == want


def test_later_here():
    o, s, h1, h2 = (np.array(x) for x in ([3, 1, 1, 2, 2, 5], [0, 4, 4, 0, 9, 0], [7, 7, 7, 7, 7, 8], [1, 1, 1, 2, 2, 1]))
    # equal places stay together, other hashes apart
    assert substrings.later_here(o, s, h1, h2).tolist() == [True, False, False, False, True, False]
    assert not len(substrings.later_here(*[np.zeros(0, np.int64)] * 4))


def test_substrings_without_broadcasts(spark, docs, monkeypatch):
    want = sorted(map(str, substrings.remove_repeats(spark, docs).collect()))
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", -1)
    assert sorted(map(str, substrings.remove_repeats(spark, docs).collect())) == want
    assert minhash.keep_one(spark, docs.withColumn("_d", F.lit(1)).withColumn("kept", F.lit(1))).count() == len(corpus()) - 4


def test_bwt():
    r = random.Random(3)
    for _ in range(60):
        s = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 8))) for _ in range(r.randint(1, 6))]
        who, depth, lcp = bwt.collection(np.frombuffer(b"".join(s), np.uint8), np.cumsum([0, *map(len, s)]))
        got = [(s[i][len(s[i]) - d :], int(i), int(d)) for i, d in zip(who, depth)]
        assert got == sorted((x[len(x) - d :] if d else b"", i, d) for i, x in enumerate(s) for d in range(len(x) + 1))
        for k in range(1, len(got)):
            a, b = got[k - 1][0], got[k][0]
            assert lcp[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_bpe_matches_tiktoken():
    ranks = bpe.load_ranks(RANKS)
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choice("a b'sdtmlrev 19!?\n\té漢\U0001f600\x1c\0_") for _ in range(r.randint(0, 40))) for _ in range(500)]
    texts += [None, "", " ", "\n\n x", "'s'll", " 's", "<|endoftext|>", "x" * 500]
    cache = bpe.ids_cache(RANKS)
    for t, parts in zip(texts, bpe.encode(texts, cache)):
        ids = np.frombuffer(b"".join(parts), "<u4")
        assert ids.tolist() == enc.encode_ordinary(t or "")
        assert bpe.decode(ids, bpe.vocabulary(RANKS)).decode() == (t or "")


def test_bpe_on_every_code_point():
    ranks = bpe.load_ranks(RANKS)
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}'s" for c in every[k : k + 4096]) for k in range(0, len(every), 4096)]
    cache = bpe.ids_cache(RANKS)
    for t, parts in zip(texts, bpe.encode(texts, cache)):
        assert b"".join(parts) == np.array(enc.encode_ordinary(t), "<u4").tobytes()


def test_bpe_round_trip(spark, docs):
    ids = bpe.encode_ids(docs, RANKS)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(ids, RANKS).collect()}
    assert back == {d: t or "" for d, t in corpus()}
    for r in ids.collect():
        data, at = back[r["doc_id"]].encode(), [*r["byte_offsets"], None]
        vocab = bpe.vocabulary(RANKS)
        assert [data[a:b] for a, b in zip(at, at[1:])] == [vocab[i] for i in r["ids"]]


def test_packing(spark, docs):
    tok = Tokenizer.from_file(JSON)
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in corpus()}
    rows = packing.pack(spark, docs, JSON).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(part) and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, x in ids.items():
        assert sum(n for _, n in by_doc[d]) == len(x)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def test_patterns_leave_little_padding():
    r = np.random.default_rng(0)
    pieces = [e - s for n in r.lognormal(7, 1, 3000).astype(int) + 1 for s, e in packing.cuts(int(n), 1024)]
    tails = [p for p in pieces if p < 1024]
    slots, used = packing.plan({int(k): int(v) for k, v in zip(*np.unique(pieces, return_counts=True))})
    assert sum(b - a for _, a, b, _, _ in slots) == len(tails) and used * 1024 < 1.02 * sum(tails) + 1024


@pytest.mark.parametrize("spread", [1, 2**58 + 1])
def test_training_order(spark, docs, tmp_path, spread):
    """Every record's ids are the tokenizer's; ids far apart, as hashes are, don't overflow."""
    folder = f"file://{tmp_path}/shards"
    far = docs.withColumn("doc_id", (F.col("doc_id") - 20) * F.lit(spread))
    rows = ordering.materialise(spark, far, JSON, folder, key=5, length=64).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(len(rows)))
    assert len({r["slot"] for r in rows}) == len(rows) and [r["slot"] for r in rows] == sorted(r["slot"] for r in rows)
    counts = {}
    for r in rows:
        counts[r["shard"]] = counts.get(r["shard"], 0) + 1
    tok = Tokenizer.from_file(JSON)
    ids = {(d - 20) * spread: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in corpus()}
    assert len(rows) == sum(-(-len(x) // 64) for x in ids.values())
    got = ordering.read_from(folder, sorted(counts.items()), 3, len(rows), length=64)
    assert len(got) == len(rows) - 3
    for r, found in zip(rows[3:], got):
        want = ids[r["doc_id"]][64 * r["window"] : 64 * r["window"] + 64]
        assert found[found != ordering.PAD_ID].tolist() == want and r["n_tokens"] == len(want) and (found[len(want) :] == ordering.PAD_ID).all()
        assert zlib.crc32(np.array(want, "<u2").tobytes()) == r["ids_crc32"]


def test_permutation_refuses_what_does_not_fit():
    with pytest.raises(ValueError):
        ordering.permute(np.arange(3), 2**66, 1)


@pytest.mark.parametrize("domain", [1, 2, 7, 1000, 4096, 99_991])
def test_permutation(domain):
    assert sorted(ordering.permute(np.arange(domain), domain, 9).tolist()) == list(range(domain))


def test_spotsigs(spark, docs):
    got = {r["doc_id"]: r for r in spotsigs.fingerprints(spark, docs).collect()}
    rows = sorted(corpus(), reverse=True)
    for k, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b = (set(filter(None, got[x]["fingerprint"].split(","))) for x in (d, rows[(k + 1) % len(rows)][0]))
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d]["near_next"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert got[20]["fingerprint"] == got[21]["fingerprint"]


def test_similar(spark):
    """Pairs from length partitions and prefixes are those of brute force."""
    r = random.Random(5)
    base = [" ".join(words(60, 200 + k)) for k in range(4)]
    texts = []
    for t in base:
        for _ in range(8):
            w = t.split()
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"z{r.randint(0, 99)}"
            texts.append(" ".join(w[: len(w) - r.randint(0, 15)]))
    df = frame(spark, list(enumerate(texts)))
    sets = {r["id"]: set(r["sig"]) for r in spotsigs.signatures(df.select("text"), "text", "sig").select(F.xxhash64("sig").alias("id"), "sig").collect()}
    want = {}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b]):
                want[frozenset((a, b))] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    got = {frozenset((r["a"], r["b"])): r["likeness"] for r in spotsigs.similar(df).collect()}
    assert got == pytest.approx(want) and len(want) > 10


def test_spots_without_common_words(spark):
    t = " ".join(f"zork{i * 7919 % 1000}" for i in range(200))
    got = spotsigs.signatures(frame(spark, [(1, t), (2, "other " * 9 + t)]), "text", "sig").select(F.array_sort("sig").alias("sig")).collect()
    a, b = set(got[0]["sig"]), set(got[1]["sig"])
    assert len(a) > 10 and len(a & b) >= 0.8 * len(a)


def test_quality(spark):
    rows = [*corpus(), (50, "a#b *c*\nsame line\n \nsame line\nsame line\nlast"), (51, None)]
    trusted = {d for d, _ in rows if d < 10}
    docs = frame(spark, rows)
    got = {r["row"]["doc_id"]: r for r in quality.judge(docs, docs.where("doc_id < 10").select("doc_id")).collect()}
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    grams = {d: [(x,) for x in w] + list(zip(w, w[1:])) for d, w in split.items()}
    names = {g for x in grams.values() for g in x}
    one = {r["w"]: r["h"] for r in spark.createDataFrame([(g[0],) for g in names if len(g) == 1], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = spark.createDataFrame([(*g, one[g[0]], one[g[1]]) for g in names if len(g) == 2], "a string, b string, x long, y long")
    bucket = {(r["a"], r["b"]): r["h"] % quality.BUCKETS for r in pairs.select("a", "b", F.xxhash64("x", "y").alias("h")).collect()} | {(w,): h % quality.BUCKETS for w, h in one.items()}
    every, good = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for d, g in grams.items():
        for x in g:
            every[bucket[x]] += 1
            good[bucket[x]] += d in trusted
    ratio = np.log((good + 1) / (good.sum() + quality.BUCKETS)) - np.log((every + 1) / (every.sum() + quality.BUCKETS))
    for d, t in rows:
        w = split[d]
        at, cover = {}, set()
        for p in range(len(w) - 4):
            at.setdefault(tuple(w[p : p + 5]), []).append(p)
        for v in at.values():
            if len(v) > 1:
                cover.update(i for p in v for i in range(p, p + 5))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover))
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        score = np.mean([ratio[bucket[x]] for x in grams[d]]) if grams[d] else 0.0
        assert r["score"] == pytest.approx(score) and r["kept"] == (not r["base_failed"] and score >= quality.THRESHOLD)


def test_toxicity(spark):
    r = random.Random(0)
    rows = [(i, " ".join(words(60, i) + (["vilebad", "vilebad", "awful"] if i % 6 == 0 else []))) for i in range(400)]
    docs = frame(spark, rows)
    labels = docs.where("doc_id % 5 < 3").select("doc_id", (F.col("doc_id") % 6 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(spark, docs, labels)
    got = {x["row"]["doc_id"]: x["predicted"] for x in toxicity.score(docs, model).collect()}
    held = {x["doc_id"] for x in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert sum(got[i] == (i % 6 == 0) for i in held) >= 0.95 * len(held)
    assert r and toxicity.fit(spark, docs, labels.limit(0)).score("vilebad") < 0.01


def test_toxicity_against_plain_risk(spark):
    """Sample, features, corrected risk, its descent and the scores, computed plainly over dense rows."""
    rows = [(i, " ".join(words(25, i) + (["vilebad", "awfulness"] * (1 + i % 2) if i % 6 == 0 else [])) if i % 29 else None) for i in range(300)] + [(7, "another text of one id"), (8, " ".join(words(25, 8)))]
    labels = {i: int(i % 6 == 0) for i in range(200)}
    docs = frame(spark, rows)
    model = toxicity.fit(spark, docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))

    def found(text):
        tally = {}
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            for f in [w] + [w[:n] + "-" for n in (4, 5, 6) if n < len(w)]:
                tally[f] = tally.get(f, 0) + 1
        return set(tally) | {f + "+" for f in tally if tally[f] >= 2}

    free = sorted({(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5}, key=str)
    told = {i: x for i, x in labels.items() if zlib.crc32(str(i).encode()) % 5}
    prior = sum(told.values()) / len(told)
    every = [found(t) for _, t in free]
    toxic = [found(t) for i, t in free if told.get(i)]
    count = lambda f, sets: sum(f in s for s in sets)
    names = [
        f for f in sorted(set().union(*every)) if count(f, toxic) >= max(toxicity.LEAST_COUNT, toxicity.LEAST_SHARE * len(toxic))
        and count(f, toxic) / len(toxic) * (len(every) + 1) / (count(f, every) + 1) >= toxicity.LEAST_LIFT / prior
    ]
    assert set(model.weights) == set(names) and "vilebad" in names
    dense = lambda sets: np.array([[float(f in s) for f in names] + [1.0] for s in sets])
    x, u = dense(toxic), dense(every)
    loss = lambda z: np.log1p(np.exp(-z))  # noqa: E731  (of a document called toxic; of one called clean it is loss(-z))

    def parts(w):
        return prior * loss(x @ w).mean(), loss(-(u @ w)).mean() - prior * loss(-(x @ w)).mean()

    def slope(part, w, d=1e-5):
        return np.array([(parts(w + e)[part] - parts(w - e)[part]) / (2 * d) for e in np.eye(len(w)) * d])

    w, m, v = np.zeros(len(names) + 1), 0.0, 0.0
    for t in range(1, toxicity.STEPS + 1):
        negative = parts(w)[1] < 0
        g = -slope(1, w) if negative else slope(0, w) + slope(1, w)
        g = g + toxicity.DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - toxicity.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    plain = {(i, t): 1 / (1 + np.exp(-(np.array([float(f in found(t)) for f in names] + [1.0]) @ w))) for i, t in rows}
    got = {(r["row"]["doc_id"], r["row"]["text"]): r["score"] for r in toxicity.score(docs, model).collect()}
    assert got.keys() == plain.keys() and max(abs(got[k] - plain[k]) for k in plain) < 1e-3


def test_toxicity_risk_is_not_negative():
    """Where the prior is larger than the share of positives, the risk on negatives would fall without end; it is pushed back up."""
    p, clean = [np.array([0]), np.array([0, 1])], [np.array([2])] * 4
    for prior in (0.3, 0.5, 0.6, 0.8):
        w, b = toxicity.train(p, p + clean, 3, prior)
        z = lambda d: w[d].sum() + b  # noqa: B023, E731
        part = np.mean([np.logaddexp(0, z(d)) for d in p + clean]) - prior * np.mean([np.logaddexp(0, z(d)) for d in p])
        assert part > -0.1 and z(clean[0]) < z(p[0])
        assert prior > 0.3 or z(clean[0]) < 0 < z(p[0])


def test_spotsigs_plainly(spark, docs):
    """Anchors, chains, hashes and likenesses of texts and edited texts, computed word by word."""
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    text_hash = lambda t, seed=42: xxhash.xxh64(t.encode(), seed=seed).intdigest()

    def plain(t):
        ws = regex.sub(r"[^\p{L}\p{N} \t\n\x0b\f\r]+", "", t.lower()).split()
        content = [i for i, w in enumerate(ws) if w not in spotsigs.ANCHORS]
        out = set()
        for k, i in enumerate(content):
            if i and (ws[i - 1] in spotsigs.ANCHORS or signed(text_hash(ws[i - 1])) % spotsigs.CHOSEN == 0):
                h = text_hash(ws[i - 1])
                for j in content[k : k + spotsigs.CHAIN]:
                    h = xxhash.xxh64(text_hash(ws[j]).to_bytes(8, "little"), seed=h).intdigest()
                out.add(h & 0xFFFFFFFF)
        if not out and t:
            out = {text_hash(" ".join(ws) if ws else t) & 0xFFFFFFFF}
        return out

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    shown = lambda s: ",".join(f"{x:X}" for x in sorted(s))
    long = (50, " ".join(words(60_000, 3)))
    rows = sorted([*corpus(), long], reverse=True)
    got = {r["doc_id"]: r for r in spotsigs.fingerprints(spark, docs.union(frame(spark, [long]))).collect()}
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        a, e, n = plain(t), plain(t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]), plain(nxt)
        r = got[d]
        assert (r["fingerprint"], r["edited_fingerprint"], r["n_signatures"]) == (shown(a), shown(e), len(a)), d
        assert r["near_edited"] == pytest.approx(like(a, e)) and r["near_next"] == pytest.approx(like(a, n))


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Many rows of one id and text count once; the limits bound rows, not ids."""
    monkeypatch.setattr(toxicity, "UNLABELLED", 20)
    monkeypatch.setattr(toxicity, "POSITIVES", 5)
    docs = frame(spark, [(1, "same text vilebad")] * 300 + [(i, f"text {i} vilebad") for i in range(2, 400)])
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda p, u, *rest: seen.append((len(p), len(u))) or train(p, u, *rest))
    toxicity.fit(spark, docs, docs.select("doc_id", F.lit(1).alias("toxic")))
    toxicity.fit(spark, docs, docs.select("doc_id", F.lit(1).alias("toxic")).limit(1))
    assert all(p <= 5 and u <= 20 for p, u in seen)


def test_revisits_far_back(spark):
    """A URL with a response in the first time range only, asked for in all others; against brute force."""
    r = random.Random(8)
    rows = [(i, f"http://h{r.choice([0, 0, 0, i % 7])}.org/p", i, i < 3 or r.random() < 0.02, f"e{r.randint(0, 1)}") for i in range(600)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, full boolean, etag string").withColumn("last_modified", F.lit(None).cast("string")).withColumn("digest", F.lit(None).cast("string")).withColumn("headers", F.create_map(F.lit("x"), F.lit("y"))).repartition(5)
    last, want = {}, {}
    for i, url, _, full, tag in rows:
        if full:
            want[i] = ("full", i)
            last[url] = (i, tag)
        else:
            src = last.get(url)
            want[i] = ("no_response", None) if src is None else ("resolved", src[0]) if src[1] == tag else ("validator_mismatch", None)
    assert {x["record_id"]: (x["status"], x["source_id"]) for x in warc.resolve(spark, df).collect()} == want
    assert sum(s == "resolved" and i - src > 100 for i, (s, src) in want.items()) > 10


def test_canonical_json(spark):
    texts = ['{ "b" : [1, {"z": null, "a": "\\u00e9\\n"}], "a": {"d": -3, "c": true} }', "[]", '"x"', '{"a":1,"a":2}', '{"a":', "", None, '{"é": "<", "A": {}, "a": []}']
    want = [json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if t and t not in ('{"a":1,"a":2}', '{"a":') else None for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", toolcalls.canonical(F.col("t")).alias("j")).orderBy("i").collect()
    assert [r["j"] for r in got] == want


def test_argument_types(spark):
    schema = {"t": {k: (k, k == "string") for k in toolcalls.KINDS}}
    cases = [('{"string":"a\\"b","integer":3,"number":2.5,"boolean":false,"array":[1],"object":{"x":1},"null":null}', None), ('{"string":"x","number":3}', None), ('{"integer":1}', "missing:string"), ('{"string":"","integer":1.5}', "type:integer"),
             ('{"string":null}', "type:string"), ('{"string":"","array":{}}', "type:array"), ('{"string":"","object":[]}', "type:object"), ('{"string":"","boolean":"true"}', "type:boolean"), ('{"string":"","more":1}', "unknown:more"), ("[1]", "not_an_object"), ("x", "not_an_object"), (None, "not_an_object")]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", toolcalls.validate(F.lit("t"), F.col("t"), schema).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in got] == [f for _, f in cases]


def test_revisits(spark):
    rows = [(1, "http://www.X.org/a/?b=2&a=1#f", 1, True, "e1"), (2, "https://x.org/a?a=1&b=2&utm_source=z", 5, False, "e1"), (3, "x.org:80/a?a=1&b=2", 9, False, "e2"), (4, "x.org/none", 9, False, "e"), (5, None, 1, True, "e"), (6, None, 2, False, "e"), (7, "http://x.org/a?a=1&b=2", 10, False, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, full boolean, etag string").withColumn("last_modified", F.lit(None).cast("string")).withColumn("digest", F.lit(None).cast("string")).withColumn("headers", F.create_map(F.lit("date"), F.col("record_id").cast("string"), F.lit("x"), F.col("record_id").cast("string")))
    got = {r["record_id"]: (r["status"], r["source_id"], dict(r["headers"])) for r in warc.resolve(spark, df).collect()}
    assert got[2] == ("resolved", 1, {"date": "2", "x": "1"})
    assert [got[i][0] for i in (1, 3, 4, 5, 6, 7)] == ["full", "validator_mismatch", "no_response", "full", "no_response", "no_validator"]


def test_toolcalls(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", "open", '{ "page" : 3 }', []), (1, 2, "b", "open", '{"page": "3"}', ["a"]), (1, 4, "c", "search", '{"query": "q"}', ["d"]), (1, 6, "d", "search", '{"query":"q"}', ["c"]), (1, 8, "a", "open", '{"page":4}', []), (2, 0, None, "open", "{}", []), (2, 1, "z", "no", None, None)],
        "conv_id long, turn long, call_id string, name string, arguments string, refs array<string>",
    )
    results = spark.createDataFrame([(1, 1, "a", "ok"), (1, 3, "a", "late"), (3, 1, "a", "alone")], "conv_id long, turn long, call_id string, content string")
    rows = toolcalls.link(spark, calls, results, toolcalls.SCHEMAS).collect()
    got = sorted((r["conv_id"], r["call_id"] or "", r["status"], r["fault"] or "") for r in rows)
    assert got == [(1, "a", "duplicate_call", ""), (1, "a", "linked", ""), (1, "b", "invalid", "type:page"), (1, "c", "cycle", ""), (1, "d", "cycle", ""), (2, "", "no_id", "missing:page"), (2, "z", "invalid", "unknown_tool"), (3, "a", "orphan_result", "")]
    linked = next(r for r in rows if r["status"] == "linked")
    assert linked["json"] == '{"arguments":{"page":3},"id":"a","name":"open"}' and linked["result"] == "ok"


def test_toolcall_chain_of_200(spark):
    calls = spark.range(200).selectExpr("1L conv_id", "2 * id turn", "concat('c', 2 * id) call_id", "'search' name", "'{\"query\":\"q\"}' arguments", "array(concat('c', 2 * id - 2)) refs")
    results = calls.where("turn < 300").selectExpr("conv_id", "turn + 1 turn", "call_id", "'ok' content")
    got = {r["call_id"]: (r["level"], r["status"]) for r in toolcalls.link(spark, calls, results, toolcalls.SCHEMAS).collect()}
    assert got == {f"c{2 * i}": (i, "linked" if i < 150 else "no_result") for i in range(200)}


def test_toolcall_levels(spark):
    """Random references to earlier calls, and rings of 3 and 1 with calls behind them, in two conversations."""
    r = random.Random(4)
    refs = {f"a{i:02}": [f"a{j:02}" for j in range(i) if r.random() < (0.08 if i % 3 else 0)] + (["x9"] if i == 30 else []) for i in range(60)}
    refs |= {f"b{i:03}": [f"b{i - 1:03}", "a40"] if i else ["gone"] for i in range(80)}
    refs |= {"x1": ["x2"], "x2": ["x3"], "x3": ["x1", "a05"], "x9": ["x1"], "y1": ["y1", "a59"]}
    level = {}
    while True:
        new = {c: 1 + max((level[t] for t in to), default=-1) for c, to in ((c, [t for t in to if t in refs]) for c, to in refs.items() if c not in level) if all(t in level for t in to)}
        if not new:
            break
        level |= new
    rows = [(k, c, to) for k in (1, 2) for c, to in refs.items()]
    got = {(x["conv_id"], x["call_id"]): x["level"] for x in toolcalls.levels(spark, spark.createDataFrame(rows, "conv_id long, call_id string, refs array<string>")).collect()}
    assert got == {(k, c): n for k in (1, 2) for c, n in level.items()} and "a30" not in level


def test_toolcall_ladders(spark, monkeypatch):
    """Two references each, to the two calls before or after, over many blocks; rounds by the logarithm of the depth."""
    rounds = []
    swept = toolcalls.swept
    monkeypatch.setattr(toolcalls, "swept", lambda *a: rounds.append(1) or swept(*a))
    monkeypatch.setattr(toolcalls, "BLOCK", 50)
    n = 1000
    for sign, most in ((-1, 8), (1, 9)):
        rounds.clear()
        rows = [(c, f"c{i}", i, [f"c{i + sign}", f"c{i + 2 * sign}"]) for c in (1, 2) for i in range(n)]
        got = toolcalls.levels(spark, spark.createDataFrame(rows, "conv_id long, call_id string, place long, refs array<string>"))
        assert {(r["conv_id"], r["place"]): r["level"] for r in got.collect()} == {(c, i): i if sign < 0 else n - 1 - i for c in (1, 2) for i in range(n)}
        assert len(rounds) <= most


def test_toolcall_odd_rows(spark):
    """No conversation, no identifier, no turn, repeated rows and identifiers, ties, clashing columns: order and values."""
    calls = [
        (None, 0, "a", "open", '{"page":1}', None), (1, None, "b", "open", '{"page":2}', [None, "b2", "gone"]), (1, 3, "b2", "open", '{"page":3}', []), (1, 3, "b2", "open", '{"page":3}', []),
        (1, 5, "t", "open", '{"page":9}', []), (1, 5, "t", "open", '{"page":8}', ["b"]), (1, 6, None, "open", '{"page":4}', ["b"]), (1, 7, "s", "open", '{"page":5}', ["s"]),
    ]
    calls = spark.createDataFrame(calls, "conv_id long, turn int, call_id string, name string, arguments string, refs array<string>").withColumn("place", F.lit(7)).withColumn("level", F.lit("x")).withColumn("_h", F.lit(1))
    results = spark.createDataFrame([(1, 4, "b2", "y"), (1, 4, "b2", "x"), (1, 1, None, "n"), (None, 1, "a", "m"), (1, None, "t", None)], "conv_id long, turn int, call_id string, content string").withColumn("place", F.lit(7))
    got = sorted((tuple(r[c] for c in ("conv_id", "seq", "call_id", "status", "level", "result")) for r in toolcalls.link(spark, calls, results, toolcalls.SCHEMAS).collect()), key=str)
    assert got == sorted([
        (None, 1, "a", "no_id", None, None), (1, 1, "b2", "linked", 0, "x"), (1, 2, "b2", "duplicate_call", 0, "x"), (1, 3, "b", "no_result", 1, None),
        (1, 4, "t", "linked", 2, None), (1, 5, "t", "duplicate_call", 2, None), (1, 6, None, "no_id", None, None), (1, 7, "s", "cycle", None, None),
        (1, None, None, "orphan_result", None, "n"), (None, None, "a", "orphan_result", None, "m"),
    ], key=str)


def run_all(spark, df, tmp_path):
    labels = df.select("doc_id", F.lit(1).alias("toxic"))
    return {
        "minhash": minhash.groups(spark, df), "substrings": substrings.remove_repeats(spark, df), "packing": packing.pack(spark, df, JSON),
        "spotsigs": spotsigs.fingerprints(spark, df), "quality": quality.judge(df, df.select("doc_id")), "bpe": bpe.encode_ids(df, RANKS),
        "toxicity": toxicity.score(df, toxicity.fit(spark, df, labels)), "ordering": ordering.materialise(spark, df, JSON, f"file://{tmp_path}/s"),
    }


def test_odd_rows(spark, odd, tmp_path):
    """Nulls, repeated rows and one id with two texts: what each operator defines for them."""
    out = {k: [r.asDict(recursive=True) for r in v.collect()] for k, v in run_all(spark, odd, tmp_path).items()}
    own = lambda k, **w: [r for r in out[k] if all((r.get("row") or r).get(c, r.get(c)) == x for c, x in w.items())]
    for k in ("minhash", "substrings", "spotsigs", "quality", "bpe", "toxicity"):
        assert len(out[k]) == 6, k
    # the null id sorts first, so the shared text stays there and goes from document 1; the two equal rows count once
    assert sorted(r["n_removed"] for r in own("substrings", doc_id=None)) == [0, 0]
    gone = sorted(r["n_removed"] for r in own("substrings", doc_id=1))
    assert gone[1] == gone[2] > 200
    assert {(r["n_shingles"], r["component_id"]) for r in own("minhash", doc_id=2)} == {(0, 2)}
    assert {r["component_id"] for r in own("minhash", doc_id=1)} == {1}
    assert sum(r["length"] for r in own("packing", doc_id=2)) == 1 and [r["n_tokens"] for r in own("ordering", doc_id=2)] == [1]
    a, b = (r for r in own("toxicity", doc_id=1) if r["row"]["text"].startswith("the") or "other " not in r["row"]["text"])
    assert a["score"] == b["score"]
    assert own("bpe", doc_id=2)[0]["ids"] == [] and own("spotsigs", doc_id=2)[0]["n_chars"] == 0
    assert own("quality", doc_id=2)[0]["base_failed"] and own("quality", doc_id=2)[0]["score"] == 0.0


def test_very_long_text(spark, tmp_path):
    """One document of a few million characters beside short ones: whole texts are worked on."""
    r = random.Random(2)
    long = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(300_000))
    df = frame(spark, [(1, long), (2, long), (3, "short text")])
    found = {x["doc_id"]: x for x in minhash.groups(spark, df).collect()}
    assert found[1]["n_shingles"] > 290_000 and found[2]["component_id"] == 1 and found[3]["component_id"] == 3
    cut = {x["row"]["doc_id"]: x for x in substrings.remove_repeats(spark, df).collect()}
    assert (cut[1]["n_removed"], cut[2]["n_removed"], cut[2]["n_spans"]) == (0, len(long), 1)
    assert sum(x["length"] for x in packing.pack(spark, df.where("doc_id = 2"), JSON).collect()) > 600_000
    assert {x["row"]["doc_id"]: x["n_words"] for x in quality.judge(df, df.limit(0)).collect()}[2] == 300_000


def test_empty_tables(spark, empty, tmp_path):
    for name, out in run_all(spark, empty, tmp_path).items():
        assert out.count() == 0, name
    calls, results = toolcalls.conversation_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert toolcalls.link(spark, calls, results, toolcalls.SCHEMAS).count() == 0
    assert warc.resolve(spark, warc.page_records(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
