"""The registered corpus queries and the pipeline on the smallest tables, against plain computations."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tonearm.llm import minhash, quality, registry, substrings, toxicity

SF = "/root/testdata/sf0.001"
DOCS = f"{SF}/documents.parquet"


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(DOCS).collect()}


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(texts):
    """(set size, smallest linked doc_id) by comparing all pairs."""
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (len(sets[d]), top(d)) for d in texts}


def cut_bytes(texts):
    """What stays of each text after strings of 100 bytes that start earlier are removed."""
    seen, out = set(), {}
    for d in sorted(texts):
        data = texts[d].encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            gone[p : p + 100] |= data[p : p + 100] in seen
            seen.add(data[p : p + 100])
        out[d] = (data, gone)
    return out


def test_every_operator_has_a_query():
    assert [int(n.split("_")[0][2:]) for n in registry.QUERIES] == list(range(1, 11))
    assert "pipeline" in entry.queries()


def test_op1(spark, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = run(spark, "op1_training_order")
    assert sorted(r["place"] for r in got) == list(range(len(got))) and len({r["slot"] for r in got}) == len(got)
    want = {}
    for d, t in rows.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u2")
        want |= {(d, k): (min(512, len(ids) - 512 * k), zlib.crc32(ids[512 * k : 512 * k + 512].tobytes())) for k in range(-(-len(ids) // 512))}
    assert {(r["doc_id"], r["window"]): (r["n_tokens"], r["ids_crc32"]) for r in got} == want


def test_op2(spark, rows):
    got = {r["doc_id"]: r for r in run(spark, "op2_toxicity")}
    assert set(got) == set(rows)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in got.items())


def test_op2_on_held_out_labels(spark):
    """Accuracy on labels that were never read, on the next larger tables."""
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["predicted"] for r in registry.QUERIES["op2_toxicity"](spark, sf).where("held_out").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got}
    assert len(labels) > 50 and np.mean([got[d] == t for d, t in labels.items()]) >= 0.93


def test_op3(spark, rows):
    got = {r["doc_id"]: r for r in run(spark, "op3_spotsigs")}
    ids, sets = sorted(rows, reverse=True), {}
    for d, r in got.items():
        sets[d] = set(filter(None, r["fingerprint"].split(",")))
    for k, d in enumerate(ids):
        t, nxt = rows[d], rows[ids[(k + 1) % len(ids)]]
        cut = len(t) // 3
        edited = set(filter(None, got[d]["edited_fingerprint"].split(",")))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest() and got[d]["n_chars"] == len(t)
        assert got[d]["near_edited"] == pytest.approx(like(sets[d], edited)) and got[d]["near_next"] == pytest.approx(like(sets[d], sets[ids[(k + 1) % len(ids)]]))
    far = [d for d in rows if len(rows[d].split()) >= 60]
    assert np.mean([got[d]["near_edited"] for d in far]) > np.mean([got[d]["near_next"] for d in far]) + 0.3


def test_op4(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    q = duckdb.sql(registry.ORACLE_SQL["op4_revisits"])
    want = sorted((dict(zip(q.columns, r)) for r in q.fetchall()), key=lambda r: r["record_id"])
    assert sorted((r.asDict() for r in run(spark, "op4_revisits")), key=lambda r: r["record_id"]) == want


def test_op5(spark, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, "op5_substrings")}
    for d, (data, gone) in cut_bytes(rows).items():
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert got[d] == (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())


def check_pieces(got, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    pieces, sequences = {}, {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (r["length"], r["doc_tokens"], r["ids_crc32"]) == (len(part), len(ids[r["doc_id"]]), zlib.crc32(np.array(part, "<u4").tobytes()))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, x in ids.items():
        assert sum(n for _, n in pieces[d]) == len(x) and len({s for s, _ in pieces[d]}) == len(pieces[d])
    for parts in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 1024
    return sum(map(len, ids.values())) / (1024 * len(sequences))


def test_op6(spark, rows):
    assert check_pieces(run(spark, "op6_packing"), rows) > 0.97


def test_op7(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op7_minhash")}
    assert got == classes(rows)


def test_op8(spark, rows):
    ranks = {}
    from tonearm.llm import bpe

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in run(spark, "op8_bpe"):
        ids = enc.encode_ordinary(rows[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest())


def test_op9(spark):
    """Links, order and statuses of the query's calls, computed plainly."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = {(r["conv_id"], r["call_id"]): r for r in run(spark, "op9_toolcalls")}
    by = {(r["conv_id"], r["turn"]): r for r in turns}
    calls = {k for k, r in by.items() if r["role"] == "user"}
    for c, t in calls:
        r = got[c, f"c{t}"]
        level = 0
        while (c, t - 2 * (level + 1)) in calls:
            level += 1
        nxt = by.get((c, t + 1))
        assert r["level"] == level and r["result"] == (nxt["text"] if nxt and nxt["role"] == "assistant" else None)
        assert r["status"] in ("linked", "invalid", "no_result") and (r["fault"] is None) == (r["status"] != "invalid")
        n = len(by[c, t]["text"] or "")
        assert (r["fault"] == "unknown_tool") == (n % 3 == 2)
    orphans = {(r["conv_id"], f"c{r['turn'] - 1}") for r in turns if r["role"] == "assistant" and (r["conv_id"], r["turn"] - 1) not in calls}
    assert {k for k, r in got.items() if r["status"] == "orphan_result"} == orphans


def test_op10(spark, rows):
    for r in run(spark, "op10_quality"):
        w = re.findall(r"[^\x20\x09-\x0D]+", rows[r["doc_id"]])
        assert r["n_words"] == len(w) and (r["kept"] is False or not r["base_failed"])


def test_pipeline(spark):
    """Each stage on its own input, a mixture of the table's first rows and odd ones, against plain computations."""
    base = spark.read.parquet(DOCS)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "two words", "en", "s", 9)], base.schema)
    docs = base.union(odd).union(base.where("doc_id % 40 = 3")).withColumn("_d", F.lit(1)).withColumn("hash", F.lit("x"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "near_duplicates", "repeats", "packing"]

    good = stages["quality"](spark, docs, SF)
    kept = quality.judge(docs, labels.where("quality = 1").select("doc_id")).where("kept").select("row.*")
    assert good.columns == docs.columns and sorted(map(str, good.collect())) == sorted(map(str, kept.collect()))
    assert good.where("doc_id > 9000").isEmpty()

    clean = stages["toxicity"](spark, good, SF).cache()
    model = toxicity.fit(spark, good, labels)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in good.collect() if model.score(r["text"]) < 0.5)

    one = stages["near_duplicates"](spark, clean, SF).cache()
    texts = {r["doc_id"]: r["text"] or "" for r in clean.collect()}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(d for d, (_, c) in classes(texts).items() if c == d)
    assert one.columns == docs.columns

    cut = stages["repeats"](spark, one, SF).cache()
    left = {d: data for d, data in cut_bytes({r["doc_id"]: r["text"] or "" for r in one.collect()}).items()}
    for r in cut.collect():
        data, gone = left[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
        if not gone.any():
            assert r["text"].encode() == data
        else:
            assert len(r["text"].encode()) <= len(data) - int(gone.sum())
    check_pieces(stages["packing"](spark, cut, SF).collect(), {r["doc_id"]: r["text"] for r in cut.collect()})


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(DOCS).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert minhash.PERCENT == 75 and minhash.WORDS == 5 and substrings.LENGTH == 100
