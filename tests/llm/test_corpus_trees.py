"""Merkle manifest, prefix trie and index search against plain computations, with odd rows and empty tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tonearm.llm import fmindex, merkle, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, tmp_path, **tables):
    """A folder with tables as the queries read them."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def twin(sf, sql, *names):
    c = duckdb.connect()
    for n in names:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf}/{n}.parquet/*.parquet')")
    out = c.execute(sql)
    names = [d[0] for d in out.description]
    return sorted((tuple(r[names.index(k)] for k in sorted(names)) for r in out.fetchall()), key=str)


def as_rows(df):
    return sorted((tuple(r[k] for k in sorted(df.columns)) for r in df.collect()), key=str)


# -- Merkle manifest ----------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """(root, proofs as lists of (left, right)) of a list of digests."""
    level, above = leaves, [[i] for i in range(len(leaves))]
    proofs = [[] for _ in leaves]
    while len(level) > 1:
        nxt, groups = [], []
        for i in range(0, len(level), 8):
            run = level[i : i + 8]
            for j in range(len(run)):
                for leaf in above[i + j]:
                    proofs[leaf].append((run[:j], run[j + 1 :]))
            nxt.append(sha(*run))
            groups.append([leaf for j in range(len(run)) for leaf in above[i + j]])
        level, above = nxt, groups
    return level[0], proofs


def plain_manifest(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda r, t: sha(*map(field, (r[0], r[3], r[2], r[4], t)))
    langs = {}
    for r in docs:
        langs.setdefault(r[2], []).append((r[0], leaf(r, r[1]), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    made = {n: tree([x[1] for x in sorted(langs[n], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for n in names}
    root, tops = tree([made[n][0] for n in names])
    out = []
    for i, n in enumerate(names):
        for (d, own, r), proof in zip(sorted(langs[n], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), made[n][1]):
            steps = proof + tops[i]
            h = leaf(r, r[1].translate(low)) if r[1] is not None and d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else own
            for left, right in steps:
                h = sha(*left, h, *right)
            out.append((d, h, own, sha(*[x for left, right in steps for x in (*left, *right)]), root, made[n][0], h == root))
    return sorted(out, key=str)


def odd_documents():
    r = random.Random(5)
    docs = [(i, f"Text {i} Ä" * (i % 4), r.choice(["en", "de", "fr"]), "s", i) for i in range(140)]
    docs += [(None, "x", "en", None, None), (7, None, None, "s", 3), (8, "", None, None, None), (9, "ONE", "zz", "s", 1), (10, "b", "é", "s", 2), (11, "c", "z", "s", 2), (12, "LONG " * 60_000, "en", "s", 9), (12, "again", "en", "s", 9)]
    docs += [(i, "X", f"l{i % 12}", "s", 1) for i in range(200, 230)]
    docs += [docs[3], docs[3]]
    return docs


def test_manifest(spark, tmp_path):
    docs = odd_documents()
    sf = put(spark, tmp_path, documents=([(*d, "other", 1) for d in docs], DOCS + ", tree string, digest int"))
    got = as_rows(merkle.op11_merkle(spark, sf))
    assert got == plain_manifest(docs)
    assert got == twin(sf, merkle.OP11_SQL, "documents")


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_manifest_of_few(spark, tmp_path, n):
    docs = [(i, f"T{i}", "en", "s", 1) for i in range(n)]
    assert as_rows(merkle.op11_merkle(spark, put(spark, tmp_path, documents=(docs, DOCS)))) == (plain_manifest(docs) if docs else [])


# -- prefix trie --------------------------------------------------------------


def plain_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    nodes = {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            nodes.setdefault(tuple(made[c][:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes)]
        saved = sum((len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) for k in below)
        ends = ",".join(str(c) for c in members if len(made[c]) == len(key))
        out.append((members[0], len(key), hashlib.sha256(ends.encode()).hexdigest(), len(children), len(members), len(leaves), nodes[key[:-1]][0] if key else None, saved))
    return sorted(out, key=str)


CONVS = "conv_id long, turn long, role string, text string"


def odd_conversations(seed=2):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 310]:
        for t in range(r.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, r.choice(["user", "assistant"]) if t else "system", r.choice("abé") if t < 3 else f"{c % 3}-{t}"))
    rows += [(401, t, "user", f"same {t}") for t in range(30)] + [(402, t, "user", f"same {t}") for t in range(30)] + [(403, t, "user", f"same {t}") for t in range(29)]
    rows += [(None, 1, "user", "x"), (500, None, None, None), (500, None, "user", "n"), (500, 1, "user", None), (500, 1, "user", None), (501, 5, "", ""), (502, -3, "user", "early"), (502, 2, "user", "LONG " * 60_000)]
    return rows


@pytest.mark.parametrize("local", [1, 12, 100_000])
def test_trie(spark, tmp_path, monkeypatch, local):
    """Whatever is finished locally: nearly nothing, some buckets, all at once."""
    rows = odd_conversations()
    sf = put(spark, tmp_path, conversations=([(*x, 1, "y") for x in rows], CONVS + ", at int, bucket string"))
    monkeypatch.setattr(trie.trie, "__defaults__", (local,))
    monkeypatch.setattr(trie, "BLOCK", 7)
    got = as_rows(trie.op12_trie(spark, sf))
    assert got == plain_trie(rows)
    assert got == twin(sf, trie.OP12_SQL, "conversations")


def test_trie_of_few(spark, tmp_path):
    assert trie.op12_trie(spark, put(spark, tmp_path / "a", conversations=([], CONVS))).count() == 0
    alone = [(7, 0, "user", "only")]
    assert as_rows(trie.op12_trie(spark, put(spark, tmp_path / "b", conversations=(alone, CONVS)))) == plain_trie(alone)


# -- decontamination ----------------------------------------------------------


def low(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain_hits(docs, items):
    phrases = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            phrases.setdefault(tuple(w[k : k + 10]), set()).add(i)
    sizes = {len(p) for p in phrases}
    out = []
    for d, t in docs:
        w, hit, ids = low(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (p := tuple(w[k : k + m])) in phrases:
                    hit.update(range(k, k + m))
                    ids |= phrases[p]
        ids = sorted({str(i) for i in ids if i is not None})
        out.append((bool(hit), d, hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit), len(ids), len(w)))
    return sorted(out, key=str)


def odd_texts():
    r = random.Random(9)
    item = lambda n, v: " ".join(r.choice("abcdefgh"[:v]) for _ in range(n))
    items = [(i, item(r.choice([12, 15, 30]), 8)) for i in range(20)] + [(20, item(3, 2)), (21, "Solo"), (21, item(11, 1)), (22, None), (23, " .,! "), (24, "É é_x9 naïve"), (None, item(13, 3)), (5, item(14, 8)), (30, items0 := item(12, 8)), (31, items0)]
    docs = []
    for d in range(150):
        t = r.choice(items)[1] or ""
        cut = r.randrange(1, len(t) + 1) if t else 0
        docs.append((d, f"{item(r.randrange(30), 8)} {t[:cut].upper()}, {r.choice(['x', 'É, é x9', ''])} {t[cut:]} {item(3, 8)}"))
    docs += [(None, "solo"), (200, None), (201, ""), (202, "solo\x00SOLO"), (203, "SOLO " * 3 + "word " * 60_000 + items0), (204, "b" * 70_000), (1, items0), (1, items0), (205, "Éé_x9\tNAÏVE"), (206, "é é X9 naïve")]
    return docs, items


@pytest.mark.parametrize("phrases,shard,piece", [(200_000, 1_000_000, 4_000_000), (40, 50, 64)])
def test_decontamination(spark, tmp_path, monkeypatch, phrases, shard, piece):
    """In one block and shard, and in many, with documents and texts cut."""
    docs, items = odd_texts()
    sf = put(spark, tmp_path, documents=([(*x, 1, "y") for x in docs], "doc_id long, text string, spans int, _row string"), benchmark=([(*x, 7) for x in items], "item_id long, text string, block int"))
    monkeypatch.setattr(fmindex, "PHRASES", phrases)
    limits = {"SHARD": shard, "PIECE": piece}
    monkeypatch.setattr(fmindex, "SHARD", shard)
    monkeypatch.setattr(fmindex, "PIECE", piece)
    # workers import the module anew: the limits go there with the function
    search = fmindex._search

    def limited(block):
        run = search(block)

        def inside(batches):
            from tonearm.llm import fmindex as there

            for k, v in limits.items():
                setattr(there, k, v)
            return run(batches)

        return inside

    monkeypatch.setattr(fmindex, "_search", limited)
    got = as_rows(fmindex.op13_decontamination(spark, sf))
    assert got == plain_hits(docs, items)
    assert got == twin(sf, fmindex.OP13_SQL, "documents", "benchmark")


def test_decontamination_keeps_columns_and_spans(spark):
    docs = spark.createDataFrame([("k", "a b c A B C", [1])], "items string, text string, spans array<int>").withColumnRenamed("spans", "x")
    got = fmindex.decontaminate(spark, docs.withColumnRenamed("items", "id"), spark.createDataFrame([(1, "b c")], "item_id int, text string")).first()
    assert got["id"] == "k" and [(s["start"], s["stop"]) for s in got["spans"]] == [(1, 3), (4, 6)] and got["items"] == ["1"]


def test_decontamination_of_nothing(spark, tmp_path):
    docs, items = [(1, "a b")], [(1, "a b")]
    for i, (d, b) in enumerate((([], items), (docs, []), ([], []))):
        sf = put(spark, tmp_path / str(i), documents=(d, "doc_id long, text string"), benchmark=(b, "item_id long, text string"))
        assert as_rows(fmindex.op13_decontamination(spark, sf)) == plain_hits(d, b)


def test_index_finds_every_place():
    r = np.random.default_rng(1)
    for top, n in ((1, 60), (3, 300), (40, 1000)):
        text = r.integers(0, top + 1, n).astype(np.int32)
        text[-1] = 0
        order = fmindex.suffix_array(text)
        breaks = np.cumsum(text == 0)
        key = [[(0, int(breaks[j])) if text[j] == 0 else (1, int(text[j])) for j in range(i, n)] for i in range(n)]
        assert sorted(range(n), key=key.__getitem__) == order.tolist()
        index = fmindex.Index(text)
        assert index.locate(np.arange(n)).tolist() == order.tolist()
        tree = index.tree
        assert tree.access(np.arange(n)).tolist() == text[order - 1].tolist()
        phrases = np.zeros((50, fmindex.WINDOW), np.int32)
        lengths = r.integers(1, 4, 50)
        for row, m in zip(phrases, lengths):
            row[fmindex.WINDOW - m :] = r.integers(1, top + 2, m)
        low, high = index.search(phrases, lengths)
        for row, m, a, b in zip(phrases, lengths, low, high):
            want = [i for i in range(n - m + 1) if text[i : i + m].tolist() == row[fmindex.WINDOW - m :].tolist()]
            assert sorted(order[a:b].tolist()) == want
