"""Table operators against plain computations, and their odd cases."""

import datetime
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonearm.functions import audio, music, text
from tonearm.operators import budget, dedupe, evidence, graph, library, mel, organize, ranks, records
from tonearm.operators.undo import undo
from tonearm.plans import catalog, more  # noqa: F401
from tonearm.sinks import writers
from tonearm.sources import readers
from tonearm.streaming import runs
from tonearm.streaming import tracks as streaming


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_ranks(spark):
    df = spark.createDataFrame([(i % 2 if i < 50 else 0, (i * 37) % 101) for i in range(100)] + [(None, 5), (None, 7)], "g int, o long")
    got = ranks.with_rank(df, ["g"], "o").collect()
    for g in (0, 1, None):
        own = sorted(r["o"] for r in got if r["g"] == g)
        assert [r["o"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == own
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(len(own)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 200)]
    got = {r["vertex"]: r["root"] for r in graph.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert graph.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaders(spark):
    r = random.Random(1)
    items = [(g, i, r.randint(0, 30)) for g in "ab" for i in range(40)]
    want, heads = {}, {}
    for g, i, v in items:
        h = next((h for h in heads.get(g, []) if abs(h[1] - v) <= 3), None)
        if h is None:
            heads.setdefault(g, []).append((i, v))
        want[g, i] = h[0] if h else i
    df = spark.createDataFrame(items, "g string, ordinal long, v int")
    old = graph.SMALLEST, graph.LARGEST, graph.BLOCK
    for limits in (old, (2, 4, 3)):
        graph.SMALLEST, graph.LARGEST, graph.BLOCK = limits
        got = graph.led(spark, df, ["g"], lambda rows: lambda item, which: (rows["v"].to_numpy()[which] - item[0] <= 3) & (item[0] - rows["v"].to_numpy()[which] <= 3), ["v"])
        graph.SMALLEST, graph.LARGEST, graph.BLOCK = old
        assert {(x["g"], x["ordinal"]): x["head"] for x in got.collect()} == want


def test_thousands_of_unlike_prints_in_a_bucket(spark):
    """A bounded number of jobs, whatever number of leaders a bucket has."""
    n = 3_000
    items = spark.range(n).selectExpr("0 g", "concat('p', id) ordinal", "transform(sequence(0, 7), i -> pmod(xxhash64(id, i), 4294967296)) fp")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("led", "led")
    began = time.time()
    got = graph.led(spark, items, ["g"], dedupe.alike_prints(dedupe.THRESHOLD), ["fp"])
    assert got.where("ordinal = head").count() == n
    took = time.time() - began
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    print(f"{n} unlike fingerprints: {took:.0f} s")
    assert len(tracker.getJobIdsForGroup("led")) < 100


def plain_names(moves, taken):
    """Names given out one after another."""
    used = {f"{f}/{n}".lower() for f, n in taken}
    out = {}
    for o, folder, name in sorted(moves):
        stem, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
        k = 0
        while True:
            n = name if not k else f"{stem}_{k}{dot}{ext}"
            if f"{folder}/{n}".lower() not in used:
                break
            k += 1
        used.add(f"{folder}/{n}".lower())
        out[o] = n
    return out


def test_free_names(spark):
    r = random.Random(3)
    pool = ["a.mp3", "A.mp3", "a_1.mp3", "a_2.mp3", "a_1_1.mp3", "b", "b_1", "c.tar.gz"]
    moves = [(i, r.choice("xy"), r.choice(pool)) for i in range(120)]
    taken = [("x", "a.mp3"), ("x", "A_3.MP3"), ("y", "b_2")]
    for m, t in ((moves, taken), ([(1, "f", "a.mp3"), (2, "f", "a.mp3"), (3, "f", "a_1.mp3")], [])):
        got = organize.free_names(spark, spark.createDataFrame(m, "ordinal long, folder string, filename string"), spark.createDataFrame(t, "folder string, filename string"))
        assert {x["ordinal"]: x["destination"] for x in got.collect()} == plain_names(m, t)
    assert organize.free_names(spark, spark.createDataFrame([], "ordinal long, folder string, filename string"), spark.createDataFrame([], "folder string, filename string")).count() == 0


def test_free_names_of_nested_forms(spark):
    """Numbered forms of wanted names that are wanted too, several deep, against giving names out one after another."""
    for seed in range(4):
        r = random.Random(seed)
        pool = ["a.mp3", "a_1.mp3", "a_2.mp3", "a_3.mp3", "a_1_1.mp3", "a_1_2.mp3", "a_1_1_1.mp3", "a_01.mp3", "_1.mp3", ".mp3", ".mp3_1", "x_1", "x", "x_1_1"]
        moves = [(i, "f", r.choice(pool)) for i in r.sample(range(1000), 40)]
        taken = [("f", r.choice(["a_4.mp3", "a_1_3.mp3", "a_1.mp3", "A.mp3", "x_2", "a_1_1_1.MP3"])) for _ in range(r.randrange(4))]
        got = organize.free_names(spark, spark.createDataFrame(moves, "ordinal long, folder string, filename string"), spark.createDataFrame(taken, "folder string, filename string"))
        assert {x["ordinal"]: x["destination"] for x in got.collect()} == plain_names(sorted(moves), taken)


def test_free_names_among_many_taken(spark):
    """10,000 taken names are a fixed number of jobs."""
    taken = spark.range(10_000).selectExpr("'f' folder", "case when id = 0 then 'a.mp3' else concat('a_', id + (case when id > 5000 then 3 else 0 end), '.mp3') end filename")
    moves = spark.range(5).selectExpr("id ordinal", "'f' folder", "'a.mp3' filename")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("names", "names")
    got = {r["ordinal"]: r["destination"] for r in organize.free_names(spark, moves, taken).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {0: "a_5001.mp3", 1: "a_5002.mp3", 2: "a_5003.mp3", 3: "a_10003.mp3", 4: "a_10004.mp3"}
    assert len(tracker.getJobIdsForGroup("names")) < 60


def test_plan_leaves_files_in_place(spark):
    t = spark.createDataFrame([(1, "/l/House/a.mp3", "House", None, "a.mp3"), (2, "/x/a.mp3", "House", None, "a.mp3"), (3, "/x/z.mp3", None, None, "z.mp3")], "track_id long, path string, genre string, subgenre string, filename string")
    have = spark.createDataFrame([("House", 9)], "folder string, n long")
    got = organize.plan(spark, t, have, 3, taken=spark.createDataFrame([("House", "a.mp3")], "folder string, filename string"), root="/l")
    assert rows(got, "track_id", "folder", "destination") == [(2, "House", "a_1.mp3"), (3, "Other/Unknown", "z.mp3")]


def fingerprint_likeness(a, b):
    best = 0.0
    for s in range(-20, 21):
        x, y = a[max(s, 0) :], b[max(-s, 0) :]
        n = min(len(x), len(y))
        if n >= 8 or s == 0 and n:
            best = max(best, 1 - sum(bin(p ^ q).count("1") for p, q in zip(x, y)) / (32 * n))
    return best


def test_likeness_in_batches(spark):
    """As the column expression has it, and the plain computation."""
    r = random.Random(6)
    base = [r.getrandbits(32) for _ in range(40)]
    prints = [[x ^ (1 << r.randrange(32) if r.random() < 0.3 else 0) for x in base[r.randrange(25) :][: r.randrange(8, 30)]] for _ in range(30)]
    leaders = pd.DataFrame({"fp": prints})
    df = spark.createDataFrame([(a, b) for a in prints[:5] for b in prints], "a array<long>, b array<long>")
    by_column = [x["s"] for x in df.select(dedupe.similarity("a", "b").alias("s")).collect()]
    for i, a in enumerate(prints[:5]):
        want = [fingerprint_likeness(a, b) for b in prints]
        assert by_column[i * 30 : i * 30 + 30] == pytest.approx(want)
        for t in (0.5, 0.9, 0.95):
            assert dedupe.alike_prints(t)(leaders)((a,), np.arange(30)).tolist() == [w >= t for w in want]


def test_unlike_prints_are_told_by_their_first_windows():
    """Of many at once: no alike pair is lost, hardly any other is compared in full; pairs of one table are as in :func:`ask`."""
    g = np.random.default_rng(3)
    table = [np.concatenate([[1, 2, 3], g.integers(0, 1 << 32, n)]) for n in g.integers(6, 400, 150)]
    noisy = lambda f, share: f ^ ((g.random((len(f), 32)) < share) * (1 << np.arange(32))).sum(1)
    copies = [noisy(f, share)[cut:] for f in table[:12] for share in (0.0, 0.13, 0.16) for cut in (0, 2)]
    items = pd.DataFrame({"fp": copies + [np.concatenate([[1, 2, 3], g.integers(0, 1 << 32, n)]) for n in g.integers(6, 400, 40)]})
    rows, every = pd.DataFrame({"fp": table}), np.arange(150)
    ask = dedupe.alike_prints(0.85)(rows)
    may = ask.maybe(items, every)
    exact = np.array([ask((f,), every) for f in items["fp"]])
    assert exact.any() and not (exact & ~may).any() and (may & ~exact).mean() < 0.05
    both = dedupe.alike_prints(0.85)(pd.concat([rows, items], ignore_index=True))
    i, j = np.divmod(np.arange(exact.size), 150)
    assert (both.pairs(i + 150, j) == exact.ravel()).all() and (both.pairs(j, i + 150) == exact.ravel()).all()


def test_buckets_of_the_same_files_are_one(spark, monkeypatch):
    """Texts that begin alike for twelve words and go on unlike: one bucket of three is worked on."""
    seen, real = [], dedupe.led
    monkeypatch.setattr(dedupe, "led", lambda spark, items, *rest: seen.append(items.select("i", "v").distinct().count()) or real(spark, items, *rest))
    r = random.Random(4)
    prints = {f"p{k:02}": [1, 2, 3] + [r.getrandbits(32) for _ in range(20)] for k in range(30)} | {"q0": [1, 2, 9] + [r.getrandbits(32) for _ in range(20)]}
    prints["q1"] = [x ^ 1 for x in prints["p07"]][:3] + prints["p07"][3:]
    files = spark.createDataFrame(list(prints.items()), "path string, fp array<long>")
    assert {x["path"]: x["cluster"] for x in dedupe.near_clusters(spark, files, 0.85).collect()} == plain_clusters(list(prints.items()), 0.85)
    # (0, 1) with (1, 2), (2, 3), and p07 with q1 at the fourth frame
    assert seen == [3]


def test_lengths_in_pairs_are_as_one_by_one():
    """Versions of small clusters are found for many at once; the later of a pair asks, and unknown lengths go with unknown ones only by the caller's groups."""
    rows = pd.DataFrame({"duration_s": [100.0, 112.0, 114.0, None, 0.0, -1.0, 89.0]})
    ask = dedupe.alike_lengths(0.12)(rows)
    i, j = np.divmod(np.arange(49), 7)
    want = [bool(ask((rows["duration_s"].iloc[y],), np.array([x]))[0]) for x, y in zip(i, j)]
    assert ask.pairs(i, j).tolist() == want and any(want) and not all(want)


def plain_clusters(files, threshold):
    """Buckets by the first four frames, leaders in the order of paths, clusters that share a file merged."""
    long = sorted((p, fp) for p, fp in files if fp and len(fp) >= 8)
    first = {}
    for p, fp in long:
        first.setdefault(tuple(fp), p)
    edges = [(p, first[tuple(fp)]) for p, fp in long]
    buckets = {}
    for fp, p in first.items():
        for i in range(4):
            buckets.setdefault((i, fp[i]), []).append((p, fp))
    for b in buckets.values():
        heads = []
        for p, fp in sorted(b):
            h = next((h for h in heads if fingerprint_likeness(fp, h[1]) >= threshold), None)
            if h:
                edges.append((p, h[0]))
            else:
                heads.append((p, fp))
    root = {p: p for p, _ in long}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    groups = {}
    for p in root:
        groups.setdefault(top(p), []).append(p)
    return {p: c for c, g in groups.items() if len(g) > 1 for p in g}


@pytest.fixture(scope="module")
def files(spark):
    r = random.Random(9)
    base = [[r.getrandbits(32) for _ in range(30)] for _ in range(6)]
    out = []
    for i in range(48):
        fp = list(base[i % 6])
        for _ in range(r.randint(0, 6)):
            fp[r.randrange(4, 30)] ^= 1 << r.randrange(32)
        if i % 7 == 0:
            fp = fp[:3] + [r.getrandbits(32)] + fp[4:]
        ext = ["flac", "mp3", "aif"][i % 3]
        out.append((f"/l/{i:03}.{ext}", f"A - B{' (Extended Mix)' if i % 4 == 0 else ''}.{ext}", ext, 0 if i == 6 else 1000 + i % 5, None if i % 9 == 0 else 100.0 + 10 * (i % 8), f"d{i % 40}", None if i == 5 else fp[:5] if i == 11 else fp))
    return spark.createDataFrame(out, "path string, filename string, ext string, size_bytes long, duration_s double, digest string, fp array<long>")


def test_near_clusters(spark, files):
    for threshold in (0.85, 0.99):
        want = plain_clusters([(x["path"], x["fp"]) for x in files.collect()], threshold)
        assert {x["path"]: x["cluster"] for x in dedupe.near_clusters(spark, files, threshold).collect()} == want and want


def plain_find(files, threshold):
    rank = lambda f: (f["size_bytes"] <= 0, {"flac": 1, "aif": 3, "mp3": 5}[f["ext"]], -f["size_bytes"], f["path"].count("/"), len(f["path"]), f["path"])
    out, gone, groups = [], set(), {}
    for f in files:
        groups.setdefault(f["digest"], []).append(f)
    for g in groups.values():
        if len(g) > 1:
            best = min(g, key=rank)
            out += [("md5", f["path"], f is best) for f in g]
            gone |= {f["path"] for f in g if f is not best}
    rest = {f["path"]: f for f in files if f["path"] not in gone}
    clusters = {}
    for p, c in plain_clusters([(p, f["fp"]) for p, f in rest.items()], threshold).items():
        clusters.setdefault(c, []).append(rest[p])
    for members in clusters.values():
        kinds = {}
        for f in sorted(members, key=lambda f: f["path"]):
            kinds.setdefault("Extended" in f["filename"], []).append(f)
        for k in kinds.values():
            parts = []
            for f in k:
                for part in parts:
                    a, b = f["duration_s"], part[0]["duration_s"]
                    if a is None and b is None or a is not None and b is not None and abs(a - b) / max(a, b) <= 0.12:
                        part.append(f)
                        break
                else:
                    parts.append([f])
            for part in parts:
                if len(part) > 1:
                    best = min(part, key=rank)
                    out += [("fingerprint", f["path"], f is best) for f in part]
    return sorted(out)


def test_find(spark, files):
    found = dedupe.find(spark, files, 0.85)
    assert rows(found, "method", "path", "keeper") == sorted(plain_find([x.asDict() for x in files.collect()], 0.85), key=str)
    formats = dedupe.find(spark, files, 0.85, distinct_versions=False, all_formats=True, exact=False)
    kept = {}
    for x in formats.collect():
        kept.setdefault(x["group_id"], []).append(x["keeper"])
    assert all(sum(k) == 1 and len(k) > 1 for k in kept.values()) and kept
    assert dedupe.find(spark, files.limit(0), 0.85).count() == 0


def test_duplicates_of_documents(spark):
    """The registered queries on the smallest tables, against the same plain computation."""
    f = more._texts_as_files(spark, "/root/testdata/sf0.001")
    want = plain_clusters([(x["path"], x["fp"]) for x in f.collect()], 0.85)
    assert {x["path"]: x["cluster"] for x in catalog.QUERIES["q_near_dupes"](spark, "/root/testdata/sf0.001").collect()} == want


def test_keeper_ranks(spark):
    assert [r[0] for r in spark.createDataFrame([("aif",), ("AIFF",), ("xyz",), (None,)], "e string").select(dedupe.format_rank(F.col("e"))).collect()] == [3, 3, 99, 99]
    one = spark.createDataFrame([("a", "g", "mp3", 5, True), ("b", "g", "mp3", 5, False)], "path string, g string, ext string, size_bytes long, alias boolean")
    assert rows(dedupe.keepers(one, ["g"]).where("keeper"), "path") == [("b",)]


def test_plan_gives_names_on_what_they_need(spark, monkeypatch):
    """Folders by genre and subgenre, nulls and odd names too; no path goes through the ranks."""
    seen, real = [], organize.free_names
    monkeypatch.setattr(organize, "free_names", lambda spark, moves, taken: seen.append(moves.columns) or real(spark, moves, taken))
    kinds = [("House", "Deep House"), ("house", None), (None, None), (None, "x"), ("a/b", "Unknown"), ("CON", "aux"), ("", "")]
    t = spark.createDataFrame([(i, f"/l/{i}", *kinds[i % 7], "f.mp3") for i in range(21)], "track_id long, path string, genre string, subgenre string, filename string")
    got = organize.plan(spark, t, spark.createDataFrame([("HOUSE", 2)], "folder string, n long"), 3)
    folders = ["HOUSE/Deep House", "HOUSE", "Unknown", "Unknown/x", "a_b", "_CON/_aux", "Unknown"]
    want = [(i, folders[i % 7], False) for i in range(21)]
    assert rows(got, "track_id", "folder", "rare") == sorted(want, key=str)
    assert set(seen[0]) == {"track_id", "ordinal", "folder", "filename", "rare"}


def test_undo_of_chains(spark):
    e = spark.createDataFrame([(1, "move", "/a", "/b"), (2, "move", "/b", "/c"), (3, "move", "/x", "/y"), (4, "trash", "/t", None), (5, "move", None, "/c"), (6, "move", "/q", "/q")], "seq long, action string, src string, dst string")
    got = undo(spark, e, spark.createDataFrame([("/c",), ("/q",), ("/q",), (None,)], "path string"))
    assert rows(got, "seq", "status") == [(1, "reverted"), (2, "reverted"), (3, "skipped_gone"), (4, "trashed"), (5, "skipped_gone"), (6, "skipped_taken")]
    assert undo(spark, e.limit(0), spark.createDataFrame([], "path string")).count() == 0


def test_undo_compares_only_moves_that_share_paths(spark, monkeypatch):
    """Of lone moves nothing goes to the components, and those of others go there as numbers."""
    from tonearm.operators import undo as module

    seen, real = [], module.components
    monkeypatch.setattr(module, "components", lambda spark, edges: seen.append((edges.count(), edges.schema["a"].dataType.simpleString())) or real(spark, edges))
    moves = [(i, "move", f"/o{i}", f"/n{i}") for i in range(40)] + [(100, "move", "/c1", "/c2"), (101, "move", "/c2", "/c3"), (102, "move", "/c3", "/c4"), (103, "move", "/s", "/s")]
    there = [f"/n{i}" for i in range(0, 40, 2)] * 2 + [f"/o{i}" for i in range(0, 40, 4)] + ["/c4"]
    got = undo(spark, spark.createDataFrame(moves, "seq long, action string, src string, dst string"), spark.createDataFrame([(p,) for p in there], "path string"))
    want = [(i, "skipped_gone" if i % 2 else "skipped_taken" if i % 4 == 0 else "reverted") for i in range(40)] + [(i, "reverted") for i in (100, 101, 102)] + [(103, "skipped_gone")]
    assert rows(got, "seq", "status") == sorted(want, key=str)
    # the move in the middle, and the one to itself
    assert seen == [(2, "bigint")]


def test_undo_of_swaps_and_rings(spark):
    """Random moves among few paths, also three in a ring, replayed one after another."""
    r = random.Random(4)
    for _ in range(2):
        moves = [(i, "move", f"/{g}{r.randrange(4)}", f"/{g}{r.randrange(4)}") for i, g in enumerate(r.choice("abcdefgh") for _ in range(150))]
        moves += [(1000 + i, "move", f"/ring{i}", f"/ring{(i + 1) % 3}") for i in range(3)]
        there = {f"/{g}{k}" for g in "abcdefgh" for k in range(4) if r.random() < 0.5} | {"/ring0", "/ring2"}
        have, want = set(there), []
        for seq, _, src, dst in sorted(moves, reverse=True):
            status = "skipped_gone" if dst not in have else "skipped_taken" if src in have else "reverted"
            if status == "reverted":
                have = have - {dst} | {src}
            want.append((seq, status))
        got = undo(spark, spark.createDataFrame(moves, "seq long, action string, src string, dst string"), spark.createDataFrame([(p,) for p in there], "path string"))
        assert rows(got, "seq", "status") == sorted(want, key=str)


def test_attempts_of_many_files_in_a_shard(spark, tmp_path, monkeypatch):
    """Shards of hundreds of files, over two batches and a restart, against one file after another."""
    monkeypatch.setattr(runs, "SHARDS", 3)
    r, want, left = random.Random(8), {}, {}
    for batch in range(2):
        events = [(f"k{r.randrange(600)}", batch * 5000 + i, r.choice(["died", "died", "claim", "ok", "error"]), r.choice(["v", None])) for i in range(1500)]
        for key, _, status, value in events:
            if key not in want:
                left[key] = left.get(key, 0) + (status == "died")
                if left[key] == 3:
                    want[key] = (key, "error", 3, None, runs.GAVE_UP)
                elif status in ("ok", "error"):
                    want[key] = (key, "result" if status == "ok" else "error", left[key] + 1, value, None if status == "ok" else value)
        r.shuffle(events)
        spark.createDataFrame(events, "key string, seq long, status string, value string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, seq long, status string, value string").parquet(f"{tmp_path}/in")
        got = runs.written(spark, runs.attempts(stream), f"{tmp_path}/out")
        assert rows(got, "key", "outcome", "attempts", "value", "error") == sorted(want.values(), key=str)


def test_attempts_over_batches_and_a_restart(spark, tmp_path):
    def batch(*events):
        spark.createDataFrame([(*e, "v") for e in events], "key string, seq long, status string, value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, seq long, status string, value string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return rows(runs.written(spark, runs.attempts(stream), f"{tmp_path}/out"), "key", "outcome", "attempts", "error")

    assert batch(("a", 1, "died"), ("b", 2, "ok"), (None, 3, "ok"), ("c", 5, "died"), ("c", 4, "claim")) == [("b", "result", 1, None)]
    # a new query on the same checkpoint: the deaths of the first batch count on
    assert batch(("a", 6, "died"), ("a", 7, "died"), ("a", 8, "ok"), ("b", 9, "ok"), ("c", 10, "ok")) == [("a", "error", 3, runs.GAVE_UP), ("b", "result", 1, None), ("c", "result", 2, None)]
    assert len(batch(("a", 11, "ok"), ("d", 12, "error"))) == 4


def test_stalls_by_timer_and_by_a_late_result(spark, tmp_path):
    schema = "run string, at timestamp, start boolean, final boolean"

    def batch(*events):
        spark.createDataFrame([(r, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), b, f) for r, s, b, f in events], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = runs.written(spark, runs.stalls(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")), f"{tmp_path}/out").collect()
        return sorted((r["run"], int((r["stalled_at"] - datetime.datetime(2024, 1, 1)).total_seconds()), r["done"]) for r in got)

    assert batch(("a", 0, True, False), ("a", 100, False, False), ("b", 0, True, False), ("c", 50, None, True), ("d", 0, True, False), ("d", 300, False, False)) == []
    # the newest event puts the clock to 450: a is silent since 100, b since 0; d's own result came in time
    assert batch(("d", 450, False, False)) == [("a", 400, 1), ("b", 300, 0)]
    assert batch(("a", 460, False, False), ("b", 461, False, True), ("d", 900, False, False)) == [("a", 400, 1), ("b", 300, 0), ("d", 750, 2)]


def test_log_mel(spark, monkeypatch):
    """Against the definition: sums over samples, triangles from the mel scale; blocks of a few frames."""
    r = np.random.default_rng(2)
    waves = [(1, r.normal(size=5000).tolist()), (2, r.normal(size=511).tolist()), (3, np.sin(np.arange(1300) * 0.3).tolist()), (4, []), (5, None), (6, [None] + [0.5] * 600)]
    monkeypatch.setattr(mel, "BLOCK", 3)
    parts = mel.blocks(spark.createDataFrame(waves, "key long, samples array<double>"))
    monkeypatch.undo()
    assert parts.where("key = 1").count() > 3
    tail = {x["key"]: [] for x in parts.collect()}
    for x in mel.frames(spark, mel.blocks(spark.createDataFrame(waves, "key long, samples array<double>"))).orderBy("key", "frame").collect():
        tail[x["key"]].append(x["mel"])
    to_mel = lambda f: f * 3 / 200 if f < 1000 else 15 + 27 * math.log(f / 1000) / math.log(6.4)
    from_mel = lambda m: m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)
    corner = [from_mel(to_mel(8000) * i / 97) for i in range(98)]
    for key, wave in waves:
        wave = [x or 0.0 for x in wave or []]
        count = max(0, (len(wave) - 512) // 256 + 1)
        assert len(tail.get(key, [])) == count
        for i in range(0, count, 7):
            cut = np.array(wave[i * 256 : i * 256 + 512]) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(512) / 511))
            power = [abs(np.sum(cut * np.exp(-2j * np.pi * k * np.arange(512) / 512))) ** 2 for k in range(257)]
            want = []
            for a, b, c in zip(corner, corner[1:], corner[2:]):
                want.append(math.log10(1 + 10000 * sum(p * max(0, min((k * 31.25 - a) / (b - a), (c - k * 31.25) / (c - b))) * 2 / (c - a) for k, p in enumerate(power))))
            assert tail[key][i] == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_log_mel_across_seams(spark):
    wave = np.random.default_rng(3).normal(size=mel.BLOCK * mel.HOP * 2 + 700)
    got = mel.frames(spark, mel.blocks(spark.createDataFrame([(1, wave.tolist())], "key long, samples array<double>"))).orderBy("frame").collect()
    assert [r["frame"] for r in got] == list(range((len(wave) - 512) // 256 + 1))
    assert np.allclose([r["mel"] for r in got], mel.log_mel(wave), atol=1e-5)


def test_root_of_mixed_paths(spark):
    f = lambda *p: organize.root_of(spark.createDataFrame([(x,) for x in p], "path string")).first()["root"]
    assert f("/a/b/1.mp3", "/a/b/c/2.mp3") == "/a/b" and f("/a/b/1.mp3", "/a/bc/2.mp3") == "/a"
    assert f("C:\\m\\1.mp3", "D:\\m\\2.mp3") is None and f("/a/1.mp3") == "/a"


def test_best_genre(spark):
    classes = ["Electronic---House", "Electronic---Deep House", "Electronic---Techno", "Rock---Rock", "Funk / Soul---Funk"]
    cases = [([0.3, 0.4, 0.1, 0.0, 0.0], ("House", "Deep House", 0.7, 0.4)), ([0.0, 0.0, 0.0, 0.0, 0.5], ("Funk/Soul", "Funk", 0.5, 0.5)), ([0.01] * 5, ("Unknown", "Unknown", 0.0, 0.0)), ([0.9, 0.8, 0.0, 0.0, 0.0], ("House", "House", 1.0, 0.9)), ([], ("Unknown", "Unknown", 0.0, 0.0))]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s array<double>").withColumn("g", audio.best_genre(F.col("s"), classes))
    assert [tuple(r["g"])[:4] for r in df.orderBy("i").collect()] == [w for _, w in cases]


def test_gate(spark):
    cases = [(0.9, 0.9, "House", "Deep House", "ml", "subgenre"), (0.5, 0.6, "House", "Deep House", "ml", "parent"), (None, 0.6, "House", "Deep House", None, "low-confidence"), (None, 0.9, "House", "Deep House", None, "subgenre"), (0.2, 0.99, "House", "Deep House", "tag", "subgenre"), (0.95, 0.2, "House", "", "ml", "low-confidence")]
    df = spark.createDataFrame(cases, "r double, f double, g string, s string, src string, want string")
    gate = lambda **o: music.tag_gate(F.col("r"), F.col("f"), F.col("g"), F.col("s"), F.col("src"), **o)["outcome"]
    assert all(r["want"] == r["got"] for r in df.withColumn("got", gate()).collect())
    assert {r["got"] for r in df.where("want = 'parent'").withColumn("got", gate(write=False)).collect()} == {"write-disabled"}


def test_evidence_of_nothing(spark):
    none = spark.createDataFrame([], "owner long, genre string, tier string, host string, url string, quote string")
    got = evidence.resolve(spark.createDataFrame([(1,)], "owner long"), none)
    assert rows(got, "owner", "genre", "grounded") == [(1, "", False)]
    assert spark.range(1).select(evidence.page_text(F.lit(None).cast("string")).alias("t")).first()["t"] == ""
    html = '<head><title>T</title><meta name="description" content="about it"><script type="application/ld+json">{"g":1}</script><style>x</style></head><body>a <b>b</b><!-- c --></body>'
    assert spark.range(1).select(evidence.page_text(F.lit(html)).alias("t")).first()["t"] == 'T about it {"g":1} a b'


def test_refused_machines(spark):
    m = spark.createDataFrame([("clap", 4, 4000, None, None, True, 8, False, "auto", True, None), ("discogs", None, 16000, None, 6000, True, 8, False, "auto", True, None)], "classifier string, requested int, total_mb int, free_mb int, free_vram_mb int, gpu_ok boolean, cpus int, vm boolean, gpu_mode string, hybrid boolean, longest_s double")
    a, b = (r["budget"] for r in budget.workers(m).orderBy("classifier").collect())
    assert (a["max_workers"], a["limit"]) == (0, "refused") and (b["max_workers"], b["gpu_workers"], b["cpu_workers"], b["limit"]) == (8, 2, 5, None)


def test_writers(spark, tmp_path):
    base = f"file://{tmp_path}"
    t = spark.createDataFrame([("/a", "House", 1), ("/b", None, 2), (None, "x", 3)], "path string, genre string, n int")
    assert writers.export(t, "", f"{base}/p", "m3u8") == 2 and sorted(r[0] for r in spark.read.text(f"{base}/p").collect()) == ["/a", "/b"]
    assert writers.export(t, "", f"{base}/j", "json") == 3 and writers.export(t, "", f"{base}/j", "json") == 3
    with pytest.raises(ValueError):
        writers.export(t, f"{base}/j/", f"{base}/j", "json")
    writers.save_report(t, f"{base}/reports", "one")
    writers.save_report(t.limit(1), f"{base}/reports", "two")
    writers.save_report(t.limit(2), f"{base}/reports", "one")
    assert rows(spark.read.parquet(f"{base}/reports").groupBy("library").count(), "library", "count") == [("one", 2), ("two", 1)]
    j = writers.journal(spark.createDataFrame([(2, "move", "b", "c"), (1, "move", "a", "b")], "seq int, action string, src string, dst string"), f"{base}/journals", "organize", "/l", 5.0)
    assert [r["src"] for r in readers.journal(spark, j).where("action = 'move'").collect()] == ["a", "b"]
    assert readers.history(spark, j, "started_at double, ts double", 5).count() == 0
    index = spark.createDataFrame([("/l1", "n", 1.0), ("/l1", "n", 3.0), ("", "x", 9.0), ("/l2", "m", 2.0)], "path string, name string, last_opened double")
    assert [r["path"] for r in writers.recent(index, index.limit(0)).orderBy("place").collect()] == ["/l1", "/l2"]
    assert rows(writers.rename(writers.forget(index, "/l2"), "/l1", " new "), "name") == [("new",), ("new",), ("x",)]


def test_readers(spark, tmp_path):
    (tmp_path / "list.txt").write_text("/a\n\n  \n/b \n")
    assert rows(readers.lines(spark, f"file://{tmp_path}/list.txt"), "path") == [("/a",), ("/b",)]
    (tmp_path / "bad.json").write_text("nonsense")
    with pytest.raises(readers.Unreadable):
        readers.report(spark, f"file://{tmp_path}/bad.json", "path string")
    for name, body in (("a", '[{"path":"/x"},3]'), ("b", '{"tracks":[{"path":"/x"}]}'), ("c", '{"path":"/x"}\n{"path":"/y"}\n')):
        (tmp_path / f"{name}.json").write_text(body)
        assert rows(readers.report(spark, f"file://{tmp_path}/{name}.json", "path string").where("path is not null"), "path")[0] == ("/x",), name
    (tmp_path / "gold.json").write_text('{"tracks":{"a.mp3":{"expect":{"genre":"House"},"close":{"bpm":{"value":120,"tol":2}},"min":{"energy":3},"present":["key"]}}}')
    assert rows(readers.manifest(spark, f"file://{tmp_path}/gold.json"), "field", "kind") == [("bpm", "close"), ("energy", "min"), ("genre", "expect"), ("key", "present")]
    (tmp_path / "none.json").write_text("{}")
    with pytest.raises(readers.Unreadable):
        readers.manifest(spark, f"file://{tmp_path}/none.json")
    spark.createDataFrame([(1, "x", [3.0, 4.0]), (2, "y", [0.0, 0.0])], "ref_id int, label string, emb array<double>").write.parquet(f"file://{tmp_path}/ref")
    assert [r["emb"] for r in readers.reference(spark, f"file://{tmp_path}/ref").orderBy("ref_id").collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_collection(spark, tmp_path):
    (tmp_path / "c.xml").write_text("""<?xml version="1.0"?>
<DJ_PLAYLISTS Version="1"><COLLECTION>
<TRACK TrackID="1" Location="file://localhost/M/a%20b.flac" Genre=" House " Kind="FLAC File" SampleRate="96000" Comments="Energy 7"></TRACK>
<TRACK TrackID="2" Location="file://localhost/m/A%20B.flac" Genre="Techno"></TRACK>
<TRACK TrackID="3" Genre="x"></TRACK><TRACK TrackID="4" Location="file://localhost/m/none.mp3"></TRACK>
</COLLECTION><PLAYLISTS><NODE><TRACK Key="1"></TRACK></NODE></PLAYLISTS></DJ_PLAYLISTS>""")
    got = readers.collection_rows(spark, f"file://{tmp_path}/c.xml")
    assert rows(got, "track_id", "path") == [("1", "/M/a b.flac"), ("2", "/m/A B.flac"), ("3", None), ("4", "/m/none.mp3")]
    assert rows(readers.priors(got), "path_key", "genre", "energy") == [("/m/a b.flac", "Techno", None)]
    (tmp_path / "d.xml").write_text("<OTHER><TRACK/></OTHER>")
    with pytest.raises(readers.Unreadable):
        readers.collection_rows(spark, f"file://{tmp_path}/d.xml")


def test_stream_state_is_reduced(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "COMPACT", 2)
    for i in range(7):
        spark.createDataFrame([(i % 3, i), (9, i)], "k int, seq int").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    args = (spark, f"file://{tmp_path}/in", "k int, seq int", "k", "seq", f"file://{tmp_path}/state")
    assert rows(streaming.last_rows(*args, per_batch=1), "k", "seq") == [(0, 6), (1, 4), (2, 5), (9, 6)]
    spark.createDataFrame([(1, 50)], "k int, seq int").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert rows(streaming.last_rows(*args, per_batch=1), "k", "seq") == [(0, 6), (1, 50), (2, 5), (9, 6)]
    assert len(list((tmp_path / "state" / "rows").glob("batch=*"))) <= 4


def test_stale_runs(spark):
    e = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "run_id string, n int")
    assert rows(streaming.run_rows(e, "a"), "n") == [(1,), (3,)]


def test_odd_rows(spark):
    """Nulls, repeated rows and empty tables."""
    t = spark.createDataFrame([(1, None, None), (1, None, None), (2, "", "x")], "track_id long, path string, genre_tag string")
    assert library.count_new(t.limit(0), t).first()["reason"] == "empty" and library.count_new(t, t.limit(0)).first()["reason"] == "nothing_known"
    assert rows(organize.route(spark, t.select(F.col("track_id").alias("ordinal"), F.lit("n.aac").alias("filename"), F.lit("aac").alias("ext"), "genre_tag").where("track_id = 1").distinct(), spark.createDataFrame([], "folder string, filename string")), "ordinal", "status") == [(1, "unreadable")]
    a, b = text.grouping_parts(F.lit(None).cast("string"))
    assert tuple(spark.range(1).select(a, b).first()) == (None, None)
    recs = catalog.tracks(spark, "/root/testdata/sf0.001").limit(0)
    assert records.counts(records.reconcile_genre(recs)).first()["total"] == 0 and records.report(recs).count() == 0
    assert records.fingerprint(recs, ["path"]).first()["drift"].startswith("0:")


def test_report_of_a_run(spark):
    r = records.report(catalog.tracks(spark, "/root/testdata/sf0.001"))
    assert {"genre", "tag_key", "vocal", "timeslot"} <= set(r.columns) and r.count() == 6000
    a, b = records.fingerprint(r, ["path", "genre"]).first()["drift"], records.fingerprint(r.repartition(3), ["path", "genre"]).first()["drift"]
    assert a == b != records.fingerprint(r.withColumn("genre", F.lit("x")), ["path", "genre"]).first()["drift"]
