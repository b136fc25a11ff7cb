"""Source divergence, lattice hashing and the prefix trie against brute-force versions, hard rows and small bounds."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import lattice_hash, prefix_trie, source_divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, df long, n long, value long, rank long"


def plain_divergence(rows, least=10, top=10):
    """rows: (text, lang, source). Results as sorted tuples, by dense sums over all kept terms."""
    table = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.decode() for t in (text or "").encode().translate(table).split()]
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        terms = [t for t, k in df[lang].items() if k >= least]
        sources = sorted({s for g, s in groups if g == lang}, key=str.encode)
        total = {s: sum(counts[lang, s][t] for t in terms) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(terms)) for t in terms} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 2) // (sum(total.values()) + 2 * len(terms)) for t in terms}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in terms), o.encode()) for o in sources if o != s))
            own = sorted((-f(p[s][t], q[t]), t.encode()) for t in terms if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(own[:top], 1)]
    return sorted(out)


def divergence_rows(seed=3, n=300):
    rng = random.Random(seed)
    vocabulary = ["the", "Über", "naïve", "日本", "x", "THE", *(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(90))]
    rows = []
    for i in range(n):
        weights = [1 + (j + i) % 7 for j in range(len(vocabulary))]
        text = rng.choice([" ", "\n", "--", "1"]).join(rng.choices(vocabulary, weights, k=rng.randrange(40)))
        rows.append((rng.choice([text, text, text, None, "", "12 34"]), rng.choice(["en", "en", "en", "de", "", None]), rng.choice(["a", "b", "", None, "é", "z", "Z"])))
    return rows


def test_divergence_is_that_of_dense_sums(spark):
    rows = divergence_rows()
    docs = spark.createDataFrame([(i % 50, *r, 0, "t", 1, 1, 1, 1) for i, r in enumerate(rows)], DOCS)
    found = source_divergence.audit(docs)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain_divergence(rows)


def test_divergence_of_nothing_and_of_rare_terms(spark):
    assert source_divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    rows = [("only once", "en", s) for s in "ab"]
    docs = spark.createDataFrame([(i, *r, 0, "t", 1, 1, 1, 1) for i, r in enumerate(rows)], DOCS)
    assert sorted(map(tuple, source_divergence.audit(docs).collect())) == plain_divergence(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_a_long_text_is_counted_in_pieces(monkeypatch):
    text = (" ".join(f"wörd{chr(97 + i % 26)}x" for i in range(5000)) + "y" * 3000).encode()
    whole = [w for part in source_divergence.words(text) for w in part]
    monkeypatch.setattr(source_divergence, "PIECE", 50)
    pieces = list(source_divergence.words(text))
    assert len(pieces) > 100 and [w for part in pieces for w in part] == whole == text.split()


def divergence_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(3)], names=["lang", "source", "text"])


def test_flushes_and_runs_add_up(monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice([b"a", b"b"]), rng.choice([b"s", b"t"]), b" ".join(rng.choices([b"u", b"v", b"w", b"x"], k=5))) for _ in range(200)]
    monkeypatch.setattr(source_divergence, "HELD", 5)
    monkeypatch.setattr(source_divergence, "CHUNK", 20)
    monkeypatch.setattr(source_divergence, "PIECE", 8)
    batches = [divergence_batch(rows[i : i + 10]) for i in range(0, len(rows), 10)]
    runs = [r for b in source_divergence.count_terms(iter(batches)) for r in b.to_pylist()]
    assert len(runs) > 100
    runs.sort(key=lambda r: r["key"])
    schema = pa.schema([("key", pa.binary()), ("df", pa.int64()), ("n", pa.int64())])
    whole = pa.schema([("lang", pa.binary()), ("term", pa.binary()), ("source", pa.binary()), ("df", pa.int64()), ("n", pa.int64())])
    for size in (1, 3, 1000):
        batches = [pa.RecordBatch.from_pylist(runs[i : i + size], schema) for i in range(0, len(runs), size)]
        added = [r for b in source_divergence.add_runs(iter(batches)) for r in b.to_pylist()]
        want, docs = Counter(), Counter()
        for lang, source, text in rows:
            for t in text.split():
                want[lang, t, source] += 1
            for t in {*text.split()}:
                docs[lang, t, source] += 1
        found = {(r["lang"], r["term"], r["source"]): (r["n"], r["df"]) for r in added if r["term"]}
        assert found == {k: (want[k], docs[k]) for k in want} and len(added) == len(want)
        order = sorted(added, key=lambda r: (r["term"], r["lang"], r["source"]))
        batches = [pa.RecordBatch.from_pylist(order[i : i + size], whole) for i in range(0, len(order), size)]
        terms = [(t.to_pylist(), at.tolist()) for t, at in source_divergence.whole_terms(iter(batches))]
        assert [r for t, _ in terms for r in t] == order
        starts = [(t[i]["lang"], t[i]["term"]) for t, at in terms for i in at]
        assert len(starts) == len(set(starts)) == len({(r["lang"], r["term"]) for r in order})


@pytest.mark.parametrize("side, pairs", [(2, 1), (3, 2), (5, 100), (100, 3)])
def test_matrices_of_few_sources_sum_alike(monkeypatch, side, pairs):
    rng = random.Random(2)
    rows = sorted({(lang, term, source): (rng.randrange(1, 10**9), rng.randrange(1, 10**9)) for lang in (b"a", b"b") for term in (b"t", b"u", b"v") for source in (b"p", b"q", b"r", b"s") if rng.random() < 0.8}.items())
    flat = [{"lang": k[0], "term": k[1], "source": k[2], "p": v[0], "z": v[1]} for k, v in rows]
    monkeypatch.setattr(source_divergence, "SIDE", side)
    monkeypatch.setattr(source_divergence, "PAIRS", pairs)
    found = Counter()
    batches = [pa.RecordBatch.from_pylist(flat[i : i + 2], pa.schema([("lang", pa.binary()), ("term", pa.binary()), ("source", pa.binary()), ("p", pa.int64()), ("z", pa.int64())])) for i in range(0, len(flat), 2)]
    for batch in source_divergence.shared_pairs(iter(batches)):
        for r in batch.to_pylist():
            found[r["lang"], r["source"], r["item"]] += r["value"]
    want, f = Counter(), lambda x, y: (x - y) ** 2 // (x + y)
    for (lang, term, a), (p, z) in rows:
        for (lang2, term2, b), (q, w) in rows:
            if (lang, term) == (lang2, term2) and a != b:
                want[lang, a, b] += f(p, q) - f(p, w) - f(z, q) + f(z, w)
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in want.items() if v}


VECTORS = "vec_id long, embedding array<float>, label int, node long, value string, n long, component string, cell long"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "v", 1, "c", 1) for i, v in rows], VECTORS)


def plain_links(rows, least=0.95):
    good = [(k, np.array(v, np.float64)) for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for x, (i, a) in enumerate(good):
        for j, b in good[:x]:
            if len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                links[i].add(j)
                links[j].add(i)
    out, seen = [], {}
    for i in range(len(rows)):
        if i in seen:
            continue
        reach, queue = {i}, [i]
        while queue:
            for j in links[queue.pop()] - reach:
                reach.add(j)
                queue.append(j)
        ids = [rows[j][0] for j in reach if rows[j][0] is not None]
        seen |= dict.fromkeys(reach, min(ids) if ids else None)
    for i, (key, _) in enumerate(rows):
        out.append((key, len(links[i]), seen[i], key == seen[i]))
    return sorted(out, key=str)


def clouds(seed=0, n=300, dims=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dims))
    rows = [(10 * i, v.tolist()) for i, v in enumerate(base)]
    for i in range(0, n, 3):
        u = base[i] / np.linalg.norm(base[i])
        w = rng.standard_normal(dims)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        for k, cosine in enumerate((0.9501, 0.9499, 0.97, 0.999)):
            rows.append((10 * i + 1 + k, (3 * (cosine * u + math.sqrt(1 - cosine * cosine) * w)).tolist()))
    return rows


def test_lattice_links_are_those_of_brute_force(spark):
    """Near copies at the threshold and above it; recall of single links is measured, none below may be there."""
    rows = [(i, np.float32(v).tolist()) for i, v in clouds()]
    found = sorted(map(tuple, lattice_hash.near_groups(vector_frame(spark, rows)).collect()), key=str)
    want = plain_links(rows)
    assert all(a[1] <= b[1] for a, b in zip(found, want, strict=True))
    assert sum(r[1] for r in found) >= 0.99 * sum(r[1] for r in want) > 500


def test_chance_to_meet_at_the_threshold():
    rng = np.random.default_rng(5)
    for dims in (16, 64, 300):
        a = lattice_hash.unit(rng.standard_normal((1000, dims)))
        w = rng.standard_normal((1000, dims))
        w -= (w * a).sum(1)[:, None] * a
        b = 0.95 * a + math.sqrt(1 - 0.95**2) * lattice_hash.unit(w)
        met = np.zeros(1000, bool)
        for t in range(lattice_hash.TABLES):
            (x, xs), (y, ys) = lattice_hash.cells(a, t), lattice_hash.cells(b, t)
            met |= (x == y) | (xs == y[:, None]).any(1) | (ys == x[:, None]).any(1)
        assert met.mean() >= 0.97, dims


def test_decoding_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(1)
    y = rng.uniform(-3, 3, (500, 8))
    near = lattice_hash.decode(y)
    assert all((p % 1 == 0).all() and p.sum() % 2 == 0 or (p % 1 == 0.5).all() and (p - 0.5).sum() % 2 == 0 for p in near)
    steps = lattice_hash.shortest()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    here = ((y - near) ** 2).sum(1)
    assert (here[:, None] <= ((y[:, None] - near[:, None] - steps[None]) ** 2).sum(2) + 1e-9).all() and here.max() <= 1 + 1e-9


def test_large_cells_go_in_pieces_and_copies_in_classes(spark, monkeypatch):
    """Four hundred unlike vectors in one cell, and copies of one vector, with parts of 50: links as by brute force."""
    rng = np.random.default_rng(2)
    middle = rng.standard_normal(32)
    rows = [(i, np.float32(middle + 0.02 * rng.standard_normal(32)).tolist()) for i in range(300)]
    rows += [(1000 + i, np.float32(middle).tolist()) for i in range(100)]
    rows += [(5000 + i, np.float32(rng.standard_normal(32)).tolist()) for i in range(100)]
    monkeypatch.setattr(lattice_hash, "CELL", 50)
    found = sorted(map(tuple, lattice_hash.near_groups(vector_frame(spark, rows)).collect()), key=str)
    assert found == plain_links(rows)


def test_hard_vectors(spark):
    v = [0.5] * 8
    rows = [(1, v), (1, v), (None, v), (2, None), (3, []), (4, [0.0] * 8), (5, [None] * 8), (6, [float("nan")] * 8), (7, [float("inf")] * 8), (8, [0.5] * 7), (9, [1.0] * 8), (10, [-0.5] * 8), (None, None), (11, [1e30] * 8), (12, [1e-40] * 8), (-3, [2.0])]
    found = sorted(map(tuple, lattice_hash.near_groups(vector_frame(spark, rows)).collect()), key=str)
    assert found == plain_links(rows)
    assert lattice_hash.near_groups(vector_frame(spark, [])).collect() == []


TURNS = "conv_id long, turn long, role string, text string, path string, bucket string, n long, depth long"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(t[1], t[3]) for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if len(paths[c]) == len(node))))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def turn_rows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(-20, n):
        for t in range(rng.choice([0, 1, 2, 3, 8, 14])):
            rows.append((c, rng.choice([t, t, t, t, None, 3]), rng.choice(["user", "model", None, ""]), rng.choice(["a", "b", "é" * 5, "", None])))
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1200) for t in range(6)]
    rows += [(None, 1, "user", "x"), (7000, 1, "user", "long " * 50000), (7000, 1, "user", "long " * 50000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bounds", [{}, {"bucket_turns": 40, "run_turns": 30}, {"bucket_turns": 7, "run_turns": 3}])
def test_trie_is_that_of_brute_force(spark, bounds):
    rows = turn_rows(len(bounds))
    turns = spark.createDataFrame([(*r, "p", "b", 1, 1) for r in rows], TURNS)
    assert sorted(map(tuple, prefix_trie.trie(turns, **bounds).collect()), key=str) == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).collect() == []
    bare = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9)  # its base is absent, and it takes its only turn from there
    for rows in ([(bare, 1, "user", "x")], [(bare, 1, "user", "x"), (bare + 1000, 1, "u", "y"), (5, 1, "u", "z")]):
        turns = spark.createDataFrame([(*r, "p", "b", 1, 1) for r in rows], TURNS)
        assert sorted(map(tuple, prefix_trie.trie(turns).collect()), key=str) == plain_trie(rows)


def test_ids_of_one_path_in_many_chunks(spark, monkeypatch):
    paths = [(b"p" * 32, [1], c) for c in range(1000)] + [(b"q" * 32, [1], 7)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in paths], t) for k, t in enumerate((pa.binary(), pa.list_(pa.int64()), pa.int64()))], names=["path", "sizes", "conv_id"])
    monkeypatch.setattr(prefix_trie, "CHUNK", 200)
    chunks = list(prefix_trie._pack_ids(iter([batch])))
    assert len(chunks) > 50
    items = [r for b in prefix_trie._fold_ids(iter(chunks)) for r in b.to_pylist()]
    assert [(r["n"], r["conv"], r["ends"]) for r in items] == [(1000, 0, hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()), (1, 7, hashlib.sha256(b"7").hexdigest())]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_loser_tree_merges_runs_and_compares_no_shared_turn_twice(monkeypatch, k):
    """Merging k front-coded runs gives the sorted items with their LCPs, reading fewer turns than plain comparisons would."""
    rng = random.Random(k)
    turn = lambda x: hashlib.sha256(str(x).encode()).digest()
    prefix = b"".join(turn(i) for i in range(30))
    paths = list({(prefix if rng.random() < 0.8 else b"") + b"".join(turn(rng.randrange(3)) for _ in range(rng.randrange(8))) for _ in range(400)})
    runs = []
    for r in range(k):
        own, before, run = sorted(paths[r::k]), b"", []
        for p in own:
            lcp = prefix_trie.shared_turns(before, p)
            run.append((lcp, p[lcp * 32 :], [1] * (len(p) // 32 - lcp), 1, paths.index(p), "e"))
            before = p
        runs.append(run)
    read = [0]
    plain = prefix_trie.shared_turns

    def counting(a, b, at=0):
        end = plain(a, b, at)
        read[0] += end - at + 1
        return end

    monkeypatch.setattr(prefix_trie, "shared_turns", counting)
    got = list(prefix_trie.merged(runs))
    assert [g[1] for g in got] == sorted(paths)
    assert [g[0] for g in got] == [0] + [plain(a, b) for a, b in zip(sorted(paths), sorted(paths)[1:], strict=False)]
    assert [len(g[2]) for g in got] == [len(p) // 32 for p in sorted(paths)]
    assert read[0] <= sum(len(p) // 32 for r in runs for _, p, *_ in r) + 2 * len(paths) * max(1, math.ceil(math.log2(k)) if k > 1 else 1)


@pytest.mark.parametrize("module", [source_divergence, lattice_hash, prefix_trie])
def test_sql_says_the_same_on_the_smallest_tables(spark, module):
    where = "/root/testdata/sf0.001"
    found = module.query(spark, where)
    names = sorted(found.columns)
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '{where}/{table}.parquet'")
    assert sorted(map(str, map(tuple, found.select(*names).collect()))) == sorted(map(str, con.execute(f"select {', '.join(names)} from ({module.SQL})").fetchall()))


def test_rows_count_as_documents_whatever_their_ids(spark):
    docs = spark.createDataFrame([(1, "word", "en", s, 4, "t", 1, 1, 1, 1) for s in "ab" for _ in range(5)], DOCS)
    assert {r["value"] for r in source_divergence.audit(docs).where(F.col("part") == "pair").collect()} == {0}
    assert source_divergence.audit(docs, least=11).count() == 2
