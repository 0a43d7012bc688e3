"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and with odd inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fluvia.llm import ann, audio, bpe, chat, line_dedup, packing, quality, registry, sharding, simhash, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
WORDS = "The station reads stage and flow each day while rain falls on the upper basin near old bridge walls".split()


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(n))


def union_find(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# SimHash


def plain_fingerprint(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints_and_components(spark, documents):
    odd = [(-5, None), (-4, ""), (-3, "one"), (-2, "ONE\x0b"), (-2, "one"), (None, "one"), (10**6, "x " * 30_000)]
    rows = documents + odd
    got = simhash.simhash_components(spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("clash"))).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = union_find(len(rows), ((i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3))
    least = {}
    for r, (i, _) in zip(roots, rows, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = Counter((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, roots, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_tree_search_is_exact(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64).view(np.uint64)
    near = np.concatenate([base] + [base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for _ in range(3)])
    points = np.unique(near)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp bigint")
    found = simhash.components(simhash.hamming_links(df, shard_rows=40))
    label = {r["u"]: r["root"] for r in found.collect()}
    signed = points.view(np.int64).tolist()
    order = sorted(range(len(signed)), key=lambda i: signed[i])
    ranked = points[order]
    roots = union_find(len(order), ((i, j) for i in range(len(order)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(ranked[i + 1 :] ^ ranked[i]) <= 3)).tolist()))
    assert [label.get(signed[o], signed[o]) for o in order] == [signed[order[r]] for r in roots]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)]
    got = {r["u"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1100)}
    assert simhash.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_views_are_independent():
    """Pairs of similarity 0.8 that agree in fewer than two views are as rare as with independent orders (under 0.1%)."""
    rng, missed = np.random.default_rng(11), 0
    for _ in range(2000):
        union = rng.integers(0, 2**64, 50, dtype=np.uint64)
        agree = simhash.view_fingerprints(union[:45]) == simhash.view_fingerprints(np.concatenate([union[:40], union[45:]]))
        missed += int(agree.sum()) < 2
    assert missed <= 5


def test_local_search_of_dense_and_sparse_points():
    """A tight cluster, random points, and points that are alike in one half, against all pairs."""
    rng = np.random.default_rng(3)
    tight = np.full(1500, np.uint64(77777))
    for _ in range(4):
        tight = tight ^ (np.uint64(1) << rng.integers(0, 64, len(tight)).astype(np.uint64))
    alike = rng.integers(0, 1 << 14, 1500).astype(np.uint64)
    points = np.unique(np.concatenate([tight, alike, rng.integers(0, 1 << 63, 1500).astype(np.uint64)]))
    got = list(range(len(points)))
    for number in range(simhash.HALVES):
        forest = simhash.Forest(len(points))
        home = np.arange(len(points))
        simhash.link(points, simhash.half(points, number), home, home[:0], 1, 3, forest, block=64)
        got = union_find(len(points), [*enumerate(got), *((i, forest.find(i)) for i in range(len(points)))])
    close = ((i, j) for i in range(len(points)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= 3)).tolist())
    assert got == union_find(len(points), close)


@pytest.mark.parametrize("seed", range(4))
def test_close_links_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    passage, base = rng.integers(-(2**62), 2**62, 40), rng.integers(-(2**62), 2**62, 120)
    sets = [np.empty(0, np.int64)] * 2
    for i in range(150):
        if i % 3:
            some = (sets[-1] if i % 2 and len(sets[-1]) > 60 else base).copy()
            some[rng.choice(len(some), int(rng.integers(0, 20)), replace=False)] = rng.integers(-(2**62), 2**62)
        else:
            some = np.concatenate([passage, rng.integers(-(2**62), 2**62, int(rng.integers(1, 60)))])
        sets.append(np.unique(some))
    plain = [set(x.tolist()) for x in sets]
    close = ((i, j) for i, j in itertools.combinations(range(len(sets)), 2) if plain[i] and len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]))
    got = list(range(len(sets)))
    for i, root in zip(*simhash.close_links(sets, 0.8), strict=True):
        got[i] = int(root)
    assert got == union_find(len(sets), close)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    passage = words(rng, 60)
    for k in range(25):
        base = words(rng, rng.randrange(5, 220)).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(max(1, len(base) // 80)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
        if k % 3 == 0:
            rows.append((len(rows), passage + " " + words(rng, 40)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, rows[0][1].upper())]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    close = ((i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    roots = union_find(len(rows), close)
    got = {r["id"]: r["group"] for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i] for i, _ in rows] == roots
    kept = simhash.drop_near_duplicates(spark.createDataFrame([*rows, (None, "x"), (None, "x"), rows[0]], DOCS)).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter({i: 1 for i in set(roots)}) + Counter({None: 2})
    assert simhash.drop_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_ids_lose_no_text(spark):
    """Rows of one id and different texts are different documents, in whatever order they come."""
    rng = random.Random(9)
    a, b, c = (words(rng, 80) for _ in range(3))
    near = c.replace(c.split()[40], "changed")
    rows = [(1, a), (1, b), (2, a), (3, b), (3, c), (4, near), (1, a.upper()), (1, a), (None, a)]
    md5 = lambda t: hashlib.md5(t.encode()).digest()
    want = sorted([(1, min((a, a.upper()), key=md5)), (1, b), (3, c), (None, a)], key=str)
    for order in (rows, rows[::-1], rows[4:] + rows[:4]):
        docs = spark.createDataFrame([(*r, f"{i}") for i, r in enumerate(order)], f"{DOCS}, other string").repartition(3, "other")
        assert sorted([(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs).collect()], key=str) == want
    groups = {(r["id"], bytes(r["raw"])): (r["group"], r["stays"]) for r in simhash.near_duplicates(docs).collect()}
    assert groups[4, md5(near)] == (3, False) and groups[2, md5(a)] == (1, False) and groups[3, md5(b)] == (1, False) and groups[3, md5(c)] == (3, True)
    assert sum(stays for _, stays in groups.values()) == 3


# nearest neighbours


def test_recall_and_distances(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 16))
    rows = centers[rng.integers(0, 12, 3000)] + 0.4 * rng.standard_normal((3000, 16))
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, rows, strict=True)], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in ann.ann_search(df, F.col("vec_id") % 50 == 0, depth=4, block_rows=100).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    true = ann.brute_force(ids, rows, ids[ids % 50 == 0])
    assert set(got) == set(true)
    found = [len({v for _, v, _ in got[q]} & {v for v, _ in true[q]}) / 10 for q in true]
    assert np.mean(found) >= 0.9
    for q, r in got.items():
        assert [k for k, _, _ in sorted(r)] == list(range(1, 11))
        assert all(math.isclose(s, math.dist(rows[q], rows[v]), rel_tol=1e-12) for _, v, s in r)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0, 1.0]), (100, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.ann_search(df, F.col("vec_id") % 100 == 0).collect())
    first = [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 0, 1.0), (0, 4, 100, 2.0)]
    second = [(0, 1, 0, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 100, 1.0)]
    assert got == Counter([*first, *second, (100, 1, 0, 1.0), (100, 2, 0, 2.0), (100, 3, 1, 2.0), (100, 4, 2, 2.0)])
    assert ann.ann_search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_embeddings(spark, sf):
    """The registered query against all pairs."""
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect() if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    true = ann.brute_force(ids, vectors, ids[ids % 100 == 0])
    got = defaultdict(set)
    for r in registry.op2_ann(spark, f"/root/testdata/{sf}").collect():
        got[r["query_id"]].add(r["vec_id"])
    assert set(got) == set(true)
    assert np.mean([len(got[q] & {v for v, _ in true[q]}) / len(true[q]) for q in true]) >= 0.9


def test_clustered_vectors_are_pruned():
    """On clustered vectors the probes hold at most a quarter of the rows and find over 0.9 of the neighbours."""
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((80, 32))[rng.integers(0, 80, 6000)] + 0.3 * rng.standard_normal((6000, 32))
    router = ann.fit(rows[:3000], 6)
    home = router.most_probable(rows, 1)[:, 0]
    asked = np.arange(0, 6000, 50)
    true = ann.brute_force(np.arange(6000), rows, asked)
    probed = router.most_probable(rows[asked], router.probes)
    assert np.mean([np.isin(home[[v for v, _ in true[q]]], p).mean() for q, p in zip(asked.tolist(), probed, strict=True)]) >= 0.9
    assert np.mean([np.isin(home, p).mean() for p in probed]) <= 0.25


def test_balanced_parts():
    rng = np.random.default_rng(0)
    part = ann.partition(ann.neighbours(rng.standard_normal((1024, 8)), 10), 4, rng)
    assert set(np.bincount(part)) == {64}


# BPE

TEXTS = ["", "aaaaaaaaaaaaa", "a" * 999, " " * 50 + "x", "don't we'll  \n\n  x", "<|endoftext|>a<|endoftext|><|endoftext|> b", "日本語テキスト と漢字", "՘ x⭳aᲉ", "🎉🎉👩‍👩‍👧", "x\x1c\x1dy\x85z 　w", "1234567890" * 10, "\x00\x01", "ab" * 30_000]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(library, documents):
    rng = random.Random(1)
    texts = TEXTS + [t for _, t in documents[:60]]
    texts += ["".join(rng.choice("abtheinon  .\n's1é") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    model = bpe.Bpe(bpe.read_spec(None))
    ids = model.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [model.decode(x) for x in ids] == [library.decode(x.tolist(), skip_special_tokens=False) for x in ids]
    other = packing.encoder(bpe.read_spec(None))
    assert all(np.array_equal(other(t), x) for t, x in zip(texts, ids, strict=True))


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 1_500_000 + "b", "\t" * 1_200_000 + "x", "x" + " \n\t" * 400_000, "abcdefghij" * 300_000, "1" * 1_000_000, "a\u0378\U000e0fff b" * 1000], ids=["spaces", "newlines", "tabs", "mixed", "word", "digits", "unassigned"])
def test_packing_encodes_any_text(library, text):
    assert packing.encoder(bpe.read_spec(None))(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_table(spark, library):
    rows = [(i, t) for i, t in enumerate([*TEXTS[:8], None, "x", "x"])]
    got = bpe.bpe_encode(spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("clash")), outputs=("ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256")).collect()
    for r in got:
        text = rows[r["doc_id"]][1] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), text)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.bpe_decode(spark.createDataFrame([(1, [50256, 72]), (2, None), (3, [])], "k int, ids array<int>")).orderBy("k").collect()
    assert [r["decoded"] for r in back] == ["<|endoftext|>i", None, ""]
    assert bpe.bpe_encode(spark.createDataFrame([], DOCS)).count() == 0


# packing


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_the_histogram(seed):
    rng = np.random.default_rng(seed)
    n, size = int(rng.integers(0, 3000)), 128
    lengths = np.clip(rng.lognormal(3, 1.2, n).astype(int), 1, size)
    counts = np.bincount(lengths, minlength=size + 1)
    planned = packing.plan(counts, size)
    used = Counter()
    for pattern, many in planned:
        assert sum(pattern) <= size and many > 0
        for x in pattern:
            used[x] += many
    assert used == Counter(lengths.tolist())
    sequences = sum(m for _, m in planned)
    assert sequences <= sum(m for _, m in packing.best_fit(counts, size)) + 2
    assert sequences >= -(-int(lengths.sum()) // size)


def test_pack(spark, library, documents):
    rows = documents + [(-1, None), (-2, ""), (None, "x"), (-3, "word " * 9000), (-3, "word " * 9000)]
    packed = packing.pack(spark.createDataFrame(rows, DOCS).withColumn("offset", F.lit("clash")), with_ids=True)
    got = packed.collect()
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_document[r["doc_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    text = dict(rows)
    for i, parts in by_document.items():
        ids = np.array([*library.encode(text[i] or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        parts = sorted(parts, key=lambda r: (r["piece"], r["sequence_id"]))[:: 2 if i == -3 else 1]
        assert b"".join(r["ids"] for r in parts) == ids
        assert [r["piece"] for r in parts] == list(range(len(parts))) and [r["start"] for r in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
        assert all(r["length"] == 2048 for r in parts[1:])
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= -(-total // 2048) * 1.02 + 1
    whole = packing.sequences(packed).agg(F.sum("n_tokens"), F.sum(F.length("ids"))).first()
    assert tuple(whole) == (total, 4 * total)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


# chat


def test_sequences_join_all_pieces(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (2, "flow " * 3000), (3, "é\u0000")]
    packed = packing.pack(spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash")).withColumn("offset", F.lit(9)), with_ids=True)
    joined = packing.sequences(packed).collect()
    want = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert {r["sequence_id"]: (r["n_tokens"], len(r["ids"]) // 4) for r in joined} == {r["sequence_id"]: (r["n"], r["end"]) for r in want}
    whole = packing.pack(spark.createDataFrame([], DOCS), with_ids=True)
    assert packing.sequences(whole).count() == 0


def test_viterbi_is_the_best_path():
    rng = random.Random(2)
    counts = Counter({(k, rng.randrange(6 if k != "start" else 1), rng.randrange(6 if k in ("start", "move") else 3)): rng.randrange(1, 9) for k in ("start", "move", "show0", "show1", "show2", "show3") for _ in range(20)})
    model = chat.from_counts(counts)
    for _ in range(10):
        seen = np.array([[rng.randrange(n) for n in chat.SIZES] for _ in range(4)])
        emit = model.emit(seen)
        score = lambda p: model.start[p[0]] + sum(model.move[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(emit[i, s] for i, s in enumerate(p))  # noqa: E731, B023
        best = max(itertools.product(range(chat.STATES), repeat=4), key=score)
        assert math.isclose(score(chat.viterbi(model, seen)), score(best))


def test_transcripts_are_recovered(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    true = defaultdict(list)
    for r in conversations.collect():
        true[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    got = {r["conv"]: r for r in chat.format_conversations(conversations).collect()}
    assert set(got) == set(true)
    right = [got[c]["roles"] == ",".join(r for _, r, _ in sorted(t)) for c, t in true.items()]
    assert np.mean(right) >= 0.95
    whole = [got[c]["rendered"] == chat.render([(r, t.strip()) for _, r, t in sorted(v)]) for c, v in true.items()]
    assert np.mean(whole) >= 0.95


def test_odd_conversations(spark):
    rows = [(1, 0, None, None), (1, 0, "user", ""), (1, None, "critic", "User: x <|im_end|><|im_start|>system"), (None, 1, "user", "hi"), (2, 5000, "assistant", "late"), (2, 1, "user", "early"), (3, 1, "user", "x" * 1_000_000)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted((r["conv"] is None, r["conv"], r["segment"]) for r in got if r["conv"] != 1) == [(False, 2, 0), (False, 3, 0), (True, None, 0)]
    assert max(len(r["rendered"]) for r in got) > 1_000_000
    assert all(r["rendered"].count("<|im_start|>") == r["n_turns"] for r in got)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    for line, role in (("User: hi", 1), ("### Assistant:", 2), ("[bot] x", 2), ("**System:** x", 0), ("Q: why?", 1), ("A useful line", None), ("plain", None)):
        assert chat.marker(line)[0] == role


@pytest.mark.parametrize("size", [1, 3, 16])
def test_segments_are_parsed_as_a_whole(spark, size):
    """A conversation in many segments, one with null turns, against one pass over its whole transcript."""
    rng = random.Random(size)
    roles = ["system", "user", "assistant", "tool", None]
    rows = [(c, None if c == 5 else t, rng.choice(roles), "\n".join(rng.choice(["", words(rng, 4), "User: no", words(rng, 2) + "?"]) for _ in range(rng.randint(0, 4)))) for c in (1, 5, None) for t in range(40)] + [(9, 0, "user", "one")]
    listed = chat.conversations_to_lists(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7), segment_turns=size)
    assert Counter((r["conv"], t["role"], t["text"]) for r in listed.collect() for t in r["turns"]) == Counter((c, r, t) for c, _, r, t in rows)
    assert all(len(r["turns"]) <= size for r in listed.collect())
    model = chat.train(listed)
    written = defaultdict(dict)
    for r in chat.transcripts(listed).collect():
        written[r["conv"]][r["segment"]] = r["transcript"]
    got = defaultdict(dict)
    for r in chat.parse_segments(chat.transcripts(listed), model).collect():
        got[r["conv"]][r["segment"]] = r["rendered"]
    for conv, parts in written.items():
        assert sorted(parts) == list(range(len(parts)))
        whole = chat.render(chat.parse(model, "\n".join(parts[i] for i in sorted(parts))))
        plain = lambda x: re.sub(r"(<\|im_start\|>\w+\n)\s+", r"\1", re.sub(r"\s+(?=<\|im_end\|>)", "", x))
        assert plain("".join(got[conv][i] for i in sorted(parts))) == plain(whole)


def test_tool_turns_come_back(spark):
    rows = [(c, t, role, words(random.Random(c * 9 + t), 6) + ("?" if role == "user" else ".")) for c in range(200) for t, role in enumerate(("system", "user", "assistant", "tool", "assistant"))]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert np.mean([r["roles"] == "system,user,assistant,tool,assistant" for r in got]) >= 0.8


# audio


def test_audio_round_trip_and_features(spark):
    rows = [(0, None), (1, ""), (2, "é" * 288), (3, "x" * 577), (4, "x" * 577), (5, "long " * 20_000)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in audio.audio_table(df, keep=["doc_id"]).collect()}
    for i, text in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r, file = got[i], audio.write_wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
    assert got[3]["feature"] == got[4]["feature"] != got[5]["feature"]
    for i, text in rows:
        found = audio.read_tensors(got[i]["tensors"])
        assert found.schema.field("patch").type == audio.PATCH_TYPE and audio.PATCH_TYPE.shape == [audio.PATCH_FRAMES, audio.MELS]
        mels, energy, _ = plain_audio((text or "").encode() + b"\xff" * (-len((text or "").encode()) % 576 if text else 576)) if i < 5 else (None, None, None)
        patches = found.column("patch").combine_chunks().to_numpy_ndarray().astype(float).reshape(-1, audio.MELS)
        start, end = found.column("start").to_numpy(), found.column("end").to_numpy()
        assert start[0] == 0 and np.allclose(start[1:], end[:-1]) and (end > start).all()
        if mels is not None:
            assert np.allclose(patches[: len(mels)], mels, atol=2e-2) and not patches[len(mels) :].any()
            assert math.isclose(end[-1], len(mels) * 0.0128)
    assert audio.audio_table(df.limit(0), keep=["doc_id"]).count() == 0


def plain_audio(payload):
    """(log-mel frames, energies, segments) from the definitions: zeros between samples, one long filter, a slow transform."""
    x = (np.frombuffer(payload, dtype=np.uint8).astype(float) - 128) / 128
    n = audio.UP * audio.TAPS
    t = np.arange(n) - (n - 1) / 2
    kernel = np.sinc(t / audio.DOWN) * np.hamming(n)
    kernel *= audio.UP / kernel.sum()
    up = np.zeros((len(x) + 4 * audio.TAPS) * audio.UP)
    up[audio.TAPS // 2 * audio.UP :: audio.UP][: len(x)] = x
    y = np.convolve(up, kernel)[n - audio.UP :: audio.DOWN][: -(-len(x) * audio.UP // audio.DOWN)]
    rate, frames = audio.RATE * audio.UP / audio.DOWN, []
    energy = []
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * math.log10(1 + rate / 2 / 700), audio.MELS + 2)]
    for k in range(max(1, -(-(len(y) - audio.WINDOW) // audio.HOP) + 1)):
        part = np.zeros(audio.WINDOW)
        some = y[k * audio.HOP : k * audio.HOP + audio.WINDOW]
        part[: len(some)] = some
        part *= [0.5 - 0.5 * math.cos(2 * math.pi * i / audio.WINDOW) for i in range(audio.WINDOW)]
        power = [abs(np.sum(part * np.exp(-2j * math.pi * f * np.arange(audio.WINDOW) / audio.WINDOW))) ** 2 for f in range(audio.WINDOW // 2 + 1)]
        row = []
        for a, b, c in zip(edges, edges[1:], edges[2:], strict=False):
            row.append(math.log10(sum(p * max(0, min((f * rate / audio.WINDOW - a) / (b - a), (c - f * rate / audio.WINDOW) / (c - b))) for f, p in enumerate(power)) + 1e-6))
        frames.append(row)
        energy.append(10 * math.log10(np.mean(power) + 1e-6))
    energy = np.array(energy)
    segments, since, state = [], 0, 0
    for k, e in enumerate([*energy, -math.inf]):
        new = 1 if e > energy.mean() + 0.5 * energy.std() else 0 if e < energy.mean() - 0.5 * energy.std() else state
        if new > state:
            since = k
        if new < state:
            segments.append((since, k))
        state = new
    return np.array(frames), energy, segments


@pytest.mark.parametrize("seed", range(3))
def test_features_against_plain_definitions(seed):
    rng = np.random.default_rng(seed)
    loud = np.repeat(rng.integers(0, 2, 12), 700)
    payload = audio.pad_payload((128 + np.round((20 + 90 * loud) * np.sin(np.arange(len(loud)) * rng.uniform(0.05, 0.8))) + rng.integers(-8, 8, len(loud))).astype(np.uint8).tobytes())
    mels, _, segments = plain_audio(payload)
    found = audio.analyze(payload)
    assert found["frames"] == len(mels) and np.allclose(found["mean"], mels.mean(axis=0), atol=1e-3)
    assert np.allclose(found["patches"].reshape(-1, audio.MELS)[: len(mels)], mels, atol=5e-3)
    step = audio.HOP * audio.DOWN / (audio.RATE * audio.UP)
    assert np.allclose(found["segments"], np.array(segments).reshape(-1, 2) * step)


def test_signal_steps():
    t = np.arange(16_000) / 16_000
    low, high = (audio.resample(np.sin(2 * np.pi * f * t).astype(np.float32))[200:-200].std() for f in (440, 7000))
    assert abs(low - 0.7071) < 0.01 and high < 0.01
    energy = np.array([0, 0, 9, 9, 5, 5, 9, 0, 5, 0, 0], dtype=np.float32)
    assert audio.segments(energy).tolist() == [[2, 7]]
    with pytest.raises(ValueError):
        audio.read_wav(b"RIFFxxxxWAVE")


# line dedup


def plain_line_dedup(rows, least=10):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                holders[key(x)].add(i)
    gone = lambda i, x: i is not None and len(key(x)) >= least and len(holders[key(x)]) > 1 and i != min(holders[key(x)])
    return Counter((i, (t or "").count("\n") + 1, sum(gone(i, x) for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t in rows)


@pytest.mark.parametrize("bits", [1 << 20, 1 << 28])
def test_lines(spark, bits):
    rng = random.Random(4)
    pool = [words(rng, 4) for _ in range(30)] + ["short", "  Ünïcode líne ten+ \t", "ÜNÏcode líne ten+", "", "abcdefghi", "éééééééééé"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, pool[0]), (3, pool[1]), (3, pool[1]), (52, "once only in one document\nonce only in one document"), (53, ("z" * 50 + "\n") * 3000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("clash")).withColumn("doc", F.lit(1))
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.line_dedup(df, max_filter_bits=bits).collect())
    assert got == plain_line_dedup(rows)
    assert line_dedup.line_dedup(spark.createDataFrame([], DOCS)).count() == 0


# quality


def test_only_losing_documents_meet_their_keys(spark):
    """Documents that lose nothing stay where they are; ids of any type are told apart by the filter."""
    rows = [(f"d{i}", f"a line of document {i} alone\n" + ("a line that many documents hold" if i % 7 == 0 else "x")) for i in range(400)]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id string, text string").repartition(5)).collect()}
    assert len(got) == 400 and sum(r["n_dropped"] for r in got.values()) == sum(i % 7 == 0 for i in range(400)) - 1
    bits = 1 << line_dedup.SEGMENT_BITS
    held = np.frombuffer(line_dedup.id_filter(spark.range(0, 1000, 3).toDF("doc"), bits), dtype=np.uint8)
    hashes = np.array([r[0] for r in spark.range(1000).select(F.xxhash64("id")).collect()])
    found = np.logical_and.reduce([held[p >> 3] >> (p & 7) & 1 for p in line_dedup.hash_positions(hashes, bits)]).astype(bool)
    assert found[::3].all() and found.sum() < 344


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [r for r in registry.op8_quality(spark, path).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= 0.95


def test_words_alone_are_learnt():
    """Texts of one form whose words differ: the good speak of rivers, the bad of prizes."""
    rng = random.Random(8)
    river, prize = ["basin", "gauge", "river", "stage", "level", "water"], ["prize", "money", "bonus", "price", "cheap", "offer"]
    filler = [f"{a}{b}{c}{d}{e}" for a in "btms" for b in "aeio" for c in "rln" for d in "aeu" for e in "dk"]
    texts = [" ".join(rng.choice(pool if rng.random() < 0.3 else filler) for _ in range(60)) for pool in (river, prize) * 150]
    rows, labels = np.stack([quality.features(t) for t in texts]), np.array([1, 0] * 150)
    model = quality.fit(rows[:200], labels[:200])
    assert np.mean((model.score(rows[200:]) >= 0.7) == (labels[200:] == 1)) >= 0.95


def test_newton_against_plain_gradient_descent():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 5))
    labels = (x @ [2.0, -1, 0, 0.5, 0] + 0.5 * rng.standard_normal(60) > 0).astype(int)
    i, j = quality.draw_pairs(labels, 300, rng)
    assert set(i) == set(np.flatnonzero(labels == 1)) and set(j) == set(np.flatnonzero(labels == 0))
    ridge = np.array([0.01, 0.01, 0.1, 0.01, 0.2])
    w = np.zeros(5)
    for _ in range(20_000):
        apart = x[i] - x[j]
        w -= 0.2 * (ridge * w - apart.T @ (1 / (1 + np.exp(apart @ w))) / len(i))
    assert np.allclose(quality.fit_pairs(x, i, j, ridge, block=64), w, atol=1e-4)


def test_contents_are_of_the_whole_text():
    text = " ".join(f"word{i % 700}" for i in range(40_000))
    data = text.encode()
    plain = np.zeros(quality.TRIGRAM_BINS)
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        plain[((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 25] += 1
    assert np.allclose(quality.contents(data, Counter(data.split()))[quality.WORD_BINS :] ** 2 * (len(data) - 2), plain)
    assert not quality.features(" \n").any() and np.isfinite(quality.features("x" * 3_000_000)).all()


def test_odd_quality_inputs(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y z"), (4, "x y z"), (4, "x y z")], DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None), (4, 7)], "doc_id bigint, quality int")
    got = quality.score(docs, quality.train(docs, labels), keep=["doc_id"]).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and not next(r for r in got if r["doc_id"] is None)["held_out"]
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).count() == 0


# sharding


def test_extendible_hashing(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(0, 900)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint")
    got = {r["doc_id"]: r for r in sharding.extendible_shards(df, size=F.col("n"), max_bytes=4000, step_bits=2).collect()}
    h = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i, _ in rows}
    sums = Counter()
    for i, n in rows:
        for d in range(61):
            sums[d, h[i] >> (60 - d)] += n
    for i, _ in rows:
        d = next(d for d in range(61) if sums[d, h[i] >> (60 - d)] <= 4000)
        assert (got[i]["shard_depth"], got[i]["shard_prefix"], got[i]["shard_bytes"], got[i]["shard_page"]) == (d, h[i] >> (60 - d), sums[d, h[i] >> (60 - d)], 0)


def test_equal_keys_overflow(spark):
    rows = [(1, "x" * 100)] * 50 + [(1, "y" * 900)] * 3 + [(1, "z" * 5000), (None, None), (None, "q"), (2, "")]
    got = sharding.extendible_shards(spark.createDataFrame(rows, DOCS).withColumn("h", F.lit(1)).withColumn("shard_page", F.lit("clash")), max_bytes=1000).collect()
    assert len(got) == len(rows)
    pages = Counter()
    for r in got:
        pages[r["shard_depth"], r["shard_prefix"], r["shard_page"]] += len((r["text"] or "").encode())
    assert all(pages[r["shard_depth"], r["shard_prefix"], r["shard_page"]] == r["shard_bytes"] for r in got)
    assert sorted(n for n in pages.values() if n > 1000) == [5000]
    assert sharding.extendible_shards(spark.createDataFrame([], DOCS)).count() == 0


# WARC

PAGES = "page_id bigint, url string, html string"


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a", "same"), (1, "http://b c\r\nX: y", "same"), (2, None, ""), (5, "u", None), (4, "u", "é" * 100_000), (1, "http://b", "same"), (None, "n", "same"), (None, "n", "alone"), (6, "t", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n")]
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash"))
    whole = warc.write_warc(df, archive_bytes=2000)
    normal = warc.normalize(whole)
    read = warc.read_warc(normal).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        h = h or ""
        response = h not in first or first[h] == i
        want[i, len(h.encode()), warc.payload_digest(h.encode()), "response" if response else "revisit", None if response else first[h]] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read) == want
    assert {r["payload"].decode() for r in read if r["record_type"] == "response"} == {h or "" for _, _, h in rows}
    index = warc.sidecar(normal).collect()
    assert len(index) == len(rows)
    data = {r["archive"]: r["data"] for r in normal.collect()}
    assert all(warc.parse_member(data[r["archive"]][r["offset"] : r["offset"] + r["length"]])["record_type"] == r["type"] for r in index)
    assert warc.export_files(normal, str(tmp_path)).agg(F.sum("records")).first()[0] == len(rows)
    loaded = warc.normalize(warc.load_files(spark, f"{tmp_path}/*.gz"))
    assert {r["data"] for r in loaded.collect()} == set(data.values())
    kept = normal.cache()
    lines = warc.write_sidecar(kept, f"{tmp_path}/sidecar")
    assert sorted(map(tuple, lines.collect()), key=str) == sorted(map(tuple, warc.sidecar(kept).collect()), key=str) and list(tmp_path.glob("sidecar/*.csv"))
    by_file = warc.read_warc(warc.with_index(kept, lines), payload=False)
    assert sorted(map(tuple, by_file.collect()), key=str) == sorted(map(tuple, warc.read_warc(kept, payload=False).collect()), key=str)
    assert warc.warc_round_trip(df, archive_bytes=2000).count() == len(rows)
    small = warc.read_warc(warc.normalize(warc.write_warc(df, min_bytes=5))).where("record_type = 'revisit'")
    assert small.count() == 0
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_files_of_empty_and_null_pages(spark, tmp_path):
    nothing = warc.normalize(warc.write_warc(spark.createDataFrame([], PAGES)))
    assert warc.sidecar(nothing).count() == 0 and warc.read_warc(nothing).count() == 0
    assert warc.export_files(nothing, f"{tmp_path}/none").count() == 0
    nulls = spark.createDataFrame([(None, None, None), (None, None, None), (7, None, "")], PAGES).selectExpr("*", "'x' AS archive", "'y' AS data", "1 AS index")
    normal = warc.normalize(warc.write_warc(nulls))
    rows = warc.read_warc(normal).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["payload_bytes"], r["url"] or "") for r in rows) in ([(0, "response", 0, ""), (0, "response", 0, ""), (7, "response", 0, "")], [(0, "revisit", 0, ""), (0, "revisit", 0, ""), (7, "response", 0, "")])
    for _ in range(2):  # the second replaces the first
        assert warc.export_files(normal, f"{tmp_path}/some").agg(F.sum("records")).first()[0] == 3
    assert warc.read_warc(warc.normalize(warc.load_files(spark, f"{tmp_path}/some/*.gz"))).count() == 3


def test_inflate_bounds_and_errors():
    data = zlib.compress(b"a" * 5_000_000, wbits=31) + zlib.compress(b"b" * 10, wbits=31)
    pieces = list(warc.inflate(data, chunk=1000))
    assert b"".join(pieces) == b"a" * 5_000_000 + b"b" * 10 and max(map(len, pieces)) <= 1000
    with pytest.raises(ValueError):
        list(warc.inflate(data[:-8]))


# pipeline


def test_pipeline_stages(spark, documents):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, SF).cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) >= 0.95
    lines = corpus_pipeline.drop_repeated_lines(spark, good, SF).cache()
    assert lines.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert Counter((r["doc_id"], r["text"]) for r in lines.collect()) == Counter((i, t) for (i, _, _, t), n in plain_line_dedup(rows).items() for _ in range(n))
    rows = [(r["doc_id"], r["text"]) for r in lines.collect()]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    ranked = [sets[k] for k in order]
    roots = union_find(len(order), ((i, j) for i, j in itertools.combinations(range(len(order)), 2) if (not ranked[i] and not ranked[j]) or len(ranked[i] & ranked[j]) >= 0.8 * len(ranked[i] | ranked[j])))
    near = corpus_pipeline.drop_near_copies(spark, lines, SF)
    assert {r["doc_id"] for r in near.collect()} == {rows[order[r]][0] for r in set(roots)}
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {rows[order[r]][0] for r in set(roots)}


@pytest.mark.parametrize("number", range(4))
def test_pipeline_stages_with_odd_input(spark, number):
    """Nulls, empty and very long texts, repeated rows, clashing names, an empty table."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[number]
    text = "Uma frase longa que se repete por inteiro em dois textos.\n" + words(random.Random(5), 90)
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, text), (None, None), (5, " " * 1_100_000), (6, words(random.Random(6), 200_000)), (7, "Uma frase longa que se repete por inteiro em dois textos.")]
    clash = ("score", "predicted", "n_lines", "n_dropped", "held_out", "id", "group", "piece", "__row", "__text", "fp")
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"mine {c}") for c in clash})
    out = stage(spark, docs, SF)
    got = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {r[0] for r in rows}
        assert sum(r["start"] == 0 for r in got) == len(rows)
    else:
        assert out.columns == docs.columns
        assert all(r[c] == f"mine {c}" for r in got for c in clash)
        ids = Counter(r["doc_id"] for r in got)
        if name == "line_dedup":
            assert ids == Counter(r[0] for r in rows)
            assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] in (2, 7)}[7] == ""
        if name == "simhash":
            assert ids == Counter({1: 1, 3: 1, 6: 1, 7: 1, None: 2})
    assert stage(spark, docs.limit(0), SF).count() == 0
