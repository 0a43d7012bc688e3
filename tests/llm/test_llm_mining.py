"""Host reputation, collocations and time partitions against brute force, and with odd inputs."""

import calendar
import datetime as dt
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fluvia.llm import collocations, registry, reputation, time_partitions

SF = "/root/testdata/sf0.001"

# Host reputation


def plain_reputation(counts, deviations=reputation.DEVIATIONS):
    """{host: (share, bound)} of {host: (n, k)}."""

    def suffix(host):
        parts = host.split(".")
        return ".".join(parts[-2:]) if ".".join(parts[-2:]) in reputation.COMPOUND else parts[-1]

    def domain(host):
        parts = host.split(".")
        return ".".join(parts[-3:]) if ".".join(parts[-2:]) in reputation.COMPOUND else ".".join(parts[-2:])

    n, k = (sum(c[i] for c in counts.values()) for i in range(2))
    above = {None: (k + 1) / (n + 2)}
    for name, up in ((suffix, lambda h: None), (domain, suffix), (lambda h: h, domain)):
        level = defaultdict(lambda: [0, 0, 0.0])
        for host, (n, k) in counts.items():
            node = level[name(host)]
            node[0], node[1], node[2] = node[0] + n, node[1] + k, above[up(host)]
        over = sum((k - n * m) ** 2 - n * m * (1 - m) for n, k, m in level.values())
        under = sum(n * (n - 1) * m * (1 - m) for n, k, m in level.values())
        rho = min(reputation.MOST_RHO, max(reputation.LEAST_RHO, over / under if under else 1))
        worth = 1 / rho - 1
        above = {x: (k + worth * m) / (n + worth) for x, (n, k, m) in level.items()}
    out = {}
    for host, (n, k, m) in level.items():
        a, b = k + worth * m, n - k + worth * (1 - m)
        out[host] = above[host], above[host] - deviations * math.sqrt(a * b / (a + b) ** 2 / (a + b + 1))
    return out


URLS = [
    "http://A.example.net/en/1?x=/de/", "https://example.net/de/", "http://bexample.net/en/", "x://example.com/de/", "http://m.example.com/de", "http://example.org/fr/9#a",
    "http://org/fr/", "no scheme", None, "", "http://net?x", "http://net/", "a://b://c/d", "http://shop.co.uk/a", "http://x.shop.co.uk/a\nb", "http://É.Org/fr/É?q",
]


def test_reputation_against_brute_force(spark):
    rng = np.random.default_rng(3)
    hosts = [f"h{i}.d{i % 7}.{('com', 'org', 'co.uk')[i % 3]}" for i in range(40)]
    pages = [(i, f"http://{hosts[int(rng.zipf(1.5)) % 40]}/p{i}") for i in range(1500)] + [(2000 + i, u) for i, u in enumerate(URLS)] + [(3, "http://h3.d3.com/again"), (None, "http://h1.d1.org/")]
    bad = {h: rng.random() ** 3 for h in hosts}
    told = [(i, int(rng.random() < bad.get((u or "").split("/")[2] if (u or "").count("/") > 2 else "", 0.1)) if i % 11 else None) for i, u in pages if i is not None and i % 3]
    told += [(1, 1), (1, 1), (None, 1), (10**6, 1)]
    got = reputation.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string").withColumn("host", F.lit(1)), spark.createDataFrame(told, "page_id bigint, bad int"), registry.URL_RULES).collect()

    def parts(url):
        if "://" not in (url or ""):
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]

    outcomes = defaultdict(list)
    for i, b in told:
        if i is not None and b is not None:
            outcomes[i].append(b)
    counts = defaultdict(lambda: (0, 0))
    for i, u in pages:
        n, k = counts[parts(u)[0]]
        counts[parts(u)[0]] = n + len(outcomes.get(i, ())), k + sum(outcomes.get(i, ()))
    known = plain_reputation(counts)
    rules = sorted(((h + p, v, h, p) for v, h, p in registry.URL_RULES), key=lambda r: -len(r[0]))
    want = []
    for i, u in pages:
        host, path = parts(u)
        fit = next(((r, v) for r, v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), (None, None))
        want.append((i, host, path, fit[0], fit[1] or ("block" if known[host][1] > reputation.LIMIT else "allow"), *known[host]))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert len(got) == len(want) and {w[4] for w in want if w[3] is None} == {"allow", "block"}
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_reputation_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    none = spark.createDataFrame([], "page_id bigint, bad int")
    assert reputation.judge_urls(pages, none, registry.URL_RULES).count() == 0
    one = reputation.judge_urls(spark.createDataFrame([(1, "http://a.b/c")], pages.schema), none, ()).collect()
    assert [r["verdict"] for r in one] == ["allow"]


def test_host_reputation_runs_no_python(spark):
    plan = registry.op11_url_reputation(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Collocations


def plain_collocations(rows, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    longer = defaultdict(int)
    for (lang, p), a in f.items():
        if len(p) == 3 and a >= least:
            for inner in (p[:2], p[1:]):
                longer[lang, inner] = max(longer[lang, inner], a)
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least and (len(p) == 3 or 100 * longer[lang, p] < share * a):
            cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            out[lang].append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


ODD = [
    ("en", None), (None, "a b a b a b, a b! a b a b a b a b a b"), ("", "a b " * 30), ("en", ""), ("en", " \t.;\n"), ("en", "É\xa0é x" + "\x00y z " * 40), ("en", "Aa bB\taa bb " * 300), ("zz", "w" * 9000 + " v " + ("w" * 9000 + " ") * 12),
]


@pytest.mark.parametrize("small", [False, True])
def test_collocations_against_brute_force(spark, monkeypatch, small):
    """With small tries, chunks and blocks, many ranges cut through words and pairs."""
    rng = np.random.default_rng(5)
    rows = [(("en", "de", None)[i % 3], " ".join(f"{'the' if rng.random() < 0.3 else 'w' + str(int(rng.zipf(1.3)) % 60)}{'. ' if rng.random() < 0.1 else ''}" for _ in range(int(rng.integers(0, 120))))) for i in range(300)] + ODD
    docs = spark.createDataFrame([(l, t, 1) for l, t in rows], "lang string, text string, w1 int").repartition(5)
    if small:
        held = collocations.serialised
        for name, value in (("CHUNK", 16), ("GATHER", 40), ("FULL", 300), ("BLOCK", 64), ("BUFFER", 32)):
            monkeypatch.setattr(collocations, name, value)
        chunks, bounds = _locally(collocations, docs, rows, 40)
        nodes = list(_merged_locally(collocations, chunks, bounds, 10))
        assert held is collocations.serialised and _total(nodes) == _plain_nodes(rows, 10)
        return
    got = collocations.collocations(docs, ranges=30).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows)
    assert sorted(map(tuple, collocations.collocations(docs, ranges=1, least=25, share=80, top=7).collect())) == plain_collocations(rows, 25, 80, 7)


def _locally(module, docs, rows, ranges):
    """Chunks of tries of a few documents each, with bounds through common words, made in this process."""
    paths = sorted({(("und" if l is None else l).encode(), *((list(w[i : i + 3]) + [b"", b""])[:3])) for l, t in rows for w in [[x for part in module.words_of((t or "").encode()) for x in part if x != module.END]] for i in range(len(w))})
    bounds = [(p[0], p[1:]) for p in sorted({paths[i * len(paths) // ranges] for i in range(1, ranges)})]
    chunks = []
    for lo in range(0, len(rows), 7):
        tries = {}
        for lang, text in rows[lo : lo + 7]:
            trie = tries.setdefault("und" if lang is None else lang, module.Trie())
            for w in module.words_of((text or "").encode()):
                trie.add(w)
            trie.add([module.END, module.END])
        for lang, trie in tries.items():
            trie.close()
            words, packed, counts = trie.sorted()
            mine = [b for b in bounds if b[0] == lang.encode()]
            first = sum(b[0] < lang.encode() for b in bounds)
            edges = np.searchsorted(packed, [module.first_at(words, b[1]) for b in mine]).tolist()
            for i, (a, z) in enumerate(zip([0, *edges], [*edges, len(packed)], strict=True)):
                for at in range(a, z, module.CHUNK):
                    some = slice(at, min(at + module.CHUNK, z))
                    head = tuple(words[int(packed[at]) >> (2 - j) * module.WORD_BITS & module.MASK] for j in range(3))
                    chunks.append((first + i, lang, head, module.pack(words, packed[some], counts[some])))
    return chunks, bounds


def _merged_locally(module, chunks, bounds, least):
    now, merge = None, None
    for at, lang, head, chunk in sorted(chunks, key=lambda c: c[:3]):
        if (at, lang) != now:
            if merge is not None:
                yield from [*merge.settle(None), merge.whole()]
            near = [p for name, p in bounds[max(0, at - 1) : at + 1] if name == lang.encode()]
            now, merge = (at, lang), module.Merge(lang, {p[:i] for p in near for i in (1, 2)}, least)
        elif merge.rows > module.GATHER:
            yield from merge.settle(head)
        merge.add(module.unpack(chunk))
    yield from [*merge.settle(None), merge.whole()]


def _total(batches):
    """{(lang, words): count} of the frequent nodes, with those that came in parts; ancestors that came must be right."""
    found, parts = {}, Counter()
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    for lang, w1, w2, w3, f, _, _, part in rows:
        words = tuple(w for w in (w1, w2, w3) if w is not None)
        if part:
            parts[lang, words] += f
        else:
            assert (lang, words) not in found
            found[lang, words] = f
    every = found | {k: v for k, v in parts.items() if v >= 10 or not k[1]}
    for lang, w1, w2, w3, _, l1, l2, _ in rows:
        assert l1 is None or every[lang, (w1,)] == l1
        assert l2 is None or every[lang, (w1, w2)] == l2
    return every


def _plain_nodes(rows, least):
    f = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang, tuple(w[i : i + k])) for k in (0, 1, 2, 3) for i in range(len(w) - max(k, 1) + 1))
    return {k: v for k, v in f.items() if v >= least or (not k[1] and v)}


def test_scores_are_exact(spark):
    rows = [(10**15 + 7, 10**15 + 9, 10**16 - 1), (3 * 10**9, 3 * 10**9 + 1, 3 * 10**9 + 5), (10, 11, 999), (10**16 - 1, 10**16 - 1, 10**16 - 1)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select("a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r["s"] == 10**6 * r["a"] * r["a"] // (r["l"] * r["r"]) for r in got)


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], none.schema)).count() == 0


def test_merge_of_overlapping_chunks_follows_their_rows(monkeypatch):
    """As the chunks of many tries all reach over their range, each of them waits till the end; looking at all of them for each is quadratic."""
    monkeypatch.setattr(collocations, "GATHER", 40)
    words = [b"", *(b"w%03d" % i for i in range(200))]
    rng = np.random.default_rng(1)
    merge, looked, total, found = collocations.Merge("en", set(), 10), 0, 0, []
    for i in range(300):
        places = np.unique(np.r_[1, rng.integers(1, 201, 20), 200])
        paths = places << 2 * collocations.WORD_BITS | (places[::-1] << collocations.WORD_BITS)
        if merge.full():
            looked += merge.rows
            found += merge.settle((words[1], words[1 + i % 100], b""))
        merge.add(collocations.unpack(collocations.pack(words, paths, np.full(len(paths), i + 1))))
        total += len(paths) * (i + 1)
    rows = merge.rows
    found += [*merge.settle(None), merge.whole()]
    assert rows > 5000 and looked < 3 * rows
    every = _total(found)
    assert every["en", ()] == total and sum(f for (_, w), f in every.items() if len(w) == 1) == total


def test_each_range_is_a_task(spark):
    """Numbers of ranges dealt by their hash met in some tasks, and left others without one."""
    rng = np.random.default_rng(3)
    texts = [(" ".join(f"w{i}" for i in rng.integers(0, 400, 200)),) for _ in range(200)]
    docs = spark.createDataFrame(texts, "text string").select(F.lit("en").alias("lang"), F.col("text").cast("binary").alias("text"))
    bounds = collocations.sample_bounds(docs, 24)
    nodes = collocations.merged(collocations.serialised(docs, bounds), bounds, 10)
    wholes = nodes.where("w1 is null").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(bounds) == 23 and [r["count"] for r in wholes] == [1] * 24


def test_collocations_of_one_long_text_of_many_words(spark):
    """A text of more words than a trie can number, which is no place where tries could be written before."""
    text = "a b " + " ".join(f"{i:x}" + (" a b" if i % 200_000 == 0 else "") for i in range(16, 2_300_000))
    got = collocations.collocations(spark.createDataFrame([(text, "en")], "text string, lang string"), ranges=3).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", 12, 12, 12, text.count(" ") + 1, 10**6)]


# Time partitions


def plain_layout(rows, limit):
    """{(leaf, part): rows in order} of rows (moment, arrived, id, ...), top down."""
    leaves = defaultdict(list)
    some = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])

    def fit(kids, prefix):
        run = None
        for label, start, end, inside, below in kids:
            if len(inside) > limit:
                run = None
                if below is None:
                    leaves[f"{prefix}{label}-{label}"] = inside
                else:
                    fit(below(), f"{prefix}{label}/")
            else:
                if run is None or len(run[2]) + len(inside) > limit:
                    run = [label, label, []]
                    runs.append((prefix, run))
                run[1] = label
                run[2] += inside

    def within(a, b, of):
        return [r for r in of if a <= r[0] < b]

    def years():
        for y in range(some[0][0].year, some[-1][0].year + 1):
            inside = within(dt.datetime(y, 1, 1), dt.datetime(y + 1, 1, 1), some)
            yield f"{y:04}", None, None, inside, lambda y=y, i=inside: months(y, i)

    def months(y, of):
        for m in range(1, 13):
            end = dt.datetime(y + m // 12, m % 12 + 1, 1)
            inside = within(dt.datetime(y, m, 1), end, of)
            yield f"{m:02}", None, None, inside, lambda m=m, i=inside: days(y, m, i)

    def days(y, m, of):
        for d in range(1, calendar.monthrange(y, m)[1] + 1):
            start = dt.datetime(y, m, d)
            inside = within(start, start + dt.timedelta(days=1), of)
            yield f"{d:02}", None, None, inside, lambda s=start, i=inside: hours(s, i)

    def hours(start, of):
        for h in range(24):
            a = start + dt.timedelta(hours=h)
            yield f"{h:02}", None, None, within(a, a + dt.timedelta(hours=1), of), None

    runs = []
    if some:
        fit(years(), "")
    for prefix, (first, last, inside) in runs:
        if inside:
            leaves[f"{prefix}{first}-{last}"] = inside
    leaves["null"] = [r for r in rows if r[0] is None]
    low = dt.datetime.min
    out = {}
    for leaf, inside in leaves.items():
        inside.sort(key=lambda r: (r[0] or low, (r[1] is not None, r[1] or low), (r[2] is not None, r[2] or 0)))
        for at in range(0, len(inside), limit):
            out[leaf, at // limit + 1] = inside[at : at + limit]
    return out


def check_layout(found, rows, old, limit, names):
    """The report and the files against the plain layout; rows are (moment, arrived, id, *table row)."""
    start = plain_layout([r for r in rows if old(r)], limit)
    want = plain_layout(rows, limit)
    assert {(r["leaf"], r["part"]) for r in found} == set(want) and len(found) == len(want)
    folder = None
    bag = lambda some: Counter(r[3:] for r in some)
    for r in found:
        inside = want[r["leaf"], r["part"]]
        assert r["columns"] == ",".join(names)
        assert r["n_rows"] == len(inside) and r["n_new"] == sum(not old(x) for x in inside)
        ids = ",".join("" if x[2] is None else str(x[2]) for x in inside)
        assert r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        same = (r["leaf"], r["part"]) in start and bag(start[r["leaf"], r["part"]]) == bag(inside)
        if r["rewritten"] == same:  # rows that are equal but for other columns may change places at the end of a part
            assert [x[:3] for x in start.get((r["leaf"], r["part"]), [])] == [x[:3] for x in inside]
        path = Path(urlparse(r["path"]).path)
        folder = path.parents[2]
        table = pq.ParquetFile(path).read()
        assert table.column_names == names and table.num_rows == len(inside)
    assert {str(p) for p in folder.rglob("*.parquet")} == {urlparse(r["path"]).path for r in found}


def test_time_partitions_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(3000):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=float(rng.random()) * 150 * 86_400)
        rows.append((None if rng.random() < 0.02 else t, t + dt.timedelta(seconds=float(rng.exponential(3000))), int(i), "x"))
    hot = dt.datetime(2024, 3, 4, 7)
    rows += [(hot, hot + dt.timedelta(minutes=i % 3), 10_000 + i // 4, "y") for i in range(300)]  # copies across the parts of one hour
    rows += [(dt.datetime(1969, 12, 31, 23, 59), None, 5, "z"), (dt.datetime(2031, 2, 1), dt.datetime(2024, 6, 1), None, None), *rows[:40], *rows[:40]]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, arrived_at timestamp_ntz, click_id bigint, leaf string").repartition(6)

    def moment(t, i):
        if t is None or i is None:
            return t
        k = zlib.crc32(str(i).encode()) % 128
        if k < 16:
            return t - dt.timedelta(days=(k + 6) ** 3)
        return dt.datetime.combine(t.date() - dt.timedelta(days=t.weekday()), dt.time()) if k > 111 else t

    cut = dt.datetime(2024, 4, 20)
    told = [(moment(t, i), a, i, t, a, i, x) for t, a, i, x in rows]
    limit = 1 + len(rows) // 60
    old = F.col("arrived_at") < F.lit(str(cut)).cast("timestamp_ntz")
    got = time_partitions.rewrite_by_time(df, moment=registry.click_moment(), arrived=F.col("arrived_at"), ident=F.col("click_id"), old=old, limit=limit).collect()
    check_layout(got, told, lambda r: r[1] is not None and r[1] < cut, limit, ["ts", "arrived_at", "click_id", "leaf"])
    assert {r["rewritten"] for r in got} == {True, False} and any(r["part"] > 1 for r in got)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(None, None, 1)] * 7, [(dt.datetime(2024, 2, 29, 23), dt.datetime(2025, 1, 1), 1)] * 9])
def test_odd_time_partitions(spark, rows):
    df = spark.createDataFrame(rows, "ts timestamp_ntz, arrived_at timestamp_ntz, click_id bigint")
    old = F.col("arrived_at") < F.lit("2024-05-01").cast("timestamp_ntz")
    got = time_partitions.rewrite_by_time(df, moment=F.col("ts"), arrived=F.col("arrived_at"), ident=F.col("click_id"), old=old, limit=2).collect()
    if rows:
        check_layout(got, [(*r, *r) for r in rows], lambda r: False, 2, ["ts", "arrived_at", "click_id"])
    else:
        assert got == []


def test_query_of_clicks(spark):
    """The query's files on the smallest table, whose clicks have all arrived before the cut: all of them stay."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/clicks.parquet").withColumn("m", registry.click_moment()).select("m", "arrived_at", "click_id", "ts", "client_id", "kind", "value", "props").collect()]
    got = registry.op13_time_partitions(spark, SF).collect()
    want = plain_layout(rows, 1 + len(rows) // 500)
    assert {(r["leaf"], r["part"], r["n_rows"], r["ids_sha256"]) for r in got} == {(*k, len(v), hashlib.sha256(",".join(str(x[2]) for x in v).encode()).hexdigest()) for k, v in want.items()}
    assert not any(r["rewritten"] or r["n_new"] for r in got)
