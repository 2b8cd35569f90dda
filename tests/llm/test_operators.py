"""Each corpus operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import html
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import ann, lm, mixing, neardup, packing, pii, quality, queries, urlfilter, wrappers
from ledgerloom.llm.queries import BLOCKED, RULES, tokenizer_path
from ledgerloom.llm.sharding import ConflictError, ShardStore

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rnd = random.Random(11)
VOCABULARY = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


BASE = [prose(rnd.randrange(1, 300)) for _ in range(60)]
TEXTS = [
    *BASE, *(t.replace(" ", "\n", 1).upper() for t in BASE[:5]), *BASE[:8], *(" ".join(w for i, w in enumerate(t.split()) if i != 7) for t in BASE[10:25]),
    None, None, "", " \t\n", "x", "same line here\nsame line here\nsame line here", prose(20000), "\x1c\x85\xa0 z\xa0y", "a b c d e f g h " * 5,
]
ROWS = [(i, t, f"s{i % 3}" if i % 7 else None, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "s0", "clash"), (None, "no id", "s1", "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    names = "doc_id long, text string, source string, size string"
    return spark.createDataFrame(ROWS, names).withColumns({n: F.lit("clash") for n in ("key", "rank", "count", "root", "word", "length", "document", "quality", "skey", "dealt", "rep", "content", "digest", "extra", "arrival", "_metadata", "shard", "twice", "x")}).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def words(t):
    return WORD.findall(t or "")


def test_ann(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.standard_normal(12).astype(np.float32).tolist() for _ in range(900)]
    vectors[5] = vectors[40]
    rows = [(i, v, "clash") for i, v in enumerate(vectors)] + [(1000, None, ""), (1001, [0.0] * 12, ""), (1002, [float("nan")] + [1.0] * 11, ""), (1003, [None] + [1.0] * 11, ""), (1020, [1.0, 2.0], ""), (1004, [], ""), (None, vectors[3], ""), (40, vectors[40], "clash")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 20, block_rows=300, query_rows=16).collect()
    x = np.array(vectors, np.float64)
    found = total = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(s[v] - y) < 1e-12 for _, v, y in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        found += len({v for _, v, _ in mine} & set(want.tolist()))
        total += 20
    assert found / total >= 0.9 and {r.query_id for r in got} == set(range(0, 900, 20))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_ties_and_extremes(spark):
    """Equal vectors have equal scores wherever they stand; components beyond the root of the largest double end the search too."""
    rng = np.random.default_rng(3)
    some = rng.standard_normal((60, 9))
    twins = [(i, some[i % 60].tolist()) for i in range(900)]
    got = ann.nearest(spark.createDataFrame(twins, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20, block_rows=130, query_rows=16).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    for mine in by.values():
        mine.sort()
        assert mine == [(k + 1, *m[1:]) for k, m in enumerate(sorted(mine, key=lambda m: (-m[2], m[1])))]
        for _, v, score in mine:
            assert all(score == y for _, w, y in mine if w % 60 == v % 60)
    huge = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(some, [1e160, 1.0, 1e-160] * 20))] + [(60, [1.7e308] * 9), (61, [1.7e308, -1.7e308] + [1.7e308] * 7)]
    got = ann.nearest(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).collect()
    assert len(got) == 4 * 5 and {r.query_id for r in got} == {0, 20, 40, 60}


def block_case(n, asked, dim, seed):
    rng = np.random.default_rng(seed)
    data = rng.standard_normal((n, dim))
    largest = float(np.abs(data).max())
    return np.arange(n) * 3, data, np.arange(asked) * 3, data[:asked].copy(), largest, float(np.sqrt(((data / largest) ** 2).sum(1).max()))


@pytest.mark.parametrize("n,dim", [(1, 4), (700, 6), (900, 260)])
def test_ann_windows(n, dim):
    """What is verified are the vectors that enough windows hold, at the first width at which there are enough of them."""
    ids, data, query_ids, queries, largest, longest = block_case(n, min(n, 25), dim, 2)
    small = data / largest
    basis = ann.projections(dim)
    places = np.concatenate([small, np.sqrt(np.maximum(longest**2 - (small * small).sum(1), 0))[:, None]], 1) @ basis
    at = np.concatenate([queries / largest, np.zeros((len(queries), 1))], 1) @ basis
    want = []
    for q in range(len(queries)):
        width, held = ann.FIRST * float(np.std(np.concatenate([places, at]))), np.zeros(0, int)
        while len(held) < min(n, 8 + int(ann.VERIFIED * n)):
            held = np.flatnonzero(((places >= at[q] - width) & (places <= at[q] + width)).sum(1) >= math.ceil(ann.THRESHOLD * (dim + 1)))
            width *= ann.GROWTH
        score = (data[held] * queries[q]).sum(1)
        want += [(int(query_ids[q]), *x) for x in sorted(((int(ids[v]), float(s)) for v, s in zip(held, score) if v != q), key=lambda x: (-x[1], x[0]))[:7]]
    assert sorted(ann.search_block(ids, data, query_ids, queries, largest, longest, 7)) == sorted(want)


def test_ann_holds_nothing_per_query_and_vector():
    args = block_case(3000, 3000, 4, 4)
    tracemalloc.start()
    try:
        rows = ann.search_block(*args, 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(rows) == 3000 and peak < 3000 * 3000


def test_lm(docs, nothing):
    got = lm.score(docs, lm.held_out(F.col("doc_id"))).collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    counts = collections.Counter()
    for i, t, _, _ in ROWS:
        if not held(i):
            counts.update((t or "").encode().lower().split())
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _, _ in ROWS:
        tokens = [*(t or "").encode().lower().split(), "end"]
        want.append((i, held(i), len(tokens), sum(w in counts for w in tokens), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    mine = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(nothing, lm.held_out(F.col("doc_id"))).count() == 0
    assert [round(r.score, 3) for r in lm.score(docs.limit(1), F.lit(True)).select("score").collect()][0] < 0


def test_rare_words_are_joined(docs, monkeypatch):
    full = {(r.doc_id, round(r.base_score, 6), r.n_known) for r in lm.score(docs, lm.held_out(F.col("doc_id"))).collect()}
    monkeypatch.setattr(lm, "NODES", 300)
    assert {(r.doc_id, round(r.base_score, 6), r.n_known) for r in lm.score(docs, lm.held_out(F.col("doc_id"))).collect()} == full


def test_url_filter(spark):
    urls = ["http://a.net/x", "http://A.Example.NET/en/1?q", "https://example.com/de/", "https://example.com/d", "http://org/fr/x", "http://forg/fr/x", "http://x.org/FR/", "http://net", "net/", None, "", "http://www.spam-farm.example.com", "http://notspam-farm.example.com/", "ftp://u@x.net:80/#a", "a://b://c/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls[:2])], "page_id long, url string, host string")

    def judge(u):
        u = u or ""
        rest = u.partition("://")[2]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        return host, path, None, "block" if any(host == b or host.endswith("." + b) for b in BLOCKED) else "allow"

    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, RULES, BLOCKED).collect()]
    assert sorted(got, key=repr) == sorted([(i, *judge(u)) for i, u in enumerate(urls + urls[:2])], key=repr)
    assert urlfilter.judge_urls(df.limit(0), RULES).count() == 0
    # hosts and paths of any length, and rules without a slash
    rules = (("block", "bad.example.com"), ("allow", "bad.example.com/ok/fine"), ("block", "example.com/x"))
    long = ["http://" + "a." * 100_000 + "bad.example.com/ok/", "http://bad.example.com/ok/fine/" + "y" * 100_000, "http://" + "." * 50_000 + "example.com/xy", "http://ad.example.com/ok/fine"]
    rows = spark.createDataFrame(list(enumerate(long)), "page_id long, url string")
    assert [(r.rule, r.verdict) for r in sorted(urlfilter.judge_urls(rows, rules).collect())] == [("bad.example.com", "block"), ("bad.example.com/ok/fine", "allow"), ("example.com/x", "block"), (None, "allow")]


def test_colliding_digests_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(urlfilter, "digest", lambda s: len(s) % 2)
    urlfilter.DigestIndex.write(str(tmp_path / "i"), {"aa": 1, "bb": 2, "c": 0})
    assert urlfilter.DigestIndex(str(tmp_path / "i")).find(["bb", "aa", "dd", "c", "e", ""]).tolist() == [2, 1, -1, 0, -1, -1]


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path()).collect()
    want = []
    for i, t, _, _ in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        for p, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want.append((i, p, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    # no two pieces of over half the capacity share a sequence
    assert len(by) <= max(-(-sum(r.length for r in got) // 1024), sum(r.length > 512 for r in got)) + 2
    assert packing.pack(nothing, tokenizer_path()).count() == 0


@pytest.mark.parametrize("unit", [" ", "\n", "a", "ab ", "7", "!", "\u6f22", "\u00a0"])
def test_runs_of_any_length_have_ids(unit):
    from tokenizers import Tokenizer

    text = "x" + unit * (2_000_000 // len(unit)) + "y"
    assert packing.encode(text, tokenizer_path())[:-1].tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def simhash(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [256, 2])
def test_fingerprint_components(docs, nothing, bucket):
    got = neardup.fingerprint_components(docs, bucket=bucket).collect()
    prints = [simhash(t) for _, t, _, _ in ROWS]
    root = list(range(len(ROWS)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ROWS)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, *_) in enumerate(ROWS):
        least.setdefault(find(k), []).append(i)
    name = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    want = [(i, f"{prints[k]:016x}", name[find(k)]) for k, (i, *_) in enumerate(ROWS)]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert neardup.fingerprint_components(nothing).count() == 0


def test_fingerprints_at_every_distance_are_linked(spark):
    values = {rnd.getrandbits(64) for _ in range(40)}
    near = [(v, v ^ sum(1 << b for b in rnd.sample(range(64), 2))) for v in values]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in {x for p in near for x in p}], "fp long")
    for bucket in (256, 1):
        links = {tuple(sorted((r.a, r.b))) for r in neardup.fingerprint_links(df, bucket).collect()}
        root = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        assert all(find(signed(a)) == find(signed(b)) for a, b in near)


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block,salt", [(256, 10_000), (2, 3)])
def test_near_copies(docs, nothing, monkeypatch, block, salt):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SALT_ROWS", salt)
    monkeypatch.setattr(neardup, "BANDED", 0 if block == 2 else neardup.BANDED)
    got = neardup.NearCopies(docs).keep_one()
    assert got.columns == docs.columns
    sets = [shingles(t) for _, t, _, _ in ROWS]
    root = list(range(len(ROWS)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ROWS)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if (len(sets[a] & sets[b]) >= 0.8 * union) if union else True:
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = collections.defaultdict(list)
    for k, (i, *_) in enumerate(ROWS):
        groups[find(k)].append(i)
    want = sorted((min((i for i in ids if i is not None), default=None) for ids in groups.values()), key=repr)
    assert sorted((r.doc_id for r in got.collect()), key=repr) == want
    assert neardup.NearCopies(nothing).keep_one().count() == 0


def test_near_copies_under_shared_keys(spark, monkeypatch):
    """All classes share all keys: no table holds a row for each class and key, and candidates are what close fingerprints connect."""
    r = random.Random(5)
    texts = []
    for _ in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([40, 60, 200]))]
        texts += [" ".join(words), " ".join([*words[:-2], "other", "end"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(neardup, "likeliest_codewords", lambda margins, probes: np.zeros((len(margins), probes), np.int16))
    rows, real = {}, neardup.materialize

    def counted(df, label):
        out = real(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    kept = sorted(x.doc_id for x in neardup.NearCopies(df).keep_one().collect())
    assert kept == [i for i in range(120) if i % 2 == 0] and max(rows.values()) <= len(texts)


@pytest.mark.parametrize("few", [1, 50, 5000])
def test_candidate_edges(monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW", few)
    rng = np.random.default_rng(3)
    m = 3000
    key, c, n = rng.integers(0, 60, m), rng.permutation(m) + 7, rng.integers(1, 60, m)
    words = rng.integers(-(2**63), 2**63, (40, 2))[rng.integers(0, 40, m)] ^ (np.int64(1) << rng.integers(0, 63, (m, 2)))
    root = {int(x): int(x) for x in c}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(m):
        near = (key == key[i]) & (np.minimum(n, n[i]) >= 0.8 * np.maximum(n, n[i])) & (np.bitwise_count((words ^ words[i]).view(np.uint64)).sum(1) <= neardup.LOOK)
        for j in np.flatnonzero(near):
            a, b = find(int(c[i])), find(int(c[j]))
            root[max(a, b)] = min(a, b)
    got = neardup._candidate_edges(key, c, n, words, 0.8)
    assert sorted(got) == sorted((find(x), x) for x in root if find(x) != x) and len(got) > 100


def test_html(spark):
    head = "<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href=/>no</a><li>no</ul></nav><header>no</header>"
    article = "<article><h1>Ti&amp;tle</h1><p>one <b>bold</b>  two<br>three<p>four&nbsp;five<script>no()</script><aside>no</aside><form><p>no</form><div class='ad banner'>no</div><!-- no --></article>"
    foot = "<div id=comments><article class=comment><p>no</article></div><footer>&copy; no</footer></body></html>"
    pages = [head + article + foot, head + article + "<footer>no", head + "<div><p>plain</div>" + foot, None, "", "just text", "<article><p>" + "long " * 50000]
    df = spark.createDataFrame([(i, f"http://h{i % 2}.example.com/{i}" if i != 2 else None, p, "clash") for i, p in enumerate([*pages, pages[0]])], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.main_text(df).collect()}
    want = "Ti&tle\none bold two three\nfour five"
    assert got[0] == got[1] == got[7] == (want, len(want))
    assert [got[i][0] for i in range(2, 6)] == ["plain", "", "", "just text"] and got[6][1] == 50000 * 5 - 1
    assert wrappers.main_text(df.limit(0)).count() == 0


def test_many_layouts_on_one_host(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "GROUP", 4)
    pages = []
    for i in range(40):
        body = "".join(rnd.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>"]).format(f"t{k}&lt;") for k in range(rnd.randrange(1, 7)))
        pages.append((i, "http://x.example.com/", f"<nav>{'<li>n' * rnd.randrange(4)}</nav>" + "<div class=ad>x</div>" * rnd.randrange(2) + f"<article>{body}</article><footer>f</footer>" * 1))
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, _, p in pages:
        inner = p[p.index("<article>") + 9 : p.index("</article>")]
        assert got[i] == "\n".join(html.unescape(t) for t in re.findall(r">([^<>]+)<", inner))


def test_mixing(docs, nothing):
    got = mixing.mix(docs).collect()
    sizes = [(i, s, len(words(t))) for i, t, s, _ in ROWS]
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=repr) == sorted(sizes, key=repr)
    of = collections.Counter()
    for _, s, n in sizes:
        of[s] += n
    order = sorted((s for s in of if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_sources, left = {}, set(order), 1.5 * sum(of.values())
    while open_sources:
        level = left / sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if level * weight[s] >= 2 * of[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_sources}
            break
        target |= {s: 2.0 * of[s] for s in over}
        left -= sum(2 * of[s] for s in over)
        open_sources -= over
    longest = max(n for _, _, n in sizes)
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == of[s] and abs(r.target - target[s]) < 1e-6 and r.taken in (0, r.size, 2 * r.size) for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 2 * longest
    assert sum(r.taken for r in got) <= 1.5 * sum(of.values())
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns and sum(len(words(r.text)) for r in rows.collect()) == sum(r.taken for r in got)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_quality(docs, nothing):
    got = quality.judge(docs).select("document.doc_id", "document.text", "quality.*").collect()
    assert len(got) == len(ROWS)
    for r in got:
        t, w = r.text or "", words(r.text)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often = collections.Counter(windows)
        repeat = len({k for i, x in enumerate(windows) if often[x] > 1 for k in range(i, i + 8)})
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 20 or 100 * repeat > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, failed)
        total = max(sum(map(len, w)), 1)
        shares = []
        for n, most in quality.MAX_DUPLICATED.items():
            grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
            many = collections.Counter(grams)
            shares.append(sum(len(w[k]) for k in {k for i, x in enumerate(grams) if many[x] > 1 for k in range(i, i + n)}) / total <= most)
        again = sum(len("".join(words(x))) for i, x in enumerate(lines) if x in lines[:i]) / total
        assert r.kept == (not failed and all(shares) and again <= quality.MAX_LINES)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} >= {t for t in BASE if len(words(t)) >= 40}
    assert quality.keep_good(nothing).count() == 0


def test_sharding(spark, docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "store"), target_bytes=40_000, small_bytes=1_000, fan_in=3)
    assert store.read() is None and store.version() == 0
    for k in range(6):
        store.append(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(6)) == k).coalesce(2))
        store.compact()
    store.append(docs.limit(0))
    held = store.read()
    plain = lambda df: sorted(map(tuple, df.select(*docs.columns).collect()), key=repr)
    assert plain(held) == plain(docs)
    tiers = collections.Counter(store.tier(s) for s in store.manifest()["shards"])
    assert all(n < 3 for t, n in tiers.items() if t is not None)
    first = store.manifest(1)
    assert len(first["shards"]) >= 1 and store.version() > 7
    store.vacuum()
    assert plain(store.read()) == plain(docs)
    with pytest.raises(ConflictError):
        store._commit(first, 1, [])
    with pytest.raises(ValueError):
        store.append(docs.withColumn("source", F.lit(1)))


def test_arrivals_of_other_columns_keep_them(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 20, small_bytes=1 << 14, fan_in=2)
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, 0.5)], "doc_id long, score double"))
    store.compact()
    store.vacuum()
    assert len(store.manifest()["shards"]) == 1 and sorted(map(tuple, store.read().collect())) == [(1, "a", None), (2, None, 0.5)]


def test_sharding_query_compacts(spark, docs, tmp_path, monkeypatch):
    """Through the query, on a table of one file: every row once, in shards of one version, fewer than arrivals came."""
    (tmp_path / "sf").mkdir()
    docs.coalesce(1).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    rows = queries.op9_sharding(spark, str(tmp_path / "sf")).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((r[0] for r in ROWS), key=repr)
    assert len({r.arrival for r in rows}) == queries.ARRIVALS and len({r.shard for r in rows}) < 4 and {r.version for r in rows} == {queries.ARRIVALS + (queries.ARRIVALS - 1) // 3}
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op9_sharding(spark, str(tmp_path / "none")).count() == 0


def base_spans(t):
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(re.sub("[^0-9]", "", m)[::-1])) % 10 == 0),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(kinds) for m in re.finditer(p, t) if good(m.group()))


def test_patterns_equal_plain_regular_expressions():
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234567", "+1", ".", " ", "é", "12", "-", "a@b.c@d.ee", "1.2.3.4.5.6.7.8", "+", "()", "\n", "0", "%"]
    for _ in range(3000):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(12)))
        assert pii.base_spans(t) == base_spans(t), t
    for t in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" + "(" * 100_000, "1 " * 100_000 + "x", "a@" * 50_000):
        pii.base_spans(t)


def test_pii(spark):
    texts = [f"{prose(30)} write to anna.k@mail.example.org {w} Zebulon {prose(30)}" for w in VOCABULARY[:6]] + [f"{prose(40)} call +49 (30) 1234567 now", "visit 10.0.0.1 or 4111 1111 1111 1111", None, "", "clean text", prose(2000), "visit 10.0.0.1 or 4111 1111 1111 1111", 'api_token = "04dbebab91ab85687d" and token: not-a-secret-word', *(f"only {w}" for w in VOCABULARY[:90])]
    df = spark.createDataFrame([(i, t, len(t or ""), "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, value string").withColumns({n: F.lit("clash") for n in ("digest", "extra", "term")})
    got = {r.doc_id: r for r in pii.Sanitiser(df).spans().collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x[1] == k for x in spans) for k in range(4))
        assert {x for x in joined.split(",") if x} <= set(got[i].spans.split(",")) and got[i].personal == bool(got[i].spans)
    assert got[13].spans == "secret:13:31" and got[13].n_secret == 1
    # the name stands only beside one address, in six texts: it reveals it
    assert all("removed" in got[i].spans for i in range(6)) and all(got[i].spans == "" for i in (8, 9, 10, 11))
    clean = {r.doc_id: r for r in pii.Sanitiser(df).clean().collect()}
    assert all("Zebulon" not in clean[i].text and "anna" not in clean[i].text and "[EMAIL]" in clean[i].text and clean[i].n_chars == len(clean[i].text) for i in range(6))
    assert clean[7].text == "visit [IP] or [CARD]" and clean[10].text == "clean text" and clean[8].text is None and clean[11].text == texts[11] and clean[13].text == 'api_token = "[SECRET]" and token: not-a-secret-word'
    empty = df.limit(0)
    assert pii.Sanitiser(empty).spans().count() == 0 and pii.Sanitiser(empty).clean().count() == 0


def test_lm_counts_every_n_gram(spark, monkeypatch):
    """Each order's counts against a plain PPM; a small NODES must not take n-grams away."""
    monkeypatch.setattr(lm, "NODES", 50)
    texts = [" ".join(f"{prose(3)} {i}" for _ in range(1 + i % 5)) for i in range(120)]
    grams = [collections.defaultdict(collections.Counter) for _ in range(lm.ORDER + 1)]
    framed = [[lm.END] * lm.ORDER + list(t.encode().lower()) + [lm.END] for t in texts]
    for i, x in enumerate(framed):
        for p in range(lm.ORDER, len(x)) if i % 4 else ():
            for k in range(lm.ORDER + 1):
                grams[k][tuple(x[p - k : p])][x[p]] += 1

    def cost(x, p):
        out, excluded = 0.0, set()
        for k in range(lm.ORDER, -1, -1):
            left = {s: n for s, n in grams[k].get(tuple(x[p - k : p]), {}).items() if s not in excluded}
            whole = sum(left.values())
            if x[p] in left:
                return out + math.log10((left[x[p]] - 0.5) / whole)
            out += math.log10(len(left) / 2 / whole) if left else 0.0
            excluded |= left.keys()
        return out - math.log10(256 - len(excluded))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score(df, F.col("doc_id") % 4 == 0).collect()}
    for i, x in enumerate(framed):
        assert abs(got[i] - sum(cost(x, p) for p in range(lm.ORDER, len(x)))) < 1e-6, i


def test_layouts_that_differ_before_the_article(spark):
    def page(mark, more):
        return f"<body><div class='{mark}'>Before.{more}</div><article><h1>Title {mark}</h1><p>Body of {mark}.</article></body>"

    rows = [(0, "http://a.example.com/0", page("banner", "")), (1, "http://a.example.com/1", page("intro", "<p>More words of it, so that this one is longer.")), (2, "http://a.example.com/2", page("topic", "<hr><p>x<p>y"))]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {m}\nBody of {m}." for i, m in enumerate(("banner", "intro", "topic"))}


def test_terms_far_from_a_value_reveal_it(spark):
    texts = [f"Zebulon {prose(40)} write to anna.k@mail.example.org {prose(30)} zebulon, {prose(12)}" for _ in range(8)] + [prose(60) for _ in range(40)] + ["nothing of Aldebaran here"]
    texts += [f"bob@mail.example.org {prose(25)} Aldebaran {prose(9)}" for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    clean = {r.doc_id: r.text for r in pii.Sanitiser(df).clean().collect()}
    assert not any("zebulon" in t.lower() for t in clean.values())
    # a text without the value discloses as much
    assert not any("aldebaran" in t.lower() for t in clean.values())
    assert all(clean[i] == texts[i] for i in range(8, 48))


def unmarked_page(i, notice=True):
    """A host's page without a telling element or class: menu, notice and imprint say the same on every page."""
    bar = "<div class=x1><ul><li><a href=/>Home</a><li><a href=/a>About us</a><li>Contact</ul></div>"
    body = "".join(f"<p>{prose(12)} {i} {k}.</p>" + ("<p>Read our <b>weekly</b> letter!</p>" if notice and k == 1 else "") for k in range(2 + i % 4))
    return bar + f"<div class=x2><h1>{prose(4)} {i}</h1>{body}</div><div class=x3><p>All rights reserved.</p></div>"


def content_of(page):
    return [t for t in re.findall(r">([^<>]+)<", re.sub("</?(?:a|b)[^>]*>", "", page)) if t not in ("Home", "About us", "Contact", "Read our weekly letter!", "All rights reserved.")]


@pytest.mark.parametrize("group", [256, 3])
def test_strings_that_a_host_repeats_are_template(spark, monkeypatch, group):
    """No element or class tells the menu from the article here: only the host's wrapper does."""
    monkeypatch.setattr(wrappers, "GROUP", group)
    pages = [unmarked_page(i, i % 5 > 0) for i in range(30)]
    copies = [unmarked_page(90)] * 40
    rows = [(i, "http://a.example.com/x", p) for i, p in enumerate(pages)] + [(100 + i, "http://b.example.com/", p) for i, p in enumerate(copies)] + [(200 + i, "http://c.example.com/", p) for i, p in enumerate(pages[:3])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit("clash") for n in ("host", "strings", "expression", "string", "n_chars")}).repartition(3)
    got = {r.page_id: r.text for r in wrappers.main_text(df).collect()}
    for i, p in enumerate(pages):
        assert got[i].split("\n") == content_of(p), i
        assert wrappers.extract(p, None) != got[i]
    # copies of one page, and hosts of few pages, tell nothing apart: all stays
    assert {got[100 + i] for i in range(40)} == {wrappers.extract(copies[0], None)}
    assert all(got[200 + i] == wrappers.extract(pages[i], None) for i in range(3))


def test_alignment_turns_mismatches_into_slots():
    known = frozenset(wrappers.string_hash(t) for t in ("Home", "News", "Part of"))
    streams = [wrappers.stream(p, known)[0] for p in ("<ul><li>Home<li>News</ul><p>one<p>Part of", "<ul><li>Home<li>Shop</ul><p>two<p>Part of", "<ul><li>Home<li>News</ul><h2>More</h2><p>three<p>four<p>Part of")]
    wrapper = wrappers.Wrapper(wrappers.infer([wrappers._folded(tuple(x)) for x in streams]))
    of = lambda t, e: f"={e}:{wrappers.string_hash(t)}"
    # one page says Shop where others say News
    assert wrapper.strings == {of("Home", "ul"), of("Part of", "")}
    assert wrappers.align(["p", of("A", "p"), "/p"], ["p", of("B", "p"), "/p"]) == ["p", "#p", "/p"]
    assert wrappers.align(["p", "#p"], ["h1", "#h1", "p", "#p"]) == [["?", ["h1", "#h1"]], "p", "#p"]


def test_terms_equal_brute_force(spark):
    """Which terms are generalised or removed, against the shares worked out text by text."""
    rare = [f"qz{w}" for w in VOCABULARY[:12]]
    texts = []
    for k, term in enumerate(rare):
        for j in range(7):  # the first terms stand with their address only, later ones more and more without
            texts.append(f"{prose(20)} {term if j < 7 - k // 4 else ''} {prose(9)} user{k}@mail{k % 3}.example.org {prose(15)}")
        texts += [f"{prose(12)} {term} {prose(12)}" for _ in range(k // 2)]
    texts += [prose(25) for _ in range(80)] + [texts[0]] * 2
    n, mentions, terms = len(texts), collections.defaultdict(set), collections.defaultdict(set)
    for i, t in enumerate(texts):
        spans = pii.protected_spans(t)
        for s, k, e in spans:
            for x in pii.entities(t[s:e], k):
                mentions[x].add(i)
        for m in WORD.finditer(t):
            terms[pii.term_of(m.group())].add(i)
    want = {}
    for held in mentions.values():
        for term, where in terms.items():
            both = held & where
            if len({texts[i] for i in both}) >= 3 and "@" not in term and len(held) < n and len(both) * math.log(n / len(held)) >= pii.EVIDENCE:
                share = math.log(n * len(both) / (len(held) * len(where))) / math.log(n / len(held))
                if share >= pii.GENERALISE:
                    want[term] = max(want.get(term, 0), pii.REMOVED if share >= pii.REMOVE else pii.TERM)
    assert pii.TERM in want.values() and pii.REMOVED in want.values() and len(want) < len(rare)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.term: r.kind for r in pii.Sanitiser(df).telling().collect()} == {pii._hash(t): k for t, k in want.items()}
