"""The training-data operators against brute force, on awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from treelens.llm import (
    components, decontaminate, lm, mixing, near_dedup, quality, sharding, suffix_dedup, token_counts,
    token_store, url_rules,
)
from treelens.llm.common import scratch
from treelens.llm.oracles import ORACLES
from treelens.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, slot int"


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(110), text(200).split()
    texts = [None, "", "  \n\t ", "one", "a b c d", text(3000), "x" * 3000, "the same line\n" * 60, "It's <|endoftext|> 12!"]
    texts += [text(40) + " " + passage + " " + text(30) for _ in range(5)]
    for i in range(8):  # near copies, each with other edits
        w = list(base)
        for k in rng.sample(range(200), 3):
            w[k] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [texts[9], texts[5], "one"]
    out = [(i, t, "en" if i % 3 else None, ["s1", "s2", None][i % 3], len(t or ""), "k", i) for i, t in enumerate(texts)]
    return [*out, (None, "a null id", "en", "s1", 9, None, None), out[9], out[4]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_repeats(rows):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[p : p + 400] for b in data for p in range(len(b) - 399))
    want = []
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
        want.append((i if i is not None else -1, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(want)


def removed(docs, **options):
    return sorted(
        (r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        for r in suffix_dedup.remove_repeats(docs, **options).collect()
    )


@pytest.mark.parametrize(("bucket", "hot"), [(2500, 4000), (10, 2)])
def test_suffix_dedup(spark, docs, empty, rows, bucket, hot):
    assert removed(docs, bucket_rows=bucket, hot_rows=hot) == brute_repeats([(r[0], r[1]) for r in rows])
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_short_periods(spark):
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = "the same line of a page, over and over again\n"
    texts = ["x" * 399, "x" * 400, "x" * 401, "x" * 3000, noise(300) + "x" * 900 + noise(300), noise(500) + "x" * 400 + "y"]
    texts += [line * 9, line * 10, line * 60, noise(100) + line * 30 + noise(200), (line * 12)[7:], noise(350) * 4, noise(353) * 3]
    texts += ["ab" * 300 + noise(50), noise(20) + "ab" * 199 + "ba" * 300, noise(900)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(docs) == brute_repeats(rows)
    data = np.frombuffer((texts[4] + line * 2000 + "z" * 90_000).encode(), np.uint8)
    anchors, spans = suffix_dedup._context_rows(data, np.array([0, len(data)]))
    assert sum(len(a[0]) for a in anchors) < 100 and sum(len(s[0]) for s in spans) == 3


def test_shared_passages(spark):
    from pyspark.sql import functions as F

    from treelens.llm import passages

    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4)))
    texts = [[word() for _ in range(rng.choice([10, 49, 50, 120, 300]))] for _ in range(60)]
    for k, n in enumerate([49, 50, 51, 60, 200] * 3):  # passages of n words in two texts
        passage = [word() for _ in range(n)]
        for i in (2 * k, 2 * k + 1):
            at = rng.randrange(len(texts[i]) + 1)
            texts[i][at:at] = passage
    texts += [["twice"] * 200, texts[40] + ["x"], texts[41] * 2]
    rows = [(i, " ".join(t).title() if i % 2 else "\n".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, "")]
    seen = collections.defaultdict(set)
    for i, t in rows:
        w = (t or "").lower().split()
        for j in range(len(w) - 49):
            seen[tuple(w[j : j + 50])].add(i)
    want = {i for ids in seen.values() if len(ids) > 1 for i in ids}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = passages.document_key(F.col("doc_id"), F.crc32(F.coalesce("text", F.lit(""))))
    got = docs.withColumn("d", key).join(passages.sharing(docs), "d", "left_semi")
    assert {r.doc_id for r in got.collect()} == want and 20 < len(want) < 40
    assert passages.sharing(docs.limit(0)).count() == 0


def test_multikey_quicksort():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    order = suffix_dedup.multikey_quicksort(strings)
    assert [strings[i].ljust(40, b"\0") for i in order] == sorted(s.ljust(40, b"\0") for s in strings)


def test_long_text_in_blocks(monkeypatch):
    data = np.frombuffer(random.Random(2).randbytes(30_000), np.uint8)
    whole = suffix_dedup._context_rows(data, np.array([0, len(data)]))[0]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4096)
    parts = suffix_dedup._context_rows(data, np.array([0, len(data)]))[0]
    join = lambda rs: {(int(p), int(g), int(a)) for _, ps, gs, xs in rs for p, g, a in zip(ps, gs, xs)}
    assert join(whole) == join(parts)


def test_token_output(spark, docs, empty, rows):
    from tokenizers import Tokenizer

    path = scratch(spark, "test-tokens")
    tok = tokenizer_path("word_bpe_49k.json")
    token_store.write_tokens(docs, path, tok, 2, file_bytes=4000)
    lib = Tokenizer.from_file(tok)
    want = collections.Counter()
    for r in rows:
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[(r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    got = token_store.digest(spark, path).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    none = scratch(spark, "test-tokens")
    token_store.write_tokens(empty, none, tok, 2)
    assert token_store.digest(spark, none).count() == 0


def test_words_met_first_stay_known(spark, sf_dir, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store.P, "CACHE_ENTRIES", 40)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:100]
    path = tokenizer_path("word_bpe_49k.json")
    enc, lib = token_store.Encoder(path), Tokenizer.from_file(path)
    for t in texts:
        assert np.frombuffer(enc(t), "<i4").tolist() == lib.encode(t, add_special_tokens=False).ids
        assert len(enc.known) <= 40 + len(set(t.lower().split()))


def test_encoders_equal_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["İstanbul ﬁ ½ é", "a\x1cb\x85c\xa0d", "'s ''re 12345 !!!", "straße œuvre ŉ", "x  \n\n  y", "<|endoftext|>a"]
    word, byte = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
    enc, cnt, a, b = token_store.Encoder(word), token_counts.PrefixCounter(byte), Tokenizer.from_file(word), Tokenizer.from_file(byte)
    rng = random.Random(4)
    for t in texts:
        assert np.frombuffer(enc(t), "<i4").tolist() == a.encode(t, add_special_tokens=False).ids
        assert cnt.count(t) == len(b.encode(t, add_special_tokens=False).ids)
        n = rng.randint(0, len(t))
        if "<|" not in t:
            assert cnt.at(t, n) == len(b.encode(t[:n], add_special_tokens=False).ids)


def test_token_counts(spark, docs, empty, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = collections.Counter(tuple(r) for r in token_counts.count_tokens(docs, path).collect())
    assert got == collections.Counter(
        (r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows
    )
    for budget in (0, 5, 40):
        for r in token_counts.truncation(token_counts.prefix_tables(docs, path), budget).collect():
            assert r.fit_tokens == r.counts[r.fit_chars] <= budget
            assert all(c > budget for c in r.counts[r.fit_chars + 1 :])
    assert token_counts.count_tokens(empty, path).count() == 0


def test_prefix_counts_equal_the_library(sf_dir):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib, counter = Tokenizer.from_file(path), token_counts.counter_of(path)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rng = random.Random(31)
    texts = ["", " ", "a   b  ", "x" * 300, "they're we've I'll it's 'ref !'re  'll", "a<|endoftext|> b  <|endoftext|>", "\n\n \t\r\n end", "naïve café — “q” … 12 345,6", "日本語 テキスト\u3000end \U0001f600!", "a\xa0\x85b\x1cc"]
    texts += ["".join(rng.choice(["a", " ", "  ", "\n", "'", "re", "ll", "9", "!", "the", "é", "<|"]) for _ in range(60)) for _ in range(40)]
    texts += [(t or "")[:250] for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()[:40]]
    for t in texts:
        want = [count(t[:n]) for n in range(len(t) + 1)]
        assert counter.table(t) == want, t
        for budget in (0, 3, rng.randint(0, 80)):
            assert counter.fits(t, budget) == max(n for n, c in enumerate(want) if c <= budget)


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x=://b", "http://example.org/en/12#t", "http://org/",
    "http://example.org/en/1", "http://notexample.org/es/", "http://x.com/de/a", "http://com/fr/", "http://x.com/de",
    "http://a.b.c.example.org/es/", "http://example.org?q", "http://x.org:80/es/", "http://net/a", "http://example.org/es/x",
]


@pytest.mark.parametrize("per_range", [20_000, 3])
def test_url_rules(spark, monkeypatch, per_range):
    monkeypatch.setattr(url_rules, "ROWS_PER_RANGE", per_range)
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:5])], "page_id long, url string, host string")
    got = {r.page_id: (r._host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(URLS + URLS[:5]):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0].lower()
            path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        fit = [r for r in rules[:5] if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        assert got[i] == (host, path, best and best[0] + best[1], best[2] if best else "allow"), u
    assert url_rules.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_lm_scoring(spark, docs, empty, rows):
    got = lm.score_texts(docs).collect()
    assert len(got) == len(rows)
    toks = [[w.lower() for w in (r[1] or "").encode().split()] + [b""] for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    c = collections.Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = collections.defaultdict(list)
    for r, t in zip(rows, toks):
        want[r[0]].append((len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)))
    for r in got:
        assert (r.n_tokens, r.n_known, round(r.base_score, 5)) in want[r.doc_id] and r.train_tokens == n
    assert lm.score_texts(empty).count() == 0


def test_tree_sums_to_one(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["a a b", "b c a", "c c c", "a b a"]) for _ in range(60))) for i in range(40)]
    tiny = dict(p_word=0.0, p_context=0.001, p_entry=0.0, kl=0.001)
    train = spark.createDataFrame(docs, "doc_id long, text string")
    # every next word after each context: the model's probabilities must sum to at most one
    for context in ("a", "b c", "c c"):
        probes = [(10**6 + i, f"{context} {w}".strip()) for i, w in enumerate(["a", "b", "c"])]
        probes = [(next(k for k in range(p, p + 999_000, 997) if zlib.crc32(str(k).encode()) % 7 == 2), t) for p, t in probes]
        both = train.union(spark.createDataFrame([*probes, (next(k for k in range(5 * 10**6, 6 * 10**6) if zlib.crc32(str(k).encode()) % 7 == 2), context)], "doc_id long, text string"))
        score = {r.doc_id: r.score for r in lm.score_texts(both, **tiny).collect()}
        assert all(score[p] < 0 for p, _ in probes)


def test_myers_and_leaks(spark, docs, empty):
    def distance(p, s):
        prev = [0] * (len(s) + 1)
        for i, a in enumerate(p, 1):
            cur = [i]
            for j, b in enumerate(s, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
            prev = cur
        return min(prev)

    rng = random.Random(6)
    for _ in range(150):
        p = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 70)))
        s = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90)))
        assert decontaminate.least_distance(decontaminate.masks(p), len(p), s) == distance(p, s)
    item = "what is the capital of the country that borders both seas and the desert in the north"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "another question altogether, much unlike the first")], "item_id long, text string")
    found = spark.createDataFrame([(1, f"A b. {item.upper()}! more"), (2, item.replace("both", "bath").replace("north", "nor")), (3, item[:40]), (4, None), (1, item)], "doc_id long, text string")
    for block in (8_000_000, 60):
        got = sorted(tuple(r) for r in decontaminate.leaks(found, items, block_chars=block).collect())
        assert got == [(1, 1, 0), (1, 1, 0), (2, 1, 3)]
    assert decontaminate.leaks(empty, items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert sorted(r.doc_id for r in decontaminate.keep_clean(found, items).collect()) == [3, 4]


def test_leaks_by_brute_force(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 5)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 12, 30])))) for i in range(25)]
    texts = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            own = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice("abcd ")
            at = rng.randrange(len(words) + 1)
            words[at:at] = ["".join(own)]
        texts.append((i, rng.choice([" ", "\n", ", "]).join(words).upper()))
    want = set()
    for d, text in texts:
        clean = decontaminate.normalise(text)
        for i, item in items:
            budget = int(decontaminate.RATE * len(item))
            best = decontaminate.least_distance(decontaminate.masks(item), len(item), clean)
            if best <= budget if budget else f" {item} " in f" {clean} ":
                want.add((d, i, best))
    got = decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want and {x[2] for x in want} >= {0, 1}
    cat = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "concatenate"), (2, "the cat."), (3, "cat")], "doc_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.leaks(rows, cat).collect()) == [2, 3]


def brute_components(texts, percent=85):
    sets = {}
    for i, t in texts:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_dedup(spark, docs, empty, rows):
    want = brute_components([(r[0], r[1]) for r in rows if r[0] is not None])
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_finds_links_between_non_hubs(spark):
    rng = random.Random(11)
    rows = []
    for g in range(6):
        base = [f"w{g}_{rng.randrange(10**6)}" for _ in range(120)]
        for i in range(14):
            w = list(base)
            for k in rng.sample(range(120), rng.randint(0, 7)):
                w[k] = f"e{rng.randrange(40)}"
            rows.append((len(rows), " ".join(w)))
    want = brute_components(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}


def test_near_dedup_of_families_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NESTED_HUBS", 16)
    rng, rows = random.Random(20240611), []
    for family in range(2):
        base = [f"f{family}w{i}" for i in range(120)]
        variants = [(rng.randrange(111), f"v{rng.randrange(4)}") for _ in range(8)]
        for _ in range(30):
            text = list(base)
            for place, word in rng.sample(variants, rng.randint(0, 5)):
                text[place] = word
            rows.append((len(rows), " ".join(text[: 120 - rng.choice([0, 0, 0, 3, 9])])))
    want = brute_components(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}


def test_near_dedup_settles_a_bucket_in_two_rounds(spark, monkeypatch):
    """What the driver has to remember does not grow with the number of hubs that a family needs."""
    cuts, cut = [], near_dedup.cut
    monkeypatch.setattr(near_dedup, "cut", lambda df: cuts.append(1) or cut(df))
    rng, rows = random.Random(5), []
    base = [f"w{i}" for i in range(120)]
    for _ in range(80):
        text = list(base)
        for place in rng.sample(range(10, 110), rng.randint(2, 5)):
            text[place] = f"v{rng.randrange(3)}"
        rows.append((len(rows), " ".join(text)))
    want = brute_components(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}
    assert len(cuts) <= 3 + 2 * 5


@pytest.mark.parametrize("per_partition", [100_000, 20])
def test_components(spark, monkeypatch, per_partition):
    monkeypatch.setattr(components, "EDGES_PER_PARTITION", per_partition)
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 120)] + [(200, 201), (201, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 120)}, 200: 200, 201: 200}


def test_mixing(spark, docs, empty, rows):
    out, m = mixing.plan(docs, rows_per_bin=2)
    got = out.collect()
    assert len(got) == len(rows)
    total = sum(len(words_of(r[1])) for r in rows)
    per = collections.defaultdict(int)
    for r in got:
        assert 0 <= r[m["taken"]] <= 2 * r[m["size"]]
        per[r.source] += r[m["taken"]]
    goal = {r.source: r[m["target"]] for r in got}
    assert math.isclose(sum(goal.values()), 1.5 * total)
    big = max(len(words_of(r[1])) for r in rows)
    assert all(abs(per[s] - goal[s]) <= big for s in goal)
    mixed = mixing.mixed(docs).collect()
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)
    assert mixing.plan(empty)[0].count() == 0


def test_quality_base(spark, docs, empty, rows):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out, m = quality.with_measures(docs, "text")
    got = collections.Counter(tuple(r[m[k]] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in out.collect())
    want = collections.Counter()
    for r in rows:
        t, w = r[1] or "", words_of(r[1])
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        rep = len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)})
        lines = [x for x in t.split("\n") if words_of(x)]
        want[(len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w))] += 1
    assert got == want
    assert quality.judge(docs, labels).count() == len(rows)
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns
    assert quality.judge(empty, labels).count() == 0


def test_certified_cutoffs_are_exact(spark):
    rows = [("a", True, 0.0)] * 995 + [("a", True, 5.0)] * 2 + [("a", True, 9.0)] * 3 + [("b", True, 0.0)] * 10
    scored = spark.createDataFrame(rows, "stratum string, good boolean, score double")
    got = {r.stratum: r.score for r in quality.certify(scored, "stratum", "good", 0.02, 0.05, {"score": [1.0, 6.0, 10.0]}).collect()}

    def tail(n, k, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    ok = [x for x, k in ((1.0, 5), (6.0, 3), (10.0, 0)) if tail(1000, k, 0.02) <= 0.05 / (2 * 3)]
    assert got == {"a": min(ok), "b": None}


def test_labels_count_once_and_rules_share_alpha(spark):
    good = "plain words of a quiet text without any marks go on and on here"
    bad = " ".join([good, *(f"#{i}" for i in range(12))])
    # one good label on a document with very many copies is one trial: nothing is certified
    copies = spark.createDataFrame([(1, good, "en")] * 3000 + [(2, bad, "en")], "doc_id long, text string, lang string")
    assert quality.judge(copies, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).filter("kept").count() == 3001
    # 3,000 labelled good documents certify; then the marked one goes, good ones stay
    many = [(i, f"{good} number{i}", "en") for i in range(3000)] + [(9999, bad, "en"), (9998, bad, None)]
    docs = spark.createDataFrame([(*r, "x") for r in many], ["doc_id", "text", "lang", "a.b"])
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(9999, 0)], "doc_id long, quality int")
    assert [r.doc_id for r in quality.judge(docs, labels).filter("NOT kept").collect()] == [9999]
    assert quality.keep_good(docs, labels).columns == docs.columns and quality.keep_good(docs, labels).count() == 3001
    # the bound of one rule is a part of alpha
    scored = spark.createDataFrame([("a", True, 0.0, 0.0)] * 300, "stratum string, good boolean, x double, y double")
    one = quality.certify(scored, "stratum", "good", 0.02, 0.05, {"x": [1.0]}).first()
    two = quality.certify(scored, "stratum", "good", 0.02, 0.05, {"x": [1.0], "y": [1.0]}).first()
    assert one.x == 1.0 and two.x is None and two.y is None


def test_false_rejections_stay_below_alpha(spark):
    """Cutoffs from random holdouts reject more than alpha of the good documents in few of them."""
    rng = random.Random(5)
    scores = lambda: (rng.gauss(0, 1), rng.gauss(0, 1))
    rows = [(f"s{i}", True, *scores()) for i in range(60) for _ in range(600)]
    scored = spark.createDataFrame(rows, "stratum string, good boolean, x double, y double")
    grid = {"x": [1.5, 2.0, 2.5, 3.0], "y": [1.5, 2.0, 2.5, 3.0]}
    got = quality.certify(scored, "stratum", "good", 0.1, 0.05, grid).collect()
    above = lambda z: 0.0 if z is None else math.erfc(z / math.sqrt(2)) / 2
    wrong = sum(1 - (1 - above(r.x)) * (1 - above(r.y)) > 0.1 for r in got)
    assert wrong == 0 and sum(r.x is not None for r in got) > 30


def test_sharding(spark, docs, empty, rows):
    back = sharding.write_shards(docs, scratch(spark, "test-shards"), 4, bucket_bytes=2000).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((r[0], r[1]) for r in rows)
    slots = collections.defaultdict(list)
    for r in back:
        slots[r.shard].append(r._slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.write_shards(docs.repartition(5), scratch(spark, "test-shards"), 4, bucket_bytes=2000).collect()
    assert sorted(map(str, back)) == sorted(map(str, again))
    from pyspark.sql import functions as F

    ids = spark.range(2000).select(sharding.shard_of(F.col("id"), 24, 17).alias("a"), sharding.shard_of(F.col("id"), 25, 17).alias("b")).collect()
    assert all(r.a == r.b or r.b == 24 for r in ids) and len({r.a for r in ids}) == 24
    assert sharding.write_shards(empty, scratch(spark, "test-shards"), 4).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    res = duck.execute(ORACLES[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held, was = docs, None
    for name, stage in pipe.STAGES[:4]:
        path = scratch(spark, "test-stage")
        stage(spark, held, sf_dir).write.parquet(path)
        held = spark.read.parquet(path)
        assert held.columns == docs.columns
        now = collections.Counter((r.doc_id, r.text) for r in held.collect())
        if name == "quality_rules":
            good = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept")
            assert sorted(i for i, _ in now) == sorted(r.doc_id for r in good.collect())
        if name == "minhash_near_dedup":  # exactly the least of each component stays
            least = brute_components(was, 80)
            assert set(now) == {(i, t) for i, t in was if least[i][1] == i}
        if name == "decontamination":
            items = [(r.item_id, decontaminate.normalise(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            found = lambda t: any(f" {x} " in f" {decontaminate.normalise(t)} " for _, x in items if x)
            leaked = {r.doc_id for r in decontaminate.leaks(spark.createDataFrame([*was], "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert set(now) == {(i, t) for i, t in was if i not in leaked} and all(i in leaked for i, t in was if found(t))
        if name == "source_mixing":
            assert set(now) <= set(was) and max(now.values()) <= 2 and sum(now.values()) > len(was)
        was = now
    out = pipe.run(spark, sf_dir)
    assert collections.Counter(r.doc_id for r in out.select("doc_id").collect()) == collections.Counter(i for i, _ in now.elements())


def test_pipeline_of_odd_tables(spark, sf_dir):
    import corpus_pipeline as pipe

    text = "a plain text of more than ten words that nothing else is like, number "
    names = ["doc_id", "text", "lang", "source", "size", "a.b", "gone_id", "position"]
    rows = [(i, text + str(i) * 3 + " " + "xyz"[i % 3] * i, "en", "s", 1, "v", 2, 3.0) for i in range(12)]
    rows += [(None, None, None, None, None, None, None, None), (20, "", "en", None, 1, "v", 2, 3.0), (21, text * 9, None, None, 1, None, 2, 3.0), rows[0]]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, `a.b` string, gone_id long, position double"), None):
        docs = held.limit(0) if docs is None else docs
        held = docs
        for name, stage in pipe.STAGES:
            path = scratch(spark, "test-odd")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "token_output":
                assert docs.columns == names
    assert docs.count() == 0


def test_token_files_can_be_read_in_parts(spark, sf_dir):
    """Encodings, row groups and page indexes of the files; metadata is read without the ids."""
    import glob

    import pyarrow.parquet as pq

    path = scratch(spark, "test-layout")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    token_store.write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"), 2, file_bytes=200_000)
    files = sorted(glob.glob(f"{path.removeprefix('file:')}/*.parquet"))
    assert len(files) > 1
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            of = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(c for name, c in of.items() if name.startswith("ids"))
            assert "RLE_DICTIONARY" in ids.encodings and ids.compression == "ZSTD"
            assert "DELTA_BINARY_PACKED" in of["doc_id"].encodings and "DELTA_BINARY_PACKED" in of["start_in_file"].encodings
            assert of["doc_id"].has_offset_index and of["doc_id"].has_column_index
    plan = token_store.read_tokens(spark, path).filter("doc_id = 7").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    schema = plan[plan.rindex("ReadSchema:") :]
    assert "ids" not in schema.split("\n")[0] and "EqualTo(doc_id,7)" in plan


def test_pipeline_drops_near_copies_of_four_fifths(spark, sf_dir):
    import corpus_pipeline as pipe

    base = [f"w{i}" for i in range(104)]  # 100 shingles
    at = lambda *places: " ".join("new" + w if i in places else w for i, w in enumerate(base))
    # 90 shared of 110 (0.818), 85 of 115 (0.739); 5 shingles go with a word inside
    texts = [" ".join(base), at(20, 60), " ".join("x" + w for w in base), " ".join(("y" if i in (20, 50, 80) else "") + "x" + w for i, w in enumerate(base))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in pipe.minhash_near_dedup(spark, docs, sf_dir).collect()) == [0, 2, 3]
    assert (1 - 0.8**5) ** pipe.NEAR_BANDS < 3e-7


def brute_scores(texts, kl=0.02, kappa=10.0, depth=3):
    """Scores by the definition in lm's docstring; texts are (held out, text)."""
    toks = [[*(t or "").lower().split(), ""] for _, t in texts]
    train = [t for (h, _), t in zip(texts, toks) if not h]
    count = [collections.Counter(tuple(t[i : i + k]) for t in train for i in range(len(t) - k + 1)) for k in range(1, depth + 2)]
    n, v = sum(count[0].values()), len(count[0])
    after = collections.defaultdict(dict)
    for k in range(1, depth + 1):
        for g, c in count[k].items():
            if c >= 2:
                after[g[:-1]][g[-1]] = c
    total = lambda s: count[len(s) - 1][s]

    def p(w, s, states):
        if not s:
            return (count[0][(w,)] + 1) / (n + v + 1)
        assert s in states
        stored = after[s]
        return (stored.get(w, 0) + (total(s) - sum(stored.values()) + kappa) * p(w, s[1:], states)) / (total(s) + kappa)

    candidates = set(after)

    def diverges(s):
        q = {w: p(w, s[1:], candidates) for w in after[s]}
        share = {w: c / total(s) for w, c in after[s].items()}
        gain, rest = sum(x * math.log(x / q[w]) for w, x in share.items()), 1 - sum(share.values())
        return gain + (rest * math.log(rest / max(1 - sum(q.values()), 1e-12)) if rest > 1e-9 else 0) >= kl

    states = {s for s in after if diverges(s)}
    for k in range(depth, 1, -1):
        states |= {s[1:] for s in states if len(s) == k}

    def longest(t, i):
        return next((s for k in range(depth, 0, -1) if i >= k and (s := tuple(t[i - k : i])) in states), ())

    return [sum(math.log10(p(w, longest(t, i), states)) for i, w in enumerate(t)) for t in toks]


@pytest.mark.parametrize("options", [dict(depth=3), dict(p_word=0.05, p_entry=0.05, depth=2), dict(p_word=2.0, p_entry=2.0, depth=1)])
def test_lm_scores_by_definition(spark, options):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(25)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([3, 25])]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(60)]
    want = brute_scores(list(zip(held, texts)), depth=options["depth"])
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).collect()}
    assert all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in range(60))


def test_lm_keeps_phrases_that_are_rare_in_a_large_corpus(spark):
    rng = random.Random(4)
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    probe = next(i for i in range(400, 500) if zlib.crc32(str(i).encode()) % 7 == 2)
    phrase = "quaint ochre lanterns drift past"
    rows = [(i, " ".join(f"n{rng.randrange(3000)}" for _ in range(250)) + (f" {phrase}" if k < 3 else "")) for k, i in enumerate(train)]
    df = spark.createDataFrame([*rows, (probe, phrase)], "doc_id long, text string")
    r = next(r for r in lm.score_texts(df).collect() if r.doc_id == probe)
    assert r.score > r.base_score + 4


def test_pipeline_keeps_the_training_order(spark, sf_dir):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    path = scratch(spark, "test-order")
    pipe.source_mixing(spark, docs, sf_dir).write.parquet(path)
    out = pipe.token_output(spark, spark.read.parquet(path), sf_dir).orderBy("start").collect()
    want = [r.doc_id for r in mixing.mixed(docs).orderBy("position", "doc_id").collect()]
    assert [r.doc_id for r in out] == want != sorted(want)


def test_lm_merges_in_little_memory_and_sends_small_batches():
    import tracemalloc

    import pyarrow as pa

    rng, n = np.random.default_rng(3), 400_000
    parts = [(rng.integers(0, n, n).astype(np.uint64), np.arange(n), np.arange(n), np.ones(n, np.int64)) for _ in range(2)]
    size = sum(c.nbytes for part in parts for c in part)
    tracemalloc.start()
    keys, *_, total = lm._merged(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.diff(keys.astype(np.int64)) > 0).all() and total.sum() == 2 * n
    assert peak < 2.25 * size
    text = pa.array([" ".join(f"w{i}" for i in range(200_000))])
    sent = list(lm._count_words(iter([pa.RecordBatch.from_arrays([text], ["text"])])))
    assert sum(b.num_rows for b in sent) == 200_001 and max(b.num_rows for b in sent) <= 1 << 16


def test_pipeline_settles_families_in_two_rounds(spark, sf_dir, monkeypatch):
    import corpus_pipeline

    cuts, cut = [], near_dedup.cut
    monkeypatch.setattr(near_dedup, "cut", lambda df: cuts.append(1) or cut(df))
    rng, rows = random.Random(6), []
    for _ in range(80):
        text = [f"w{i}" for i in range(120)]
        for place in rng.sample(range(10, 110), rng.randint(3, 6)):
            text[place] = f"v{rng.randrange(3)}"
        rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, docs, sf_dir).collect()}
    assert 0 in kept and len(cuts) <= 3 + 2 * 5


def test_bitmaps_come_packed(spark, monkeypatch):
    from pyspark.sql import functions as F

    from treelens.llm import bitmaps

    keys = spark.range(0, 200_000, 1, 4).select(F.xxhash64("id").alias("key"))
    frame, sent = type(keys), []
    to_arrow = frame.toArrow

    def spied(self):
        out = to_arrow(self)
        sent.append(out.nbytes)
        return out

    monkeypatch.setattr(frame, "toArrow", spied)
    got = bitmaps.bitmap(keys)
    places = np.array([r.key for r in keys.collect()], np.int64).view(np.uint64) >> np.uint64(64 - bitmaps.BITS)
    want = np.zeros(1 << (bitmaps.BITS - 6), np.uint64)
    np.bitwise_or.at(want, places >> np.uint64(6), np.uint64(1) << (places & np.uint64(63)))
    assert (got.words == want).all()
    assert sum(sent) < 8 * int((want > 0).sum())  # a word's row has 16 bytes
    assert not bitmaps.bitmap(keys.limit(0)).words.any()


def test_batches_equal_the_library(sf_dir):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    enc, lib = token_store.Encoder(path), Tokenizer.from_file(path)
    letters = "".join(c for c in map(chr, range(0x10FFFF)) if not 0xD800 <= ord(c) < 0xE000 and token_store.P.common(c, ()))
    texts = ["İstanbul ﬁ", None, "", "  ", " a  b\n", "\u3000", "straße \xa0 x", "'s ''re 12345 !!!", "x<|endoftext|>a", " ".join(letters), letters.upper(), "\x0b", "l'été's 3é4"]
    texts += pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()[:300]
    for some in (texts, texts[::-1], texts[1:4], ["\u3000"], []):
        ids, sizes = enc.encode_all(pa.array(some, pa.string()), 2)
        want = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for t in some]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == list(itertools.chain(*want))
    learnt = []
    plain, enc.plain = enc.plain, type("Spy", (), {"encode_batch_fast": lambda _, x, **k: learnt.extend(x) or plain.encode_batch_fast(x, **k)})()
    enc.encode_all(pa.array(["zyxwvq, (zyxwvq) zyxwvq! \u201czyxwvq\u201d"]), 2)
    assert " ".join(learnt).count("zyxwvq") == 1  # a word is encoded once, whatever stands around it


def test_runs_are_counted_by_slices(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120)
    level, tables = lm._level, []

    def spied(runs, *rest):
        tables.append(runs.count())
        return level(runs, *rest)

    monkeypatch.setattr(lm, "_level", spied)
    scores, shares = [], []
    for slices in (1, 4):
        monkeypatch.setattr(lm, "SLICES", slices)
        scores.append({r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_texts(docs).collect()})
        shares.append(tables[:])
        tables.clear()
    assert scores[0] == scores[1] and len(shares[1]) == 4 * len(shares[0])
    for k, whole in enumerate(shares[0]):  # a slice's runs alone are on disk
        part = shares[1][4 * k : 4 * k + 4]
        assert sum(part) == whole and max(part) < 0.6 * whole


def test_lm_sends_rows_packed_and_sums_those_of_a_key():
    import pyarrow as pa

    from treelens.llm.coded import pack, unpack

    rng, n = np.random.default_rng(5), 50_000
    keys = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
    others, counts = rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(1, 9, n).astype(np.uint64)
    blob = pack(keys, others, counts)
    assert all((a == b).all() for a, b in zip(unpack(blob, 3), (keys, others, counts)))
    assert len(blob) < 17 * n  # in rows of longs 24
    # a word's own weight and its weight as a context come in two rows; 12 is not known
    weight = lambda key, n, value: pack(np.array([key], np.uint64), np.array([n]), np.array([value]))
    asked = pack(np.array([7, 7, 9, 12], np.uint64), np.array([0, 3, 3, 1], np.uint64))
    rows = lm._blobs([0] * 4, [lm.WEIGHT] * 3 + [lm.ASK], [None] * 3 + [5], [weight(7, 4, 0.5), weight(7, 0, -0.25), weight(9, 0, 2.0), asked])
    got = pa.Table.from_batches(lm._answer(iter([rows]))).to_pylist()
    assert [r["batch"] for r in got] == [5] and np.frombuffer(got[0]["texts"], np.uint32).tolist() == [0, 3]
    assert np.frombuffer(got[0]["known"], np.uint32).tolist() == [1, 1]
    assert np.allclose(np.frombuffer(got[0]["base"]), math.log10(5)) and np.frombuffer(got[0]["score"]).tolist() == [0.25, 2.25]


def test_known_words_are_not_encoded_again():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    enc, lib = token_store.Encoder(path), Tokenizer.from_file(path)
    learnt = []
    plain, enc.plain = enc.plain, type("Spy", (), {"encode_batch_fast": lambda _, x, **k: learnt.extend(x) or plain.encode_batch_fast(x, **k)})()
    texts = ["zyxwvq it's 42", "(zyxwvq), zyxwvq's\t42% ''re-zyxwvq!", "", "zyxwvq 42zyxwvq", None]
    for t in texts:
        ids, sizes = enc.encode_all(pa.array([t, t], pa.string()), 2)
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert ids.tolist() == 2 * want and sizes.tolist() == 2 * [len(want)]
    assert " ".join(learnt).split().count("zyxwvq") == 1


def test_words_are_told_apart_by_eight_bytes_at_once():
    import pyarrow as pa

    from treelens.llm import shingles as S

    rng = random.Random(1)
    some = ["a", "B", "b", "Z", " ", "\n", "\t", "é", "漢", "\x0b", "\0", "x" * 9, "Y" * 17, "q" * 130, "Q" * 128, "abcdefgh", "  "]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ["", None, "a" * 100, "A" * 100, "a", "a\0", "a\0\0", " ", "w"]
    keys = {}
    for i in range(0, len(texts), 37):
        for _, data, offsets in S.pieces(pa.array(texts[i : i + 37], pa.string())):
            (old, sizes), (new, counts) = S.word_hashes(data, offsets), S.word_keys(data, offsets)
            assert counts.tolist() == sizes.tolist() and len(new) == len(old)
            assert all(keys.setdefault(a, b) == b for a, b in zip(old.tolist(), new.tolist()))
    assert len(set(keys.values())) == len(keys) > 500


def test_lm_looks_up_keys_by_their_first_bits():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 40_000):
        keys = np.unique(np.concatenate([rng.integers(0, 2**64, n, dtype=np.uint64), np.arange(n // 2, dtype=np.uint64), ~np.arange(n // 9, dtype=np.uint64)]))
        wanted = np.concatenate([rng.permutation(keys), rng.integers(0, 2**64, 9000, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at, hit = lm.Index(keys).found(wanted)
        assert (hit == np.isin(wanted, keys)).all() and (keys[at[hit]] == wanted[hit]).all()


def test_lm_packs_its_weights_once(spark, sf_dir, monkeypatch):
    from treelens.llm import bitmaps

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120)
    asked, seen, level, levels = lm._asked, [], lm._level, []
    monkeypatch.setattr(lm, "_level", lambda *x: levels.append(1) or level(*x))

    def spied(texts, weights, *rest):
        rows = [r for table in weights for r in table.filter(f"kind IN ({lm.WEIGHT}, {lm.HOT})").collect()]
        seen.append([(r.kind, len(lm.unpack(r.blob, 3)[0])) for r in rows])
        return asked(texts, weights, *rest)

    monkeypatch.setattr(lm, "_asked", spied)
    lm.score_texts(docs, p_word=1e-3, p_entry=1e-3)
    assert len(levels) == 3  # the texts are read once for pairs, twice for longer runs
    packed = seen[0]
    assert {k for k, _ in packed} == {lm.WEIGHT, lm.HOT} and sum(n for _, n in packed) > 20 * len(packed)
    keys = spark.range(0, 200_000, 1, 4).selectExpr("xxhash64(id) AS key")
    assert (bitmaps.bits_of(keys).words == bitmaps.bitmap(keys).words).all()
    assert not bitmaps.bits_of(keys.limit(0)).words.any()
