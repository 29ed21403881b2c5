"""Each operator against a plain brute-force version, with hostile rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skald.llm import batches as B
from skald.llm import op1_rule_ensemble as op1
from skald.llm import op2_hash_tree as op2
from skald.llm import op3_tag_path_ratios as op3
from skald.llm import op4_partenum_join as op4
from skald.llm import op5_suffix_repetition as op5
from skald.llm import op6_toxicity_cnn as op6
from skald.llm import op7_bpe as op7
from skald.llm import op8_cross_entropy as op8
from skald.llm import op9_spaced_seeds as op9
from skald.llm import op10_cross_parsing as op10
from skald.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def _words(text):
    return re.findall(WORD, text or "")


def _docs(spark, texts, ids=None):
    rows = [(i, t, "en", "node", 1) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, root string, n long")  # root: clashes with inner names


def _hostile():
    rng = random.Random(3)
    base = [" ".join(rng.choices("abcdefghij klmno pq rstu vw".split() + ["é#", "X"], k=60)) for _ in range(6)]
    near = [t.replace("pq", "zz", 1) for t in base] + base[:3]
    return [None, "", " \n", "one", "A b", "a B", "x " * 3000, "lang\nlang\nlang", *base, *near]


def _repeats(words, least):
    """Words inside a repeat of at least so many words, and the longest repeat, by comparing all pairs of places."""
    n, inside, longest = len(words), set(), 0
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= least:
                inside |= {*range(i, i + k), *range(j, j + k)}
    return len(inside), longest


def _verdict(n, covered, longest):
    return covered <= 0.35 * n and (longest <= 100 or longest <= 0.25 * n)


def test_op5_against_brute_force(spark):
    def brute(text):
        w = _words(text)
        n = len(w)
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if re.search(WORD, line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
        hit = {j for i in range(n - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n

    texts = _hostile()
    got = {r.doc_id: r for r in op5.quality_statistics(_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        if len(_words(t)) < 500:
            covered, longest = _repeats(_words(t), 5)
            assert (r.n_covered_words, r.longest_repeat, r.kept) == (covered, longest, not r.base_failed and _verdict(r.n_words, covered, longest))
    kept = {r.doc_id for r in op5.keep_unrepetitive(_docs(spark, texts)).collect()}
    assert kept == {i for i in got if got[i].kept}
    assert op5.quality_statistics(_docs(spark, texts).limit(0)).count() == 0


def _components(texts, k, percent):
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for t in texts:
        w = _words((t or "").translate(fold))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), top(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_op4_against_brute_force(spark, k, percent):
    texts = _hostile()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op4.link_sets(_docs(spark, texts), op4.JaccardJoin(k, percent)).collect()}
    assert [got[i] for i in range(len(texts))] == _components(texts, k, percent)
    kept = sorted(r.doc_id for r in op4.keep_one_of_each(_docs(spark, texts), op4.JaccardJoin(k, percent)).collect())
    assert kept == [i for i in range(len(texts)) if got[i][1] == i]


def test_op4_signatures_lose_no_pair():
    rng = np.random.default_rng(1)
    for percent in (90, 80, 50):
        join = op4.JaccardJoin(percent=percent)
        for _ in range(400):
            s = int(rng.integers(1, 300))
            x = np.unique(rng.integers(0, 2**63, s, dtype=np.uint64) * np.uint64(2))
            d = int(rng.integers(0, s // 3 + 2))
            y = np.unique(np.concatenate([x[: s - d], rng.integers(0, 2**63, d // 2, dtype=np.uint64) * np.uint64(2)]))
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= percent * (len(x) + len(y) - both):
                sigs, at = op4.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), join)
                assert len(np.intersect1d(sigs[: at[1]], sigs[at[1] :]))


def test_op4_groups_across_batches():
    rng = random.Random(2)
    for _ in range(300):
        crowd = rng.choice([2, 3, 100])
        rows = sorted((rng.randint(0, 5), rng.randint(0, 6)) for _ in range(rng.randint(0, 30)))
        cut = [0, *sorted(rng.randint(0, len(rows)) for _ in range(4)), len(rows)]
        parts = [rows[a:b] for a, b in zip(cut, cut[1:])]
        its = (pa.RecordBatch.from_arrays([pa.array([r[c] for r in p], pa.int64()) for c in (0, 1)], names=["sig", "node"]) for p in parts)
        got: dict = {}
        for batch in op4._grouped(its, crowd):
            for group, node, crowded in zip(*(c.to_pylist() for c in batch.columns)):
                got.setdefault((group, crowded), []).append(node)
        own = {s: sorted({n for t, n in rows if t == s}) for s, _ in rows}
        assert all(g in own for g, crowded in got if crowded)
        assert sorted(v for (_, c), v in got.items() if c) == sorted(v for v in own.values() if len(v) > crowd)
        assert sorted(v for (_, c), v in got.items() if not c) == [list(v) for v in sorted({tuple(v) for v in own.values() if 1 < len(v) <= crowd})]


def _near_and_passage(copies=150):
    """Near copies just over and under the threshold, and unlike texts that share a passage."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passage, base = [word() for _ in range(60)], [word() for _ in range(150)]
    texts = _hostile()
    for _ in range(copies):
        t = list(base)
        for i in rng.sample(range(150), rng.randint(1, 7)):
            t[i] = word()
        texts.append(" ".join(t))
        texts.append(" ".join([word() for _ in range(rng.randint(1, 150))] + passage + [word() for _ in range(rng.randint(1, 40))]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k,percent,crowd,levels", [(3, 90, 4096, 2), (3, 90, 20, 1), (5, 80, 8, 0), (5, 80, 4096, 2)])
def test_op4_crowded_groups(spark, k, percent, crowd, levels):
    texts = _near_and_passage(90)
    ids = [None if i % 11 == 3 else i for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op4.link_sets(docs, op4.JaccardJoin(k, percent, crowd=crowd, levels=levels)).where("doc_id is not null").collect()}
    want = _components(texts, k, percent)
    named: dict = {}
    for i, (_, root) in zip(ids, want):
        if i is not None:
            named[root] = min(named.get(root, i), i)
    assert got == {i: (n, named[root]) for i, (n, root) in zip(ids, want) if i is not None}


def test_op4_sketches_bound_the_difference():
    rng, join = np.random.default_rng(4), op4.JaccardJoin(percent=80)
    for _ in range(100):
        x = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        y = np.unique(np.concatenate([x[int(rng.integers(0, 60)) :], rng.integers(0, 2**63, int(rng.integers(0, 60)), dtype=np.uint64)]))
        a, b = (np.frombuffer(s, np.uint64) for s in op4.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), join))
        least = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(s.reshape(-1, least), 0) for s in (a, b))
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_op4_empty_table_and_repeated_ids(spark):
    assert op4.link_sets(_docs(spark, []).limit(0)).count() == op4.keep_one_of_each(_docs(spark, ["a"]).limit(0)).count() == 0
    same, other = "a b c d e f g h", "i j k l m n o p"
    docs = spark.createDataFrame([(1, same), (1, same), (2, same), (2, other), (None, same), (None, None), (3, None)], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in op4.keep_one_of_each(docs).collect())
    assert [i for i, _ in kept] == [0, 0, 1, 2, 3] and (1, same) in kept


def test_op7_equals_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "a", "é", "22", "?!", " ", "　", "\x85", "\x1c", "漢", "🎉", "the", "'s", "aaaa", "<|endoftext|>", "́", "٣"]
    texts = [None, "", "a" * 3000, *("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(300))]
    library = Tokenizer.from_file(tokenizer_path())
    bpe = op7.ByteBpe.read(tokenizer_path())
    got = {r.doc_id: r for r in op7.encode_and_check(_docs(spark, texts), bpe).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    again = op7.decode(op7.encode(_docs(spark, texts), bpe), bpe).select("doc_id", "text", "decodes").collect()
    assert {r.doc_id: r.text for r in again} == {i: t or "" for i, t in enumerate(texts)} and all(r.decodes for r in again)


def _draw(key, shard, weight=1.0):
    h = int(hashlib.md5(f"{key}/s{shard}".encode()).hexdigest()[:12], 16)
    return -np.log((h + 0.5) / 2.0**48) / weight


def _descend(key, n, weights=None):
    """Region, rack and shard by the smallest draw, written out: two racks a region, two shards a rack."""
    draws = [_draw(key, i, (weights or {}).get(i, 1.0)) for i in range(n)]
    regions = [range(a, min(a + 4, n)) for a in range(0, n, 4)]
    region = min(regions, key=lambda r: min(draws[i] for i in r))
    racks = [range(a, min(a + 2, region.stop)) for a in range(region.start, region.stop, 2)]
    return min(min(racks, key=lambda r: min(draws[i] for i in r)), key=lambda i: draws[i])


def test_op2_against_plain_descent(spark):
    texts = _hostile() * 20
    ids = [None if i % 17 == 5 else i // 2 if i % 5 == 0 else i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, shard int, size int")  # clashing names
    got = op2.shard_documents(docs).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    key = lambda i: "" if i is None else str(i)
    want = sorted((key(i), len((t or "").encode()) + 1, crc(t), _descend(key(i), 8), _descend(key(i), 9)) for i, t in zip(ids, texts))
    assert sorted((key(r.doc_id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    assert {r.law for r in got} == {"key"}
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert op2.shard_documents(docs.limit(0)).count() == 0


def test_op2_one_more_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"))
    for n in range(1, 21):
        moved = op2.placed(rows, "doc_id", n).where("shard <> grown_shard").collect()
        assert moved and {r.grown_shard for r in moved} == {n}, n


def test_op2_weights_move_rows_only_into_their_shard(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"))
    old = {r.doc_id: r.shard for r in op2.placed(rows, "doc_id", 8).collect()}
    new = {r.doc_id: r.shard for r in op2.placed(rows, "doc_id", 8, {5: 3.0, 2: 0.0}).collect()}
    assert all(new[i] == 5 or old[i] == 2 for i in old if old[i] != new[i]) and 2 not in new.values()
    assert abs(sum(s == 5 for s in new.values()) / 3000 - 3 / 9) < 0.04


def test_op3_pages():
    page = lambda b: f"<html><head><title>t</title></head><body>{b}</body></html>"
    assert op3.main_text(None) == op3.main_text("") == op3.main_text(page('<div class="ad">x</div>')) == ""
    assert op3.main_text(page("<nav><a>m</a></nav><article><h1>A &amp; b</h1><p><b>c\n d<br><p>e<script>x</script></article><footer>f</footer>")) == "A & b c d e"
    long = "Some words of the article, and then some more of them. " * 5
    assert op3.main_text(page(f'<main><p>{long}</p><section class="comments"><p>no</p></section><form><p>no</p></form></main><aside>no</aside>')) == long.strip()
    assert op3.main_text("plain") == "plain"
    assert op3.main_text("<main><p>aa.</p><svg/><p>bb.</p></main>") == op3.main_text("<main><p>aa.</p><object><p>bb.</p></main>") == "aa. bb."
    assert op3.main_text('<p title="the hidden truth">x y.</p><div id="share-prices"><p>Prices rose.</p></div><div hidden><p>no</p></div>') == "x y. Prices rose."
    assert op3.main_text("a < b <p>c") == "a < b c" and op3.main_text("<p>a<!-- never closed <p>b") == "a"


def test_op3_short_articles_and_linked_parts():
    page = lambda b: f"<html><body>{b}</body></html>"
    short, long = "A short note of one paragraph, no more than this.", "Some long notice of the site, with commas, and more. " * 8
    for tag in ("footer", "form", "aside", "nav", "dialog"):
        assert op3.main_text(page(f"<div><p>{short}</p></div><{tag}><p>{long}</p></{tag}>")) == short
        assert op3.main_text(page(f"<{tag}><p>{long}</p></{tag}><article><p>{short}</p></article>")) == short
        assert op3.main_text(page(f"<{tag}><p>{long}</p></{tag}>")) == long.strip()  # nothing else is there
    assert op3.main_text(page(f"<form><header>site</header><div><h1>T</h1><p>{long}</p></div><input></form>")) == f"T {long.strip()}"
    article = f'<article><h1><a href="x">Title</a></h1><p>{long}</p><h2><a href="y">Part</a></h2><p>{long}</p><ul><li><a href="z">First source</a></li><li><a href="w">Second source</a></li></ul></article>'
    menu = "<div><ul>" + "".join(f'<li><a href="{k}">Menu {k}</a></li>' for k in range(9)) + "</ul></div>"
    assert op3.main_text(page(menu + article + menu)) == f"Title {long.strip()} Part {long.strip()} First source Second source"
    talk = "".join(f'<div class="thread"><b>Ann</b><p>{short}</p></div>' for _ in range(12))
    assert op3.main_text(page(f'<div><p>{long}</p></div><div class="discussion">{talk}</div>')) == long.strip()


def test_op3_ratios_decide_and_names_of_articles_do_not(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    plain = [re.sub(r"(?i)<(/?)(article|main)\b", r"<\1div", h) for h in pages]
    texts = [op3.main_text(h) for h in pages]
    assert all(texts) and [op3.main_text(h) for h in plain] == texts
    monkeypatch.setattr(op3, "fused_ratios", lambda page, config: np.ones(len(page.blocks)))
    assert sum(op3.main_text(h) != t for h, t in zip(pages, texts)) > len(pages) // 3


def test_op3_ratios_against_plain_sums():
    page = "<ul><li><a>one, two</a><li>three. x</ul><div><h1>T</h1><p>A b, c. D</p><p>E f; g!</p><p>h</p></div><p>tail</p>"
    paths = ["ul/li", "ul/li", "div/h1", "div/p", "div/p", "div/p", "p"]
    texts = ["one, two", "three. x", "T", "A b, c. D", "E f; g!", "h", "tail"]
    marks = [1, 1, 0, 2, 2, 0, 0]
    config = op3.TagPathConfig(sigma=0.5)
    read = op3.read_page(page, config)
    assert [b.text for b in read.blocks] == texts
    own = lambda x, p: [v for v, q in zip(x, paths) if q == p]
    length = [sum(map(len, own(texts, p))) / len(own(texts, p)) for p in paths]
    points = [(sum(own(marks, p)) + 1) / len(own(marks, p)) for p in paths]
    free = [1 - 8 / 16 if p == "ul/li" else 1.0 for p in paths]
    kernel = {d: np.exp(-0.5 * (d / 0.5) ** 2) for d in (-2, -1, 0, 1, 2)}
    smooth = lambda x, i: sum(kernel[d] * x[i + d] for d in kernel if 0 <= i + d < len(x)) / sum(kernel.values())
    want = [smooth(length, i) * smooth(points, i) * free[i] for i in range(len(paths))]
    assert np.allclose(op3.fused_ratios(read, config), want)


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<div>" * 50_000 + "</p></li>" * 20_000, "<a " * 80_000, '<a b="' * 80_000 + ">", "<svg>" * 80_000, "<ul><li>x" * 20_000 + "</ul>" * 20_000, "<div><section>" * 20_000 + "</div>" * 20_000, "<div><p>t</p>" * 30_000])
def test_op3_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    op3.main_text(page)
    assert time.process_time() - began < 4


def test_op3_tables(spark):
    rows = [(1, "u", None, 5), (2, None, "", 5), (3, "u", "<p>a b.</p>", 5), (3, "u", "<p>a b.</p>", 5), (None, "u", "<p>" + "word " * 200_000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")  # text: clashes with the result
    got = sorted((r.page_id or 0, r.url, r.text if r.page_id else len(r.text), r.n_chars) for r in op3.extract_text(pages).collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 3] and got[0][2:] == (999_999, 999_999)
    assert [g[2:] for g in got[1:]] == [("", 0), ("", 0), ("a b.", 4), ("a b.", 4)]
    assert op3.extract_text(pages.limit(0)).count() == 0


def test_op9_finds_substituted_leaks_and_leaves_clean_texts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [" ".join(word() for _ in range(30)) for _ in range(5)]
    noisy = items[1].split()
    noisy[4] = noisy[17] = "zzz"
    clean = [" ".join(word() for _ in range(200)) for _ in range(5)]
    texts = [None, "", clean[0] + " " + items[0].upper() + ", " + clean[1], "x " + " ".join(noisy) + " y", *clean[2:]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op9.contaminated_pairs(_docs(spark, texts), bench).collect()}
    assert got == {(2, 0), (3, 1)}
    assert sorted(r.doc_id for r in op9.drop_contaminated(_docs(spark, texts), bench).collect()) == [0, 1, 4, 5, 6]


def test_op9_masks_hit_every_window_that_counts():
    from itertools import combinations

    seeds = op9.SpacedSeeds()
    allowed = seeds.window * (100 - seeds.least_percent) // 100
    for gone in combinations(range(seeds.window), allowed):
        hits = [o for m in seeds.masks for o in range(seeds.window - len(m) + 1) if all(m[i] == "0" or o + i not in gone for i in range(len(m)))]
        assert hits, gone


def _leaks(texts, items):
    """{(text, item): (words that agree in the best window, its length)}, by all windows."""
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            x, y = tokens(t), tokens(item)
            n = min(13, len(y))
            best = max((sum(a == b for a, b in zip(x[p : p + n], y[q : q + n])) for p in range(len(x) - n + 1) for q in range(len(y) - n + 1)), default=0) if n else 0
            if n and 100 * best >= 80 * n:
                out[i, k] = best, n
    return out


def test_op9_against_all_windows(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcd", k=2))
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 20, 30)] + ["", None, "!?"]

    def noisy(text):
        w = (text or "").split()
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = word()
        cut = rng.randint(0, max(0, len(w) - 12))
        return " ".join([word() for _ in range(rng.randint(0, 9))] + w[cut:] + [word() for _ in range(rng.randint(0, 9))])

    texts = [noisy(rng.choice(items)).upper() for _ in range(150)] + [None, "", items[14]]
    want = _leaks(texts, items)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = _docs(spark, texts).withColumn("_gone", F.lit(1)).withColumn("h", F.lit(2)).withColumn("doc", F.lit(3))
    got = {(r.doc_id, r.item_id): (r.n_agree, r.n_window) for r in op9.contaminated_pairs(docs, bench).collect()}
    assert got == want and len({k for _, k in want}) == 15
    kept = op9.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(texts))) - {i for i, _ in want})
    assert op9.drop_contaminated(docs, bench.limit(0)).count() == len(texts) and op9.contaminated_pairs(docs.limit(0), bench).count() == 0


def test_op8_against_plain_counts(spark):
    texts = ["a b a c", "a b", None, "", "c c c a", "b"]
    config = op8.LmConfig(vocabulary=2)
    got = {r.doc_id: r for r in op8.score_documents(_docs(spark, texts), spark.createDataFrame([(0,)], "doc_id long"), config).collect()}
    counts = Counter(w for t in texts for w in _words(t))
    h = lambda w: int(B.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]), B.FOLDED)[0])
    top = sorted(counts, key=lambda w: (-counts[w], np.uint64(h(w)).view(np.int64)))[:2]
    ids = {w: sorted(top, key=h).index(w) + 1 for w in top}
    seqs = [[ids.get(w, 0) for w in _words(t)] for t in texts]
    tables = []
    for own in (seqs[:1], seqs):
        c = np.zeros((3, 3))
        for s in own:
            for a, b in zip(s, s[1:]):
                c[a, b] += 1
        tables.append(op8.losses(c, config))
    for i, s in enumerate(seqs):
        n = max(len(s) - 1, 1)
        want = [sum(t[a, b] for a, b in zip(s, s[1:])) / n for t in tables]
        assert got[i].n_tokens == len(s) and np.allclose([got[i].target_loss, got[i].background_loss], want, atol=1e-5)


@pytest.mark.parametrize("config", [op8.LmConfig(), op8.LmConfig(hot=4), op8.LmConfig(hot=0)])
def test_op8_tells_all_words_apart(spark, config):
    rng = random.Random(8)
    texts = [*_hostile(), *(" ".join(f"w{int(rng.paretovariate(0.2)) % 5000}" for _ in range(n)) for n in (1, 2, 400, 3000, 3000, 3000))]
    ids = [None, None, *range(len(texts) - 2)]
    texts, ids = texts + texts[-2:] + ["a b"], ids + ids[-2:] + [None]  # rows that stand twice, another without id
    target = {0, 5, 7, ids[-2]}
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    got = op8.score_documents(docs, spark.createDataFrame([(i,) for i in target], "doc_id long"), config).collect()
    seqs = [_words((t or "").lower()) for t in texts]
    size = len({w for s in seqs for w in s}) + 1
    assert size > 1500
    tables = []
    for own in ([s for i, s in zip(ids, seqs) if i in target], seqs):
        pairs = [p for s in own for p in zip(s, s[1:])]
        tables.append((Counter(pairs), Counter(a for a, _ in pairs), Counter(b for _, b in pairs), len(pairs)))
    want = []
    for i, s in zip(ids, seqs):
        loss = [-sum(np.log((c[a, b] + 20 * (i_[b] + 1) / (n + size)) / (o[a] + 20)) for a, b in zip(s, s[1:])) / max(len(s) - 1, 1) for c, o, i_, n in tables]
        want.append((-1 if i is None else i, len(s), *loss, loss[0] - loss[1]))
    found = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got)
    assert np.allclose(found, sorted(want), atol=1e-5)


@pytest.mark.parametrize("segment,dense", [(256, True), (16, True), (16, False)])
def test_op10_against_naive_parse(monkeypatch, segment, dense):
    if not dense:
        monkeypatch.setattr(op10, "_DENSE", 0)
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 9)))
    train = {"aa": [" ".join(word("abcdeé") for _ in range(120)) for _ in range(3)], "bb": [" ".join(word("abxyz") for _ in range(120)) for _ in range(3)]}
    texts = [" ".join(word("abcdexyzé漢") for _ in range(n)) for n in (1, 5, 50, 300)] + [train["aa"][1], train["bb"][0][7:], "x" * 900, "", "-- ..", "𐐀𐐁 a", "A-B 1c"]

    def spell(t):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        return " " + "".join(w + " " for w in words)

    def naive(reference, t):
        i = n = 0
        while i < len(t):
            size = 1
            while i + size < len(t) and t[i : i + size + 1] in reference:
                size += 1
            i, n = i + (size if t[i] in reference else 1), n + 1
        return n

    model = op10.Languages.learn({k: v + v[:1] for k, v in train.items()}, op10.CrossParsing(segment=segment))
    got = np.stack([a.phrases(*op10.spelled(texts), segment) for a in model.automata], 1)
    references = [" " + "".join(spell(t)[1:] for t in train[name]) for name in model.names]
    assert got.tolist() == [[naive(r, spell(t)) for r in references] for t in texts]
    names, scores = model.judge(pa.array([*texts, None]))
    letters = [sum(c.isalpha() for c in t.lower()) for t in texts]
    rates = [[p * np.log2(len(r)) for p, r in zip(own, references)] for own in got.tolist()]
    assert names == [model.names[int(np.argmin(r))] if n else "und" for r, n in zip(rates, letters)] + ["und"]
    assert all(0 <= x <= 1 for x in scores)


def test_op10_odd_tables(spark):
    rows = [(None, "le chat", "fr"), (7, "the cat sat", "en"), (7, "the cat sat", "en"), (8, "le chat dort", "fr"), (9, None, "fr"), (10, "the cat " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = op10.learn_languages(docs)
    got = {(r.doc_id, r.lang_pred) for r in op10.predict_language(docs, model).collect()}
    assert got == {(None, "fr"), (7, "en"), (8, "fr"), (9, "und"), (10, "en")}
    assert op10.predict_language(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in op10.predict_language(docs, op10.learn_languages(docs.limit(0))).collect()} == {"und"}


def test_learned_models_on_held_out_rows(spark):
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for name, column in (("op1_rule_ensemble_quality", "quality"), ("op6_cnn_toxicity", "toxic")):
        rows = [r for r in QUERIES[name](spark, "/root/testdata/sf0.01").collect()]
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows) and len(rows) == 1000
        held = [r for r in rows if r.held_out and r.doc_id in labels]
        assert sum(r.predicted == labels[r.doc_id][column] for r in held) >= 0.9 * len(held)
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op10_cross_parsing_language"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.95 * len(rows)


def _plain_statistics(t):
    t = t or ""
    words, lines, n = _words(t), [x for x in t.split("\n") if x.strip(" ")], len(t)
    count = lambda chars: sum(c in chars for c in t)
    share = lambda a, b: a / max(b, 1)
    return {
        "n_words": len(words), "log_words": np.log1p(len(words)), "word_chars": share(n - count(" \t\n\r"), len(words)), "distinct_words": share(len(set(words)), len(words)), "n_lines": len(lines),
        "line_words": share(len(words), len(lines)), "distinct_lines": share(len(set(lines)), len(lines)), "upper": share(sum("A" <= c <= "Z" for c in t), n), "lower": share(sum("a" <= c <= "z" for c in t), n),
        "digits": share(count("0123456789"), n), "symbols": share(count("#*$%&|<>"), n), "bars": share(count("|"), n), "shouts": share(count("!?"), n), "stops": share(count("."), n),
        "commas": share(count(",;:"), n), "brackets": share(count("()[]{}=_/\\"), n), "spaces": share(count(" "), n),
    }


def test_op1_statistics_and_compiled_rules_against_plain(spark):
    texts = [*_hostile(), "One, two.\nOne, two.\n\n #3 | x! ABC (d)"]
    docs = _docs(spark, texts).withColumn("_w", F.lit(1)).withColumn("_q_n_words", F.lit("clash"))

    rows, names, mark = op1.with_statistics(docs)
    got = {r.doc_id: r for r in rows.select("doc_id", *(f"{mark}_{n}" for n in names)).collect()}
    for i, t in enumerate(texts):
        want = _plain_statistics(t)
        assert set(names) == set(want) and all(abs(got[i][f"{mark}_{k}"] - v) < 1e-9 for k, v in want.items()), i
    x = np.array([[_plain_statistics(t)[k] for k in names] for t in texts])
    rules = [((0, True, 5.0), (11, False, 0.2)), ((5, False, 30.0),), ((3, True, 0.5), (16, True, 0.1), (0, False, 1000.0))]
    model = op1.RuleEnsemble(names, rules, [1.5, -0.7, 0.4], -0.3)
    z = [-0.3 + sum(w for r, w in zip(rules, model.weights) if all(row[k] > v if above else row[k] <= v for k, above, v in r)) for row in x]
    want = 1 / (1 + np.exp(-np.array(z)))
    assert np.allclose(model.predict(x), want)
    scored = {r.doc_id: r.score for r in op1.score_quality(docs, model).collect()}
    assert np.allclose([scored[i] for i in range(len(texts))], want)
    kept = op1.keep_good(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, p in enumerate(want) if p >= 0.3]
    assert op1.keep_good(docs.limit(0), model).count() == op1.score_quality(docs.limit(0), model).count() == 0


def test_op1_filter_stays_above_the_statistics(spark):
    model = op1.RuleEnsemble(["n_words", "log_words"], [((0, True, 5.0),), ((1, True, 2.0),)], [1.0, 1.0], 0.0)
    plan = op1.keep_good(_docs(spark, ["a"]), model)._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan[plan.index("Filter") : plan.index("\n", plan.index("Filter"))]


def test_op6_against_naive_convolution(spark):
    rng = np.random.default_rng(3)
    config = op6.CnnConfig(buckets=64, dims=3, filters=2, widths=(1, 3))
    model = op6.TextCnn(config)
    model.embedding = rng.normal(size=(64, 3)).astype(np.float32)
    model.embedding[0] = 0
    model.freeze()
    texts = [*_hostile(), "word " * 40_000]
    want = []
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        ids, _ = op6.word_buckets(data, np.array([0, len(data)]), config)
        x = model.embedding[ids].astype(np.float64).sum(1)
        pooled = []
        for kernel, bias in zip(model.kernels, model.bias):
            padded = np.concatenate([x, np.zeros((len(kernel), 3))])
            sums = [[sum(padded[i + j] @ kernel[j, :, f] for j in range(len(kernel))) + bias[f] for f in range(2)] for i in range(min(len(x), 500))]
            pooled += np.maximum(np.max(sums, 0), 0).tolist()
        want.append(1 / (1 + np.exp(-(np.array(pooled) @ model.top + model.base[0]))))
    docs = _docs(spark, texts).withColumn("_lang", F.lit("clash"))
    got = {r.doc_id: r.score for r in op6.score_toxicity(docs, model).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-4)
    assert op6.score_toxicity(docs.limit(0), model).count() == 0


def test_op6_learns_the_same_model_again(spark):
    rows = [(f"id{i}", ("vile rotten " if i % 3 == 0 else "kind gentle ") * (1 + i % 4) + f"w{i % 7}", "en", int(i % 3 == 0)) for i in range(90)] + [(None, "x", None, 1), ("long", "y " * 30_000, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, toxic int")
    a, b = (op6.learn_toxicity(docs.repartition(k), docs.select("doc_id", "toxic")) for k in (2, 3))
    assert np.array_equal(a.embedding, b.embedding) and np.array_equal(a.shift, b.shift)
    got = op6.score_toxicity(docs, a).join(docs, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.9 * len(got)


def test_models_without_labels_and_odd_texts(spark):
    docs = _docs(spark, _hostile())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op1.score_quality(docs, op1.learn_quality(docs, none)).where("predicted = 1").count() == len(_hostile())
    assert op6.score_toxicity(docs, op6.learn_toxicity(docs, none)).count() == len(_hostile())
    got = {r.doc_id: r.lang_pred for r in op10.predict_language(docs, op10.learn_languages(docs)).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] == "en"


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) < set(out.columns)
    kept = {r.doc_id for r in out.select("doc_id", "decodes").collect()}
    quality = {r.doc_id for r in op5.quality_statistics(docs).where("kept").collect()}
    leaks = {r.doc_id for r in op9.contaminated_pairs(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert kept and kept <= quality and not kept & leaks and out.where("not decodes").isEmpty()


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 7)))
    item = " ".join(word() for _ in range(25))
    texts = [None, "", "too short", "again " * 60]
    for _ in range(60):
        own = [word() for _ in range(rng.randint(25, 90))]
        texts.append(" ".join(own) + ".")
        if rng.random() < 0.4:
            own[rng.randrange(len(own))] = word()
            texts += [" ".join(own) + "."] * rng.randint(1, 2)
        if rng.random() < 0.2:
            texts.append(" ".join(own[:12]) + " " + item + " " + " ".join(word() for _ in range(12)))
        if rng.random() < 0.5:
            texts.append(" ".join(w.upper() + "!!!" for w in own))
    rng.shuffle(texts)
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _q_score long")
    labels = spark.createDataFrame([(i, int("!!!" not in (t or "")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    def unrepetitive(t):
        w = _words(t)
        counted = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if counted[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w) >= 20 and 100 * len(hit) <= 30 * len(w) and _verdict(len(w), *_repeats(w, 5))

    kept = [i for i, t in enumerate(texts) if unrepetitive(t)]
    model = op1.learn_quality(docs.where(F.col("doc_id").isin(kept)), labels)
    assert model.rules
    kept = [i for i in kept if model.predict(np.array([[_plain_statistics(texts[i])[k] for k in model.names]]))[0] >= 0.3]
    groups = _components([texts[i] for i in kept], 5, 80)
    kept = [i for k, i in enumerate(kept) if groups[k][1] == k]
    leaks = {k for k, _ in _leaks([texts[i] for i in kept], [item])}
    kept = [i for k, i in enumerate(kept) if k not in leaks]
    library = Tokenizer.from_file(tokenizer_path())
    want = {i: library.encode(texts[i], add_special_tokens=False).ids for i in kept}
    out = corpus_pipeline.run(spark, folder)
    got = {r.doc_id: (list(r.token_ids), r.text, r._q_score) for r in out.collect()}
    assert got == {i: (ids, texts[i], i) for i, ids in want.items()} and 0 < len(got) < len(texts) - 20 and leaks


def test_pipeline_stages_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
