"""Spelling variants, fill-in-middle and window removal against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skald.llm import op11_spelling_variants as op11
from skald.llm import op12_fill_middle as op12
from skald.llm import op13_recompression as op13
from skald.llm.durable import Scratch, shared_folder
from skald.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _docs(spark, texts, ids=None):
    rows = [(i, t, 7, "clash", 1, "x") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, form string, doc long, word string")


# --- spelling variants


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _plain_words(rows, config):
    count = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if config.slips and h % config.slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= config.letters and n >= config.occurrences}


def _plain_forms(words, ratio):
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def _rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def _word_texts():
    rng = random.Random(5)
    stems = ["".join(rng.choices("abé", k=rng.randint(5, 12))) for _ in range(25)]
    texts = [None, "", "1234 - _", "a" * 70_000, " ".join(["a" * 70_000, "a" * 69_999 + "b"] * 6)]
    for _ in range(150):
        out = []
        for _ in range(40):
            w = list(rng.choice(stems[: rng.randint(1, 25)]))
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice(["", "b", "éa", "ÿ"])
            out.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        texts.append(rng.choice([" ", "-", "×1", ", "]).join(out))  # × is one of the letters
    return [*texts, "chainer " * 125, "chainers " * 25 + "xchainers " * 5]


@pytest.mark.parametrize("config", [op11.Spelling(), op11.Spelling(slips=3, ratio=2, bucket_pairs=1), op11.Spelling(letters=1, occurrences=1, ratio=2, slips=7, bucket_pairs=3)])
def test_op11_against_all_pairs(spark, config):
    texts = _word_texts()
    if config.letters == 1:
        texts = [*texts[:3], *texts[5:30], "a b ab ba aa bb é ÿ", "a a a b"]
    ids = [*range(len(texts) - 2), None, 3]
    words = _plain_words(zip(ids, texts), config)
    want = _plain_forms(words, config.ratio)
    got = _rows(op11.spelling_variants(_docs(spark, texts, ids).repartition(5), config))
    assert got == want and any(x[1] for x in want) and (config.slips < 199 or any(x[1] and x[2] != x[1] for x in want))


def test_op11_ties_and_empty_tables(spark):
    texts = ["letters " * 5, "fetters " * 50, "betters " * 50, "etters " * 4]
    assert _rows(op11.spelling_variants(_docs(spark, texts), op11.Spelling(slips=0))) == {
        ("letters", "betters", "betters", 5, 2, 50), ("fetters", None, "fetters", 50, 2, None), ("betters", None, "betters", 50, 2, None),
    }
    assert op11.spelling_variants(_docs(spark, [None])).count() == 0
    assert op11.spelling_variants(_docs(spark, [None]).limit(0)).count() == 0


def test_op11_checksums_of_joined_bytes():
    rng = random.Random(1)
    heads = [rng.randbytes(rng.randint(0, 20)) for _ in range(200)]
    tails = [rng.randbytes(rng.choice([0, 1, 7, 300, 70_000])) for _ in range(200)]
    crc = lambda parts: np.array([zlib.crc32(p) for p in parts], np.uint32)
    got = op11.joined_crc32(crc(heads), crc(tails), np.array(list(map(len, tails))))
    assert (got == crc([a + b for a, b in zip(heads, tails)])).all()


# --- fill-in-middle


def _units(text, unit):
    if unit == "char":
        return list(text)
    return re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", text)


def _plain_middle(i, text, config):
    text = text or ""
    digest = hashlib.sha256(f"{config.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = _units(text, config.unit)
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - config.plain:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < config.spm:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def _middle_texts():
    rng = random.Random(8)
    texts = [None, "", "<P>", "a <S> b", "<M", "S>", "<", "P>P>", "é", "\U0001f600", "\n\n", " lead", "x" * 300_000 + "é\U0001f600 end"]
    for _ in range(120):
        texts.append("".join(rng.choices("ab éß中\U0001f600\n\t <>PSM", k=rng.randint(0, 60))))
    return texts + texts[-5:]


@pytest.mark.parametrize("config", [op12.FillMiddle(), op12.FillMiddle(seed=9, plain=0, spm=50), op12.FillMiddle(unit="word", plain=40), op12.FillMiddle(unit="line", spm=100)])
def test_op12_against_plain_version(spark, config):
    texts = _middle_texts()
    ids = [*range(len(texts) - 7), None, *range(6)]
    docs = _docs(spark, texts, ids).repartition(3)
    made = op12.transform(docs, config)
    want = Counter((i, t, *_plain_middle(i, t, config)) for i, t in zip(ids, texts))
    got = made.select("doc_id", "text", "n", "form", "prefix_units", "middle_units", "output").collect()
    assert Counter(map(tuple, got)) == want and {r.form for r in got} > {"plain"}
    back = op12.restore(made).select("text", "restored", "word").collect()
    assert all(r.restored == (r.text or "") and r.word == "x" for r in back) and len(back) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = op12.transform_and_check(docs, config).collect()
    assert Counter(map(tuple, digests)) == Counter((w[0], *w[2:6], sha(w[6]), sha(w[1] or "")) for w in want.elements())


def test_op12_outputs_that_do_not_fit(spark):
    rows = [("<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c", "spm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b", "psm"), ("a", "plain"), (None, "plain"), ("a", None), ("<S>b<P>a<M>c", "spm")]
    got = op12.restore(spark.createDataFrame(rows, "output string, form string").coalesce(1)).collect()
    assert [r.restored for r in got] == ["acb", None, None, None, "a", None, None, "acb"]
    assert op12.transform(_docs(spark, [None]).limit(0)).count() == 0 and op12.transform_and_check(_docs(spark, ["a"]).limit(0)).count() == 0


# --- window removal


def _plain_removal(rows, window):
    first = {}
    split = [(float("inf") if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = Counter()
    for (i, w), (given, _) in zip(split, rows):
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out[given, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    return out


def _repeating_texts(window):
    rng = random.Random(11)
    letters = [chr(97 + k) for k in range(26)] + ["é", "the", "of", "X#"]
    passages = [" ".join(rng.choices(letters[: rng.choice([2, 5, 30])], k=n)) for n in [window - 1, window, window + 1, window + 2, 3 * window, 40, 90, 300] * 3]
    texts = [None, "", " \n ", "a", "a " * 400, "a " * (window - 1), "a " * window, "a b " * 200, "b " + "a " * 30 + "c", "a b c " * 60 + " ", *passages]
    for _ in range(60):
        parts = [" ".join(rng.choices(letters, k=rng.randint(0, 30))), rng.choice(passages), " ".join(rng.choices(letters, k=rng.randint(0, 9))), rng.choice(passages)]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(parts))
    long = " ".join(rng.choices(letters, k=60_000))
    return texts + texts[-4:] + [long, long[:200_000] + " q " + long[200_000:]]


@pytest.mark.parametrize("config", [op13.Recompression(), op13.Recompression(window=5, base_rounds=1, levels=(4, 7)), op13.Recompression(window=8, base_rounds=5, levels=()), op13.Recompression(window=1, base_rounds=2, levels=(3,))])
def test_op13_against_all_windows(spark, config):
    texts = _repeating_texts(config.window)
    rng = random.Random(2)
    ids = rng.sample(range(-50, 1000), len(texts) - 6) + [None, None]
    ids += rng.sample([i for i in ids if i is not None], 4)  # ids that stand twice, with other texts
    rows = list(zip(ids, texts))
    want = _plain_removal(rows, config.window)
    for parts in (1, 6):
        got = op13.drop_repeats(_docs(spark, texts, ids).repartition(parts), config)
        assert got.columns == ["doc_id", "text", "form", "doc", "word", "n_words", "n_removed"] or set(got.columns) == {"doc_id", "text", "n", "form", "doc", "word", "n_words", "n_removed"}
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()) == want


def test_op13_upper_symbols_settle_copies():
    rng = random.Random(4)
    words = [str(rng.randrange(10_000)) for _ in range(500)]
    data = " ".join(words * 2).encode()
    half = len(" ".join(words)) + 1
    c = op13.Chunk.read(np.frombuffer(data, np.uint8), np.array([0, half, len(data)]), op13.Recompression())
    names = [set(c.upper.name[c.upper.text == k].tolist()) for k in (0, 1)]
    assert names[0] == names[1] and len(names[0]) > 5
    size = (c.upper.end - c.upper.start)[c.upper.text == 1]
    assert size.min() >= 13 and size.max() == 500


def test_op13_base_symbols_depend_on_their_context_only():
    rng = random.Random(6)
    config = op13.Recompression()
    for _ in range(60):
        core = [rng.choice("abcdefgh") for _ in range(13)]
        seen = []
        for _ in range(4):
            sides = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))] for _ in range(2)]
            data = " ".join(sides[0] + core + sides[1]).encode()
            c = op13.Chunk.read(np.frombuffer(data, np.uint8), np.array([0, len(data)]), config)
            at, used = len(sides[0]), c.usable()
            used = used[(c.low[used] >= at) & (c.high[used] <= at + 13)]
            seen.append({(int(n), int(a) - at, int(b) - at) for n, a, b in zip(c.base.name[used], c.base.start[used], c.base.end[used])})
        assert all(s == seen[0] for s in seen)


def test_op13_empty_table(spark):
    assert op13.drop_repeats(_docs(spark, ["a"]).limit(0)).count() == 0


# --- tables between steps


def test_scratch_tables_go(spark):
    folder = shared_folder(spark).removeprefix("file://")
    scratch = Scratch(spark, "going", free_shuffles=True)
    kept, gone = scratch.write(spark.range(5)), scratch.write(spark.range(6).groupBy("id").count())
    scratch.drop(gone)
    assert kept.count() == 5 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    import os

    assert os.listdir(scratch.path.removeprefix("file://")) == ["001"]
    scratch._end()
    assert os.listdir(scratch.path.removeprefix("file://")) == [] and os.path.isdir(folder)


@pytest.mark.parametrize("name", ["op11_even_partition_spelling", "op12_fill_middle_batches", "op13_recompression_dedup"])
def test_queries_return_the_agreed_columns(spark, name):
    want = {
        "op11_even_partition_spelling": "word:string form:string root:string n:bigint n_near:bigint form_n:bigint",
        "op12_fill_middle_batches": "doc_id:bigint n:bigint form:string prefix_chars:bigint middle_chars:bigint output_sha256:string restored_sha256:string",
        "op13_recompression_dedup": "doc_id:bigint n_words:bigint n_removed:bigint kept_sha256:string",
    }[name]
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {":".join(x) for x in df.dtypes} == set(want.split()) and df.where(F.lit(True)).count() > 0
