"""The training-data operators against brute force, and on odd input."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from webloom.llm import common, decontaminate, html_text, language, neighbours, packing, repeats, simhash, toxicity, url_filter, wordpieces
from webloom.llm.queries import word_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
EXTRA = ["rest", "spans", "leaks", "p_toxic", "fp", "component_id", "doc", "c0", "empty"]
WORDS = "the of and in to thing hand reat other sion ing able ness ent ous ful ion ate ment".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def frame(spark, texts, ids=None, extra=False):
    ids = range(len(texts)) if ids is None else ids
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    for c in EXTRA if extra else ():
        df = df.withColumn(c, F.lit(f"x-{c}"))
    return df


ODD = [None, "", " \t\n", "A.", "The hand", "é" * 300, "x " * 5000, "a" * 7000, "日本語 текст", "The hand"]


# ---- SimHash

def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(n, linked):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(n)]


def test_simhash_brute_force(spark):
    rng = random.Random(1)
    base = [sentence(rng, 120) for _ in range(12)]
    texts = list(ODD)
    for b in base:
        texts += [b, b, b.replace(" ", "  ", 3), b + " tail", b.upper()]
    rng.shuffle(texts)
    fps = [brute_fingerprint(t) for t in texts]
    roots = components(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts, extra=True)).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    assert {i: r["component_id"] for i, r in got.items()} == dict(enumerate(roots))
    kept = simhash.without_copies(frame(spark, texts, extra=True))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots)) and kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("tile", [4, 2048])
def test_links_of_dense_and_wide_buckets(spark, tile):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 4)).tolist())) for _ in range(150)]
    fps = np.unique(np.array([int(centre[i % 3]) ^ x for i, x in enumerate(flips)] + rng.integers(0, 1 << 63, 40).tolist(), np.uint64))
    roots = components(fps.size, lambda i, j: (int(fps[i]) ^ int(fps[j])).bit_count() <= 3)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = simhash.links(df, tile=tile)
    got = {r["node"]: r["root"] for r in common.connected(found).collect()}
    ours = {}
    for i, x in enumerate(fps.view(np.int64).tolist()):
        ours.setdefault(got.get(x, x), set()).add(i)
    want = {}
    for i, r in enumerate(roots):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, want.values()))


def test_connected_chain(spark):
    rng = random.Random(5)
    names = [rng.getrandbits(62) for _ in range(200)]
    edges = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a long, b long")
    assert len({r["root"] for r in common.connected(edges).collect()}) == 1
    assert common.connected(edges.limit(0)).count() == 0


def test_simhash_nulls_and_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.without_copies(frame(spark, [])).count() == 0
    df = frame(spark, ["some text here", "some text here", None, None], [None, 4, None, 4])
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(df).collect()) == [("4", 4), ("4", 4), ("None", 4), ("None", 4)]
    same = frame(spark, ["some text here"] * 3, [1, 1, 2])
    assert [r["doc_id"] for r in simhash.without_copies(same).collect()] == [1]


# ---- repeats

def brute_repeats(docs, depth=100):
    seen, out = set(), {}
    for i, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            if w in seen:
                gone[p : p + depth] = b"\1" * depth
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 2, 1])
def test_repeats_brute_force(spark, hot):
    rng = random.Random(7)
    shared = [sentence(rng, 30) for _ in range(4)]
    texts = list(ODD) + [shared[0][:99], shared[0][:100], shared[0][:101], "ab" * 150, "x" + "ab" * 150]
    for _ in range(40):
        texts.append("\n".join(rng.choice([sentence(rng, 12), rng.choice(shared), rng.choice(shared)[rng.randint(0, 60) :]]) for _ in range(rng.randint(1, 5))))
    texts += texts[20:24]
    want = brute_repeats(list(enumerate(texts)))
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = frame(spark, [texts[i] for i in order], order, extra=True).repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.removals(df, hot=hot).collect()}
    assert got == want


def test_long_texts_are_cut_into_pieces_alike():
    rng = random.Random(9)
    text = " ".join(sentence(rng, 40) for _ in range(60)).encode()
    whole = sorted((int(p), int(h), int(a), int(b)) for _, ps, hs, xs, ys in repeats._spread([text], 100, 40) for p, h, a, b in zip(ps, hs, xs, ys, strict=True))
    pieces = sorted((int(p), int(h), int(a), int(b)) for _, ps, hs, xs, ys in repeats._spread([text], 100, 40, limit=1500) for p, h, a, b in zip(ps, hs, xs, ys, strict=True))
    assert whole == pieces


def test_repeats_odd_rows(spark):
    long = sentence(random.Random(1), 60)
    df = frame(spark, [long, long, long + "!", None, long], [None, 3, 3, 5, 3], extra=True)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"] > 0) for r in repeats.removals(df).collect())
    n = len(long)
    # of the two texts of doc 3 one comes first; the repeated row has its document's result; null comes last
    assert [g[:2] for g in got] == [("3", n), ("3", n), ("3", n + 1), ("5", 0), ("None", n)] and got[-1][2] and got[0][2] == got[1][2] != got[2][2]
    kept = repeats.removed(frame(spark, [long, long, None], extra=True))
    assert [(r["doc_id"], r["text"], r["n_chars"], r["rest"]) for r in kept.orderBy("doc_id").collect()] == [(0, long, n, "x-rest"), (1, "", 0, "x-rest"), (2, None, None, "x-rest")]
    assert repeats.removals(frame(spark, [])).count() == 0


# ---- packing

def test_packing_round_trip(spark):
    rng = random.Random(2)
    texts = [*ODD, *[sentence(rng, rng.randint(1, 900)) for _ in range(40)], "<|endoftext|> x", sentence(rng, 6000)]
    df = frame(spark, texts, extra=True).repartition(3)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    rows = packing.pack(df, word_tokenizer(), shard=20_000).collect()
    digests = packing.digests(packing.pack(df, word_tokenizer(), shard=20_000)).count()
    assert digests == len(rows)
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(docs) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        pieces = sorted(docs[i], key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == ids and all(p["doc_tokens"] == len(ids) // 4 for p in pieces)
        assert [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces]])[:-1].tolist()
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and zlib.crc32(bytes(r["ids"])) >= 0
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0  # full or a power of two: no padding
    assert packing.pack(frame(spark, []), word_tokenizer()).count() == 0


def test_packing_takes_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.integers(k * 100, k * 100 + 60, 300) for k in range(1, 9)]
    docs = [topics[i % 8].astype("<u4").tobytes() for i in range(40)]
    packer = packing.Packer(0)
    packer.shard(list(enumerate(docs)))
    packer.finish()
    of = {}
    for doc, *_, sequence in packer.rows:
        of.setdefault(sequence, set()).add(doc % 8)
    assert max(map(len, of.values())) <= 4 and sum(map(len, of.values())) / len(of) < 3


# ---- decontamination

def test_decontamination_brute_force(spark):
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.randint(10, 40)) + (f"\n{sentence(rng, rng.randint(1, 12))}" if i % 2 else "")) for i in range(30)] + [(30, "short one"), (31, ""), (None, "x y"), (33, None), (34, "the of")]
    texts = list(ODD)
    for i in range(80):
        t = rng.choice(items[:30])[1]
        w = t.split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zzz"
        texts.append(sentence(rng, rng.randint(0, 150)) + " " + " ".join(w[rng.randint(0, 4) :]) + ". " + sentence(rng, rng.randint(0, 90)))
    texts += [sentence(rng, 100) for _ in range(20)] + ["a short one, here", "Of the OF the"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.judged(frame(spark, texts, extra=True), bench).collect()}
    for d, t in enumerate(texts):
        words = decontaminate.WORD.findall((t or "").lower())
        seen = set().union(*(decontaminate.shingles(words, k) for k in range(1, 6)))
        want = []
        for i, item in items:
            q, a = decontaminate.parts(item or "")
            if i is None or len(q) + len(a) < 5:
                continue
            whole, alone = decontaminate.shingles(q) | decontaminate.shingles(a), decontaminate.shingles(q) if len(q) >= decontaminate.QUESTION else set()
            if len(whole & seen) / len(whole) >= 0.8 - 1e-9 or alone and len(alone & seen) / len(alone) >= 0.8 - 1e-9:
                want.append(i)
        assert got[d] == want, (d, t)
    assert sum(map(len, got.values())) > 20
    assert decontaminate.clean(frame(spark, texts, extra=True), bench.limit(0)).count() == len(texts)
    assert decontaminate.clean(frame(spark, [], extra=True), bench).columns == [*SCHEMA.replace(",", "").split()[::2], *EXTRA]


def test_wand_is_exhaustive():
    rng = random.Random(8)
    index = decontaminate.Index.build([(i, sentence(rng, rng.randint(5, 60))) for i in range(60)])
    for _ in range(60):
        words = set(sentence(rng, rng.randint(5, 120)).split())
        scores = np.zeros(60)
        for w in words:
            if w in index.lists:
                scores[index.lists[w][0]] += index.lists[w][1]
        assert index.search(words) == [i for i in range(60) if scores[i] >= 1]


# ---- toxicity

def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["idiot", "scum", "trash", "moronic", "moronish", "moronly"]
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = sentence(rng, 60).split()
        for _ in range(rng.randint(2, 8) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    df = frame(spark, texts + ODD + ["what an idiot and a scum trash moronish"], extra=True)
    lab = spark.createDataFrame([*labels[:300], (None, 1), (5, None), *labels[:3]], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judged(df, lab).collect()}
    assert len(got) == len(texts) + len(ODD) + 1
    right = sum(got[i]["toxic"] == bool(t) for i, t in labels[300:])
    assert right >= 98 and got[len(texts) + len(ODD)]["toxic"] and not any(got[i]["toxic"] for i in range(400, 410))
    heavy = [got[i]["severity"] for i, t in labels if t and sum(texts[i].count(b) for b in bad) >= 7]
    light = [got[i]["severity"] for i, t in labels if t and sum(texts[i].count(b) for b in bad) <= 2]
    assert np.mean(heavy) > np.mean(light) > 0.5
    assert toxicity.accepted(df, lab.limit(0)).columns == df.columns and toxicity.accepted(df, lab.limit(0)).count() == df.count()
    assert toxicity.judged(frame(spark, []), lab).count() == 0


# ---- word pieces

def test_word_pieces(spark):
    pieces = ["a", "b", "c", "ab", "abc", "bcd" + wordpieces.END, "d", "c" + wordpieces.END, "abcda", "a" + wordpieces.END]
    automaton, known = wordpieces.Automaton(pieces), set(pieces)

    def greedy(word):
        word, at, n = word + wordpieces.END, 0, 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
            if end is None:
                return 1
            at, n = end, n + 1
        return n

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdx") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    assert [automaton.count(w) for w in words] == [greedy(w) for w in words]
    rows = wordpieces.counts(frame(spark, ODD, extra=True), word_tokenizer()).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows[:3]] == [(0, 0)] * 3 and rows[4]["n_words"] == 2 and rows[4][1:] == rows[9][1:]
    assert wordpieces.counts(frame(spark, []), word_tokenizer()).count() == 0


# ---- language

def test_language(spark):
    rng = random.Random(5)
    kinds = {"aa": "ka lo mi ta ne".split(), "bb": "strum grelz pfick".split(), "cc": "ção nhe lhã".split()}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(2)) for _ in range(40)), k) for i in range(300) for k in [list(kinds)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "123 !!", "aa"), (None, rows[0][1], None), (1003, rows[1][1], None), (1003, rows[1][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = language.predictions(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([by[i]["lang_pred"] == k for i, _, k in rows[:300]]) > 0.99
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == "und" and by[1000]["score"] == 0 and by[None]["lang_pred"] == "aa" and not by[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = language.predictions(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and language.predictions(df.limit(0)).count() == 0


# ---- neighbours

@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (1.5, 0.9)])
def test_neighbours(spark, factor, least):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)) + 4 * rng.integers(0, 3, (900, 1))
    x[100:200] = x[100]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, []), (904, [None] * 8), (None, [1.0] * 8), (1000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 100 = 0"), 10, factor, shard=250).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10].tolist()
        hits += len(set(want) & {v for v, _ in found})
        assert all(abs(d[v] - s) < 1e-12 for v, s in found) and found == sorted(found, key=lambda f: (f[1], f[0]))
        if factor == 1.0:
            assert [v for v, _ in found] == want
    assert hits / 90 >= least
    few = neighbours.nearest(df.where("vec_id < 3"), df.where("vec_id = 0")).collect()
    assert [r["rank"] for r in few] == [1, 2] and neighbours.hundredth(df.limit(0)).count() == 0


# ---- HTML

PAGE = "<html><head><title>t</title></head><body><header>top</header><nav><a>menu</a></nav><div class='ad'>buy</div>{}<aside>side</aside><div id='comments'>nice</div><form>mail</form><footer>foot</footer></body>"


def test_html(spark):
    body = "<article><h1>Head &amp; more</h1><p><b>one  two<br><p>three&nbsp;<i>x</i>y</p><ul><li>a<li>b</ul><script>var p='</p>'</script><p>co&shy;de &lt;p&gt; &amp</p></article>"
    widget = "<div class='box'><p>Read all our stories every day</p></div>"
    rows = [(1, "http://H.com/1", PAGE.format(body)), (2, None, None), (3, "x", ""), (4, "http://h.com/p", PAGE.format("<main><p>m1</p></main>")), (5, "http://h.com/q", "plain <b>text</b> only"), (6, "http://h.com/z", "<p>unclosed <a href='x")]
    rows += [(10 + i, f"http://site.org/{i}", PAGE.format(f"<div id=x><p>story {i} it is</p><p>common line</p></div>{widget}")) for i in range(12)]
    rows += [(40 + i, "http://copy.org/", PAGE.format(body + widget)) for i in range(12)]
    rows += [(7, "http://h.com/w", "<div class='wrap with-sidebar'><p>kept</p><div class='post-share'>x</div><p class=notice>y</p><article class='comment'>z</article></div>")]
    rows += [(1, "http://H.com/1", PAGE.format(body))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_text.texts(df).collect()}
    want = "Head & more\none two\nthree xy\na\nb\nco\u00adde <p> &"
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want) and got[40]["text"] == want
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "m1" and got[5]["text"] == "plain text only" and got[6]["text"].startswith("unclosed")
    assert got[7]["text"] == "kept"
    assert [got[10 + i]["text"] for i in range(12)] == [f"story {i} it is\ncommon line" for i in range(12)]
    assert html_text.texts(df).count() == len(rows) and html_text.texts(df.limit(0)).count() == 0


# ---- URLs

def test_url_filter(spark):
    urls = ["http://A.Example.com/en/1?x#y", "https://example.com/en/77", "http://x.net/de/8", "http://example.net/de/8", "http://m.example.net/de/81/a", "http://a.org/es/", "http://a.org/es", "http://orgs/es/", "nothing", "", None, "a://b?c", "http://casino-win.example.com/fr/1", "http://com/en/", "x://EXAMPLE.com:80/en/7"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("length", F.lit("clash"))
    labelled = spark.createDataFrame([(f"http://s{i}.example.com/fr/{i}", 0) for i in range(60)] + [(f"http://casino-win.example.com/fr/{i}", 1) for i in range(30)] + [(None, 1), ("u", None)], "url string, label int")
    rows = url_filter.judged(df, labelled)
    assert "Python" not in rows._jdf.queryExecution().toString() and "Arrow" not in rows._jdf.queryExecution().toString()
    got = {r["page_id"]: r for r in rows.collect()}
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, None), (None, None)]
    for i, (rule, verdict) in enumerate(want):
        assert got[i]["rule"] == rule and (verdict is None or got[i]["verdict"] == verdict)
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 8, 9, 10, 11)] == [("a.example.com", "/en/1"), ("", ""), ("", ""), ("", ""), ("b", "")]
    assert got[12]["rule"] is None and got[12]["verdict"] == "block" and got[13]["rule"] == "com/en/" and got[14]["host"] == "example.com:80" and got[14]["rule"] is None
    assert {r["verdict"] for r in url_filter.judged(df, labelled.where("label = 0")).where("rule is null").collect()} == {"allow"}
    assert url_filter.judged(df.limit(0), labelled).count() == 0
