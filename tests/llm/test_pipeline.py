"""The pipeline, stage by stage, against brute force on a small corpus."""

import random
import zlib

import numpy as np
import pytest
from test_llm import SCHEMA, brute_fingerprint, components, sentence

import corpus_pipeline
from webloom.llm import decontaminate
from webloom.llm.queries import QUERIES, word_tokenizer


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    bad = ["idiot", "scum", "trash", "loser"]
    items = [(i, sentence(rng, 25)) for i in range(8)]
    passage = [sentence(rng, 60) for _ in range(3)]
    texts, toxic = [], []
    for i in range(240):
        text, bad_one = sentence(rng, rng.randint(60, 140)), i % 5 == 0
        if bad_one:
            for _ in range(6):
                text = text.replace(" ", f" {rng.choice(bad)} ", 1) + " " + rng.choice(bad)
        elif i % 7 == 0:
            text += " " + rng.choice(items)[1]
        elif i % 4 == 0:
            text += "\n" + rng.choice(passage) + "\n" + sentence(rng, 20)
        texts.append(text)
        toxic.append(int(bad_one))
    texts += texts[1:9] + [texts[2].upper(), texts[3] + " ", None, ""]
    folder = tmp_path_factory.mktemp("corpus")
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, dict(enumerate(toxic)), items


def brute_cut(rows, depth=100):
    seen, out = set(), {}
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if b[p : p + depth] in seen:
                gone[p : p + depth] = b"\1" * depth
            seen.add(b[p : p + depth])
        out[i] = None if text is None else bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_stages(spark, corpus):
    folder, docs, toxic, items = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_array", "decontamination", "packing"]
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = df.columns, dict((d[0], d[1]) for d in docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, folder)
        if name == "packing":
            break
        assert out.columns == columns
        out.write.parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
        got = {r["doc_id"]: r["text"] for r in df.collect()}
        if name == "toxicity":
            missed = [i for i, t in toxic.items() if t == (i in got)]
            assert len(missed) <= 2 and all(got[i] == rows[i] for i in got)
            want = got
        elif name == "simhash":
            ids = sorted(rows)
            fps = [brute_fingerprint(rows[i]) for i in ids]
            roots = components(len(ids), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
            want = {ids[r]: rows[ids[r]] for r in set(roots)}
        elif name == "suffix_array":
            want = {i: t for i, t in brute_cut(sorted(rows.items())).items() if t != ""}
            assert sum(len(t or "") for t in want.values()) < sum(len(t or "") for t in rows.values())
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in df.collect())
        else:
            want = {}
            for i, t in rows.items():
                seen = decontaminate.shingles(decontaminate.WORD.findall((t or "").lower()))
                if not any(len(s & seen) / len(s) >= 0.8 for _, x in items for s in [decontaminate.shingles(decontaminate.WORD.findall(x.lower()))]):
                    want[i] = t
            assert 0 < len(rows) - len(want) < 60
        assert got == want, name
        rows = got
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    pieces: dict = {}
    for r in out.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(rows)
    for i, t in rows.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p in pieces[i]:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        assert sum(p["length"] for p in pieces[i]) == ids.size
    assert corpus_pipeline.run(spark, folder).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
