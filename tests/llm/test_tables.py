"""Corpus operators on the driver's tables and the pipeline on a fixture, against the libraries, brute force and held-out rows."""

import os
import random
import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from palimpsest.llm import jaccard, langid, packing, tokencount, toxicity  # noqa: E402

SMALL = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


def lower(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def components_of(sets, percent):
    """Smallest index that links reach, and the links of each, by comparing every two sets that share a shingle."""
    label, links, holders = list(range(len(sets))), [0] * len(sets), {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(sets))], links


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


@needs_tables
def test_whole_table_of_token_counts_and_ids(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sp, tk = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.op8_tokencount(spark, SMALL).collect()}
    want = {d: (len((t or "").encode()), len(sp.encode(t or ""))) for d, t in texts.items()}
    assert got == {d: (b, n, n > 4096) for d, (b, n) in want.items()}
    ids = {d: np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t in texts.items()}
    covered, lengths = dict.fromkeys(texts, 0), {}
    rows = packing.op2_packing(spark, SMALL).collect()
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        covered[r.doc_id] += r.length
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert covered == {d: len(x) for d, x in ids.items()}
    assert all(n & (n - 1) == 0 and n <= 1024 for n in lengths.values())
    assert {r.placed for r in rows} == {packing.WHOLE, packing.LEVEL, packing.END}


@needs_tables
def test_whole_table_of_near_links(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    sets = [shingles(t, 3) for _, t in rows]
    label, links = components_of(sets, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.op5_jaccard(spark, SMALL).collect()}
    assert got == {d: (len(s), rows[a][0], n) for (d, _), s, a, n in zip(rows, sets, label, links)}


@needs_tables
def test_held_out_accuracy_of_the_classifiers(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    lang = langid.op1_langid(spark, SMALL).collect()
    held = [r for r in lang if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert len(lang) == len(docs) and np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.97
    larger = SMALL.replace("0.01", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in toxicity.op4_toxicity(spark, larger).collect() if r.held_out and r.doc_id in labels]
    assert len(held) > 500 and np.mean([a == b for a, b in held]) >= 0.97


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept: what goes, what stays, what is cut, and that all ids of the rest are packed."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    words = {"en": "the of and river stone house walk green light small open garden".split(), "fr": "été où très forêt maison près lumière même fenêtre château après".split()}
    rows = []

    def add(text, lang):
        rows.append((len(rows), text, lang, "s", len(text or "")))
        return len(rows) - 1

    prose = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randrange(300)) for _ in range(n))
    for lang in ("en", "fr") * 100:
        add(prose(lang, 60), lang)
    toxic = [add(prose("en", 30) + " scumbag vermin " + prose("en", 30), "en") for _ in range(80)]
    unknown = [add(t, "en") for t in (None, "", "12 34", "!!")]
    groups = []
    for k in range(15):
        w = prose("en", 120).split()
        copy = list(w)
        copy[50] = "changed"
        groups.append([add(" ".join(w), "en"), add(" ".join(w), "en"), add(" ".join(copy), "en")])
    passage = "benchmark question one asks for the longest river of the whole northern continent".split()
    leaked = [add(prose("en", 20) + " " + " ".join(passage) + " " + prose("en", 20), "en") for _ in range(5)]
    only = add(" ".join(passage), "en")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] in toxic)) for r in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(passage)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        left[name] = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame([tuple(r) for r in docs.collect()], docs.schema)
    every = {r[0] for r in rows}
    assert set(left["toxicity"]) == every - set(toxic)
    assert set(left["language_id"]) == every - set(toxic) - set(unknown)
    before = sorted(left["language_id"])
    label, _ = components_of([shingles(rows[d][1], 5) for d in before], 80)
    assert set(left["ngram_jaccard"]) == {before[i] for i, a in enumerate(label) if a == i} and all(set(g) & set(left["ngram_jaccard"]) == {g[0]} for g in groups)
    assert set(left["decontamination"]) == set(left["ngram_jaccard"]) - {only}
    for d, t in left["decontamination"].items():
        assert t == (rows[d][1].replace(" ".join(passage), "") if d in leaked else rows[d][1])
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    ids = {d: np.array(tk.encode(t, add_special_tokens=False).ids + [0], "<u4") for d, t in left["decontamination"].items()}
    assert set(got) == set(ids)
    for d, pieces in got.items():
        at = 0
        for start, length, crc in sorted(pieces):
            assert start == at and crc == zlib.crc32(ids[d][at : at + length].tobytes())
            at += length
        assert at == len(ids[d])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
