"""Corpus operators against brute force, the public libraries and exact round trips, with awkward rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from palimpsest.llm import decontaminate, jaccard, langid, lattice, mpegts, packing, sharding, tokencount, toxicity, warc  # noqa: E402
from palimpsest.llm.blocks import Block, blocks  # noqa: E402
from palimpsest.llm.components import components  # noqa: E402

ODD = [None, "", " ", "\n\t ", "a", "one two", "naïve Ünïcode ▁ x  y", "日本語 　テスト 😀", "<|endoftext|> a<|endoftext|> <s>", "it's  I'M 12345 ½²\r\n z", "x" * 30_000, "word " * 5_000]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string"


def corpus(spark, n=300, seed=5):
    rng = random.Random(seed)
    words = ["w%03d" % i for i in range(400)]
    texts = ODD + ODD[:5] + [" ".join(rng.choices(words, k=rng.randint(3, 120))) for _ in range(n)]
    for _ in range(60):
        t = rng.choice(texts[20:]).split(" ")
        t[rng.randrange(len(t))] = "edited"
        texts.append(" ".join(t))
    return texts, spark.createDataFrame([(i, t, "en", "s", 0, 1, "x") for i, t in enumerate(texts)], COLUMNS).repartition(3)


def lower(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def test_token_counts_equal_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    c = tokencount.Counter(P.path("piece_bpe_32k.model"))
    got = [n for b in blocks(pa.array(ODD, pa.string())) for n in c.counts(b).tolist()]
    assert got == [len(sp.encode(t or "")) for t in ODD]


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts, df = corpus(spark)
    rows = packing._public(df).collect()
    sequences, covered = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        covered.setdefault(r.doc_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0
    for i, t in enumerate(texts):
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(covered[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_takes_the_least_sum_of_squares():
    rng = random.Random(6)
    packer, levels, closed = packing.Packer(16), [], []  # levels: of the open windows, brute force over all choices
    for doc in range(600):
        n = rng.randint(1, 40)
        packer.add(doc, np.arange(n, dtype="<u4"))
        if rest := n % 16:
            squares = lambda x: sum(x.count(k) ** 2 for k in range(1, 16))
            options = [(squares([*levels, rest]), 0, None)]
            options += [(squares(levels[:i] + levels[i + 1 :] + ([h + rest] if h + rest < 16 else [])), -h, i) for i, h in enumerate(levels) if h + rest <= 16]
            _, h, i = min(options, key=lambda x: x[:2])
            if i is not None:
                levels.pop(i)
            if rest - h < 16:
                levels.append(rest - h)
            else:
                closed.append(doc)
        assert sorted(levels) == [k for k in range(17) for _ in packer.open[k]] and packer.counts.tolist() == [levels.count(k) for k in range(17)]
    assert [r[0] for r in packer.out if r[7] == packing.LEVEL and r[6] + r[2] == 16] == closed and len(closed) > 100
    before, kept = len(packer.out), {p[0]: k for k, windows in enumerate(packer.open) for pieces in windows for p in pieces[:1]}
    packer.fill_up()
    ends = {}
    for r in packer.out[before:]:
        ends.setdefault(r[5], []).append(r)
    sizes = [sum(r[2] for r in x) for x in ends.values()]
    assert all(x in (1, 2, 4, 8, 16) for x in sizes) and sum(x < 16 for x in sizes) <= 4
    # The windows that were filled up begin as the level array left them.
    assert sum(x[0][0] in kept for x in ends.values()) >= 0.6 * len(kept)


def test_packing_of_remainders_that_never_fit():
    """However many windows are open, the level array goes on, and ids are held in two bytes each."""
    packer = packing.Packer(1024)
    for doc in range(20_000):
        packer.add(doc, np.arange(700, dtype="<u4"))
    assert packer.counts[700] == 20_000 and not packer.out and packer.open[700][0][0][2].dtype == np.uint16
    packer.fill_up()
    covered = {}
    for r in packer.out:
        covered[r[0]] = covered.get(r[0], 0) + r[2]
    assert covered == dict.fromkeys(range(20_000), 700)


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_decontamination_equals_brute_force(spark, block_bytes):
    """One block of the benchmark, and many; null and repeated item ids, clashing columns, a very long text."""
    import hashlib

    from pyspark.sql import functions as F

    texts, df = corpus(spark)
    df = df.withColumn("n_hit", F.lit("mine")).withColumn("Clean_Text", F.lit("mine"))
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, " ".join(texts[40].split()[:14])), (2, "one TWO"), (3, None), (4, ""), (5, texts[50]), (5, texts[60]), (7, "never seen here"), (None, "日本語"), (10, "word " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = rx.findall(lower(t or ""))
        m = min(10, len(w))
        for k in range(len(w) - m + 1) if m else ():
            windows.setdefault(tuple(w[k : k + m]), set()).update({str(i)} if i is not None else ())
    rows = decontaminate.find(df, bench, block_bytes=block_bytes).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and sum(r.contaminated for r in rows) > 5
    for r in rows:
        w = rx.findall(lower(texts[r.doc_id] or ""))
        hit, found = [False] * len(w), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (x := windows.get(tuple(w[k : k + m]))) is not None:
                    found |= x
                    hit[k : k + m] = [True] * m
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), sum(hit), len(found), any(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.clean_text == texts[r.doc_id] or rx.findall(lower(r.clean_text)) == [x for x, y in zip(w, hit) if not y]


def test_decontamination_stage(spark, tmp_path):
    bench = [(1, "alpha beta gamma"), (None, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "x alpha beta gamma y", 20, "kept"), (1, "alpha beta gamma", 16, "gone"), (None, "clean", 5, "kept"), (3, None, None, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, clean_text string")
    out = decontaminate.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(1, "x  y", 4, "kept"), (None, "clean", 5, "kept"), (3, None, None, "kept")], docs.schema).collect()))
    assert decontaminate.stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(3)
    seq = np.append(rng.integers(0, 5, 500), 0)
    index = decontaminate.FMIndex(seq, 4)
    patterns = rng.integers(1, 5, (50, 3))
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(seq) - 2) if (seq[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    copies = np.concatenate([np.tile(rng.integers(1, 9, 70), 3), [0]] * 4)  # long repeats
    order = decontaminate.suffix_array(copies)
    breaks = np.where(copies == 0, np.cumsum(copies == 0) - 10, copies)
    assert order.tolist() == sorted(range(len(copies)), key=lambda i: breaks[i:].tolist())
    assert len(index.positions) <= len(seq) // decontaminate.SAMPLE + (seq == 0).sum() + 1


def test_jaccard_equals_brute_force(spark):
    texts, df = corpus(spark)
    rx = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for t in texts:
        w = rx.findall(lower(t or ""))
        sets.append(frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    links = [sum(bool(a) and i != j and 100 * len(a & b) >= 90 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(df).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.near_join(df).collect()}
    assert got == {i: (len(s), label[i], links[i]) for i, s in enumerate(sets)}


def test_one_large_near_group_equals_brute_force(spark):
    rng = random.Random(8)
    base = ["b%d" % i for i in range(150)]
    texts = []
    for k in range(2000):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((0, 1, 1, 2, 3))):
            words[at] = "x%d" % rng.randrange(5)
        texts.append(" ".join(words))
    texts += [" ".join(["q%d" % i for i in range(40)] + base[:110])] * 3 + [None, "", "lone", "lone"]
    sets = [{" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if (w := (t or "").split()) else set() for t in texts]
    number = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number[x] for x in s]] = 1
    both, size = has @ has.T, has.sum(1)
    link = (100 * both >= 90 * (size[:, None] + size - both)) & (both > 0)
    label = np.arange(len(sets))
    while True:
        new = np.array([label[r].min() if r.any() else label[i] for i, r in enumerate(link)])
        if (new == label).all():
            break
        label = new
    np.fill_diagonal(link, False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.near_join(df).collect()}
    assert got == {i: (len(s), label[i], link[i].sum()) for i, s in enumerate(sets)}
    got = {r.doc_id: r.component_id for r in jaccard.near_components(df).collect()}
    assert got == dict(enumerate(label.tolist()))


def test_tiles_of_several_nodes_over_many_tasks(spark):
    rng = random.Random(3)
    named = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        for keys, hot in ((400, 0), (30, 0), (50, 600), (1, 300), (0, 0)):
            rows = [(rng.randrange(-9, 9), rng.randrange(-keys, keys)) for _ in range(4 * keys)] + [(rng.randrange(400), 5) for _ in range(hot)]
            rows += [(k, 1000 + k) for k in range(40 if keys else 0)]  # tiles of one node
            of = {}
            for node, key in rows:
                of.setdefault(key, set()).add(node)
            got = [tuple(r) for r in jaccard.shared_tiles(spark.createDataFrame(rows, "node long, key long").repartition(5)).collect()]
            assert sorted(got) == sorted((k, n) for k, nodes in of.items() if len(nodes) > 1 for n in nodes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n)), "".join("ba"[bin(i).count("1") & 1] for i in range(n))


def test_words_of_one_structure_are_told_apart(spark):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    texts = [x for n in (64, 1024, 2048, 4096) for x in thue_morse(n)]
    texts += [f"{t} {t[::-1]} same" for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert all(r.component_id == r.doc_id and r.n_links == 0 for r in jaccard.near_join(df).collect())
    tk, sp = Tokenizer.from_file(P.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = {}
    for r in packing._public(df).collect():
        ids = tk.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        own[r.doc_id] = own.get(r.doc_id, 0) + r.length - len(ids) * (r.start == 0)
    assert own == dict.fromkeys(range(len(texts)), 0)
    assert {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, P.path("piece_bpe_32k.model"), 10).collect()} == {i: len(sp.encode(t)) for i, t in enumerate(texts)}


def test_near_stage_keeps_one_row_of_each_group(spark):
    rows = [(None, "one two three four five six", "en"), (None, "one two three four five six", "fr"), (7, "one two three four five six", "x"), (7, "one two three four five six", "y"), (3, "other words are in this one", "z"), (3, "nothing of those can be found here", "z"), (None, "a text of its own for a row without id", "z"), (None, None, "n"), (8, "", "n"), (8, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    kept = sorted((str(r.doc_id), str(r.text)) for r in jaccard.stage(spark, df, "").collect())
    assert jaccard.stage(spark, df, "").columns == df.columns
    assert kept == sorted([("7", rows[2][1]), ("3", rows[4][1]), ("3", rows[5][1]), ("None", rows[6][1]), ("None", "None"), ("8", ""), ("8", "None")])
    named = {(r.doc_id, r.component_id) for r in jaccard.near_join(df).collect()}
    assert (None, 7) in named and (None, None) in named and (3, 3) in named


def test_near_stage_equals_brute_force_of_five_words(spark, tmp_path):
    rng = random.Random(11)
    texts, _ = corpus(spark, 120)
    for k in range(60):  # one to four separate words replaced: similarities on both sides of 80 per cent
        words = ["c%d_%d" % (k, rng.randrange(10**6)) for _ in range(rng.randint(20, 120))]
        texts.append(" ".join(words))
        for at in rng.sample(range(0, len(words), 7), min(len(words) // 7, k % 4 + 1)):
            words[at] = "other%d" % at
        texts.append(" ".join(words))
    hundred = ["z%d" % i for i in range(100)]
    texts.append(" ".join(hundred))
    texts.append(" ".join(["first" if i == 30 else "second" if i == 60 else w for i, w in enumerate(hundred)]))
    rx = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for t in texts:
        w = rx.findall(lower(t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    label, pairs = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                pairs += sets[i] != sets[j]
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert pairs > 40
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r.doc_id for r in jaccard.stage(spark, df, str(tmp_path)).collect()}
    assert kept == {i for i, x in enumerate(label) if x == i}
    assert len(texts) - 2 in kept and len(texts) - 1 not in kept


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "x long, y long")
    assert {r.node: r.comp for r in components(links).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


def segmentations(raw, pieces):
    """Log of the summed probability of all segmentations, by trying every one from the left."""
    if not raw:
        return 0.0
    ways = [pieces.byte_logp + segmentations(raw[1:], pieces)]
    for size in range(1, len(raw) + 1):
        h = np.uint64(Block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0, np.zeros(1, bool)).hashes(np.array([0]), np.array([size]))[0])
        if h in pieces.hashes:
            ways.append(pieces.logp[np.searchsorted(pieces.hashes, h)] + segmentations(raw[size:], pieces))
    return np.logaddexp.reduce(ways)


def test_lattice_sums_all_segmentations_of_all_sizes():
    words = [b" ab", b" the", b" naive", " é".encode(), b" qqqqqqq", b" \xff\xfe", b" international"]
    cuts = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    block = Block(np.frombuffer(b"".join(words), np.uint8), cuts, 0, np.zeros(len(words), bool))
    pieces = lattice.Pieces.existing(P.path("piece_bpe_32k.model"))
    assert pieces.sizes[-1] == max(len(p.replace("\u2581", " ").encode()) for p in tokencount.read_pieces(P.path("piece_bpe_32k.model"))) > 24
    assert np.allclose(lattice.marginals(block, pieces), [segmentations(w, pieces) for w in words])
    assert np.exp(pieces.logp).sum() + 256 * np.exp(pieces.byte_logp) + pieces.end_share == pytest.approx(1)


def test_lattice_scores_equal_brute_force(spark):
    """Counts, base and score of every row, with repeated and null keys and clashing columns."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    texts = [t if t is None or len(t) < 200 else t[:30] for t in ODD] + [" ".join(rng.choices(["ab", "the", "Net", "é", "cat"], k=rng.randint(1, 6))) for _ in range(60)]
    rows = [(None if i % 9 == 4 else i // 2, t, i % 4 != 1, "w", 1, 0.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, trained boolean, word string, h int, score double").repartition(3)
    rx = re.compile(r"[^\x20\x09-\x0D]+")
    counts, ends = {}, 0
    for _, t, f, *_ in rows:
        if f:
            ends += 1
            for x in rx.findall(lower(t or "")):
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    pieces = lattice.calibrate(spark.createDataFrame([(bytearray(w.encode()), c) for w, c in counts.items()], "word binary, trained long"), lattice.Pieces.existing(P.path("piece_bpe_32k.model")), ends)
    memo = {w: segmentations(b" " + w.encode(), pieces) / np.log(10) for w in {x for t in texts for x in rx.findall(lower(t or "")) if len(x) < 12}}
    want = []
    for d, t, *_ in rows:
        w = rx.findall(lower(t or ""))
        lm = sum(memo[x] for x in w) + np.log10(pieces.end_share) if all(x in memo for x in w) else None
        want.append((-1 if d is None else d, len(w) + 1, sum(x in counts for x in w) + 1, n, sum(base(counts.get(x, 0)) for x in w) + base(ends), lm))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lattice.score(df, F.col("trained"), P.path("piece_bpe_32k.model")).collect())
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=lambda x: x[:5] + (x[5] or 0,))):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and (b[5] is None or a[5] == pytest.approx(b[5]))
    assert lattice.score(df.where("false"), F.col("trained"), P.path("piece_bpe_32k.model")).count() == 0
    untrained = lattice.score(df, F.lit(False), P.path("piece_bpe_32k.model")).collect()
    assert len(untrained) == len(rows) and all(r.score < 0 and r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def test_shards_are_exact_and_uniform(spark):
    from pyspark.sql import functions as F

    rows = [(None if i % 3 == 0 else i, i, 0, "x") for i in range(4000)]  # a third of the rows have one key
    df = spark.createDataFrame(rows, "doc_id long, n long, SHARD int, row string").repartitionByRange(7, "n")
    out = sharding.shard_rows(df, 16, rows_each=50)
    assert out.columns == ["doc_id", "n", "row", "shard", "slot"]
    got = out.collect()
    by, where = {}, {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        where[r.n] = (r.shard, r.slot)
    assert sorted(where) == list(range(4000))
    assert all(sorted(s) == list(range(250)) for s in by.values()) and len(by) == 16
    for part in ([i for i in where if i % 3 == 0], range(500), range(3500, 4000)):
        counts = np.bincount([where[i][0] for i in part], minlength=16)
        assert ((counts - len(part) / 16) ** 2 / (len(part) / 16)).sum() < 45  # chi-square, 15 degrees of freedom
    slots = np.array([where[i][1] for i in range(4000)])
    assert abs(np.corrcoef(slots, np.arange(4000))[0, 1]) < 0.08
    assert sharding.shard_rows(df.where("false"), 16).count() == 0
    few = {(r.shard, r.slot) for r in sharding.shard_rows(df.where("n < 3"), 16).collect()}
    assert len(few) == 3 and {s for _, s in few} == {0}


def test_shard_query_handles_nulls_and_repeats(spark, tmp_path):
    rows = [(i % 5 or None, t) for i, t in enumerate(ODD)] * 2
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op7_sharding(spark, str(tmp_path)).collect()
    want = sorted((d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    assert {r.grown_shard for r in got} == {None} and {r.law for r in got} == {"rows"}


def test_hypergeometric_draws_follow_the_law():
    import math

    line = sharding.matrix([30, 0, 70], [40, 60], 1)
    assert [sum(x) for x in line] == [30, 0, 70] and [sum(x) for x in zip(*line)] == [40, 60]
    rng, good, bad, draws = random.Random(5), 13, 20, 12
    seen = np.bincount([sharding.hypergeometric(rng, good, bad, draws) for _ in range(20_000)], minlength=13)
    pmf = np.array([math.comb(good, k) * math.comb(bad, draws - k) for k in range(13)]) / math.comb(good + bad, draws)
    at = pmf > 1e-3
    assert ((seen[at] - 20_000 * pmf[at]) ** 2 / (20_000 * pmf[at])).sum() < 35
    big = [sharding.hypergeometric(rng, 10**9, 15 * 10**9, 10**6) for _ in range(300)]
    sd = math.sqrt(10**6 / 16 * 15 / 16)
    assert abs(np.mean(big) - 62_500) < 5 * sd / math.sqrt(300) and 0.85 < np.std(big) / sd < 1.15


def test_transport_stream_round_trip_and_faults():
    for n in (0, 1, 192, 3072, 3073, 50_000):
        p = mpegts.pad(b"q" * n)
        assert mpegts.demux(mpegts.mux(p)).payload() == p
    m = mpegts.mux(mpegts.pad(b"z" * 20_000))
    lost = mpegts.demux(m[: 188 * 5] + m[188 * 6 :])
    assert (lost.continuity_errors, lost.pes_errors) == (1, 1)
    assert mpegts.demux(b"").n_packets == 0 and mpegts.demux(b"abc").sync_errors == 1


def packets_of(stream):
    """A plain reader of transport streams, a packet at a time: PES packets of each PID as (pts, random access, payload)."""

    def crc(data):
        c = 0xFFFFFFFF
        for byte in data:
            for k in range(7, -1, -1):
                c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if (c >> 31) ^ (byte >> k & 1) else 0)
        return c

    tables, pes, counters = {}, {}, {}
    assert len(stream) % 188 == 0
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47 and not p[1] & 0x80
        pid, start, control, counter = (p[1] & 0x1F) << 8 | p[2], bool(p[1] & 0x40), p[3] >> 4 & 3, p[3] & 15
        body, random_access = p[4:], False
        if control & 2:
            body, flags = p[5 + p[4] :], p[5] if p[4] else 0
            random_access = bool(flags & 0x40)
            if flags & 0x10:
                assert p[4] >= 7
        if pid in (0, 0x1000):
            section = body[1 + body[0] :]
            n = 3 + ((section[1] & 15) << 8 | section[2])
            assert crc(section[:n]) == 0
            tables[pid] = section[:n]
            continue
        assert counter == counters.get(pid, -1) + 1 & 15
        counters[pid] = counter
        if start:
            pes.setdefault(pid, []).append([random_access, b""])
        pes[pid][-1][1] += body
    assert (tables[0][8] << 8 | tables[0][9], (tables[0][10] & 0x1F) << 8 | tables[0][11]) == (1, 0x1000)
    (pid,) = pes
    assert tables[0x1000][12] == 6 and (tables[0x1000][13] & 0x1F) << 8 | tables[0x1000][14] == pid
    out = []
    for rap, data in pes[pid]:
        assert data[:3] == b"\0\0\1" and data[4] << 8 | data[5] == len(data) - 6
        t = data[9:14]
        assert t[0] >> 4 == 2 and t[0] & t[2] & t[4] & 1
        out.append(((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1, rap, data[9 + data[8] :]))
    return out


def test_streams_equal_a_plain_reader(spark):
    import hashlib

    texts = ODD + ["z" * 3071, "y" * 3072, "x" * 200_001, "é" * 9000]
    df = spark.createDataFrame([(i % 7 or None, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, MEDIA string").coalesce(2)
    media = mpegts.to_media(df)
    assert media.columns == ["doc_id", "text", "media"]
    stored = {r.text: bytes(r.media) for r in media.collect()}
    by_text = {}
    for r in mpegts.elementary_packets(media, "text").collect():
        by_text.setdefault(r.text, []).append((r.pts, r.random_access, bytes(r.payload)))
    for r in mpegts.digest(df).collect():
        pass
    digests = {}
    for row, r in zip(df.collect(), mpegts.digest(df).collect()):
        assert row.doc_id == r.doc_id
        digests[row.text] = r
    for t in texts:
        want = packets_of(stored[t])
        payload = b"".join(p for *_, p in want)
        raw = (t or "").encode()
        assert payload.rstrip(b" ") == raw.rstrip(b" ") and len(payload) == max(192, -(-len(raw) // 192) * 192)
        assert by_text[t] == want
        r = digests[t]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[t]), hashlib.sha256(stored[t]).hexdigest())
        assert r.pts == [p for p, *_ in want] and r.random_access == [p for p, rap, _ in want if rap]


def test_revisits(spark):
    c = "id long, url string, t long, etag string, last_modified string, headers map<string,string>"
    responses = spark.createDataFrame([(1, "http://www.A.org/x/", 10, "e1", None, {"etag": "e1", "server": "s"}, "one"), (2, "https://a.org/x#f", 20_000_000, "e2", None, {}, "two"), (2, "https://a.org/x", 19_000_000, "e0", None, {}, "differs"), (None, "https://a.org/x", 25_000_000, "e1", None, {}, "unnamed")], c + ", body string")
    revisits = spark.createDataFrame([(5, "https://a.org/x?utm_source=q", 1_000_000, "e1", None, {"etag": "e1", "server": "no"}), (6, "https://a.org/x", 30_000_000, "e1", None, {}), (7, "https://a.org/x", 10, "e1", None, {}), (8, None, 99, "e1", None, None), (9, "https://a.org/x", 20_000_001, None, None, {}), (9, "https://a.org/x", 20_000_001, None, None, {}), (None, "https://a.org/x", 11, "e1", None, None)], c)
    rows = warc.resolve(revisits, responses).collect()
    got = {r.id: (r.response_id, r.status, r.body, r.headers) for r in rows}
    assert len(rows) == 7 and sum(r.id == 9 for r in rows) == 2
    assert got[5] == (1, "resolved", "one", {"server": "s", "etag": "e1"}) and got[None][:3] == (1, "resolved", "one")
    assert [got[i][:3] for i in (6, 7, 8, 9)] == [(2, "mismatch", None), (None, "orphan", None), (None, "orphan", None), (2, "mismatch", None)]
    empty, none = responses.where("false"), revisits.where("false")
    assert {r.status for r in warc.resolve(revisits, empty).collect()} == {"orphan"} and warc.resolve(none, responses).count() == 0


def test_revisits_equal_brute_force(spark):
    """Many captures of one URL, ties in time, by trying every response."""
    rng = random.Random(9)
    c = "id long, url string, t long, etag string, last_modified string, headers map<string,string>"
    urls = ["https://hot.org/"] * 6 + ["https://b.org/p", "https://c.org/?q=1"]
    responses = [(i, rng.choice(urls), rng.randrange(40) * 1800, rng.choice("ab"), "m" + rng.choice("xy"), {}, "body %d" % i) for i in range(200)]
    revisits = [(1000 + i, rng.choice(urls), rng.randrange(40) * 1800, rng.choice(["a", "b", None]), rng.choice(["mx", None]), {}) for i in range(300)]
    got = {r.id: (r.response_id, r.status, r.body) for r in warc.resolve(spark.createDataFrame(revisits, c), spark.createDataFrame(responses, c + ", body string")).collect()}
    for i, url, t, etag, modified, _ in revisits:
        before = [r for r in responses if r[1] == url and r[2] < t]
        if not before:
            assert got[i] == (None, "orphan", None)
            continue
        r = max(before, key=lambda r: (r[2], r[0]))
        same = r[3] == etag if etag else r[4] == modified
        assert got[i] == ((r[0], "resolved", r[6]) if same else (r[0], "mismatch", None))


def test_records_are_read(spark):
    head = "WARC/1.1\r\nWARC-Type: %s\r\nWARC-Target-URI: http://a.org/x\r\nWARC-Date: %s\r\nWARC-Record-ID: <urn:uuid:%s>\r\n\r\n"
    full = head % ("response", "2024-01-01T00:00:10Z", "r1") + "HTTP/1.1 200 OK\r\nETag: \"e\"\r\nLast-Modified: Mon\r\nServer: s: t\r\n\r\nbody\r\n\r\nmore"
    again = head % ("revisit", "2024-02-01T00:00:00Z", "r2") + "HTTP/1.1 304 Not Modified\r\nETag: \"e\"\r\nDate: now\r\n\r\n"
    rows = [(full,), (again,), (None,), ("",), ("no record",), (head % ("request", "x", "r3"),)]
    revisits, responses = warc.from_records(spark.createDataFrame(rows, "record string"))
    (r,) = responses.collect()
    assert (r.id, r.url, r.t, r.etag, r.last_modified, r.body) == ("<urn:uuid:r1>", "http://a.org/x", 1704067210, '"e"', "Mon", "body\r\n\r\nmore")
    assert r.headers == {"etag": '"e"', "last-modified": "Mon", "server": "s: t"}
    (x,) = warc.resolve(revisits, responses).collect()
    assert (x.id, x.status, x.body, x.headers["date"]) == ("<urn:uuid:r2>", "resolved", r.body, "now")


def test_classifiers_on_odd_rows_and_held_out(spark):
    rng = random.Random(1)
    bad, good, fr = ["idiotic", "scumbag"], ["tree%d" % i for i in range(40)], ["été%d" % i for i in range(40)]
    rows = []
    for i in range(400):
        w = rng.choices(fr if i % 2 else good, k=30) + (rng.choices(bad, k=2) if i % 5 == 0 else [])
        rows.append((i, " ".join(w), "fr" if i % 2 else "en", i % 5 == 0))
    docs = spark.createDataFrame([(i, t, l) for i, t, l, _ in rows] + [(1000 + k, t, None) for k, t in enumerate(ODD)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, _, x in rows if i < 300], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 300"), labels)
    tox = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert all(tox[i] == int(x) for i, _, _, x in rows) and len(tox) == 400 + len(ODD)
    lang = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs.where("doc_id < 300"))).collect()}
    assert all(lang[i][0] == l for i, _, l, _ in rows)
    assert [lang[1000 + k][0] for k in range(4)] == ["und"] * 4


def test_risk_gradient_is_that_of_the_risk_and_reversed_below_zero():
    rng = np.random.default_rng(2)
    for shift, reversed_ in ((0.0, False), (-6.0, True)):
        g, prior, n_p = rng.normal(size=30), 0.3, 10
        g[10:] += shift
        g[:10] -= shift
        loss = lambda x: np.logaddexp(0, -x)

        def risk(x):
            positive, negative = prior * loss(x[:n_p]).mean(), loss(-x[n_p:]).mean() - prior * loss(-x[:n_p]).mean()
            return -negative if negative < 0 else positive + negative

        got, back = toxicity.risk_gradient(g, n_p, prior)
        assert back == reversed_
        eye = np.eye(30) * 1e-6
        assert np.allclose(got, [(risk(g + e) - risk(g - e)) / 2e-6 for e in eye], atol=1e-6)


def test_toxicity_edge_cases(spark, tmp_path):
    bad = [(i, "vile brute text %d" % i, 42.0, "p") for i in range(40)]
    good = [(100 + i, "kind tree river %d" % i, 42.0, "p") for i in range(120)]
    docs = spark.createDataFrame(bad + good + [(None, "vile brute", 42.0, "p"), (900, None, 42.0, "p"), (900, "", 42.0, "p")], "doc_id long, text string, Score double, predicted string")
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(120)] + [(None, 1), (99999, 1), (1, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = toxicity.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {(r.doc_id, r.text) for r in out.collect()} == {(r[0], r[1]) for r in good} | {(900, None), (900, "")}
    assert {(r.Score, r.predicted) for r in out.collect()} == {(42.0, "p")}
    assert toxicity.stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(abs(r.score) < 1e-9 and r.predicted == 0 for r in toxicity.score(docs, nothing).collect())
    assert toxicity.score(docs, nothing).columns == ["doc_id", "text", "score", "predicted"]


def test_pairwise_machines_separate_languages_of_one_family(spark):
    rng = random.Random(3)
    words = {"es": "que los una para con esta pero ciudad hombre año niña calle".split(), "pt": "que os uma para com esta mas cidade homem ano menina rua não".split(), "it": "che gli una per con questa ma città uomo anno bambina strada".split(), "en": "the of and that with this but city man year girl street".split()}
    langs = sorted(words)
    rows = [(i, " ".join(rng.choices(words[langs[i % 4]], k=25)), langs[i % 4]) for i in range(400)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, LANG_PRED string, score string")
    model = langid.fit(docs.where("doc_id < 280"))
    assert [m for m in model.machines if m[0] == "pair"] == [("pair", "es", "it"), ("pair", "es", "pt"), ("pair", "it", "pt")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert all(got[i][0] == x and 0 <= got[i][1] <= 1 for i, _, x in rows if i >= 280)
    kept = langid.stage(spark, docs, "")
    assert kept.columns == docs.columns and {(r.LANG_PRED, r.score) for r in kept.collect()} == {("x", "y")}
    one = langid.fit(docs.where("lang = 'es'"))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, one).collect()} == {("es", 1.0)}
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs.where("false"))).collect()} == {("und", 0.0)}


def test_language_stage_rejects_unrecognised_texts_only(spark):
    rng = random.Random(4)
    words = {"en": ["the%d" % i for i in range(30)], "fr": ["été%d" % i for i in range(30)]}
    rows = [(i, " ".join(rng.choices(words[l], k=25)), l) for i, l in enumerate(["en", "fr"] * 60)]
    odd = [(1000, None, "en"), (1001, "12 34 !!", "en"), (1002, "", None), (1003, " ".join(words["fr"]), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    kept = langid.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} | {1003}
    assert langid.stage(spark, docs, "", min_score=1.1).count() == 0
    unlabelled = langid.stage(spark, docs.select("doc_id", "text").selectExpr("*", "cast(null as string) lang"), "")
    assert {r.doc_id for r in unlabelled.collect()} == {r[0] for r in rows} | {1003}
    assert langid.stage(spark, docs.where("false"), "").count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], COLUMNS)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert packing._public(docs).count() == 0
    assert decontaminate.find(docs, bench).count() == 0
    assert jaccard.near_components(docs).count() == 0
    assert jaccard.near_join(docs).count() == 0
    assert jaccard.stage(spark, docs, "").count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    assert langid.predict(docs, langid.fit(docs)).count() == 0
    assert mpegts.digest(docs).count() == 0
