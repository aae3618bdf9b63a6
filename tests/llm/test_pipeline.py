"""The pipeline against its stages put together by hand, on the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import test_llm_operators as brute

import corpus_pipeline
from boundarylens.llm import packing, queries, resampling


def test_stages_in_order(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.collect()}
        assert now and now <= ids
        ids = now
    packed = corpus_pipeline.pack_sequences(spark, docs, data)
    direct = packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(packed) == key(direct)


def brute_run(spark, docs, labels):
    """The five stages in plain Python on (doc_id, text, source): the pieces (doc_id, piece, start, length, crc) with how often each stands."""
    from tokenizers import Tokenizer

    _, keys, lowest = brute.brute_sample(spark, [d[:2] for d in docs], labels)
    docs = [d for d, k in zip(docs, keys, strict=True) if k >= lowest - 1e-9]
    classes = brute.brute_classes([d[:2] for d in docs])
    docs = [d for d in docs if classes[d[0]][0] == 0 or classes[d[0]][1] == d[0]]
    found = collections.defaultdict(list)
    for i, a, b in brute.brute_random_spans([t for _, t, _ in docs], 0.001, 0.001):
        found[i].append((a, b))
    clean = []
    for i, (doc, text, source) in enumerate(docs):
        if text is not None:
            spans = [*found[i], *[m.span() for m in brute.ASSIGN.finditer(text) if len(m[2]) >= 8], *[m.span() for m in re.finditer("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", text)]]
            out, at, masked = [], 0, 0
            for a, b in sorted(spans):
                if a >= masked:
                    out += [text[at:a], "<secret>"]
                at = masked = max(masked, b)
            text = "".join([*out, text[at:]])
        clean.append((doc, text, source))
    sizes = collections.Counter()
    for _, text, source in clean:
        sizes[source] += len(brute.words(text))
    targets, mixed = brute.brute_targets(sizes), []
    for source, total in sizes.items():
        budget = int(targets[source] + 0.5)
        epochs, rest = divmod(budget, total) if total else (0, 0)
        own = sorted(((hashlib.md5(f"7/{d}/{len(brute.words(t))}".encode()).hexdigest(), d, t) for d, t, s in clean if s == source))
        for _, d, t in own:
            w = brute.words(t)
            if w:
                mixed += [(d, t)] * epochs
                if rest >= len(w):
                    mixed.append((d, t))
                elif rest > 0:
                    mixed.append((d, b" ".join(w[:rest]).decode()))
                rest = max(0, rest - len(w))
    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.Counter()
    for d, t in mixed:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            pieces[d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
    return pieces


def test_run_against_brute_force(spark, tmp_path):
    r = random.Random(31)
    good = "The house stands by a river, quiet water. Stone and bird were there in autumn".split()
    line = lambda pool, n: " ".join(r.choice(pool) + str(r.randrange(30)) for _ in range(n))
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [line(good, r.randrange(30, 400)) for _ in range(70)]
    texts += [t.replace("house", "home", 1) for t in texts[:12]] + [texts[3]] * 4
    texts += [line(["BUY!!", "NOW!!", "###", "$$$", "%%%"], 80) for _ in range(25)]
    texts += [f"{line(good, 40)} key {''.join(r.choice(base62) for _ in range(40))} and password = hunter2hunter2 {line(good, 9)}" for _ in range(12)]
    texts += [None, "", "one", line(good, 5000)]
    docs = [(i, t, ["web", "books", None, "code"][r.choice([0, 0, 0, 1, 2, 3])]) for i, t in enumerate(texts)]
    labels = {i: int(not (t or "").startswith(("BUY", "NOW", "#", "$", "%"))) for i, t, _ in docs if i % 2 and t}
    spark.createDataFrame([(*d[:2], "en", d[2], 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = brute_run(spark, docs, labels)
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == expected
    kept = {k[0] for k in expected}
    # The mix itself leaves out what a source has over its target.
    assert len(kept & set(range(70))) > 30 and not kept & {i for i, t, _ in docs if t and t.startswith("###")}
    at = collections.defaultdict(list)
    for x in got:
        at[x.sequence_id].append((x.offset, x.length))
    assert all(sum(n for _, n in held) <= 2048 for held in at.values())


def test_classifier_keeps_labelled_good_documents(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in resampling.resampled_documents(docs, labels).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert sum((i in kept) == bool(q) for i, q in marks.items()) >= 0.95 * len(marks)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
