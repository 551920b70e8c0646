import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprint

TOP = -(1 << 63) + (1 << 62)


def _sketch(text):
    words = [xxhash.xxh64(w.encode(), 42).intdigest() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]

    def shingle(part):
        seed = 42
        for v in part:
            seed = xxhash.xxh64(struct.pack("<Q", v), seed).intdigest()
        return seed - (1 << 64) if seed >> 63 else seed

    hashes = sorted({shingle(words[i:i + 5]) for i in range(max(1, len(words) - 4))}) if words else []
    return [h for h in hashes if h < TOP] or hashes[:1]


def _brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    out = []
    for n, (i, t) in enumerate(rows):
        follow = rows[(n + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[:len(t) - q] + follow[:q]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), _sketch(t), _sketch(edited), _sketch(follow)))
    return sorted(out, key=repr)


def _got(docs):
    rows = fingerprint.fingerprints(docs).collect()
    return sorted(((r["doc_id"], r["n_chars"], hashlib.sha256(r["edited"].encode()).hexdigest(), r["sketch"], r["edited_sketch"], r["next_sketch"]) for r in rows), key=repr)


def test_brute_force_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([i, i * i * 1000, -i]), " ".join(rng.choice(["a", "bb", "ccc", "é", "漢字", "x\ty"]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    base = docs.withColumn("key", F.col("doc_id"))
    got = {(r["doc_id"], r["text"]): r["next_text"] for r in fingerprint.with_next(base, "key", "text", range_docs=1).collect()}
    line = sorted(rows, key=lambda r: (r[0], r[1].encode()))
    for (i, t), (_, follow) in zip(line, line[1:] + line[:1]):
        if line.count((i, t)) == 1:
            assert got[i, t] == follow
    assert _got(docs) == _brute(rows)


def test_odd_rows(odd_docs):
    assert _got(odd_docs) == _brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])


def test_single_row_and_empty(spark, no_docs):
    docs = spark.createDataFrame([(5, "one two three four five six seven eight")], "doc_id bigint, text string")
    assert _got(docs) == _brute([(5, "one two three four five six seven eight")])
    assert fingerprint.fingerprints(no_docs).count() == 0


def test_estimates(spark):
    words = [f"w{i}" for i in range(4000)]
    docs = spark.createDataFrame([(1, " ".join(words[:1000])), (2, " ".join(words))], "doc_id bigint, text string")
    rows = fingerprint.with_sketch(docs, "text", "sketch")
    pair = rows.alias("a").join(rows.alias("b"), F.expr("a.doc_id = 1 and b.doc_id = 2"))
    got = pair.select(fingerprint.likeness(F.col("a.sketch"), F.col("b.sketch")).alias("j"), fingerprint.containment(F.col("a.sketch"), F.col("b.sketch")).alias("c"),
                      (fingerprint.merged(F.col("a.sketch"), F.col("b.sketch")) == F.col("b.sketch")).alias("m")).first()
    assert abs(got["j"] - 0.25) < 0.05 and got["c"] == 1.0 and got["m"]
