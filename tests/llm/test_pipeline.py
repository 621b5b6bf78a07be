"""The corpus pipeline against a plain version of its five stages."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from protolens.llm import near_copies, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(11)
    words = [f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fi", "go") for b in ("ra", "na", "to", "mi", "su", "le", "ka", "po")]
    prose = lambda n: " ".join(" ".join(r.choice(words) for _ in range(8)).capitalize() + "." for _ in range(n))
    rows = []
    add = lambda text, source: rows.append((len(rows), text, "en", source, len(text or "")))
    for i in range(120):
        add(prose(r.randrange(4, 12)), f"s{i % 4}")
    for i in range(50):
        add(" ".join(r.choice(words).upper() + "!!" + r.choice("*#$%") * 3 for _ in range(40)), f"s{i % 4}")
    for i in range(20):
        add(rows[i][1], "s1")
    for i in range(20, 40):
        own = rows[i][1].split(" ")
        own[len(own) // 2] = "changed"
        add(" ".join(own), None)
    add(None, "s0")
    add("", "s2")
    return rows, [(d, int(not 120 <= d < 170), 0) for d in range(170)]


def plain(rows, labels):
    stats = {r[0]: quality.statistics(r[1]) for r in rows}
    use = sorted((hashlib.md5(str(d).encode()).hexdigest(), d, q) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 3 != 1)
    use = sorted((d, q) for _, d, q in use)
    forest = quality.fit(np.array([stats[d] for d, _ in use]), np.array([q for _, q in use], float))
    rows = [r for r in rows if forest.score(np.array([stats[r[0]]]))[0] >= 0.5]
    last = {}
    for r in rows:
        last[r[1] or ""] = max(last.get(r[1] or "", -1), r[0])
    rows = [r for r in rows if last[r[1] or ""] == r[0]]
    group = {r[0]: r[0] for r in rows}
    prints = {r[0]: simhash.fingerprint(r[1], near_copies.PAIR) for r in rows}
    sets = {r[0]: near_copies.shingles(r[1]) for r in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in group:
        for b in group:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= near_copies.WIDE and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    rows = [r for r in rows if find(r[0]) == r[0]]
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest(), r[0]))
    names = sorted(s for s in by if s is not None) + ([None] if None in by else [])
    weight, total = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}, {s: sum(size[d] for _, d in by[s]) for s in names}
    target, left, free = {}, 1.5 * sum(total.values()), set(names)
    while over := [s for s in free if weight[s] * left / sum(weight[t] for t in free) > 2 * total[s]]:
        for s in over:
            target[s] = 2.0 * total[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    target |= {s: weight[s] * left / sum(weight[t] for t in free) for s in free}
    copies = {}
    for s in names:
        epochs, rest = divmod(int(target[s] + 0.5), total[s]) if total[s] else (0, 0)
        for _, d in sorted(by[s]):
            part = max(0, min(size[d], rest))
            rest -= size[d]
            copies[d] = (epochs + (part > 0 and 2 * part >= size[d])) * (size[d] > 0)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        row = (r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())
        out[row] += copies[r[0]]
    return +out


def test_run(spark, tmp_path):
    rows, labels = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = plain(rows, labels)
    assert got == want
    assert len(want) > 60 and max(want.values()) == 2


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
