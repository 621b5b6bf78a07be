import hashlib
import re
from collections import defaultdict

from conftest import CLASHING

from protolens.llm import mixing


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, size(r[1])))
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(x[3] for x in by[s]) for s in names}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > 2 * total[s] + 1e-9]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: weight[s] * level for s in open_}
    out = []
    for s in names:
        budget = int(target[s] + 0.5)
        epochs, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for key, has, i, n in sorted(by[s]):
            out.append((i if has else None, n, total[s], round(target[s], 6), epochs * n + max(0, min(n, rest))))
            rest -= n
    return sorted(out, key=str)


def test_mix(odd_docs, odd_rows, no_docs):
    rows, _ = mixing.mix(odd_docs)
    got = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in rows.collect()), key=str)
    assert got == brute(odd_rows)
    assert mixing.mix(no_docs)[0].count() == 0


def test_block_borders(odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 2)
    rows, _ = mixing.mix(odd_docs)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in rows.collect()), key=str) == brute(odd_rows)


def test_documents(odd_docs, no_docs):
    rows, src = mixing.mix(odd_docs)
    out = mixing.mix_documents(odd_docs)
    assert out.columns == odd_docs.columns
    assert {tuple(r)[5:] for r in out.collect()} == {(7, "x", 1, *CLASHING)}
    words = defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    largest = max(r["size"] for r in rows.collect())
    for s in src.collect():
        assert abs(words[s["source"]] - s["target"]) <= largest
    assert mixing.mix_documents(no_docs).count() == 0
