"""Each operator against a brute-force version, on the odd corpus and on empty tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.llm import _hashing, _runtime, bpe, collocations, conversations, decontamination, graph, jaccard_join, lm_quality, repetition, resampling, sentencepiece_bpe, substring_dedup, token_files, toxicity, url_lists

from .conftest import ITEM, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def key(row) -> tuple:
    return (row["doc_id"] is None, row["doc_id"] or 0)


def tally(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


# 1


def covered(ws: list[str], n: int) -> set[int]:
    seen = Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    return {i + k for i in range(len(ws) - n + 1) if seen[tuple(ws[i : i + n])] > 1 for k in range(n)}


def brute_repetition(text: str | None) -> tuple:
    text = text or ""
    ws, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    chars = sum(map(len, ws))
    dup = [sum(len(ws[i]) for i in covered(ws, n)) for n in repetition.MAX_DUP_CHARS]
    repeat = len(covered(ws, 3))
    dup_lines = sum(len(w) for x in again for w in WORD.findall(x))
    failed = len(ws) < 50 or 100 * repeat > 50 * len(ws)
    kept = not failed and dup_lines <= 0.2 * chars and all(d <= m * chars for d, m in zip(dup, repetition.MAX_DUP_CHARS.values(), strict=True))
    return len(ws), chars, len(re.findall(r"[#*$%&|<>]", text)), len(again), repeat, dup_lines, *dup, failed, kept


def test_repetition(docs, rows, empty):
    got = tally(repetition.coverage(docs).collect())
    assert got == Counter((r["doc_id"], *brute_repetition(r["text"])) for r in rows)
    assert repetition.coverage(empty).count() == 0
    kept = repetition.kept_documents(docs)
    assert kept.columns == docs.columns and tally(kept.collect()) == tally(r for r in rows if brute_repetition(r["text"])[-1])


# 2


@pytest.mark.parametrize("heavy", [url_lists.HEAVY, 3])
def test_url_lists(spark, monkeypatch, heavy):
    monkeypatch.setattr(url_lists, "HEAVY", heavy)
    entries = [("example.com", 10, "block"), ("example.com", 20, "allow"), ("a.example.com", 15, "block"), ("b.org/x", 5, "block"), (None, 1, "block"), ("b.org", None, "block"), ("b.org", 8, "allow"), ("b.org", 8, "block"), ("b.org", 8, None)]
    urls = ["http://a.example.com/q", "HTTPS://u@Example.com:80/x?y", "http://b.org/x/y", "http://b.org/z", "no url", None, "http://example.com./", "http://c.net"]
    captures = [(i * 100 + t, u, t) for i, u in enumerate(urls) for t in (0, 5, 8, 10, 15, 19, 20, 99)] + [(1, "http://b.org/x", None), (1, "http://b.org/x", None)]
    df = url_lists.verdicts(spark.createDataFrame(captures, "page_id int, url string, fetched_at int"), spark.createDataFrame(entries, "key string, since int, action string"))

    def brute(url, t):
        m = re.match(url_lists.HOST, (url or "").lower())
        host = m[1].removesuffix(".") if m else ""
        labels = host.split(".")
        keys = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))] if host else []
        seg = re.match(url_lists.SEGMENT, url or "")
        keys = ([f"{host}/{seg[1]}"] if host and seg else []) + keys
        for k in keys:
            held = [(s, a) for e, s, a in entries if e == k and s is not None and t is not None and s <= t]
            if held:
                last = max(s for s, _ in held)
                return k, last, "block" if any(a == "block" for s, a in held if s == last) else "allow"
        return None, None, "none"

    assert tally(df.collect()) == Counter({(p, u, t, *brute(u, t)): 1 for p, u, t in set(captures)})
    assert url_lists.verdicts(spark.createDataFrame([], "page_id int, url string, fetched_at int"), spark.createDataFrame(entries, "key string, since int, action string")).count() == 0


# 3


def brute_components(rows) -> dict[int, tuple]:
    sets = []
    for r in rows:
        ws = WORD.findall(lower(r["text"]))
        sets.append(frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids: dict[int, list] = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r["doc_id"])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return {i: (len(s), least[find(i)], find(i)) for i, s in enumerate(sets)}


def test_jaccard_join(docs, rows, empty):
    want = brute_components(rows)
    assert tally(jaccard_join.linked(docs).collect()) == Counter((r["doc_id"], *want[i][:2]) for i, r in enumerate(rows))
    assert jaccard_join.linked(empty).count() == 0


def test_one_document_of_each_group(docs, rows):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute_components(rows)
    ids = sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and WORD.search(r["text"] or "")), key=str)
    # An id stands for its component; component ids are carried by rows of their own.
    assert set(ids) == {want[i][1] for i, r in enumerate(rows) if want[i][0] and want[i][1] is not None}
    assert len([r for r in kept.collect() if not WORD.search(r["text"] or "")]) == len([r for r in rows if not WORD.search(r["text"] or "")])


def test_exact_repeats_of_a_kept_document_stay_once(spark, docs, rows):
    kept = [r for r in jaccard_join.one_of_each(docs).collect() if WORD.search(r["text"] or "")]
    groups = {least for n, least, _ in brute_components(rows).values() if n}
    assert len(kept) == len(groups)
    texts = [(1, "a b c d e f", "z"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (2, "a b c d e f", "a"), (3, "other words here", "q"), (4, "", "e"), (4, "", "e")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(3)
    assert tally(jaccard_join.one_of_each(df).collect()) == Counter([(1, "a b c d e f", "y"), (3, "other words here", "q"), (4, "", "e"), (4, "", "e")])


def test_near_copies_that_few_pivots_reach(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(150):
        ws = list(base)
        for k in rnd.sample(range(80), rnd.randint(0, 5)):
            ws[k] = f"e{rnd.randint(0, 3)}"
        texts.append((i, " ".join(ws)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_components([{"doc_id": i, "text": t} for i, t in texts])
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.linked(df).collect()} == {i: want[i][1] for i in range(150)}


@pytest.mark.parametrize("small", [4])
def test_large_group_just_under_the_threshold(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rnd = random.Random(9)
    base, texts = [f"w{i}" for i in range(60)], []
    for i in range(90):  # most differ from one another by a little too much, and what they come from is not there
        ws = list(base)
        for k in rnd.sample(range(60), rnd.choice([1, 2, 2, 3])):
            ws[k] = f"e{rnd.randint(0, rnd.choice([2, 10**6]))}"
        texts.append((i, " ".join(ws[: rnd.choice([60, 60, 55])])))
    want = brute_components([{"doc_id": i, "text": t} for i, t in texts])
    got = jaccard_join.linked(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: want[i][1] for i in range(90)} and len({r["component_id"] for r in got}) > 20


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_hash_of_words_ignores_where_they_stand():
    from loomspark.llm import _hashing as H

    data = np.frombuffer("ab c\nab  d".encode(), np.uint8)
    a, b, text = H.words(data, np.array([0, 5, 10]))
    spans = H.Prefix(data).span(a, b)
    assert spans[0] == spans[2] != spans[1] and text.tolist() == [0, 0, 1, 1]
    keys = np.array([5, 7, 5, 9, 5], np.uint64)
    assert H.repeated(keys).tolist() == [True, False, True, False, True] and H.later(keys).tolist() == [False, False, True, False, True]


# 4


def test_conversations(spark):
    base = [("user", "hi"), ("assistant", "yo <|end|>"), ("user", None), (None, "d"), ("user", "e")]
    logs = {1: base[:2], 2: base[:4], 3: base, 4: base[:4], 5: [("user", "other")], 6: base, 7: [("user", "hi"), ("assistant", "no")], None: [("user", "lost")]}
    log = [(c, k, *t, "x") for c, ts in logs.items() for k, t in enumerate(ts)]
    log += [log[0], (8, None, "user", "hi", "x"), (8, 600, "user", "later", "x"), (9, None, "user", "hi", "x")]
    df = spark.createDataFrame(log, "conv_id long, turn long, role string, text string, block string").repartition(3)
    got = {r["conv_id"]: r for r in conversations.rendered(df).collect()}
    assert set(got) == {3, 5, 7, 8} and got[3]["n_turns"] == 5 and got[3]["n_copies"] == 2
    assert got[7]["chat"] == "<|user|>\nhi<|end|>\n<|assistant|>\nno<|end|>\n" and "yo <\\|end|><|end|>" in got[3]["chat"]
    assert conversations.rendered(df.limit(0)).count() == 0


def test_conversations_longer_than_a_block(spark):
    n = 3 * conversations.BLOCK + 5
    log = [(c, k, "user", f"t{k}") for c, m in ((1, n), (2, n - 1), (3, conversations.BLOCK), (4, 1)) for k in range(m)] + [(5, 0, "user", "t1")]
    got = conversations.maximal(conversations.turns(spark.createDataFrame(log, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((r["conv_id"], r["n_turns"]) for r in got) == [(1, n), (5, 1)]


# 5


def test_toxicity_learns_words_and_stems(spark):
    rnd = random.Random(2)
    clean = ["".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(60)]
    docs, labels = [], []
    for i in range(400):
        ws = [rnd.choice(clean) for _ in range(rnd.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            ws.insert(rnd.randint(0, len(ws)), rnd.choice(["zonk", "blurgh"]) if i % 8 else "quuxo" + rnd.choice(clean))
        docs.append((i, " ".join(ws), "en" if i % 8 else "de", "k"))
        labels.append((i, 0, int(toxic)))
    docs += [(None, "zonk", None, "k"), (900, None, None, "k"), (901, "", "en", "k"), (0, docs[0][1], "en", "k")]
    labels += [(None, 0, 1), (1, 0, None), (2, 0, labels[2][2])]
    d, t = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.scores(d, t).collect()
    truth = dict((i, y) for i, _, y in labels if y is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got) and len(got) == len(docs)
    kept = toxicity.clean_documents(d, t)
    assert kept.columns == d.columns and tally(kept.select("doc_id").collect()) == Counter((r["doc_id"],) for r in got if not r["toxic"])
    assert toxicity.scores(d.limit(0), t).count() == 0
    assert all(r["score"] < 0.5 for r in toxicity.scores(d, t.limit(0)).collect())


def test_scores_equal_a_forward_pass_written_out():
    rnd = random.Random(3)
    model = toxicity.Model(5)
    model.bias[:] = [rnd.uniform(-0.5, 0.5) for _ in model.bias]
    texts = ["", "one", "Two words, éü", words(rnd, 40), "a b"]
    raw = [t.encode() for t in texts]
    feats, owner = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = model.score(feats, owner, len(texts))
    for i in range(len(texts)):
        x = [sum(model.vectors[f].astype(float) for f in row) for row in feats[owner == i]]
        out, tap = [], 0
        for w in toxicity.WIDTHS:
            taps = [model.filters[:, tap + k * toxicity.FILTERS : tap + (k + 1) * toxicity.FILTERS].astype(float) for k in range(w)]
            tap += w * toxicity.FILTERS
            bias = model.bias[len(out) : len(out) + toxicity.FILTERS]
            windows = [sum(x[j + k] @ taps[k] for k in range(w)) + bias for j in range(len(x) - w + 1)]
            out += np.maximum(np.max(windows, axis=0), 0).tolist() if windows else [0.0] * toxicity.FILTERS
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(np.array(out) @ model.weights + model.constant[0]))), rel=1e-4)
    step, labels, cost = 1e-2, np.array([0, 1, 1, 0, 1]), np.full(5, 0.2)
    grads = model.gradients(feats, owner, 5, labels, cost)
    loss = lambda: -sum(c * np.log(p if y else 1 - p) for p, y, c in zip(model.score(feats, owner, 5), labels, cost, strict=True))
    for parameter, g in zip(model.parameters()[1:], grads[1:], strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        own = parameter[at]
        parameter[at] = own + step
        up = loss()
        parameter[at] = own - step
        down = loss()
        parameter[at] = own
        assert g[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=3e-3)


def test_toxicity_thresholds_cover_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        toxic = rnd.random() < 0.15
        docs.append((i, " ".join([words(rnd, 12), *["zonk"] * (toxic if rnd.random() < 0.9 else not toxic)]), "de" if i % 5 == 0 else "en"))
        labels.append((i, int(toxic)))
    got = toxicity.scores(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    for language in ("de", "en"):
        own = [(r["score"], labels[r["doc_id"]][1], r["threshold"]) for r in got if docs[r["doc_id"]][2] == language and not r["held_out"]]
        errors = lambda cut: sum((s >= cut) != y for s, y, _ in own)  # noqa: B023, E731
        ordered = sorted({s for s, _, _ in own})
        fewest = min(errors((a + b) / 2) for a, b in zip(ordered[:-1], ordered[1:], strict=True))
        limit = {x for _, _, x in own}
        assert len(limit) == 1 and errors(limit.pop()) == fewest


# 6


@pytest.mark.parametrize("block", [decontamination.BLOCK_WINDOWS, 3])
def test_decontamination(spark, docs, rows, empty, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", block)
    items = [(1, ITEM), (2, "short item"), (3, None), (4, "!!"), (9, ITEM), (8, ITEM + " more"), (None, ITEM), (5, " ".join(ITEM.split()[3:14])), (6, "日本語のテキスト"), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict[tuple, set[str]] = {}
    for i, t in items:
        ws = word.findall(lower(t))
        n = min(10, len(ws))
        if i is not None and ws:
            for k in range(len(ws) - n + 1):
                windows.setdefault(tuple(ws[k : k + n]), set()).add(str(i))

    def brute(text):
        ws = word.findall(lower(text))
        hit, found = set(), set()
        for win, own in windows.items():
            for k in range(len(ws) - len(win) + 1):
                if tuple(ws[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= own
        return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    want = Counter((r["doc_id"], *brute(r["text"])) for r in rows)
    assert tally(decontamination.contamination(docs, bench).collect()) == want and sum(n for k, n in want.items() if k[-1]) >= 4
    kept = decontamination.clean_documents(docs, bench)
    assert kept.columns == docs.columns and tally(kept.collect()) == tally(r for r in rows if not brute(r["text"])[-1])
    assert decontamination.contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, bench.limit(0)).collect())


# 7


def brute_removals(rows) -> dict[tuple, tuple]:
    raw = [(r["doc_id"] if r["doc_id"] is not None else 1 << 63, (r["text"] or "").encode()) for r in rows]
    least: dict[bytes, int] = {}
    for i, x in raw:
        for k in range(len(x) - 49):
            least[x[k : k + 50]] = min(i, least.get(x[k : k + 50], i))
    out = []
    for i, x in raw:
        gone = bytearray(len(x))
        for k in range(len(x) - 49):
            if least[x[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(x)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(x), sum(gone), runs, hashlib.sha256(left).hexdigest(), left))
    return out


@pytest.mark.parametrize("shard", [substring_dedup.SHARD, 300])
def test_substring_dedup(docs, rows, empty, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    want = brute_removals(rows)
    assert tally(substring_dedup.removals(docs).collect()) == Counter((r["doc_id"], *w[:4]) for r, w in zip(rows, want, strict=True))
    if shard == 300:
        return
    out = substring_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    texts = Counter((r["doc_id"], None if r["text"] is None else w[4].decode(errors="ignore")) for r, w in zip(rows, want, strict=True))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == texts
    assert substring_dedup.removals(empty).count() == 0


def test_repeated_lines_partly_shared_with_a_smaller_document(spark):
    rnd = random.Random(3)
    texts = []
    for i in range(12):
        line = words(rnd, 30)
        texts += [(2 * i, f"{words(rnd, 4)} {line[20:75]} {words(rnd, 4)}"), (2 * i + 1, f"{line}\n" * 4)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    want = brute_removals([{"doc_id": i, "text": t} for i, t in texts])
    assert tally(substring_dedup.removals(df).collect()) == Counter((i, *w[:4]) for (i, _), w in zip(texts, want, strict=True))


def test_substring_dedup_of_short_texts_only(spark):
    df = spark.createDataFrame([(i, f"short text {i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    got = substring_dedup.removals(df).collect()
    assert len(got) == 40 and all(r["n_removed"] == 0 for r in got)


def test_texts_longer_than_a_piece(spark, word_library):
    """Two texts of 0.7 MB, more than numpy takes at once, with a shared middle, through every operator that cuts texts into pieces."""
    rnd = random.Random(12)
    some = [words(rnd, 1) for _ in range(4000)]
    pick = lambda n: " ".join(rnd.choice(some) for _ in range(n))
    shared = pick(30_000)
    rows = [{"doc_id": 1, "text": f"{pick(90_000)}\n{shared}\n{pick(9)}"}, {"doc_id": 2, "text": f"{shared}\n{pick(90_000)}"}, {"doc_id": 3, "text": "short"}]
    assert all(len(r["text"].encode()) > _runtime.PIECE_BYTES for r in rows[:2])
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").coalesce(1)
    assert tally(repetition.coverage(df).collect()) == Counter((r["doc_id"], *brute_repetition(r["text"])) for r in rows)
    want = brute_components(rows)
    assert tally(jaccard_join.linked(df).collect()) == Counter((r["doc_id"], *want[i][:2]) for i, r in enumerate(rows))
    assert tally(substring_dedup.removals(df).collect()) == Counter((r["doc_id"], *w[:4]) for r, w in zip(rows, brute_removals(rows), strict=True))
    ids = [word_library.encode(r["text"], add_special_tokens=False).ids for r in rows]
    assert [r["token_ids"] for r in bpe.token_rows(df, WORD_BPE).orderBy("doc_id").collect()] == ids
    model = brute_kneser_ney([rows[2]["text"]])
    got = lm_quality.scored(df, spark.createDataFrame([(3, 1)], "doc_id long, quality int")).orderBy("doc_id").collect()
    assert not held_out(3) and got[2]["perplexity"] == pytest.approx(brute_perplexity(model, "short"), rel=1e-4) and got[0]["n_chars"] == len(rows[0]["text"])


@pytest.mark.parametrize("partitions", [1, 30])
def test_repeats_inside_a_document_and_rows_of_one_id(spark, partitions):
    rnd = random.Random(21)
    texts = []
    for i in range(15):
        passage = words(rnd, 60)
        a = rnd.randint(0, 60)
        texts += [(3 * i, f"{words(rnd, 3)} {passage[a : a + rnd.randint(55, 120)]} {words(rnd, 3)}"), (3 * i + 1, f"{passage} {words(rnd, 6)} {passage}"), (3 * i + 2, passage[10:90]), (3 * i + 2, passage[10:90])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(partitions)
    want = brute_removals([{"doc_id": i, "text": t} for i, t in texts])
    assert tally(substring_dedup.removals(df).collect()) == Counter((i, *w[:4]) for (i, _), w in zip(texts, want, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300).map(lambda b: bytes(x % 3 for x in b)))
def test_suffix_array_and_prefixes(raw):
    data = np.frombuffer(raw, np.uint8)
    order = substring_dedup.suffix_array(data).tolist() if len(raw) else []
    assert order == sorted(range(len(raw)), key=lambda i: raw[i:])
    if len(raw) > 1:
        got = substring_dedup.common_prefixes(data, np.array(order), 20).tolist()
        for k in range(1, len(order)):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert got[k] == min(n, 20)


# 8


def spelled(text: str) -> str:
    return re.sub("[0-9]", "0", text.lower())


def brute_kneser_ney(texts: list[str]):
    """Counts, discounts and interpolation written out for one model of characters: the probability of an n-gram's last symbol."""
    n, levels = lm_quality.ORDER, []
    grams: Counter = Counter()
    for t in texts:
        padded = "\n" * (n - 1) + spelled(t)
        grams.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    for _ in range(n):
        levels.append(grams)
        grams = Counter(g[1:] for g in grams)
    levels.reverse()
    tables = []
    for c in levels:
        by = Counter(c.values())
        y = by[1] / (by[1] + 2 * by[2]) if by[1] + 2 * by[2] else None
        d = [0.0] + [max(0.0, min(k - (k + 1) * y * by[k + 1] / by[k] if y is not None and by[k] else 0.75, float(k))) for k in (1, 2, 3)]
        off = {g: min(d[min(v, 3)], v) for g, v in c.items()}
        total, kept = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kept[g[:-1]] += off[g]
        tables.append((c, off, total, kept))

    def p(gram):
        if not gram:
            return 1 / (len(levels[0]) + 1)
        c, off, total, kept = tables[len(gram) - 1]
        if gram[:-1] not in total:
            return p(gram[1:])
        return (c[gram] - off[gram] if gram in c else 0) / total[gram[:-1]] + kept[gram[:-1]] / total[gram[:-1]] * p(gram[1:])

    return p


def brute_perplexity(p, text: str) -> float | None:
    n = lm_quality.ORDER
    padded = "\n" * (n - 1) + spelled(text)
    bits = [np.log2(p(padded[i : i + n])) for i in range(len(padded) - n + 1)]
    return float(2 ** -np.mean(bits)) if bits else None


def held_out(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % lm_quality.HELD_OUT == 0


@pytest.mark.parametrize("block", [lm_quality.BLOCK, 700])
def test_kneser_ney(spark, monkeypatch, block):
    monkeypatch.setattr(lm_quality, "BLOCK", block)
    monkeypatch.setattr(lm_quality, "SLICE", lm_quality.SLICE if block > 700 else 50)
    rnd = random.Random(6)
    scripts = {"en": "abcde 12.", "ru": "абвгд ё!", "ja": "日本語のテキスト。", **{f"l{k}": "aeiou xyz" for k in range(8)}}
    docs = [(100 * k + i, "".join(rnd.choice(s) for _ in range(rnd.randint(1, 60))), x) for k, (x, s) in enumerate(scripts.items()) for i in range(14)]
    docs += [(5000, "qq ÉÀ 日本 123", "other"), (5001, "abc 45", None), (5002, None, "en"), (5003, "", "other"), (5004, "zzz", "ru"), (5004, "zzz", "ru"), (None, "abc", "en"), (5005, "ba a" * 200, "en")]
    labels = [(i, 1) for i, _, _ in docs if i is not None and i < 5000 and i % 3] + [(1, 0), (None, 1), (3, None), (5000, 0)]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    trusted = {i for i, q in labels if q == 1 and i is not None}
    trains = [(i, t, x) for i, t, x in docs if i in trusted and not held_out(i)]
    models = {x: brute_kneser_ney([t for _, t, y in trains if y == x]) for x in scripts}
    models[""] = brute_kneser_ney([t for _, t, _ in trains])
    limits = {}
    for m, p in models.items():
        own = [(i, brute_perplexity(p, t)) for i, t, x in docs if i in trusted and (x == m or (m == "" and held_out(i)))]
        held = sorted(v for i, v in own if held_out(i)) or sorted(v for _, v in own)
        limits[m] = held[int(np.ceil(lm_quality.QUANTILE * len(held))) - 1]
    got = sorted(lm_quality.scored(df, marks).collect(), key=lambda r: (key(r), r["n_chars"]))
    want = sorted(((i, t, x if x in models else "") for i, t, x in docs), key=lambda d: ((d[0] is None, d[0] or 0), len(spelled(d[1] or ""))))
    assert len(got) == len(want)
    for r, (i, t, m) in zip(got, want, strict=True):
        value = brute_perplexity(models[m], t or "")
        assert (r["doc_id"], r["model"], r["n_chars"]) == (i, m, len(spelled(t or "")))
        assert (r["perplexity"] is None) == (value is None) and (value is None or r["perplexity"] == pytest.approx(value, rel=1e-4))
        assert r["threshold"] == pytest.approx(limits[m], rel=1e-4)
        assert r["kept"] == (value is not None and r["perplexity"] <= r["threshold"])
    if block == 700:
        return
    chars = [*"abcde 0.", "x"]  # the last stands for all that the model has not seen
    assert sum(models["en"]("ab cd"[1 - lm_quality.ORDER :] + c) for c in chars) == pytest.approx(1, abs=1e-9)
    assert lm_quality.scored(df.limit(0), marks).count() == 0
    bare = lm_quality.scored(df.withColumn("model", F.lit(1)).withColumn("block", F.lit("b")), marks.limit(0)).collect()
    assert len(bare) == len(docs) and all(r["kept"] == bool(r["n_chars"]) and r["perplexity"] is None for r in bare)


# 9


def test_token_files(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    got = sorted(token_files.read_files(token_files.write_files(docs, BYTE_BPE)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x or 0))
    start = 0
    ids = {}
    for r in rows:
        x = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        ids.setdefault(r["doc_id"], []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    for r in got:
        assert r["start"] == start
        ids[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        start += r["n_tokens"]
    assert token_files.read_files(token_files.write_files(empty, BYTE_BPE)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=512, max_size=512) | st.lists(st.integers(0, 40), min_size=1024, max_size=1024))
def test_blocks_round_trip(ids):
    blocks = token_files.pack_blocks(np.array(ids, np.uint32))
    starts = np.cumsum([0, *map(len, blocks[:-1])])
    assert token_files.unpack_blocks(b"".join(blocks), starts).tolist() == ids


@pytest.fixture(scope="module")
def chunk_encoder():
    return token_files.ChunkEncoder(BYTE_BPE)


ODD = st.lists(st.sampled_from([" ", "\n", "\t", "a", "The", "'s", "é", "\x1c", "\x85", "\xa0", "1", "!", "…", "　", "Σ", "İ", "\x00", "日", "́", "ﬁ", "<|endoftext|>"]), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_chunks_equal_library(chunk_encoder, texts):
    ids, counts = chunk_encoder.encode(texts)
    want = [chunk_encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


# 10


@pytest.fixture(scope="module")
def speller():
    return bpe.Encoder(bpe.Model(WORD_BPE))


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


@settings(max_examples=200, deadline=None)
@given(ODD | st.text(st.sampled_from("abcdehinorst"), min_size=1, max_size=90))
def test_bpe_equals_library(speller, word_library, text):
    n, ids, decoded = next(speller.encode([text]))
    want = word_library.encode(text, add_special_tokens=False).ids
    assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), word_library.decode(want, skip_special_tokens=False))


def test_latin_words_equal_the_pattern_of_all_words(speller):
    """Also their normal form: of Latin-1, the lower case."""
    for c in map(chr, range(256)):
        assert c.isspace() and c not in "\x1c\x1d\x1e\x1f" or speller.normal(c) == c.lower(), c
    rnd = random.Random(23)
    for _ in range(3000):
        text = "".join(rnd.choice([chr(rnd.randrange(256)), rnd.choice("aé5² '.st")]) for _ in range(rnd.randint(1, 12)))
        assert speller.latin(text.lower()) == speller.find(speller.normal(text)), text


def test_words_are_kept_over_pieces_and_taken_over(monkeypatch, word_library):
    """A word of many pieces is encoded once, also when a worker starts to forget."""
    encoder, seen = bpe.Encoder(bpe.Model(WORD_BPE)), []
    encode = encoder.model.encode
    monkeypatch.setattr(encoder.model, "encode", lambda words: (seen.extend(words), encode(words))[1])
    texts = ["blesh### blesh,", "blesh$$$ Blesh <|endoftext|>Ñesh", "中blesh blesh. ́x", None, "<|startoftext|><|endoftext|>", "blesh"]
    monkeypatch.setattr(bpe, "MEMORY", 1)
    for text in texts * 2:
        want = word_library.encode(text or "", add_special_tokens=False).ids
        assert next(encoder.encode([text])) == (len(want), " ".join(map(str, want)), word_library.decode(want, skip_special_tokens=False))
    assert seen.count("blesh") <= 3
    monkeypatch.undo()
    encoder = bpe.Encoder(bpe.Model(WORD_BPE))
    assert [x[0] for x in encoder.encode(texts)] == [len(word_library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert "blesh" in encoder.ids and not any("#" in w and "b" in w for w in encoder.ids)


def test_words_merged_side_by_side_equal_words_merged_alone(monkeypatch, speller):
    model = speller.model
    monkeypatch.setattr(bpe, "ROWS", 7)
    rnd = random.Random(17)
    some = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 14))) for _ in range(400)] + ["a中b", "中中", "b中", "ab" * 29]
    assert model._side_by_side(some[:400]) == [model._exact(w) for w in some[:400]]
    assert model.encode(some) == [model._exact(w) for w in some]


def test_greedy_proposals_fail_and_are_repaired(speller):
    model = speller.model
    words = ["".join(random.Random(i).choice("abcdehinorst") for _ in range(9)) for i in range(400)]
    greedy = [model.proposed(w) for w in words]
    exact = [model.merged(model.symbols(w))[0] for w in words]
    assert any(g != e for g, e in zip(greedy, exact, strict=True)) and model.encode(words) == exact


def test_bpe(docs, rows, empty, word_library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want: Counter = Counter()
    for r in rows:
        ids = word_library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(word_library.decode(ids, skip_special_tokens=False))] += 1
    assert tally(bpe.digests(docs, WORD_BPE).collect()) == want
    out = bpe.encode(docs, WORD_BPE).select("doc_id", F.size("token_ids").cast("long"), F.sha2(F.array_join(F.transform("token_ids", lambda x: x.cast("string")), " "), 256), F.sha2("decoded", 256))
    assert tally(out.collect()) == want
    assert bpe.digests(empty, WORD_BPE).count() == 0


# 11


def brute_phrases(rows, least: int, top: int) -> list[tuple]:
    n, f = Counter(), Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r["text"])):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    many = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    found = []
    for p, a in many.items():
        around = [b for q, b in many.items() if len(q) > len(p) and q[0] == p[0] and p[1:] in (q[1:-1], q[2:])]
        if any(100 * b >= 50 * a for b in around):
            continue
        cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[0], *p[k:]]), k, f[p[:k]], f[p[0], *p[k:]]) for k in range(2, len(p))]
        score, _, left, right = min(cuts)
        found.append((p[0], -score, -a, " ".join(p[1:]).encode(), left, right))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def phrase_rows() -> list[tuple]:
    rnd = random.Random(4)
    vocabulary = ["New", "york", "new", "City", "é", "日本", "x y", "a", "b", "\x00"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]
    texts = ["".join(rnd.choice(vocabulary) + rnd.choice(gaps) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    texts += ["new york city " * 40, "a a a a a a a a a a a a a a", "  ", ",,,", None, "w" * 300]
    rows = [(i, t, None if i % 7 == 0 else "en" if i % 2 else "und", "s", i % 3, None) for i, t in enumerate(texts)]
    return rows + rows[:5]


@pytest.mark.parametrize(("fewest", "slice_", "heavy", "top"), [(1 << 18, 4 << 20, 2000, 2000), (64, 4 << 20, 5, 7), (64, 11, 2, 2000)])
def test_phrases(spark, monkeypatch, fewest, slice_, heavy, top):
    """Also with a sketch so small that rare phrases pass, texts in slices of a few bytes, and joins of every kind."""
    for name, value in (("FEWEST", fewest), ("MOST", fewest), ("SLICE", slice_), ("HEAVY", heavy), ("BLOCK", 32 if fewest == 64 else 1 << 16)):
        monkeypatch.setattr(collocations, name, value)
    df = spark.createDataFrame(phrase_rows(), "doc_id int, text string, lang string, phrase string, n_words int, f int").repartition(3)
    got = collocations.phrases(df, 10, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(df.collect(), 10, top)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 10


def test_phrases_of_no_rows(empty, docs, rows):
    assert collocations.phrases(empty).count() == 0
    assert sorted(map(tuple, collocations.phrases(docs, 3).collect())) == sorted(brute_phrases(rows, 3, 2000))


def test_scores_pass_64_bits(spark):
    big = 10**12
    counts = spark.createDataFrame([("en", 1, "a", 3 * big), ("en", 1, "b", 2 * big + 1), ("en", 2, "a b", 2 * big)], "lang string, n_words int, phrase string, f long")
    assert [tuple(r) for r in collocations.scored(counts).collect()] == [("en", "a b", 2, 2 * big, 3 * big, 2 * big + 1, 10**6 * (2 * big) ** 2 // (3 * big * (2 * big + 1)))]


def test_sketch_never_undercounts():
    rnd = np.random.default_rng(1)
    into = np.zeros(1 << 10, np.uint8)
    true = np.zeros(1 << 10, np.int64)
    for _ in range(20):
        own = np.minimum(rnd.integers(0, 4, 1 << 10) * (rnd.random(1 << 10) < rnd.choice([0.01, 0.9])), 10).astype(np.uint8)
        true += own
        collocations._add(into, collocations._packed(own), 10)
    assert (into == np.minimum(true, 10)).all()


# 12


PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def piece_model():
    from sentencepiece import SentencePieceProcessor

    return sentencepiece_bpe.Encoder(sentencepiece_bpe.Model(PIECE_BPE)), SentencePieceProcessor(model_file=PIECE_BPE)


def piece_encoded(encoder, text: str | None) -> tuple[list[int], str]:
    parts = list(encoder.encode(text))
    return [int(i) for _, ids, _ in parts for i in ids.split(",") if i], "".join(t for _, _, t in parts)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["  ", " ", "▁", "a", "the", " of", "ing", "ee", "日本語", "é", "²", ".", "...", "\n", "\t", "</s>", "<0x0A>", "😀", "\x00", "12", "ﬁ", "ab"]), max_size=30).map("".join) | st.text(max_size=60))
def test_pieces_equal_the_library(piece_model, text):
    encoder, library = piece_model
    ids = library.encode(text)
    assert piece_encoded(encoder, text) == (ids, library.decode(ids))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 31999), max_size=12))
def test_any_ids_decode_as_in_the_library(piece_model, ids):
    encoder, library = piece_model
    assert encoder.model.decoded(ids) == library.decode(ids)


def test_pieces_in_slices_and_windows(piece_model, monkeypatch):
    encoder, library = piece_model
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("  aehinst▁é.1\n") for _ in range(n)) for n in (3, 50, 400, 3000)] + ["abcde" * 5000, "=" * 4000, " " * 999, "▁" * 60]
    for size in (7, 40, 1 << 20):
        monkeypatch.setattr(sentencepiece_bpe, "SLICE", size)
        monkeypatch.setattr(sentencepiece_bpe, "WINDOW", size)
        encoder._forget()
        for text in texts:
            ids = library.encode(text)
            assert piece_encoded(encoder, text) == (ids, library.decode(ids))


def test_backtracking_takes_tokens_back(monkeypatch):
    """A vocabulary whose longest matches lead astray: 'ab' and 'cd' must give way, and a character is no piece."""

    class Tiny(sentencepiece_bpe.Model):
        def __init__(self):
            self.score = {"a": -9.0, "b": -9.0, "c": -9.0, "bc": -1.0, "bcd": -2.0, "ab": -3.0, "abc": -4.0, "d": -9.0, "cd": -5.0}
            self.ids = {p: i for i, p in enumerate(self.score)}
            self.path, self.pieces, self.unknown, self.bytes, self.silent, self.byte_of, self.special = "", list(self.ids), -1, {}, set(), {}, set()
            self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
            self.usable = [p for p in self.ids if self.merged(p) == [p]]

    encoder = sentencepiece_bpe.Encoder(Tiny())
    for n in range(1, 8):
        for text in map("".join, itertools.product("abcdz" if n < 6 else "abcd", repeat=n)):
            assert encoder.tokens(text) == encoder.model.merged(text)


def test_piece_columns(spark, docs, rows, empty, piece_model):
    library = piece_model[1]
    want = {t: library.encode(t or "") for t in {r["text"] for r in rows}}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = tally(sentencepiece_bpe.digests(docs, PIECE_BPE).collect())
    assert got == Counter((r["doc_id"], len(ids := want[r["text"]]), sha(",".join(map(str, ids))), sha(library.decode(ids))) for r in rows)
    full = sentencepiece_bpe.encode(docs.withColumn("decoded", F.lit(1)), PIECE_BPE)
    assert full.columns == [*docs.columns, "token_ids", "decoded"]
    assert Counter((*r[:-2], tuple(r[-2]), r[-1]) for r in full.collect()) == Counter((*r, tuple(want[r["text"]]), library.decode(want[r["text"]])) for r in rows)
    back = sentencepiece_bpe.decode(full.drop("decoded"), PIECE_BPE)
    assert Counter(r["decoded"] for r in back.collect()) == Counter(r["decoded"] for r in full.collect())
    odd = spark.createDataFrame([(None,), ([],), ([3 + 0xE6, 5],)], "token_ids array<int>")
    assert {r["decoded"] for r in sentencepiece_bpe.decode(odd, PIECE_BPE).collect()} == {None, "", library.decode([3 + 0xE6, 5])}
    assert sentencepiece_bpe.digests(empty, PIECE_BPE).count() == 0 and sentencepiece_bpe.encode(empty, PIECE_BPE).count() == 0


# 13


def brute_resampled(rows, targets, longest=1, buckets=10_000, least=20, percent=10, seed=2024) -> Counter:
    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]

    own = [features(r["text"]) for r in rows]
    s, t = Counter(b for _, x in own for b in x), Counter(b for x in targets for b in features(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)}
    scored = []
    for r, (n, x) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        scored.append([r["doc_id"], len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((x for x in scored if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    drawn = {id(x): k for k, x in enumerate(able[: percent * len(able) // 100], 1)}
    return Counter((*x[:4], drawn.get(id(x))) for x in scored)


@pytest.mark.parametrize(("longest", "buckets", "least", "percent"), [(1, 10_000, 20, 10), (2, 50, 1, 60), (3, 1000, 2, 100)])
def test_resampled(docs, rows, spark, longest, buckets, least, percent):
    target = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, ITEM.upper() + " é")], "item_id int, text string")
    got = resampling.resampled(docs, target, longest, buckets, least_words=least, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert tally(got.collect()) == brute_resampled(rows, [r["text"] for r in target.collect()], longest, buckets, least, percent)


def test_resampled_documents(docs, rows, spark, empty):
    target = spark.createDataFrame([(1, ITEM)], "item_id int, text string")
    drawn = {r[0] for r in brute_resampled(rows, [ITEM]) if r[4]}
    kept = resampling.sampled_documents(docs, target)
    assert kept.columns == docs.columns and tally(kept.collect()) == tally(r for r in rows if r["doc_id"] in drawn and r["doc_id"] is not None)
    assert resampling.resampled(empty, target).count() == 0
    assert tally(resampling.resampled(docs, target.limit(0)).collect()) == brute_resampled(rows, [])


@pytest.mark.parametrize("bits", [3, 12, 20])
def test_parts_are_cut_where_they_change(bits):
    rnd = np.random.default_rng(bits)
    for n in (0, 1, 700):
        part = np.sort(rnd.integers(0, 1 << bits, n))
        assert substring_dedup._cut(part) == [(p, int(np.flatnonzero(part == p)[0]), int(np.flatnonzero(part == p)[-1]) + 1) for p in np.unique(part).tolist()]


def test_anchors_spread_evenly_over_ranges(spark):
    data = np.frombuffer(words(random.Random(5), 60_000).encode(), np.uint8)
    _, hashes, *_ = substring_dedup.anchors(data, np.array([0, len(data)]))
    share = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256) / len(hashes)
    assert share.max() < 3 / 256  # the least of 27 hashes: 27 / 256 in the first range


@pytest.mark.parametrize("n", [0, 1, 2, 400])
def test_keys_repeated_over_blocks(monkeypatch, n):
    monkeypatch.setattr(_hashing, "BLOCK", 16)
    keys = np.random.default_rng(n).integers(0, 300, n).astype(np.uint64) * np.uint64(1 << 40)
    own, count = np.unique(keys, return_counts=True)
    assert _hashing.repeated(keys).tolist() == [int(count[own == k][0]) > 1 for k in keys]


def test_strings_of_many_shards_are_sorted_once():
    draw = np.random.default_rng(8)
    shards = [(np.unique(draw.integers(0, 2, (40, substring_dedup.LENGTH)) * (np.arange(substring_dedup.LENGTH) > 45), axis=0).astype(np.uint8), None) for _ in range(9)]
    shards = [(s, draw.integers(0, 1000, len(s))) for s, _ in shards]
    least = {}
    for strings, owners in shards:
        for x, o in zip(strings, owners.tolist(), strict=True):
            least[x.tobytes()] = min(o, least.get(x.tobytes(), o))
    got = substring_dedup.merged(shards)
    assert [g.tolist() for g in got] == [[least[x.tobytes()] for x in s] for s, _ in shards]


def test_a_very_common_anchor_is_cut_to_one_of_a_kind_before_its_windows(spark, monkeypatch):
    """Copies of a passage with few rims: windows are only made of segments that differ, in blocks of bytes."""
    monkeypatch.setattr(substring_dedup, "BLOCK", 200)
    rnd = random.Random(4)
    passage, ends = words(rnd, 12), [words(rnd, 9) for _ in range(6)]
    texts = [(i, f"{passage} {ends[i % 5]} {words(rnd, 2)} {ends[i * i % 6]} {passage}") for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    want = brute_removals([{"doc_id": i, "text": t} for i, t in texts])
    assert tally(substring_dedup.removals(df).collect()) == Counter((i, *w[:4]) for (i, _), w in zip(texts, want, strict=True))
