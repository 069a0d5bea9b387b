"""Packing, phrase mining and spelling variants against brute force on the smallest given tables, and their edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millwright.llm import collocations, packing, queries, spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, uid int, piece int, word string, key int, n int, phrase string, open int"


def odd(spark, texts, langs=("en", None)):
    """Documents with nulls, a repeated row and columns whose names the operators use inside."""
    rows = [(i, t, langs[i % len(langs)], 1, 2, "w", 3, 4, "p", 5) for i, t in enumerate(texts)]
    rows += [(None, "seven words stand here without an id", "en", 1, 2, "w", 3, 4, "p", 5), rows[-1]]
    return spark.createDataFrame(rows, DOCS)


def documents(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


# ---- 11 ---------------------------------------------------------------------------------------

def test_token_bytes_equal_the_tokenizer(model):
    rng = random.Random(5)
    strange = [chr(c) for c in range(1, 0x250)] + list("̧̀́Σσ   　﻿中กİẞ\U0001f600")
    texts = ["".join(rng.choice(strange) for _ in range(60)) for _ in range(400)]
    texts += ["Word, word. WORD... word!? Été, été. ÉTÉ** (Ünder)under] x_. 3., a1. don't. it's, ß. µ, ª. word.' <b>, Straße; naïve--"] * 2
    texts += [f"a{c}b {c} x{c}\t{c}y" for c in strange] + ["<|endoftext|> a<|startoftext|>b <|x|>", "It's we'll THEY'VE 'summer", "", " \n "]
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.token_bytes(texts)]
    assert got == [model.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, ids):
    """Every piece of every document once, gapless sequences within capacity."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, want in ids.items():
        got = sorted(by_doc.pop(doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(len(got))) and [r["start"] for r in got] == [4096 * k for k in range(len(got))]
        assert [r["length"] for r in got] == [min(4096, len(want) - 4096 * k) for k in range(-(-len(want) // 4096))]
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(np.array(want[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
    assert not by_doc
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by_seq)


def test_packing_of_all_documents(spark, model):
    out = queries.op11_packing(spark, SF)
    ids = {d: [*model.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in documents(spark)}
    n = check_packing(out.collect(), ids)
    sequences, bound = packing.certificate(out)
    assert sequences == n and -(-sum(map(len, ids.values())) // 4096) <= bound <= n <= bound + 1


def best_possible(lengths, capacity):
    """The fewest bins, by search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= lengths[i]}:
            rest = list(rooms)
            rest.remove(r)
            place(i + 1, [*rest, r - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_bounds_and_best_fit_against_search():
    rng = np.random.default_rng(1)
    tight = 0
    for _ in range(150):
        lengths = np.sort(rng.integers(1, 21, rng.integers(1, 9)))[::-1]
        where, offset, n = packing.best_fit_decreasing(lengths, 20)
        bound, best = packing.lower_bound(np.bincount(lengths, minlength=21)), best_possible(lengths.tolist(), 20)
        assert bound <= best <= n
        tight += bound == best
        rooms = []
        for x in lengths.tolist():            # best fit, bin by bin
            fits = [k for k, r in enumerate(rooms) if r >= x]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= x
            else:
                rooms.append(20 - x)
        assert n == len(rooms)
        for seq in range(n):
            at = 0
            for k in np.flatnonzero(where == seq):
                assert offset[k] == at
                at += lengths[k]
            assert at <= 20
    assert tight > 140
    assert packing.lower_bound(np.bincount([11] * 5, minlength=21)) == 5 and packing.lower_bound(np.zeros(21, np.int64)) == 0


def test_partitions_exchange_documents(spark):
    rng = random.Random(2)
    rows = [(k, k, True, 0, 0, rng.choice([1500, 1400, 1250, 700, 300, 60, 4096]), 0) for k in range(3000)]
    found = spark.createDataFrame(rows, "uid long, doc_id long, has_id boolean, piece int, start long, length long, ids_crc32 long")
    alone = sum(packing.best_fit_decreasing(np.sort([r[5] for r in rows if r[0] % 100 == g])[::-1])[2] for g in range(100))
    out = packing.pack(found, group=30).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(3000))
    fill = Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096
    n, bound = packing.certificate(packing.pack(found, group=30))
    assert n == len(fill) and bound <= n < alone        # fewer than without exchange
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 3000


def test_packing_edge_cases(spark, model):
    texts = [None, "", " \n ", "a", "word " * 9000, "x" * 5000, "<|endoftext|>", "éè \U0001f600 ok"]
    docs = odd(spark, texts)
    out = packing.sequences(docs)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"]
    rows = out.collect()
    ids = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter([*range(8), 7, None])
    assert [r["length"] for r in rows if r["doc_id"] == 0] == [1] and len([r for r in rows if r["doc_id"] == 4]) == -(-9001 // 4096)
    twice = {r["ids_crc32"] for r in rows if r["doc_id"] == 7}
    assert twice == {zlib.crc32(np.array(ids[7], "<u4").tobytes())}
    assert packing.sequences(docs.limit(0)).count() == 0
    few = docs.filter("doc_id between 3 and 6")
    whole = [r["ids"] for r in packing.filled(spark, packing.sequences(few), packing.token_ids(few)).collect()]
    assert sum(map(len, whole)) == sum(len(ids[k]) for k in range(3, 7))


# ---- 12 ---------------------------------------------------------------------------------------

def phrases(docs, least, top):
    """The contract, counted plainly."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in f.items():
        rows = []
        for g, a in c.items():
            if len(g) == 1 or a < least:
                continue
            score, k = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rows.append((g, a, c[g[:k]], c[g[k:]], score))
        inside = {p for g, a, *_ in rows if len(g) == 3 for p in (g[:2], g[1:]) if 100 * a >= 50 * c[p]}
        kept = sorted((-s, -a, " ".join(g).encode(), l, r) for g, a, l, r, s in rows if g not in inside)
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(kept[:top])]
    return sorted(out)


def test_collocations_equal_brute_force(spark):
    got = sorted(tuple(r) for r in queries.op12_collocations(spark, SF).collect())
    assert got == phrases(documents(spark), 10, 2000) and got


def test_chunks_cover_each_ngram_once():
    rng = random.Random(3)
    for _ in range(60):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 120))]
        found = collocations.chunks(" ".join(words).encode())
        assert all(len(c) < 2000 for c in found)
        got = Counter()
        every = np.full(1 << collocations.BITS - 3, 255, np.uint8)
        for lengths, may in (((1, 2), None), ((3,), every)):
            for frame in collocations._count("en", [c.decode() for c in found], [2] * len(found), lengths, may):
                got.update(dict(zip(frame["phrase"], frame["n"], strict=True)))
        want = Counter({"": 2 * len(words)})
        for size in (1, 2, 3):
            for i in range(len(words) - size + 1):
                want[" ".join(words[i:i + size])] += 2
        assert got == want
    long = " ".join(str(k * 7919 % 1009) for k in range(4000)).encode()
    assert len(collocations.chunks(long)) > 200


def test_collocation_edge_cases(spark):
    line = "New York City is big, new york city! is.\nNew\tYork  city Été été a b"
    texts = [None, "", " . , ", *[line] * 12, "x " * 30_000, "one two " * 50]
    docs = odd(spark, texts)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    got = sorted(tuple(r) for r in collocations.mine(docs).collect())
    assert got == phrases(rows, 10, 2000) and {r[0] for r in got} == {"en", "und"}
    assert sorted(tuple(r) for r in collocations.mine(docs, top=3).collect()) == phrases(rows, 10, 3)
    assert collocations.mine(docs.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, b, c = 4_000_000_007, 9_000_000_011, 5_000_000_029
    found = spark.createDataFrame([("en", "x", b), ("en", "y", c), ("en", "x y", a)], "lang string, phrase string, n long")
    r = collocations.scored(found).first()
    assert (r["a"], r["l"], r["r"], r["score"]) == (a, b, c, 1_000_000 * a * a // (b * c))


# ---- 13 ---------------------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def spellings(docs):
    """The contract, word by word: near words are those that deletions at the same place, or one deletion, make equal."""
    n = Counter()
    for doc, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1:]
            holes[i, cut].add(w)
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, k in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, k, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


def test_spelling_equals_brute_force(spark):
    got = sorted(tuple(r) for r in queries.op13_spelling(spark, SF).collect())
    want = spellings(documents(spark))
    assert got == want and any(r[3] for r in got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(tuple(r) for r in spelling.variants(docs, long_list=2).select("word", "n", "n_near", "form", "form_n", "root").collect()) == want


def test_sorted_list_scan_equals_full_matrix():
    rng = random.Random(7)
    for _ in range(120):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(40)})
        common = [0, *(spelling._prefix(a, b) for a, b in zip(words, words[1:], strict=False))]
        for q in words[::7]:
            assert [words[j] for j in spelling.within_one(q, words, common)] == [w for w in words if edits(q, w) <= 1]


def test_spelling_edge_cases(spark):
    base = "separate"
    texts = [None, "", "short", " ".join([base] * 200 + ["seperate"] * 15 + ["seperat"] * 2), "RESUMÉS resumÉs résumés", "a" * 70_000, "a" * 70_001, "b" * 40 + " " + "b" * 40,
             *["aaaaaaa aaaaaaab aaaaaab baaaaaaa"] * 30, "tietieti tietietx tietiety tietiety"]
    docs = odd(spark, texts)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    want = spellings(rows)
    for limit in (2048, 1):
        got = spelling.variants(docs, long_list=limit).select("word", "n", "n_near", "form", "form_n", "root")
        assert sorted(tuple(r) for r in got.collect()) == want
    found = {r[0]: r for r in want}
    assert found["seperat"][3] is None or found["seperat"][5] == "separate"
    assert spelling.variants(docs.limit(0)).count() == 0


def test_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(18)], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(links).collect()} == {f"w{k}": "w18" for k in range(18)}
