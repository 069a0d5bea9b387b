"""Each operator's query against a brute-force version on the smallest given tables, and its edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millwright.llm import decontam, host_reputation, line_dedup, mixing, queries, simhash, suffix_dedup, template_html, toxicity, winnow

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, of string, fp int, h int, row int, n int"


def ragged(spark, texts, sources=None):
    """Documents with nulls, repeats and columns whose names the operators use inside."""
    rows = [(i, t, None, (sources or {}).get(i, "s"), None, "x", 1, 2, 3, 4) for i, t in enumerate(texts)]
    rows += [(None, "one two three four five six", "en", None, 5, "x", 1, 2, 3, 4), rows[-1]]
    return spark.createDataFrame(rows, DOCS)


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ODD = [None, "", " ", "\n\n", "a", "a b", "the same line of words here\nthe same line of words here", "x" * 5000, LONG, LONG + " tail", "\u00e9\u00e8 \U0001f600 ok"]


# ---- 1 ----------------------------------------------------------------------------------------

def test_decontamination_finds_exact_and_edited_passages(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: set(r["item_ids"]) for r in queries.op1_decontamination(spark, SF).collect()}
    docs = documents(spark)
    assert set(got) == {d for d, _ in docs}
    for d, text in docs:
        assert got[d] == {i for i, t in items if decontam.normalise(t) in decontam.normalise(text)}
    assert any(got.values())
    index = decontam.Benchmark(items)
    item, text = max(items, key=lambda x: len(x[1]))
    edited = text[:20] + "q" + text[21:60] + text[62:]
    filler = "Some other words stand before it. " * 40
    assert item in {h[0] for h in index.search(filler + edited + filler)}
    assert not index.search(filler)


def test_banded_alignment_equals_full_alignment():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = "".join(rng.choice(list("abc"), 12))
        b = "".join(rng.choice(list("abc"), 16))
        best = [0] * (len(b) + 1)
        for i in range(1, len(a) + 1):
            new = [i]
            for j in range(1, len(b) + 1):
                new.append(min(best[j - 1] + (a[i - 1] != b[j - 1]), best[j] + 1, new[j - 1] + 1))
            best = new
        got = decontam._banded(a, b, 4)
        assert (got[0] if got else None) == (min(best) if min(best) <= 4 else None)


def test_decontamination_edge_cases(spark):
    item = "This passage is a benchmark question that is surely long enough to be told apart from anything else here."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (5, item)], "item_id long, text string")
    docs = ragged(spark, [*ODD, "Before. " + item.upper() + " After.", LONG + " " + item])
    found = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontam.find(docs, bench).collect()}
    assert {d for d, h in found.items() if h} == {11, 12} and found[12] == [1, 5]
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert decontam.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontam.clean(docs.limit(0), bench).count() == 0
    many = decontam.blocks(bench, chars=120)
    assert sorted(i for b in many for i, _ in b) == [1, 5] and len(many) == 2


def unfiltered(text, item):
    """Whether any stretch of the item aligns within the budget: every stretch against the whole text."""
    text, item = decontam.normalise(text), decontam.normalise(item)
    m = min(decontam.STRETCH, len(item))
    for start in range(len(item) - m + 1):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item[start:start + m], 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        if min(row) <= int(decontam.ERROR * m):
            return True
    return False


def test_decontamination_finds_quotes_from_any_place(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontam.Benchmark(items)
    texts = {i: decontam.normalise(t) for i, t in items}
    long = [(i, t) for i, t in texts.items() if len(t) >= 100]
    found = lambda text: {h[0] for h in index.search(text)}
    for i, t in long[:12]:
        for size in (80, 95, 118):
            for start in range(0, len(t) - size + 1, 13):
                assert i in found("Some words before it, " + t[start:start + size] + " and others after it.")
        for cut in range(1, len(t)):                                  # the text ends, or begins, inside the item
            there = {i in found(x) for x in ("other words stand here " + t[:cut], t[-cut:] + " other words stand here", t[:cut], t[-cut:])}
            assert 60 <= cut < 80 or there == {cut >= 80}             # 68 characters lie within the budget of 80
        words = t.split(" ")
        middle = len(words) // 2
        for new in ("x", "replacement", "quite"):
            assert i in found(" ".join([*words[:middle], new, *words[middle + 1:]]))


def test_decontamination_equals_unfiltered_alignment(spark):
    rng = np.random.default_rng(11)
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a batch of strange potions tonight"
    index = decontam.Benchmark([(1, item)])
    seen = set()
    for _ in range(40):
        text = list(item[int(rng.integers(0, 12)):])
        for _ in range(int(rng.integers(0, 5))):
            k = int(rng.integers(0, len(text)))
            text[k:k + int(rng.integers(0, 2))] = list("zq"[: int(rng.integers(0, 3))])
        text = "unrelated start " + "".join(text) + " unrelated end"
        got, want = bool(index.search(text)), unfiltered(text, item)
        assert got == want
        seen.add(want)
    assert True in seen and not unfiltered("unrelated words only " * 8, item) and not index.search("unrelated words only " * 8)


# ---- 2 ----------------------------------------------------------------------------------------

def test_restoring_disguised_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = spark.createDataFrame([(k, "idiot stupid loser pathetic trash moron " * 20) for k in range(30)], "doc_id long, text string")
    model = toxicity.language_model(docs.select("doc_id", "text").unionByName(words))
    restore = toxicity.Restorer(model)
    assert restore("1d10t i d i o t looooser p.a.t.h.e.t.i.c tr@sh m0r0n").split() == ["idiot", "idiot", "loser", "pathetic", "trash", "moron"]
    assert restore("Plain words, 1234 and 12:30!").split() == ["plain", "words", "and"]
    assert restore(None).strip() == "" and restore("").strip() == ""


def test_restoring_long_and_mixed_disguises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = spark.createDataFrame([(k, "idiot stupid loser pathetic trash moron asshole ass " * 20) for k in range(30)], "doc_id long, text string")
    model = toxicity.language_model(docs.select("doc_id", "text").unionByName(words))
    restore = toxicity.Restorer(model)
    assert restore("i d 1 o t").split() == ["idiot"] and restore("m 0 r o n").split() == ["moron"]
    assert restore("a$$").split() == ["ass"] and restore("4$$h0|3").split() == ["asshole"]
    assert restore("idi" + "o" * 30 + "t").split() == ["idiot"]
    assert "".join(restore(" ".join("youareastupididiotandapatheticmoronloser")).split()) == "youareastupididiotandapatheticmoronloser"
    assert restore(" ".join("stupid" * 60)).replace(" ", "") == "stupid" * 60
    assert restore(".".join("pathetic" * 5)).replace(" ", "") == "pathetic" * 5
    assert restore("1 2 3 4, 12:30 and $100").split() == ["and"]


def test_language_model_counts_every_gram(spark):
    docs = documents(spark)
    counts = np.zeros(toxicity.SIGNS**4, np.int64)
    for _, text in docs:
        np.add.at(counts, toxicity._grams(text)[: len(text.encode()) + 1], 1)
    got = {r["gram"]: r["n"] for r in toxicity.gram_counts(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    inner = [g for g in np.flatnonzero(counts) if g % 32 and g // 32 % 32 and g // 1024 % 32 and g // 32768 % 32]
    assert inner and all(got[g] == counts[g] for g in inner)


def _accuracy(spark, query, label, folds, fold):
    sf = "/root/testdata/sf0.1"
    rows = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("predicted", "score", label).toPandas()
    everything = query(spark, SF).select("doc_id", "held_out", "score", "predicted").toPandas()
    assert everything["score"].between(0, 1).all() and len(everything) == spark.read.parquet(f"{SF}/documents.parquet").count()
    import zlib

    assert all(h == (zlib.crc32(str(d).encode()) % folds == fold) for d, h in zip(everything["doc_id"], everything["held_out"]))
    return (rows["predicted"] == rows[label]).mean()


def test_toxicity_held_out_accuracy(spark):
    assert _accuracy(spark, queries.op2_toxicity, "toxic", 5, 0) > 0.97


def test_quality_held_out_accuracy(spark):
    assert _accuracy(spark, queries.op9_quality, "quality", 4, 2) > 0.98


def test_classifiers_on_odd_rows(spark):
    from millwright.llm import quality_gam

    docs = ragged(spark, ODD)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (6, 0, None), (7, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for found in (toxicity.classify(docs, labels), quality_gam.classify(docs, labels), toxicity.classify(docs, labels.limit(0)), quality_gam.classify(docs, labels.limit(0))):
        rows = found.collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = toxicity.clean(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.clean(docs.limit(0), labels).count() == 0


# ---- 3 ----------------------------------------------------------------------------------------

def _repeats(docs):
    seen, out = set(), {}
    for d, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(b[p:p + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op3_suffix_dedup(spark, SF).collect()}
    assert got == _repeats(documents(spark))


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for size, signs in ((1, 2), (2, 1), (50, 1), (300, 2), (500, 4)):
        data = rng.integers(0, signs, size).astype(np.uint8) + 97
        text = bytes(data)
        order = suffix_dedup.suffix_array(data)
        assert [text[i:] for i in order] == sorted(text[i:] for i in range(size))
        common = suffix_dedup.common_prefixes(data, order)
        for k in range(1, size):
            a, b = text[order[k - 1]:], text[order[k]:]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == min(n, suffix_dedup.LENGTH)


def test_suffix_dedup_edge_cases_and_salted_shards(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [*ODD, "ab" * 400, passage + " one", "two " + passage, "three " + passage[:150] + "?" + passage[150:], "z" * 99]
    docs = ragged(spark, texts).filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = _repeats(list(enumerate(texts)))
    for hot in (4096, 1):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        rows = suffix_dedup.deduplicate(docs).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in rows} == want
    assert suffix_dedup.deduplicate(docs.limit(0)).count() == 0
    assert suffix_dedup.deduplicate(ragged(spark, texts)).count() == len(texts) + 2


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup_keeps_one_text_of_repeated_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    passage, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    rows = [(None, "n" + other), (None, "n" + other), (None, "m" + passage), (None, "m" + passage), (1, passage), (1, passage), (2, "x " + other), (2, "y " + other), (2, "y " + other), (3, passage + "!"), (4, "short"), (4, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = {r["text"]: r["h"] for r in docs.select("text", F.hash("text").alias("h")).collect()}
    kinds = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, order[r[1]]))
    want = dict(zip(kinds, _repeats(list(enumerate(t for _, t in kinds))).values()))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.deduplicate(docs).collect()]
    assert sorted(got, key=str) == sorted(((d, *want[d, t]) for d, t in rows), key=str)
    assert sum(r[2] for r in got) > 0 and all(r[2] == 0 for r in got if r[0] is None)


# ---- 4 ----------------------------------------------------------------------------------------

def _lines_to_remove(docs):
    known, sets, index, out = {}, [], defaultdict(list), {}
    for d, text in docs:
        out[d] = []
        for k, line in enumerate((text or "").split("\n")):
            words = tuple(WORD.findall(line))
            if not words:
                continue
            if words in known:
                out[d].append(k)
                continue
            s = frozenset(words[j:j + 5] for j in range(max(1, len(words) - 4)))
            common = defaultdict(int)
            for x in s:
                for q in index[x]:
                    common[q] += 1
            if any(v >= 0.8 * (len(s) + len(sets[q]) - v) - 1e-9 for q, v in common.items()):
                out[d].append(k)
            known[words] = len(sets)
            for x in s:
                index[x].append(len(sets))
            sets.append(s)
    return out


def test_line_dedup_equals_brute_force(spark):
    got = {r["doc_id"]: list(r["removed_lines"]) for r in queries.op4_line_dedup(spark, SF).collect()}
    assert got == _lines_to_remove(documents(spark))


def test_line_dedup_families_and_edge_cases(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = list(ODD)
    for _ in range(60):                                    # a family of near copies, deeper than one rank
        words = list(base)
        for p in rng.integers(0, 60, rng.integers(0, 4)):
            words[p] = f"v{rng.integers(0, 50)}"
        texts.append("head\n" + " ".join(words))
    docs = ragged(spark, texts).filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = _lines_to_remove(list(enumerate(texts)))
    got = {r["doc_id"]: r for r in line_dedup.summary(docs).collect()}
    assert {d: list(r["removed_lines"]) for d, r in got.items()} == want
    kept = line_dedup.remove(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        whole = texts[r["doc_id"]]
        gone = set(want[r["doc_id"]])
        assert r["text"] == (whole if not gone else "\n".join(x for k, x in enumerate(whole.split("\n")) if k not in gone))
    odd = ragged(spark, texts)
    assert line_dedup.remove(odd).count() == odd.count()
    assert line_dedup.remove(docs.limit(0)).count() == 0


# ---- 5 ----------------------------------------------------------------------------------------

def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not full:
            break
        for s in full:
            out[s] = 3 * sizes[s]
            free.discard(s)
    return out | {s: level * weight[s] for s in free}


@pytest.mark.parametrize("odd", [False, True])
def test_mixing_hits_its_targets(spark, odd):
    if odd:
        docs = ragged(spark, [*ODD, "a few words"] * 3, {0: "b", 1: None, 5: "tiny", 8: "big", 9: "\u00e9", 10: "c"})
    else:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, draws = mixing.mix(docs)
    rows, again = out.collect(), mixing.mix(docs)[0].collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(rows, key=key) == sorted(again, key=key) and len(rows) == docs.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = _targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= mixing.BLOCK + 1
    per_block = draws.groupBy("k", "epoch", "block").count()
    assert per_block.filter("count > 1").count() == 0      # within an epoch, a permutation
    assert mixing.mix(docs.limit(0))[0].count() == 0


def test_mixed_shards_hold_the_words_taken(spark):
    rng = np.random.default_rng(6)
    sizes = {i: int(rng.integers(0, 900)) for i in range(60)}
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(n)) if n else None, "abc"[i % 3] if i % 7 else None) for i, n in sizes.items()], "doc_id long, text string, source string")
    out, draws = mixing.mix(docs)
    held = mixing.shards(docs).collect()
    assert len(held) == draws.count() and {r["slot"]: len(r["words"]) for r in held if r["k"] == 0} == {r["slot"]: r["words"] for r in draws.filter("k = 0").collect()}
    got = defaultdict(int)
    for r in held:
        assert 0 < len(r["words"]) <= mixing.BLOCK
        for w in r["words"]:
            got[int(w[1:w.index("w")])] += 1
    assert {r["doc_id"]: r["taken"] for r in out.collect() if r["taken"]} == dict(got)
    assert mixing.shards(docs.limit(0)).count() == 0


def test_swap_or_not_is_a_permutation(spark):
    for n in (1, 2, 3, 64, 101):
        at = mixing.swap_or_not(F.col("id"), F.lit(n).cast("bigint"), F.lit(7))
        assert sorted(r[0] for r in spark.range(n).select(at).collect()) == list(range(n))


def test_size_counts_words(spark):
    docs = ragged(spark, ODD)
    rows = docs.select("text", mixing.n_words(F.col("text")).alias("n_words")).collect()
    assert all(r["n_words"] == len(WORD.findall(r["text"] or "")) for r in rows)


# ---- 6 ----------------------------------------------------------------------------------------

def _winnow(text):
    words = re.findall(r"[^\x20\x09-\x0D]{1,32}", text)
    grams = [tuple(words[i:i + 5]) for i in range(max(min(1, len(words)), len(words) - 4))]
    return grams


def test_winnowing_contract(spark):
    docs = documents(spark)
    rows = {r["doc_id"]: r for r in queries.op6_winnowing(spark, SF).collect()}
    names = {}
    for k, (d, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        assert rows[d]["n_chars"] == len(text) and rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert names.setdefault(text, rows[d]["fingerprint"]) == rows[d]["fingerprint"]
        assert names.setdefault(edited, rows[d]["edited_fingerprint"]) == rows[d]["edited_fingerprint"]
        a, b = set(_winnow(text)), set(_winnow(edited))
        assert 0 <= rows[d]["near_next"] <= 1 and abs(rows[d]["near_edited"] - len(a & b) / max(1, len(a | b))) < 0.35


def test_winnowing_picks_and_match_guarantee(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdef"), n)) for n in (0, 1, 4, 5, 6, 12, 13, 40, 200)]
    df = winnow.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "chosen")
    rows = df.select("i", winnow.positions(F.col("chosen")).alias("at"), F.transform("chosen", lambda x: F.shiftrightunsigned(x, 31)).alias("hash")).collect()
    for r in rows:
        n = len(_winnow(texts[r["i"]]))
        assert list(r["at"]) == sorted(set(r["at"])) and all(0 <= p < n for p in r["at"])
        gaps = np.diff([-1, *r["at"], n])
        assert n == 0 and not r["at"] or (gaps <= winnow.WINDOW).all()
    shared = " ".join(f"s{i}" for i in range(winnow.GRAM + winnow.WINDOW - 1))
    two = winnow.with_fingerprint(spark.createDataFrame([(0, f"a b c {shared} d"), (1, f"{shared} x y")], "i int, text string"), "text", "chosen")
    a, b = [set(r[0]) for r in two.orderBy("i").select(winnow.hashes(F.col("chosen"))).collect()]
    assert a & b


def test_winnowing_edge_cases(spark):
    docs = ragged(spark, ODD)
    rows = winnow.compare(docs).collect()
    assert len(rows) == docs.count()
    empty = [r for r in rows if r["doc_id"] in (0, 1)]
    assert all(r["n_chars"] == 0 and r["near_edited"] == 1.0 and list(r["chosen"]) == [] for r in empty)
    assert winnow.compare(docs.limit(0)).count() == 0
    one = winnow.compare(docs.filter("doc_id = 8")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


# ---- 7 ----------------------------------------------------------------------------------------

def _simhash(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def _components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    docs = documents(spark)
    rows = {r["doc_id"]: r for r in queries.op7_simhash(spark, SF).collect()}
    fps = [_simhash(t) for _, t in docs]
    groups = _components(fps)
    for (d, _), fp, g in zip(docs, fps, groups):
        assert rows[d]["fingerprint"] == f"{fp:016x}" and rows[d]["component_id"] == docs[g][0]


def test_simhash_links_are_complete(spark):
    rng = np.random.default_rng(4)
    fps = []
    for _ in range(40):                                    # balls and chains of fingerprints, split anchors
        at = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            for p in rng.integers(0, 64, rng.integers(0, 5)):
                at ^= 1 << int(p)
            fps.append(at)
    fps = sorted(set(fps))
    signed = [int(np.array(f, dtype=np.uint64).view(np.int64)) for f in fps]
    want = len(set(_components(fps)))
    for homes in (2048, 1):
        edges = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), homes=homes).collect()]
        parent = {f: f for f in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
            parent[find(a)] = find(b)
        assert len({find(f) for f in signed}) == want


def test_simhash_edge_cases(spark):
    docs = ragged(spark, ODD)
    rows = {r["doc_id"]: r for r in simhash.groups(docs).collect()}
    assert all(rows[d]["fp"] == 0 and rows[d]["component_id"] == 0 for d in (0, 1, 2, 3))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == simhash.groups(docs).select("component").distinct().count()
    assert simhash.deduplicate(docs.limit(0)).count() == 0


# ---- 8 ----------------------------------------------------------------------------------------

def test_html_equals_the_article_of_every_page(spark):
    import html as escapes

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op8_html_text(spark, SF).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(escapes.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


PAGE = """<!doctype html><html><head><title>T {n}</title><style>p{{}}</style><script>if (1 < 2) "<p>no</p>";</script></head><body class="x">
<header id="top"><a href="/">Site</a></header><nav><ul><li>Menu {n}</li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="sidebar">Side {n}</div><div id="main-text"><h1>Title&nbsp;{n}</h1><p>First   <b>par</b>agraph &amp; {n}<br>more &lt;text&gt;.</p>
<ul><li>one {n}<li>two</ul><div class="ad">Buy {n}</div><form><label>Mail</label><input></form></div>
<section class="comments"><p>Reader {n} says</p></section><p>Read our terms</p><footer>(c) {n}</footer><noscript>off</noscript></body></html>"""


def test_html_without_an_article_element(spark):
    rows = [(n, f"http://h.example/{n}", PAGE.format(n=n)) for n in range(8)]
    got = {r["page_id"]: r["text"] for r in template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(8):
        assert got[n] == f"Title {n}\nFirst paragraph & {n} more <text>.\none {n}\ntwo"


def test_html_edge_cases(spark):
    rows = [(0, None, None, "x"), (1, "", "", "x"), (2, "no host", "plain & simple", "x"), (3, "http://a.b/", "<p>cut <b", "x"), (4, "http://a.b/", "<article><p>a<p>b</article></article><script>x", "x"),
            (4, "http://a.b/", "<article><p>a<p>b</article></article><script>x", "x"), (None, "http://a.b", "<main>" + "<p>w</p>" * 3000 + "</main>", "x"), (5, "http://a.b", "<!-- <article>no</article> --><body><p>yes", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = [(r["page_id"], r["text"]) for r in template_html.extract(pages).collect()]
    assert len(got) == len(rows)
    assert dict(got)[0] == "" and dict(got)[1] == "" and dict(got)[2] == "plain & simple" and dict(got)[3] == "cut" and dict(got)[4] == "a\nb" and dict(got)[5] == "yes"
    assert dict(got)[None] == "\n".join(["w"] * 3000)
    assert template_html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("raw", ["<script>for(i=0;i<n;i++){f(i)}</script>", "<SCRIPT>a<b</SCRIPT >", "<style>a<b{}</style>", "<script>x='</scripts>';y<z</script>", "\u0130<title>a<b \u0130</title>", "<script>a<!--b</script>"])
def test_html_raw_elements_end_at_their_own_end_tag(raw):
    got = template_html.main_text(f"<body>{raw}<article><p>Kept</p><script>1<x</script><p>too</p></article></body>", None, frozenset())
    assert got == "Kept\ntoo"


def _html(spark, bodies):
    rows = [(n, f"http://h.example/{n}", f"<html><body>{b}</body></html>") for n, b in enumerate(bodies)]
    return {r["page_id"]: r["text"] for r in template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_class_words_of_a_wrapper_do_not_drop_the_text(spark):
    for word in ("with-sidebar", "no-ads", "content-sidebar-wrap"):
        side = f'<div class="sidebar"><p>Side</p></div>'
        got = _html(spark, [f'<div class="{word}">{side}<article><p>Text {n}</p><div class="comments">c {n}</div></article><div class="related"><p>More {n}</p></div></div>' for n in range(6)])
        assert got == {n: f"Text {n}" for n in range(6)}, word
        got = _html(spark, [f'<div class="{word}">{side}<div class="body"><p>A longer text number {n}</p><p>and more of it</p></div><div class="related">More</div></div>' for n in range(6)])
        assert got == {n: f"A longer text number {n}\nand more of it" for n in range(6)}, word
    one = template_html.main_text('<article><p>Text</p></article><div class="related"><article>Teaser that is longer</article></div>', None, frozenset())
    assert one == "Text"


def test_html_template_decides_inside_and_outside_an_article(spark):
    box = '<div class="about-us"><p>We are a site.</p><p>Write to us.</p></div>'
    got = _html(spark, [f"<article><h1>Title {n}</h1><p>Text of page {n}</p>{box}</article>" for n in range(6)])
    assert got == {n: f"Title {n}\nText of page {n}" for n in range(6)}
    text = " ".join(["words of the page"] * 20)
    got = _html(spark, [f'<main class="teaser">Read {n}</main><div class="body"><p>{text} {n}</p></div>' for n in range(6)])
    assert got == {n: f"{text} {n}" for n in range(6)}


# ---- 10 ---------------------------------------------------------------------------------------

def _rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in host_reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_and_parts(spark):
    odd = [None, "", "no scheme/x", "HTTP://WWW.Example.NET/en/A?q#f", "http://example.net/EN/", "x://a.example.com/de/1://b", "http://org/fr/", "http://morg/fr/", "http://a.net", "http://a.net?x=/", "ftp://u@h.org:80/fr/x"]
    rows = [(k, u, "x") for k, u in enumerate(odd)] + [(None, "http://b.org/", "x")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in host_reputation.judge(pages, labels).collect() + queries.op10_url_filter(spark, SF).collect():
        rule, verdict = _rule(r["host"], r["path"])
        assert r["rule"] == rule and (verdict is None or r["verdict"] == verdict) and r["verdict"] in ("allow", "block")
    parts = {r["page_id"]: (r["host"], r["path"]) for r in host_reputation.judge(pages, labels).collect()}
    assert parts[0] == parts[1] == parts[2] == ("", "") and parts[3] == ("www.example.net", "/en/A") and parts[5] == ("a.example.com", "/de/1://b") and parts[9] == ("a.net", "")
    assert host_reputation.judge(pages.limit(0), labels).count() == 0


def test_reputation_shrinks_towards_its_domain(spark):
    rows = [("bad.evil.example", 1)] * 40 + [("new.evil.example", 1)] + [("good.fine.example", 0)] * 40 + [("new.fine.example", 1)] + [("a.other.test", 0)] * 30 + [("b.other.test", 1)] * 2
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    hosts = outcomes.select("host").distinct()
    got = {r["host"]: r for r in host_reputation.reputation(hosts, outcomes).collect()}
    assert got["bad.evil.example"]["bad_low"] > 0.5 > got["good.fine.example"]["bad_low"]
    assert got["new.evil.example"]["bad_rate"] > got["new.fine.example"]["bad_rate"]
    assert all(r["bad_low"] <= r["bad_rate"] for r in got.values())


# ---- pipeline ---------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    bench = [decontam.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontaminate", "mix"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        rows = [(r["doc_id"], r["text"]) for r in out.orderBy("doc_id").collect()]
        held = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert {d for d, _ in rows} <= set(held)
        if name == "line_dedup":
            gone = _lines_to_remove(sorted(held.items()))
            assert dict(rows) == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone[d])) for d, t in held.items()}
        elif name == "simhash":
            ids = sorted(held)
            groups = _components([_simhash(held[d]) for d in ids])
            assert [d for d, _ in rows] == [d for k, d in enumerate(ids) if groups[k] == k]
        elif name == "decontaminate":
            assert {d for d, _ in rows} == {d for d, t in held.items() if not any(b in decontam.normalise(t) for b in bench)}
        docs = spark.createDataFrame(rows, "doc_id long, text string").join(docs.drop("text"), "doc_id").select(*columns)
    mixed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert 0 < mixed.count() <= before and mixed.filter("taken <= 0 or taken > 3 * size").count() == 0
