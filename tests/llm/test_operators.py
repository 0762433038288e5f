"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from placelore.llm import anchors, lempelziv, runindex
from placelore.llm.op1_chat_formatting import preference_pairs
from placelore.llm.op2_license_scan import TEMPLATES, scan
from placelore.llm.op3_suffix_dedup import remove_repeats
from placelore.llm.op4_best_fit_packing import Plan, cut, pack, token_ids
from placelore.llm.op5_ngram_jaccard import choose_bands, classes
from placelore.llm.op6_token_counts import Counter as TokenCounter
from placelore.llm.op6_token_counts import default_model, prefix_counts, token_counts, within
from placelore.llm.op7_learned_partitions import search
from placelore.llm.op8_quality_cascade import RULES, measure, order_rules, quality_cascade, verdict
from placelore.llm.op9_substring_dedup import remove_repeated_passages
from placelore.llm.op10_temperature_mixing import entropy_exponent, mix, repetition_exponent

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, n_words long, row string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}é"[: rng.randint(2, 6)] for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, a passage in many documents, nulls, empty texts, repeats, a long text."""
    rng = random.Random(3)
    passage, common = words(rng, 70), words(rng, 60)
    out = []
    for i in range(60):
        w = words(rng, rng.randint(0, 260))
        if i % 5 == 0:
            w[10:10] = passage
        if i % 2 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = common
        out.append(" ".join(w) if i % 3 else "\n".join([" ".join(w[:40]), " ".join(w[40:]), "same line", "same line"]))
    out += [out[7], out[7], None, "", "   ", "a", "a", "x" * 3000, "ab" * 2000, " ".join(words(rng, 30_000))]
    near = out[11].split()
    near[len(near) // 2] = "changed"
    out.append(" ".join(near))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), -1, -2, "clash") for i, t in enumerate(texts)]
    rows += [rows[12], (None, texts[3], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_spans(docs, split, window=50):
    """{(id, text): covered flags}; a null id comes after all others."""
    key = lambda d: (1 << 63) - 1 if d is None else d
    first: dict = {}
    rows = [(key(r["doc_id"]), r["text"] or "") for r in docs.collect()]
    for d, t in rows:
        s = split(t)
        for p in range(len(s) - window + 1):
            w = tuple(s[p : p + window])
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in rows:
        s = split(t)
        gone = [False] * len(s)
        for p in range(len(s) - window + 1):
            if first[tuple(s[p : p + window])] < d:
                gone[p : p + window] = [True] * window
        out[d, t] = (s, gone)
    return out


@pytest.mark.parametrize("hot", [1000, 3])
def test_suffix_dedup(docs, hot):
    want = brute_spans(docs, lambda t: list(t.encode()))
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    got = remove_repeats(docs, hot=hot).select("row.doc_id", "row.row", "n_bytes", "begins", "ends", "kept").collect()
    assert len(got) == docs.count()
    seen = 0
    for r in got:
        if r["doc_id"] is None:
            continue
        s, gone = want[r["doc_id"], text[r["doc_id"]] or ""]
        assert r["row"] == "clash"
        assert r["n_bytes"] == len(s)
        assert bytes(r["kept"]) == bytes(c for c, g in zip(s, gone) if not g)
        assert len(r["begins"]) == sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        seen += sum(gone)
    assert seen > 10_000


def test_phrases_partition_the_windows():
    win = anchors.Windows("bytes", 50, 18)
    sym = win.hashed(np.frombuffer(random.Random(1).randbytes(400), np.uint8))
    h, first, size, of = win.phrases(sym, np.array([0]), np.array([0]), np.array([400]))
    assert size.sum() == 351 and (np.diff(first) == size[:-1]).all()


def test_numbers_travel_tightly():
    rng = np.random.default_rng(1)
    ends = np.array([0, -1, (1 << 63) - 1, -(1 << 63), 5])
    big = rng.integers(-(1 << 63), (1 << 63) - 1, 1000)
    for arrays in ((ends, ends[::-1]), (big, np.arange(1000)), (np.zeros(0, np.int64),) * 2):
        assert all((a == b).all() for a, b in zip(arrays, anchors.loose(anchors.tight(*arrays), 2), strict=True))
    assert (anchors.loose(anchors.tight(big.view(np.uint64)), 1)[0] == big).all()
    assert len(anchors.tight(np.arange(100_000))) < 10_000


def test_windows_of_hot_anchors_travel_without_their_symbols():
    win, n, texts = anchors.Windows("bytes", 50, 18), 8, [random.Random(i).randbytes(1000) for i in range(40)]
    found = [win.phrases(win.hashed(np.frombuffer(t, np.uint8)), np.array([0]), np.array([0]), np.array([1000]))[0] for t in texts]
    press = zstandard.ZstdCompressor()
    batch = pa.RecordBatch.from_pydict({"did": range(40), "fp": range(40), "nth": [1] * 40, "z": [press.compress(t) for t in texts], "anchors": [anchors.tight(np.unique(anchors.tag_of(h, n)) | 1) for h in found]})
    out = pa.Table.from_batches(list(anchors.cut(win, n)([batch])))
    blobs = [b for k, b in zip(out["kind"].to_pylist(), out["blob"].to_pylist()) if k == anchors.WINDOW]
    assert anchors.loosed(blobs, 5).shape[1] == 40 * 951
    assert sum(map(len, out["blob"].to_pylist())) < 24 * 40 * 951  # 50 bytes of text and 42 of numbers for each, once


@pytest.mark.parametrize("hot", [1000, 3])
def test_substring_dedup(docs, hot):
    want = brute_spans(docs, lambda t: t.encode().split())
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    got = remove_repeated_passages(docs, hot=hot).select("row.doc_id", "n_words", "n_removed", "kept", "left_text").collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            continue
        s, gone = want[r["doc_id"], text[r["doc_id"]] or ""]
        kept = b" ".join(c for c, g in zip(s, gone) if not g)
        assert (r["n_words"], r["n_removed"]) == (len(s), sum(gone))
        assert hashlib.sha256(r["kept"].encode()).digest() == hashlib.sha256(kept).digest()
        assert r["left_text"].encode().split() == kept.split()
    assert sum(r["n_removed"] for r in got) > 1000


def test_repeats_of_an_empty_table(empty):
    assert remove_repeats(empty).count() == remove_repeated_passages(empty).count() == 0


def matching(index, pattern):
    return [max((k for k in range(len(pattern) - i + 1) if pattern[i : i + k] in index), default=0) for i in range(len(pattern))]


def test_matching_statistics_of_the_run_index():
    rng = random.Random(2)
    for _ in range(30):
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(5, 120)))
        p = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40))) for _ in range(4)]
        sym = np.array([*[c + 1 for c in t], 0], np.int64)
        flat = np.array([c + 1 for x in p for c in x], np.int64)
        lens = np.array([len(x) for x in p])
        got = runindex.RunIndex(sym).statistics(flat, np.cumsum(lens) - lens, lens)
        assert got.tolist() == [m for x in p for m in matching(t, x)]


def test_relative_factors():
    code = np.array([5, 6, 7, 8, 0, 5, 6, 7, 9, 6, 7, 8, 1])
    best, _ = lempelziv.longest(code, 5)
    assert best[:3].tolist() == [3, 2, 1] and best[4:7].tolist() == [3, 2, 1]
    of, at, size = lempelziv.factors(best, np.array([0]), np.array([7]))
    assert size.tolist() == [3, 1, 3]


def test_token_counts_equal_the_library(spark, docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    got = token_counts(docs, limit=50).select("row.doc_id", "row.row", "n_bytes", "n_tokens", "over_limit", "fit_bytes").collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is not None:
            t = text[r["doc_id"]]
            n = len(sp.encode(t))
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 50)
            assert len(sp.encode(t.encode()[: r["fit_bytes"]].decode())) <= 50
    assert token_counts(empty).count() == 0


def test_every_prefix_has_its_count():
    import sentencepiece

    sp, c = sentencepiece.SentencePieceProcessor(model_file=default_model()), TokenCounter(default_model())
    rng = random.Random(4)
    some = ["".join(rng.choice("  the▁ing漢🙂é\n\t<s>0x") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    assert c.count([t.encode() for t in some])[0].tolist() == [len(sp.encode(t)) for t in some]
    chunk = "▁internationalisation,漢!".encode().replace("▁".encode(), b" ")
    table = c.table(np.frombuffer(chunk, np.uint8), np.array([0]), np.array([len(chunk)]))[:, 0]
    assert table.tolist() == c.long(chunk)
    for i, n in enumerate(table.tolist()):
        if n > 0 and i > 1:  # the first byte is the added space
            assert n == len(sp.encode(chunk[1:i].decode()))


def test_prefix_counts_answer_any_budget(spark, docs, empty, monkeypatch):
    import sentencepiece

    from placelore.llm import op6_token_counts as op6

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    some = ["the  internationalisation,漢 of ▁▁ things🙂 \n<s>", "", None, "x" * 900, " ", "▁", "y" * 100_000, "a b " * 300]
    rows = spark.createDataFrame([*enumerate(some), (3, some[3])], "doc_id long, text string")
    counted = prefix_counts(rows)
    got: dict = {}
    for r in counted.where("row.doc_id <> 6").collect():
        assert r["start"] == 0
        got[r["row"]["doc_id"]] = r["counts"]
    for i, t in enumerate(some):
        if i != 6:
            raw = (t or "").encode()
            assert len(got[i]) == len(raw) + 1
            for b, n in enumerate(got[i]):
                inside = b < len(raw) and raw[b] & 0xC0 == 0x80
                assert n == (None if inside else len(sp.encode(raw[:b].decode()))), (i, b)
    blocks = counted.where("row.doc_id = 6").select("start", F.size("counts")).collect()
    assert sorted(map(tuple, blocks)) == [(0, op6.BLOCK), (op6.BLOCK, 100_001 - op6.BLOCK)]
    for r in within(counted, F.col("row.doc_id"), [-1, 0, 7, 50, 10**6]).collect():
        prefixes = got.get(r["key"])
        if prefixes is not None:
            fits = [b for b, n in enumerate(prefixes) if n is not None and n <= r["budget"]]
            assert (r["fit_bytes"], r["n_tokens"]) == (fits[-1], prefixes[fits[-1]])
        assert r["budget"] >= 0
    for r in token_counts(rows, limit=7).where("row.doc_id <> 6").collect():
        assert r["fit_bytes"] == max(b for b, n in enumerate(got[r["row"]["doc_id"]]) if n is not None and n <= 7)
    assert prefix_counts(empty).count() == 0 and within(prefix_counts(empty), F.col("row.doc_id"), [5]).count() == 0
    monkeypatch.setattr(op6, "KNOWN", 50)
    texts = ["the quick brown fox jumps over lazy dogs " * 3, "another of many sentences with other words"]
    assert TokenCounter(default_model()).count([t.encode() for t in texts])[0].tolist() == [len(sp.encode(t)) for t in texts]


def test_packing_round_trip(docs, texts, empty):
    from placelore.llm.op4_best_fit_packing import encoders

    library = encoders("byte_bpe_50k")[1]
    got = pack(docs, room=64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        rows = sorted(by_doc[i], key=lambda r: (r["piece"], r["sequence_id"]))[:: 2 if i == 12 else 1]
        assert sum(r["length"] for r in rows) == len(ids)
        for r in rows:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            assert r["length"] == 64 or r["piece"] == 0
    total = sum(r["length"] for r in got)
    assert len(by_seq) <= -(-total // 64) * 1.02 + 1
    assert pack(empty).count() == 0


def test_special_strings_and_long_runs_are_ids_as_in_the_library():
    from placelore.llm.op4_best_fit_packing import encoders

    library = encoders("byte_bpe_50k")[1]
    for t in ("a<|endoftext|>b <|endoftext|>", "x" * 5000 + " y", "漢" * 900, "  \n\n tab\t", "it's 123 Été"):
        assert token_ids(t.encode()).tolist() == library.encode(t, add_special_tokens=False).ids


def test_ids_of_all_texts_are_the_librarys():
    import pyarrow.parquet as pq

    from placelore.llm.op4_best_fit_packing import encoders

    library = encoders("byte_bpe_50k")[1]
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()]
    for i in range(0, len(texts), 500):
        for t, e in zip(texts[i : i + 500], library.encode_batch_fast(texts[i : i + 500], add_special_tokens=False), strict=True):
            assert token_ids(t.encode()).tolist() == e.ids


def lengths_of(kind: str) -> np.ndarray:
    rng = np.random.default_rng(5)
    if kind == "uniform":
        return rng.integers(1, 1025, 20_000)
    if kind == "large":
        return rng.integers(300, 1025, 20_000)
    if kind == "log-normal":
        return np.concatenate([cut(int(n), 1024) for n in np.exp(rng.normal(5.5, 1, 20_000)) + 1])
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    return np.concatenate([cut(len(token_ids((t or "").encode())) + 1, 1024) for t in texts])


@pytest.mark.parametrize("kind", ["uniform", "large", "log-normal", "real"])
def test_plan_needs_no_more_sequences_than_best_fit_alone(kind):
    count = np.bincount(lengths_of(kind), minlength=1025)
    plan = Plan.best(count)
    used = np.zeros(1025, np.int64)
    for some, times in plan.patterns:
        assert sum(some) <= 1024
        np.add.at(used, list(some), times)
    assert (used == count).all()
    assert plan.sequences <= Plan(count, sums=0).sequences
    if kind in ("log-normal", "real"):
        assert plan.sequences <= 1 + -(-int(count @ np.arange(1025)) // 1024)


def test_complements_of_one_two_and_three_lengths():
    for gap, count in (((4,), {6: 2, 4: 2}), ((3, 2), {5: 1, 3: 1, 2: 1}), ((3, 2, 1), {4: 1, 3: 1, 2: 1, 1: 1})):
        plan = Plan(np.bincount([x for x, n in count.items() for _ in range(n)], minlength=11), 10)
        assert plan.sequences == max(count.values()) and sorted(plan.patterns[0][0][1:], reverse=True) == sorted(gap, reverse=True)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for _ in range(20):
        count = np.bincount(rng.integers(1, 101, rng.integers(0, 400)), minlength=101)
        plan = Plan.best(count, 100)
        used = Counter()
        for lengths, times in plan.patterns:
            assert sum(lengths) <= 100
            for x in lengths:
                used[x] += times
        assert all(used[i] == n for i, n in enumerate(count.tolist()))


def jaccard_classes(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = defaultdict(set)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (min(seen), len(links[i]))
    return out


def test_jaccard_classes(spark, empty):
    rng = random.Random(6)
    base = [words(rng, 120, 5000) for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(12, 90):  # copies with zero to four changed words: some just under the threshold
        w = list(base[i % 4])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "a b"), (204, " \n ")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, class_id string")
    got = {r["node"]: (r["class_id"], r["n_links"]) for r in classes(df).collect()}
    assert got == jaccard_classes(rows)
    assert classes(empty).count() == 0


def test_jaccard_rows_without_id_and_repeated_rows(docs):
    got = classes(docs).collect()
    assert len({r["node"] for r in got}) == len(got) == docs.select(F.col("doc_id")).distinct().count() - 1 + 2
    assert all(r["class_id"] <= r["node"] for r in got)


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_nearest_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(12, 16))
    v = centre[rng.integers(0, 12, 4000)] + 0.4 * rng.normal(size=(4000, 16))
    v[100:400] = v[100]  # a hot vector
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(c)) for c in x], 1) for i, x in enumerate(v)]
    bad = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [None] * 16, 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in search(df, df.where("vec_id % 20 = 0"), k=20, probes=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    x = np.array([r[1] for r in rows])
    hit = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(4000), -np.round(s, 12)))[:20]
        found = [g[0] for g in got[q]]
        hit += len(set(best.tolist()) & set(found))
        assert [g[2] for g in got[q]] == list(range(1, len(found) + 1))
        assert all(abs(g[1] - s[g[0]]) < 1e-9 for g in got[q])
        assert got[q] == sorted(got[q], key=lambda g: (-g[1], g[0]))
    assert hit / (200 * 20) >= 0.9
    assert set(got) == set(range(0, 4000, 20))
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search(none, none).count() == 0


def test_quality_measures_and_order(docs, empty, texts):
    import re

    got = {r["doc_id"]: r for r in quality_cascade(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert quality_cascade(empty).count() == 0
    some = [t.encode() for t in texts if t] + [b"WORD!! " * 1 + b" ".join(b"UP%d!!" % i for i in range(30)), b" ".join(b"a%d###" % i for i in range(40))]
    m = measure(some)
    assert (verdict(some, m, list(RULES)) == verdict(some, m, list(RULES)[::-1])).all()
    assert {r.name for r in order_rules(some)} == {r.name for r in RULES}


def test_preference_pairs(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "no"),
        (2, 0, "user", "a"), (3, 0, "user", "a"),
        (4, 0, None, None), (4, 0, None, None), (4, None, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, prompt int")
    out = {r["pair_id"]: r for r in preference_pairs(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    a = out[0]
    assert a["prompt"] == "<|user|>\nhi<|end|>\n" and a["n_prompt_turns"] == 1
    assert [a["chosen"][m["begin"] : m["end"]] for m in a["chosen_mask"]] == ["yes<|end|>"]
    assert [a["rejected"][m["begin"] : m["end"]] for m in a["rejected_mask"]] == ["no<|end|>"]
    assert (out[1]["chosen"], out[1]["rejected"], out[1]["n_prompt_turns"]) == ("", "", 1)
    assert out[2]["rejected_id"] is None and out[2]["n_prompt_turns"] == 0 and out[2]["chosen"].startswith("<|user|>\nx")
    assert preference_pairs(df.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


def test_license_scan(spark, docs, empty):
    said = [
        (1, "Intro. released UNDER the  mit license! More words follow here."),
        (2, "This work is licensed under the GNU General Public, version 3, and so on"),  # a word is missing
        (3, "Licensed under the Apache License, Version 2.0. And: Licensed under the Apache License, Version 2.0."),
        (4, "nothing here about the work under way"), (5, None), (6, ""), (1, "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(*r, 9) for r in said], "doc_id long, text string, begin int")
    got = sorted((r["doc_id"], r["template"], round(r["coverage"], 2), r["found"]) for r in scan(df).collect())
    assert [g[:3] for g in got] == [(1, "mit", 1.0), (1, "mit", 1.0), (2, "gpl-3.0", 0.92), (3, "apache-2.0", 1.0), (3, "apache-2.0", 1.0)]
    text = dict(said[:4])
    for r in scan(df).where("doc_id = 3").collect():
        assert text[3][r["begin"] : r["end"]] == r["found"]
    assert scan(empty).count() == scan(docs).count() == 0
    assert len({n for n, _ in TEMPLATES}) == len(TEMPLATES)


def test_mixing_weights(spark, docs, empty):
    rows = [(i, " ".join(["w"] * 50), "big" if i < 800 else "mid" if i < 960 else "small", 0) for i in range(1000)] + [(2000, None, None, 0), (None, "x y", "small", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int")
    out = mix(df, limit=3.0, block_tokens=200).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"), F.max("epoch").alias("e")).collect()
    n = {r["source"]: (r["n"], r["d"]) for r in out}
    t = repetition_exponent(42 / 1002, 800 / 1002, 3.0)
    assert n["big"][0] == 800 and n[None] == (1, 1)
    assert 2.7 <= n["small"][0] / 41 <= 3.1
    assert abs(n["mid"][0] / 160 - (800 / 160) ** (1 - t)) < 0.15
    assert {s: d for s, (_, d) in n.items()} == {"big": 800, "mid": 160, "small": 40, None: 1}
    with pytest.MonkeyPatch.context() as patch:  # many sources: salted instead of broadcast
        patch.setattr("placelore.llm.op10_temperature_mixing.FEW_SOURCES", 1)
        again = mix(df, limit=3.0, block_tokens=200)
        assert sorted(map(str, again.collect())) == sorted(map(str, mix(df, limit=3.0, block_tokens=200).collect()))
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "share double")
    e = entropy_exponent(shares, 1.0)
    w = np.array([0.7, 0.2, 0.1]) ** e
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-6
    assert mix(empty).count() == 0
    assert mix(docs, keep=True).columns == docs.columns and mix(docs).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    spoken = lambda n: [''.join(rng.choice('abcdefghijklmnop') for _ in range(rng.randint(3, 8))) for _ in range(n)]
    clean = [" ".join(spoken(150)) for _ in range(30)]
    passage = " ".join(spoken(60))
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "s0", 1), (101, clean[1].replace(clean[1].split()[70], "zz"), "en", "s0", 1), (102, "short", "en", "s1", 5), (103, None, None, None, None)]
    rows += [(110 + i, " ".join([*spoken(40), passage, *spoken(40)]), "en", "s1", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, "")
        assert at.columns == docs.columns, name
        ids = {r["doc_id"] for r in at.select("doc_id").collect()}
        assert set(range(30)) <= ids, name
        if name == "quality rules":
            assert 102 not in ids and 103 not in ids
        if name == "near duplicates":
            assert 100 not in ids and 101 not in ids and {110, 111, 112} <= ids
        if name == "repeated passages":
            assert sum(passage in (r["text"] or "") for r in at.collect()) == 1
            assert all(r["n_chars"] == len(r["text"]) for r in at.where("doc_id >= 110").collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, "").collect()
    assert {r["doc_id"] for r in pieces} >= set(range(30))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
    assert len(corpus_pipeline.STAGES) == 5


def test_nearest_neighbours_recall_with_many_partitions(spark, monkeypatch):
    """More partitions than probes, on vectors without clusters: the probes grow until the recall is there."""
    monkeypatch.setattr("placelore.llm.op7_learned_partitions.EACH", 128)
    x = np.random.default_rng(1).normal(size=(6000, 32)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    for recall in (0.9, 0.6):
        got = defaultdict(set)
        for r in search(df, df.where("vec_id % 10 = 0"), sample=3000, probes=4, recall=recall).collect():
            got[r["query_id"]].add(r["vec_id"])
        hit = 0
        for q in range(0, 6000, 10):
            s = x @ x[q]
            s[q] = -np.inf
            hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
        assert recall <= hit / (600 * 20) < 1  # 46 partitions: neither the first 4 nor all of them
    few = search(df, df.where("vec_id < 20"), sample=3000, probes=4).collect()  # too few to measure on: an exact scan
    for q in range(20):
        s = x @ x[q]
        s[q] = -np.inf
        assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"]) if r["query_id"] == q] == np.argsort(-s)[:20].tolist()


def test_nearest_neighbours_recall_at_fifty_thousand(spark, tmp_path):
    """Queries are the ids divisible by 50, against all rows, through about 195 partitions of which some are searched."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(2)
    x = (rng.normal(size=(300, 24))[rng.integers(0, 300, 50_000)] + 0.6 * rng.normal(size=(50_000, 24))) * rng.uniform(0.8, 1.2, (50_000, 1))
    pq.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": pa.array(x.tolist())}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = defaultdict(set)
    for r in search(df, df.where("vec_id % 50 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    q = np.arange(0, 50_000, 50)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    best = np.argpartition(-s, 20, axis=1)[:, :20]
    assert all(len(got[i]) == 20 for i in q.tolist())
    hit = sum(len(got[i] & set(b)) for i, b in zip(q.tolist(), best.tolist(), strict=True))
    assert 0.9 <= hit / (20 * len(q)) < 1  # below 1: not all partitions were searched


def test_nearest_neighbours_of_odd_rows(spark):
    """Ragged vectors, repeated ids with other vectors, fewer candidates than asked for."""
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0, 1.0]), (5, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in search(df, df).collect()}
    assert got == {(1, 1): (3, 0.5), (1, 2): (2, 0.0), (2, 1): (3, 2.0), (2, 2): (1, 0.0), (3, 1): (2, 2.0), (3, 2): (1, 1.0)}


def test_license_notices_back_to_back(spark):
    """Each of several short notices that stand closer together than the band, whole or without a word."""
    name = dict(TEMPLATES)
    mit, apache, cc = name["mit"], name["apache-2.0"], name["cc-by-nc-4.0"]
    less = "Licensed under the Apache License, Version 2."
    said = {
        1: ("mit", [mit] * 2), 2: ("mit", [mit] * 40), 3: ("cc-by-nc-4.0", [cc] * 4), 4: ("apache-2.0", [apache] * 3),
        5: ("apache-2.0", [apache, less, less, apache]), 6: ("mit", ["Released under the MIT.", mit, mit, "Under the MIT License."]),
        7: ("mit", ["released under the GPL.", "released under the MIT.", "released under the MIT."]),
    }
    df = spark.createDataFrame([(i, "\n".join(lines)) for i, (_, lines) in said.items()], "doc_id long, text string")
    got = defaultdict(list)
    for r in scan(df).orderBy("doc_id", "begin").collect():
        got[r["doc_id"], r["template"]].append(r["found"])
    for i, (template, lines) in said.items():
        assert got[i, template] == [x.removesuffix(".") for x in lines if "GPL" not in x]


def matched_words(template: list[str], text: list[str]) -> list[list[int]]:
    """Brute force: for each window of the text the words it has in common with the template, in order."""
    longest = [[0] * (len(text) + 1) for _ in range(len(text) + 1)]
    for i in range(len(text)):
        row = [0] * (len(template) + 1)
        for j in range(i, len(text)):
            new = [0]
            for k, t in enumerate(template):
                new.append(row[k] + 1 if t == text[j] else max(row[k + 1], new[k]))
            row = new
            longest[i][j + 1] = row[-1]
    return longest


def test_license_scan_against_brute_force(spark):
    """Words changed or left out, within the coverage and beyond: a notice is found if brute force finds it, and not otherwise."""
    from placelore.llm.op2_license_scan import plain

    rng = random.Random(21)
    split = lambda t: plain(t.encode()).decode().split()
    other = [f"q{i}" for i in range(50)]
    rows, want = [], {}
    for name, text in TEMPLATES:
        for share in (0, 0.1, 0.2, 0.3):
            said = split(text)
            places = rng.sample(range(len(said)), int(share * len(said) + 1e-9))
            for p in sorted(places, reverse=True):
                said[p : p + 1] = [rng.choice(other)] if rng.random() < 0.5 else []
            rows.append((len(rows), " ".join([*rng.sample(other, 20), *said, *rng.sample(other, 20)])))
            if share <= 0.2:
                want[rows[-1][0]] = name
    got = defaultdict(list)
    for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append(r)
    by_name = {n: split(t) for n, t in TEMPLATES}
    for i, name in want.items():
        assert got[i], (name, rows[i])
        if name in ("apache-2.0-notice", "bsd-3-clause", "cc0-1.0", "isc", "mit-text", "mpl-2.0", "zlib"):  # without near relatives
            assert name in [r["template"] for r in got[i]], (name, got[i])
    for i, found in got.items():
        for r in found:
            said = split(r["found"])
            assert matched_words(by_name[r["template"]], said)[0][len(said)] == r["n_matched"] or len(said) > 60
            assert r["n_matched"] >= 0.8 * r["n_template_words"]


def test_license_templates_of_any_length(spark):
    df = spark.createDataFrame([(1, "All rights RESERVED (c) by WTFPL, two three")], "doc_id long, text string")
    assert scan(df, templates=()).count() == 0
    found = scan(df, templates=(("none", "..."), ("one", "wtfpl"), ("two", "two  Three"), ("five", "All rights waived by wtfpl"))).collect()
    assert sorted((r["template"], r["found"]) for r in found) == [("five", "All rights RESERVED (c) by WTFPL"), ("two", "two three")]
    assert [r["found"] for r in scan(df, templates=(("one", "wtfpl"),)).collect()] == ["WTFPL"]


def test_near_duplicates_of_texts_that_share_an_id(spark):
    import corpus_pipeline

    rng = random.Random(12)
    a, b, c, d, e = (" ".join(words(rng, 80)) for _ in range(5))
    rows = [(1, a), (5, b), (5, c), (5, c), (7, a), (7, d), (9, b), (None, e), (None, e), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted([(1, a), (5, b), (5, c), (7, d), (None, e)], key=key)


def test_pipeline_stages_on_empty_tables_and_clashing_columns(spark, empty):
    """Columns that the stages use inside, rows that differ in other columns only, ids and texts that are null."""
    import corpus_pipeline

    rng = random.Random(13)
    a, b = (" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(120)) for _ in range(2))
    schema = SCHEMA + ", fp long, place long, `a.b` string, mix_tokens int, mix_epoch int, mix_salt string"
    more = (9, 8, "dot", 7, 6, "salt")
    rows = [(2, a, "en", "s", len(a), 5, 4, "r", *more), (2, a, "de", "s", len(a), 5, 4, "r", *more), (3, b, None, None, None, 1, 1, None, *more), (None, None, None, None, None, None, None, None, *more)]
    docs = spark.createDataFrame(rows, schema)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        kept = {(r["doc_id"], r["node"], r["a.b"], r["mix_tokens"], r["place"]) for r in got.collect()}
        assert {(2, 5, "dot", 7, 8), (3, 1, "dot", 7, 8)} <= kept, name
        assert stage(spark, none, "").count() == 0, name
    assert [(r["doc_id"], r["lang"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").where("doc_id = 2").collect()] == [(2, "de")]
    assert corpus_pipeline.packing(spark, none, "").count() == 0
