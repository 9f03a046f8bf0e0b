import collections
import hashlib
import math
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldlark.llm import queries as Q
from fieldlark.llm.decontamination import find_leaks
from fieldlark.llm.blocks import blocks
from fieldlark.llm.fingerprints import fingerprint_documents, nfkc
from fieldlark.llm.near_dedup import near_duplicates
from fieldlark.llm.packing import pack_documents
from fieldlark.llm.quality import fit_quality, score_quality
from fieldlark.llm.sharding import shard_rows
from fieldlark.llm.span_dedup import remove_repeats
from fieldlark.llm.token_counts import count_tokens
from fieldlark.llm.toxicity import fit_toxicity, score_toxicity
from fieldlark.llm.url_filters import filter_urls, list_entries

SCHEMA = "doc_id long, text string, score string, id string, node string, key int, h string, kept int, member string, removed int, runs string, shard string, slot string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, "One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen."),
    (2, "One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen."),
    (2, "other text with the same id."),
    (3, None), (4, ""), (5, LONG), (5, LONG), (6, "  \n "), (7, "solo"), (8, "SOLO"), (None, "no id here at all"), (None, None), (9, "Ünïcödé ﬁx Å <|endoftext|> é"), (10, "bad   line\x85sep"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *[None] * 12) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(table):
    return {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}


def test_odd_rows(spark, docs, none):
    n = len(ROWS)
    assert fingerprint_documents(docs).count() == count_tokens(docs).count() == near_duplicates(docs).count() == remove_repeats(docs).count() == shard_rows(docs, shards=3).count() == n
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "Seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, "solo"), (4, "solo")], "item_id long, text string")
    assert score_quality(docs, fit_quality(docs, labels), keep_columns=True).count() == n
    assert score_toxicity(docs, fit_toxicity(docs, labels)).count() == n
    pieces = pack_documents(docs).collect()
    assert sum(p.length for p in pieces) == sum(r.n_tokens + 1 for r in count_tokens(docs).collect())
    leaks = sorted((r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect())
    assert leaks == [(1, 1), (2, 1), (7, 4), (7, 4), (8, 4), (8, 4)]
    for out in (fingerprint_documents(none), count_tokens(none), near_duplicates(none), remove_repeats(none, keep_columns=True), shard_rows(none), pack_documents(none), score_quality(none, fit_quality(none, labels)), score_toxicity(none, fit_toxicity(none, labels)), find_leaks(none, bench), find_leaks(docs, bench.limit(0))):
        assert out.count() == 0
    kept = remove_repeats(docs, keep_columns=True)
    assert set(kept.columns) >= set(docs.columns) - {"removed"}


def test_nfkc(spark):
    pool = "aeọ́̋ ﬁ½ﷺｶﾞㄱ가각각qͅǅ゙かཱིུ①²"
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list(pool), rng.integers(0, 9))) for _ in range(400)]
    got = {r.i: r.n for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", nfkc(F.col("t")).alias("n")).collect()}
    assert got == {i: unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}


def test_op1(spark, sf_dir, texts):
    canon = lambda t: re.sub(r"[\s\x1c-\x1f\x85]+", " ", unicodedata.normalize("NFKC", t).upper().lower()).strip()
    got = {r.doc_id: r for r in Q.op1_fingerprints(spark, sf_dir).collect()}
    order = sorted(texts, reverse=True)
    seen = {}
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got.pop(i)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited, r.near_next) == (float(canon(t) == canon(edited)), float(canon(t) == canon(nxt)))
        for c, f in ((canon(t), r.fingerprint), (canon(edited), r.edited_fingerprint)):
            assert seen.setdefault(c, f) == f
    assert not got and len(set(seen.values())) == len(seen)


def test_op2_and_op10(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    from fieldlark.llm.pieces import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in texts.items()}
    assert {r.doc_id: r.n_tokens for r in Q.op10_token_counts(spark, sf_dir).collect()} == {i: len(x) - 1 for i, x in ids.items()}
    at, windows = collections.Counter(), collections.defaultdict(list)
    for r in sorted(Q.op2_packing(spark, sf_dir).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        windows[r.sequence_id].append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:k]) for k in range(len(w))] and sum(n for _, n in w) <= 2048
    assert sum(at.values()) / (2048 * len(windows)) > 0.97


def test_op3_against_sql(spark, sf_dir):
    from compare import assert_same, connect

    assert_same(Q.op3_url_filters(spark, sf_dir), connect(sf_dir), Q.ORACLES["op3_url_filters"])


def test_url_rules(spark):
    entries = list_entries(spark, (("bad.org", None, "2024-01-01", "block", "x"), ("bad.org", "", "2024-03-01", "end", None), ("bad.org", "/ok", "2024-01-10", "allow", "y"), (None, "", "2024-01-01", "block", "z"), ("sub.bad.org", "", "2024-02-01", "block", "s")))
    rows = [("http://BAD.org./a", "2024-01-05"), ("http://u:p@www.bad.org:80/ok/b?q", "2024-02-05"), ("http://bad.org/a", "2024-03-01"), ("http://sub.bad.org/ok", "2024-02-02"), ("http://notbad.org/", "2024-01-05"), (None, "2024-01-05"), ("", None), ("http://bad.org/a", None)]
    df = spark.createDataFrame(rows, "url string, day string").withColumn("fetched_on", F.col("day").cast("date")).withColumn("rule", F.lit("old"))
    got = [(r.url, r.day, r.decision) for r in filter_urls(df, entries).collect()]
    want = ["drop", "keep", "keep", "drop", "keep", "keep", "keep", "keep"]
    assert sorted(got, key=str) == sorted([(u, d, w) for (u, d), w in zip(rows, want)], key=str)
    assert {r.decision for r in filter_urls(df, list_entries(spark, ())).collect()} == {"keep"}


def components_of(texts, n, share=0.8):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    inverted = collections.defaultdict(list)
    for i, s in sorted(sets.items()):
        near = collections.Counter(j for x in s for j in inverted[x])
        for j, inter in near.items():
            if 100 * inter >= 100 * share * (len(s) + len(sets[j]) - inter):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            inverted[x].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_op7_by_brute_force(spark, sf_dir, table, texts, n):
    rows = (Q.op7_near_dedup(spark, sf_dir) if n == 2 else near_duplicates(table)).collect()
    want = components_of(texts, n)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_copies_chain(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base[: 60 - k], *(f"z{k}_{j}" for j in range(k))])) for k in range(0, 40, 3)] + [(100 + k, f"tiny {k % 3} text") for k in range(9)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == {i: c for i, (_, c) in components_of(dict(rows), 2).items()}


def test_op4(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in Q.op4_span_dedup(spark, sf_dir).collect()}
    runs = lambda ts: collections.Counter(h for t in ts for h in {tuple(w[a : a + 50]) for w in [(t or "").lower().split()] for a in range(len(w) - 49)})
    before, after = sum(n > 1 for n in runs(texts.values()).values()), sum(n > 1 for n in runs(r.text for r in rows.values()).values())
    assert set(rows) == set(texts) and before > 0 and after <= before * 0.02
    for i, r in rows.items():
        old, at, keep = (texts[i] or "").encode(), 0, b""
        for s in r.removed:
            keep, at = keep + old[at : s.start], s.stop
        assert r.text.encode() == (keep + old[at:] if not r.removed else (keep + old[at:]).rstrip(b" \t\n\r\x0b\x0c"))
        assert bool(r.removed) == (r.n_removed > 0)


def kept_whole(before, after, n=51):
    """Runs of n words that two texts shared before and still share after."""
    runs = lambda ts: collections.Counter(h for t in ts for h in {tuple(w[a : a + n]) for w in [(t or "").lower().encode().split()] for a in range(len(w) - n + 1)})
    old = runs(before)
    return [h for h, k in runs(after).items() if k > 1 and old[h] > 1]


def test_long_shared_passages(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    rows = []
    for k in range(300):
        p = words(51) if k % 3 else f"{words(k % 50 + 1)}. {words(50 - k % 50)}"
        rows += [(2 * k, f"{words(rng.integers(0, 40))} {p} {words(rng.integers(0, 40))}"), (2 * k + 1, f"{words(rng.integers(0, 40))} {p} {words(rng.integers(0, 40))}")]
    out = [r.text for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert not kept_whole([t for _, t in rows], out)


def test_long_shared_passages_of_the_table(spark, sf_dir, texts):
    assert not kept_whole(texts.values(), [r.text for r in Q.op4_span_dedup(spark, sf_dir).collect()])


def test_span_rules(spark):
    p = "Alpha beta gamma delta one two. Epsilon zeta eta theta three four. Iota kappa lambda mu five six."
    rows = [(2, f"Start here now. {p} End of it."), (1, p), (3, "Nothing shared in this one at all, my friend. Really nothing is shared."), (None, p), (4, f"{p} {p}")]
    got = {r.doc_id: r.text for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), min_words=10).collect()}
    assert got == {1: p, 2: "Start here now. End of it.", 3: rows[2][1], None: "", 4: ""}


def test_op5_and_op8_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    for name, label, threshold in (("op5_quality", "quality", 0.3), ("op8_toxicity", "toxic", 0.5)):
        labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
        rows = [r for r in Q.QUERIES[name](spark, big).collect()]
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
        hits = collections.Counter(held)
        assert (hits[0, 0] + hits[1, 1]) / len(held) > 0.97
        assert hits[1, 1] / (hits[1, 1] + hits[1, 0]) > 0.9 and hits[0, 0] / (hits[0, 0] + hits[0, 1]) > 0.85


def test_op8_against_brute_force(spark, sf_dir):
    """Every row's neighbours, cosines and score against dense cosines with all examples."""
    from fieldlark.llm.models import logistic
    from fieldlark.llm.toxicity import counts

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels)
    x = model.index
    dense = np.zeros((len(x.label), len(model.vocabulary)))
    term_of_run = np.repeat(np.arange(len(model.vocabulary)), np.diff(x.of_term))
    dense[x.example, np.repeat(term_of_run, np.diff(x.run))] = x.weight
    assert np.allclose((dense**2).sum(1), 1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in score_toxicity(docs, model).collect():
        (block,) = blocks(pa.array([texts[r.doc_id] or ""]), 1 << 30)
        _, term, times = counts(block, model.vocabulary)
        if not len(term):
            assert r.score == model.base and not r.neighbours
            continue
        w = (1 + np.log(times)) * model.weight[term]
        norm = np.sqrt((w * w).sum())
        every = dense[:, term] @ (w / norm)
        top = np.sort(every[every > 0])[::-1][: x.k]
        assert np.allclose(r.cosines, top)
        at = [int(np.flatnonzero(x.ids == i)[0]) for i in r.neighbours]
        assert np.allclose(every[at], top) and len(set(at)) == len(at)
        share = (top @ x.label[at]) / top.sum()
        assert math.isclose(r.score, logistic(np.array([[share, share * np.log1p(norm), top.mean(), np.log1p(norm)]]), model.calibration)[0], abs_tol=1e-9)


def test_op6(spark, sf_dir, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for k, x in items.items() if x in (t or "")}
    got = {(r.doc_id, r.item_id): r.distance for r in Q.op6_decontamination(spark, sf_dir).collect()}
    assert want <= set(got) and all(got[p] == 0 for p in want)
    groups = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), group_bytes=500)
    assert {(r.doc_id, r.item_id) for r in groups.collect()} == set(got)


def test_op9(spark, sf_dir, texts):
    rows = Q.op9_sharding(spark, sf_dir).collect()
    per = collections.defaultdict(list)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
        per[r.shard].append(r.slot)
    assert len(rows) == len(texts) and sorted(per) == list(range(8)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    deals = spark.range(4000).repartition(5)
    first = [r.shard for r in shard_rows(deals, shards=4, part_rows=300).where("id < 400").collect()]
    assert all(abs(n - 100) < 45 for n in collections.Counter(first).values()) and math.isclose(len(first), 400)


def test_op9_offsets_by_join(spark, monkeypatch):
    monkeypatch.setattr("fieldlark.llm.sharding.BROADCAST_PARTS", 0)
    per = collections.defaultdict(list)
    for r in shard_rows(spark.range(5000).repartition(3), shards=4, part_rows=100).collect():
        per[r.shard].append(r.slot)
    assert len(per) == 4 and all(sorted(s) == list(range(1250)) for s in per.values())


@pytest.mark.parametrize("most", [200_000, 0])  # broadcast, and shuffled lists
def test_url_list_of_many_paths_against_brute_force(spark, tmp_path, monkeypatch, most):
    import random

    from fieldlark.llm import url_filters
    from fieldlark.llm.url_filters import read_entries

    monkeypatch.setattr(url_filters, "BROADCAST_ENTRIES", most)

    r = random.Random(7)
    hosts = ["a.example.com", "example.com", "b.a.example.com", "com", "other.org"]
    paths = ["", "/", "/a", "/a/b", "/a/bc", "/b", "/ab"]
    entries = {(r.choice(hosts), r.choice(paths), f"2024-0{r.randint(1, 9)}-1{r.randint(0, 9)}"): (r.choice(["block", "allow", "end"]), "c") for _ in range(60)}
    (tmp_path / "list.csv").write_text("host,path,since,action,category\n" + "".join(f"{h},{p},{d},{a},{c}\n" for (h, p, d), (a, c) in entries.items()))
    asked = [(i, f"https://{r.choice(hosts)}{r.choice(paths)}", f"2024-0{r.randint(1, 9)}-15", i) for i in range(300)] + [(300, None, "2024-05-05", 0), (301, "https://com/a", None, 0), (302, "", "2024-05-05", 0)]
    captures = spark.createDataFrame(asked, "i int, url string, day string, path int").withColumn("fetched_on", F.col("day").cast("date"))

    def judge(url, day):
        if not url or day is None:
            return "keep", None
        host, _, path = url.removeprefix("https://").partition("/")
        path, held = ("/" + path if _ else ""), []
        for h, p in {(h, p) for h, p, _d in entries}:
            dates = [d for hh, pp, d in entries if (hh, pp) == (h, p) and d <= day]
            if dates and (host == h or host.endswith("." + h)) and path.startswith(p) and entries[h, p, max(dates)][0] != "end":
                held.append((len(h), len(p), h, p, entries[h, p, max(dates)][0]))
        best = max(held, default=None)
        return ("drop" if best and best[4] == "block" else "keep"), best and best[2] + best[3]

    got = {x.i: (x.decision, x.rule) for x in filter_urls(captures, read_entries(spark, str(tmp_path / "list.csv"))).collect()}
    assert got == {i: judge(url, day) for i, url, day, _ in asked}
