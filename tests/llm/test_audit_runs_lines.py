"""Filter audit, periodic runs and line dedup against one-by-one versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from compare import assert_same, connect
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldlark.llm import queries as Q
from fieldlark.llm.filter_audit import audit_filters
from fieldlark.llm.line_dedup import drop_repeated_lines
from fieldlark.llm.periodic_runs import collapsed, find_runs, intern, periodic_runs, plant_periods, run_digests

WORD = re.compile("[^\x20\x09-\x0d]+")
CLASHING = "id long, part string, mask int, h string, h1 long, n long, least long, key string, line int, lines string, dropped int, holder long, runs int, n_words int, label string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd(spark, rows):
    """Rows of (doc_id, text, lang) with columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, " + CLASHING
    return spark.createDataFrame([(*r, *[None] * 15) for r in rows], schema).repartition(3)


# --- periodic runs ------------------------------------------------------------------------------------------


def runs_one_by_one(w, min_words=6, repeats=4):
    found, n = {}, len(w)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_words, repeats * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed_one_by_one(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 6)), max_size=6))
def test_runs_of_repeated_words(parts):
    w = [x for word, times, extra in parts for x in (word * (times + 1))[: len(word) * times + extra]]
    assert find_runs(np.array(w, np.int64)) == runs_one_by_one(w)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120), st.integers(1, 8), st.integers(2, 5))
def test_runs_of_two_letters(w, min_words, repeats):
    assert find_runs(np.array(w, np.int64), min_words, repeats) == runs_one_by_one(w, min_words, repeats)


def test_long_runs():
    n = 60_000
    assert find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    w = np.concatenate((np.arange(n) % 7, np.arange(n) % 9_000 + 10))
    assert find_runs(w) == [(0, n, 7), (n, n, 9_000)]
    assert find_runs(np.arange(n)) == find_runs(np.random.default_rng(1).integers(0, 50, n)) == []


def test_intern_in_pieces(monkeypatch):
    monkeypatch.setattr("fieldlark.llm.periodic_runs._PIECE", 5)
    text = "ab  cd\tef\x85x\n ab\x0b\x0ccd\r" * 20
    ids, words = intern(text.encode())
    assert [words[i].decode() for i in ids] == WORD.findall(text)
    assert collapsed(ids, words, find_runs(ids)) == "ab cd ef\x85x ab cd".encode()


def test_op12_against_one_by_one(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = Q.op12_periodic_runs(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert any(r.n_runs for r in rows)
    for r in rows:
        words = WORD.findall(texts[r.doc_id])
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_one_by_one(words)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(top or (None,) * 3))
        assert r.exponent_milli == (1000 * top[1] // top[2] if top else None)
        assert r.runs_sha256 == sha("".join(f"{a},{n},{q}\n" for a, n, q in runs))
        assert r.collapsed_sha256 == sha(collapsed_one_by_one(words, runs))


def test_runs_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t", "a"), (4, "x " * 7, "a"), (4, "x " * 7, "a"), (None, "a b " * 9, "b"), (5, "x y z " * 20_000, "b"), (6, "X x " * 4, "b")]
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs(odd(spark, rows)).collect())
    assert got == [
        (0, 18, [(0, 18, 2)], "a b"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 7, [(0, 7, 1)], "x"), (4, 7, [(0, 7, 1)], "x"),
        (5, 60_000, [(0, 60_000, 3)], "x y z"), (6, 8, [(0, 8, 2)], "X x"),
    ]
    assert periodic_runs(odd(spark, [])).count() == 0
    planted = run_digests(periodic_runs(plant_periods(odd(spark, rows + [(i, "one two three four five six seven", "c") for i in range(10, 60)]))))
    assert planted.count() == len(rows) + 50 and planted.where("runs_sha256 IS NULL OR collapsed_sha256 IS NULL").count() == 0


# --- lines --------------------------------------------------------------------------------------------------


def lines_one_by_one(rows, min_chars=40, min_docs=5):
    key = lambda line: re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    rank = lambda i: (i is not None, i or 0)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and i != max(holders[key(x)], key=rank))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def test_op13(spark, sf_dir):
    got = Q.op13_line_dedup(spark, sf_dir)
    assert_same(got, connect(sf_dir), Q.ORACLES["op13_line_dedup"])
    assert got.where("n_dropped > 0").count() > 0


@pytest.mark.parametrize("threshold, least_hot", [("10485760", 256), ("-1", 256), ("-1", 6)])
def test_lines_of_odd_rows(spark, monkeypatch, threshold, least_hot):
    monkeypatch.setattr("fieldlark.llm.line_dedup.LEAST_HOT", least_hot)
    long = "This line is shared by many, ÄÖ included, and long"
    rows = [(1, None), (2, ""), (3, f"{long}\n\nend"), (3, "another text of id three\n" + long), (3, f"{long}\n\nend"), (4, f" {long.upper().replace('Ä', 'Ä')} \r\n{long}\x0b\nx"), (5, f"a\n{long}"), (None, long), (None, f"b\n{long}"), (6, f"\t{long}\n{long}\n"), (7, long[:39] + "\n"), (8, long + "ä"), (9, long + "Ä")]
    rows += [(i, "y" * 40) for i in range(20, 24)] + [(i, "z" * 40 + "\nq") for i in range(20, 25)] + [(30, "\n".join(f"{k} " + "w" * 40 for k in range(3000))) for _ in range(2)] + [(i, "\n".join(f"{k} " + "w" * 40 for k in range(0, 3000, 2))) for i in range(31, 35)]
    random.Random(3).shuffle(rows)
    docs = odd(spark, [(i, t, None) for i, t in rows])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = drop_repeated_lines(docs, keep_columns=True)
        assert set(docs.columns) <= set(got.columns)
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == lines_one_by_one(rows)
        assert got.where(F.size("dropped") != F.col("n_dropped")).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert drop_repeated_lines(odd(spark, [])).count() == 0


# --- filter audit -------------------------------------------------------------------------------------------


def audit_one_by_one(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": text in first and (i is None or i > first[text])}
        docs.append((lang or "", {c for c, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == part]
        removed = Counter()
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                gone = [d for d in of if c in d[1] and not d[1] & set(order[:k])]
                removed[c] += len(gone)
                out[part, "".join(order), k + 1] = [sum(not d[1] & set(order[: k + 1]) for d in of), len(gone), sum(c in d[1] for d in of) - len(gone), sum(d[1] == {c} for d in of), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(removed[order[k - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_op11(spark, sf_dir):
    got = Q.op11_filter_audit(spark, sf_dir)
    assert_same(got, connect(sf_dir), Q.ORACLES["op11_filter_audit"])
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert {tuple(r) for r in got.collect()} == audit_one_by_one(docs, labels)


@pytest.mark.parametrize("least_hot", [256, 2])
def test_audit_of_odd_rows(spark, monkeypatch, least_hot):
    monkeypatch.setattr("fieldlark.llm.filter_audit.LEAST_HOT", least_hot)
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(1, None, "x"), (2, "", None), (3, "", ""), (3, "", "x"), (None, "", "x"), (None, "only here", "x"), (4, words, "x"), (5, words, None), (5, words, "y"), (6, words + " # " * 300, "y"), (7, "ABC DEF\x0bghi " * 30_000, "y"), (8, "ÄÖÜ " * 99, "y"), (9, "a\x85b c", "z")]
    labels = [(5, 1, 0), (5, None, 1), (None, 1, 1), (6, 0, 1), (99, 1, 1), (3, 1, None)]
    got = audit_filters(odd(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1)))
    assert {tuple(r) for r in got.collect()} == audit_one_by_one([(i, t, p) for i, t, p in rows], labels)
    assert got.count() == 600 * 4
    assert audit_filters(odd(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
