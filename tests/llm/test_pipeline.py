"""The pipeline: stage contract, and the whole run against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import corpus_pipeline as P
from tokenizers import Tokenizer

import __spark_entry__ as E
from inkmeter.llm import language, mixing, simhash_pivots as S
from inkmeter.llm.common import kept, table
from inkmeter.llm.queries import MAX_EPOCHS, tokenizer_path

SF001 = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def holds_item(text, items):
    w = words(text)
    for b in items:
        k = min(5, len(b))
        mine = Counter(tuple(b[i:i + k]) for i in range(len(b) - k + 1))
        if not mine or not any(tuple(w[i:i + k]) in mine for i in range(len(w) - k + 1)):
            continue
        for s in range(max(1, len(w) - len(b) + 1)):
            ws = w[s:s + len(b)]
            ws = Counter(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
            if sum((ws & mine).values()) >= 0.8 * sum((ws | mine).values()) > 0:
                return True
    return False


def test_stages_against_plain_python(spark):
    docs = table(spark, SF001, "documents")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    items = [words(r.text) for r in table(spark, SF001, "benchmark").collect()]
    ids = set(rows)
    for name, stage in P.STAGES[:4]:
        docs = kept(stage(spark, docs, SF001), "test-stage")
        assert docs.columns == columns, name
        got = Counter(r.doc_id for r in docs.collect())
        if name == "language_id":
            want = {k for k in ids if language.has_letter(rows[k].text)}
            assert set(got) <= want and len(got) >= 0.99 * len(want)
        elif name == "simhash_near_dedup":
            fps = [(k, S.fingerprint(rows[k].text)) for k in sorted(ids)]
            parent = {k: k for k in ids}

            def top(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i, (a, f) in enumerate(fps):
                for b, g in fps[i + 1:]:
                    if bin(f ^ g).count("1") <= 4 and top(a) != top(b):
                        lo, hi = sorted((top(a), top(b)))
                        parent[hi] = lo
            assert set(got) == {k for k in ids if top(k) == k}
        elif name == "decontamination":
            assert set(got) == {k for k in ids if not holds_item(rows[k].text, items)}
        else:
            assert set(got) == ids and max(got.values()) <= int(np.ceil(MAX_EPOCHS))
        if name != "mixing":
            assert set(got.values()) == {1}
        ids = set(got)
    before = sorted((r.doc_id, r.text) for r in docs.collect())
    library = Tokenizer.from_file(tokenizer_path())
    at, want = 0, []
    for k, text in before:
        t = np.array(library.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((k, at, len(t), zlib.crc32(t.tobytes())))
        at += len(t)
    out = P.STAGES[4][1](spark, docs, SF001).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out) == want


def test_registered(spark):
    q = E.queries()
    assert q["pipeline"] is not None and P.ORACLE_SQL is None
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in q if re.match(r"op\d+_", k)) == list(range(1, 14))
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "token_store"]


@pytest.mark.parametrize("k", range(5))
def test_stages_on_empty_tables_and_odd_rows(spark, k):
    name, stage = P.STAGES[k]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string, row string, _h string"
    empty = stage(spark, spark.createDataFrame([], schema), SF001)
    assert empty.count() == 0
    rows = [(1, None, None, None, None, "e", "r", "h"), (2, "", "en", "s", 0, "e", "r", "h"),
            (None, "the words of this text and the others", "en", "s", 5, "e", "r", "h"),
            (3, "the words of that text and the others", "en", "s", 5, "e", "r", "h"),
            (3, "the words of that text and the others", "en", "s", 5, "e", "r", "h"),
            (4, "and so on " * 20_000, "en", None, 5, "e", "r", "h")]
    df = spark.createDataFrame(rows, schema)
    out = stage(spark, df, SF001)
    got = out.collect()
    assert got and (name == "token_store" or out.columns == df.columns)
    if name == "mixing":
        assert len(got) >= len(rows)
    if name == "simhash_near_dedup":
        assert len([r for r in got if r.doc_id == 3]) <= 1
    if name == "decontamination":
        assert len(got) == len(rows)
    if name == "token_store":
        assert len(got) == len(rows)


def test_mixing_is_native(spark):
    docs = table(spark, SF001, "documents")
    assert "Python" not in mixing.mixed(docs)._jdf.queryExecution().toString()
