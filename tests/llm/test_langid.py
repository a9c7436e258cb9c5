import zlib

import numpy as np
import pyarrow.parquet as pq

from fieldspan.llm import langid
from fieldspan.llm.langid import DIM, GRAM, gram_vectors, grams, identify, letter_vector, op4_langid, text_vectors

SF = "/root/testdata/sf0.1"


def test_vectors_equal_brute_force(monkeypatch):
    text = "Hé, llo!  wörld x"
    s = " " + "".join(c.lower() if c.isalpha() else " " for c in text).replace("   ", " ").replace("  ", " ") + " "
    want = np.zeros(DIM)
    for i in range(len(s) - GRAM + 1):
        v = np.ones(DIM)
        for k in range(GRAM):
            v *= np.roll(letter_vector(ord(s[i + k])), GRAM - 1 - k)
        want += v
    assert (text_vectors([text, ""])[0] == want).all() and not text_vectors([""]).any()
    assert gram_vectors(grams(text)[0]).shape[1] == DIM
    long = "".join(chr(97 + i * i % 23) + (" " if i % 5 == 0 else "") for i in range(3000))
    whole = grams(long)
    monkeypatch.setattr(langid, "CHUNK", 997)
    parts = grams(long)
    assert abs(int(whole[1].sum()) - int(parts[1].sum())) <= 8


def test_held_out_accuracy(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    lang = dict(zip(t["doc_id"].to_pylist(), t["lang"].to_pylist(), strict=True))
    got = op4_langid(spark, SF).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    print("held-out accuracy", np.mean(held))
    assert np.mean(held) > 0.97


def test_odd_rows(spark):
    rows = [(i, ["le chat et la souris " * 3, "the cat and the mouse " * 3][i % 2], ["fr", "en"][i % 2], 1.0) for i in range(40)]
    rows += [(50, None, "fr", 1.0), (51, "", "fr", 1.0), (52, "123 !?", "en", 1.0), (None, "the mouse", None, 1.0), (53, "中文", "en", 1.0), (53, "中文", "en", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {}
    for r in identify(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[k][0].lang_pred for k in (50, 51, 52)] == ["und"] * 3
    assert got[None][0].lang_pred == "en" and got[0][0].lang_pred == "fr" and len(got[53]) == 2
    assert identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(df.where("lang is null")).collect()} == {"und"}
