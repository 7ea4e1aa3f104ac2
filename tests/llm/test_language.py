import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.llm.language import bundles, gram_vectors, identify

SOUNDS = {"aa": ["ka", "lo", "mi", "ta", "no"], "bb": ["sch", "ung", "eit", "ver", "ß"], "cc": ["été", "que", "oir", "eau", "ç"]}


def sentences(lang, count, seed):
    draw = random.Random(f"{lang}{seed}")
    word = lambda: "".join(draw.choice(SOUNDS[lang]) for _ in range(draw.randint(1, 4)))
    return [" ".join(word() for _ in range(draw.randint(5, 60))).capitalize() + "." for _ in range(count)]


def slow_bundle(text, size):
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    while "  " in letters:
        letters = letters.replace("  ", " ")
    total = np.zeros(size)
    for k in range(len(letters) - 2):
        total += gram_vectors(np.array([[ord(c) for c in letters[k : k + 3]]]), size)[0]
    return total


@pytest.mark.parametrize("texts", [["One two.", "", "?? !!", "é", "x1y2 z", "ab" * 500], ["".join(chr(0x4E00 + k) for k in range(400)), "abc"]])
def test_bundles_like_slow_sums(texts):
    assert np.array_equal(bundles(texts, 64), np.stack([slow_bundle(t, 64) for t in texts]))


def test_held_out_accuracy_and_odd_texts(spark, documents):
    rows, number = [], 0
    for lang in SOUNDS:
        for text in sentences(lang, 60, 1):
            rows.append((number, text, lang))
            number += 1
    rows += [(number, None, "aa"), (number + 1, "12 34 !", "bb"), (number + 2, "kalomi", None), (number + 2, "kalomi", None), (None, sentences("cc", 1, 9)[0], None)]
    found = identify(documents(rows), train=F.coalesce(F.col("doc_id") % 4 != 2, F.lit(True))).select("doc.doc_id", "doc.lang", "doc.found", "lang_pred", "score").collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.found == "found" for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < number and r.doc_id % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    odd = {r.doc_id: (r.lang_pred, r.score) for r in found if r.doc_id is not None and r.doc_id >= number}
    assert odd[number] == odd[number + 1] == ("und", 0.0) and odd[number + 2][0] == "aa"
    assert [r.lang_pred for r in found if r.doc_id is None] == ["cc"]


def test_nothing_to_learn_from(documents):
    found = identify(documents([(1, "some text", None), (2, None, "aa")])).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    assert identify(documents([])).count() == 0
