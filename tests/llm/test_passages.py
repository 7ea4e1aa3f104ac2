import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pagegrain.llm import repeats
from pagegrain.llm.passages import _WORD, remove_repeated_passages
from tests.llm import brute


def expected(texts, threshold, words):
    """Kept bytes of each text: strings and windows looked for one by one."""
    blobs = [(t or "").encode() for t in texts]
    places = [[m.span() for m in _WORD.finditer(b)] for b in blobs]
    marks = brute.removed(blobs, threshold, False)
    by_word = brute.removed([[b[x:y] for x, y in p] for b, p in zip(blobs, places, strict=True)], words, False)
    for mark, place, gone in zip(marks, places, by_word, strict=True):
        for k in np.flatnonzero(gone):
            mark[slice(*place[k])] = True
            if k and gone[k - 1]:
                mark[place[k - 1][1] : place[k][0]] = True
    return [bytes(np.frombuffer(b, np.uint8)[~m]) for b, m in zip(blobs, marks, strict=True)]


def test_short_and_long_words(documents):
    short, long = [f"{k:x}" for k in range(12)], ["x" * 30 + str(k) for k in range(5)]
    texts = ["the  début " + " ".join(short) + " one end", "two\n" + "\t".join(short) + " é", "a " + " ".join(long) + " b", "c " + " ".join(long) + " d",
             " ".join(short[:7]) + " no", None, "", "u v w u v w"]
    found = remove_repeated_passages(documents(list(enumerate(texts))), threshold=60, words=8).select("doc.doc_id", "cut.kept").collect()
    assert [bytes(r.kept) for r in sorted(found, key=lambda r: r.doc_id)] == expected(texts, 60, 8)


def test_stage_cuts_51_short_words_and_leaves_50(spark, documents):
    words = [f"{k:02d}" for k in range(51)]
    other = [f"x{k:02d}" for k in range(50)]
    texts = ["first " + " ".join(words) + " end", "second " + " ".join(words) + " close", "third " + " ".join(other) + " end", "fourth " + " ".join(other) + " close"]
    assert all(len(t) < 400 for t in texts)
    docs = documents(list(enumerate(texts))).withColumn("n_chars", F.length("text").cast("bigint"))
    found = {r.doc_id: r for r in corpus_pipeline.repeated_strings(spark, docs, "").collect()}
    assert [found[k].text for k in range(4)] == ["first  end", "second  close", *texts[2:]]
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_empty_table(documents):
    assert remove_repeated_passages(documents([])).count() == 0


def test_the_stage_needs_one_python_worker_a_task(documents, spark):
    """A second function over the first one's result would double the workers that an executor holds from then on."""
    shared = " ".join(f"w{k}" for k in range(60))
    docs = documents([(1, f"one é{shared}"), (2, f"two {shared} é"), (3, None), (4, "")], clash=False).withColumn("n_chars", F.lit(0).cast("bigint"))
    out = corpus_pipeline.repeated_strings(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("one éw0 ", 8), 2: ("two w0  é", 9), 3: (None, None), 4: ("", 0)}


def test_runs_are_not_broadcast_by_the_size_of_their_files(documents, monkeypatch):
    plans, save = [], repeats.save

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, label)

    monkeypatch.setattr(repeats, "save", noted)
    shared = " ".join(f"w{k}" for k in range(60))
    found = remove_repeated_passages(documents([(1, f"one {shared}"), (2, f"two {shared}")]), readable=True)
    assert sum("SortMergeJoin" in plan for plan in plans) >= 10 and not any("Broadcast" in plan for plan in plans)
    assert {r.doc_id: r.kept for r in found.select("doc.doc_id", "cut.kept").collect()} == {1: "one ", 2: "two "}
